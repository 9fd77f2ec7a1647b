import hashlib
import math
import random

import numpy as np

from lodeseek.llm import edit_embedding as ee
from lodeseek.llm import nbsvm, substring_dedup, suffix_tree

from .conftest import ROWS


def brute_removed(rows):
    """Spans by a plain pass over all units in rank order."""
    keyed = sorted({(i is None, i or 0, k, t) for i, k, t in rows})
    seen, out = set(), {}
    for none, i, k, t in keyed:
        gone = []
        for place, digest in sorted(substring_dedup.units(t)):
            if digest in seen:
                gone.append(place)
            seen.add(digest)
        out[k] = gone
    return out


def test_substring_dedup(spark, odd, clashing, none):
    passage = " ".join(f"Sentence {i} says something of its own here." for i in range(9))
    line = "This boilerplate line stands in many documents"
    docs = spark.createDataFrame(
        [(1, f"Start one. {passage} End one.", "x"), (2, f"{line}\nSecond text begins. {passage} And ends.", "x"), (3, f"Own words.\n{line}\nMore own words.", "x"), (4, f"{passage}", "x"), (None, line, "x"), (5, None, "x")],
        "doc_id long, text string, place string",
    )
    got = {r["doc_id"]: r for r in substring_dedup.dedup(docs).collect()}
    assert got[1]["text"] == f"Start one. {passage} End one."
    assert passage[10:] not in got[2]["text"] and line in got[2]["text"] and "Second text begins." in got[2]["text"] and "And ends." in got[2]["text"]
    assert got[3]["text"] == "Own words.\nMore own words." and got[4]["text"] == "" and got[None]["text"] == "" and got[5]["text"] == ""
    for r in docs.collect():
        t, spans = r["text"] or "", got[r["doc_id"]]["__spans"]
        at, kept = 0, ""
        for s in spans:
            kept, at = kept + t[at : s["start"]], s["stop"]
        assert kept + t[at:] == got[r["doc_id"]]["text"]
    for docs in (odd, clashing):
        out = substring_dedup.dedup(docs)
        assert out.columns[:-1] == docs.columns and out.columns[-1].startswith("__spans") and out.count() == len(ROWS)
        assert "__key" not in docs.columns or {r["__key"] for r in out.collect()} == {"x"}
    assert substring_dedup.dedup(none).collect() == []


def test_units_against_brute_force(spark):
    rng = random.Random(4)
    pool = [" ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randrange(1, 12))) + rng.choice([". ", "\n", "! "]) for _ in range(40)]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randrange(0, 30)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keys = {r["doc_id"]: r["k"] for r in docs.select("doc_id", substring_dedup.row_key().alias("k")).collect()}
    want = {k: g for k, g in brute_removed([(i, keys[i], t) for i, t in rows]).items() if g}
    assert {r["row_key"]: sorted(r["places"]) for r in substring_dedup.removed(docs).collect()} == want


def test_edit_embedding(odd, none):
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8))) for _ in range(900))
    other = " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8))) for _ in range(900))
    a = ee.fingerprint(text)
    assert a == ee.fingerprint(text) and ee.likeness(a, a) == 1
    assert ee.likeness(a, ee.fingerprint(text[:2000] + "zz" + text[2001:])) > 0.8
    assert 0.6 < ee.likeness(a, ee.fingerprint(text[: 2 * len(text) // 3] + other[: len(text) // 3])) < 0.85
    assert ee.likeness(a, ee.fingerprint(other)) < 0.3
    assert ee.fingerprint("") == "0.0." and ee.likeness("0.0.", a) == 0
    w = ee.Walk(text)
    assert ee.Walk(text[:500] + other[:50], w, 500).fingerprint() == ee.fingerprint(text[:500] + other[:50])
    assert ee.edited(none).collect() == []


def test_likeness_follows_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(21)
    steps = []
    for _ in range(25):
        text = "".join(rng.choice("etaoin shrdlu") for _ in range(400))
        found = []
        for edits in (2, 15, 60):
            t = list(text)
            for _ in range(edits):
                at = rng.randrange(len(t))
                kind = rng.randrange(3)
                t[at : at + (kind != 0)] = [] if kind == 1 else [rng.choice("etaoin shrdlu")]
            found.append((distance(text, "".join(t)), ee.likeness(ee.fingerprint(text), ee.fingerprint("".join(t)))))
        assert [d for d, _ in found] == sorted(d for d, _ in found)
        steps.append([x for _, x in found])
    few, some, many = (sum(x) / len(steps) for x in zip(*steps))
    assert few > some + 0.1 and some > many + 0.1 and sum(x[0] > x[2] for x in steps) >= 0.95 * len(steps)


def test_edited_rows_follow_descending_ids(spark):
    rng = random.Random(6)
    rows = [(i, None if i % 11 == 0 else "".join(rng.choice("abc déf") for _ in range(rng.randrange(0, 60)))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for ranges in (1, 7, 64):
        got = {r["doc_id"]: r for r in ee.edited(docs, ranges).collect()}
        assert len(got) == 200
        texts = dict(rows)
        for i in range(200):
            t, n = texts[i] or "", texts[i - 1 if i else 199] or ""
            k = len(t) // 3
            want = t[: len(t) - k] + n[:k]
            assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
            assert got[i]["fingerprint"] == ee.fingerprint(t) and got[i]["edited_fingerprint"] == ee.fingerprint(want)
            assert got[i]["near_next"] == ee.likeness(ee.fingerprint(t), ee.fingerprint(n))


def test_edited_takes_odd_rows(odd, clashing):
    for docs in (odd, clashing):
        assert ee.edited(docs).count() == len(ROWS)


def test_near_groups(spark, odd, none):
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(60, 900))) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t[:40] + "qq" + t[41:]) for i, t in enumerate(texts)] + [(200 + i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in ee.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 90 and all(got[200 + i]["class_id"] == i == got[200 + i]["group_id"] for i in range(30))
    assert sum(got[100 + i]["group_id"] == i for i in range(30)) >= 27
    assert ee.near_groups(odd).count() == len(ROWS) and ee.near_groups(none).collect() == []


def test_quality_on_held_out_rows(spark, sf_dir, none):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = nbsvm.op9_quality(spark, sf_dir)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"] and found.count() == docs.count()
    held = found.join(labels, "doc_id").where("held_out").collect()
    up, down = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert sum((a > b) + (a == b) / 2 for a in up for b in down) >= 0.97 * len(up) * len(down) > 0  # area under the curve
    assert sum(r["predicted"] == r["quality"] for r in held) >= 0.95 * len(held) and len(held) > 5
    model = nbsvm.train(docs, labels)
    assert model.weight.any() and nbsvm.score(none, model).collect() == []
    assert nbsvm.train(none, labels).score("x") == 0.5


def test_quality_takes_odd_rows(spark, odd, clashing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, None), (6, None, 1), (7, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for docs in (odd, clashing):
        got = nbsvm.score(docs, nbsvm.train(docs, labels), "own").collect()
        assert len(got) == len(ROWS) and all(0 <= r["own"] <= 1 for r in got)
        assert nbsvm.keep(docs, labels).columns == docs.columns


def test_words_are_read_whole():
    a, b = "x" * 5000 + "9", "x" * 5000 + "-"
    assert nbsvm._shape(a) != nbsvm._shape(b) and nbsvm._shape("a9" * 40) != nbsvm._shape("a9" * 41)


def test_sample_is_bounded_in_bytes(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(nbsvm, "fit", lambda rows, y: seen.append(sum(4 * len(r) for r in rows)))
    tables = [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")]
    for most in (10**9, 20_000):
        monkeypatch.setattr(nbsvm, "SAMPLE_BYTES", most)
        nbsvm.train(*tables)
    assert seen[0] > 20_000 >= seen[1] > 0


def test_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(50, 8, replace=False) + (0 if k % 2 else 40)).astype(np.int32) for k in range(200)]
    y = np.array([1 if k % 2 else -1 for k in range(200)])
    m = nbsvm.fit(rows, y, 128)
    assert np.mean([(m.margin(f) > 0) == (c > 0) for f, c in zip(rows, y)]) > 0.95


def corpus():
    rng = random.Random(8)
    common = [f"w{i}" for i in range(12)]
    rows = []
    for i in range(150):
        t = [rng.choice(common) for _ in range(40)]
        if i % 3 == 0:
            t[5:5] = "the quick brown fox jumps over it".split()
        if i % 4 == 0:
            t.append(f"rare{i}")
        rows.append((i, " ".join(t).replace("quick", "QUICK")))
    return rows + [(150, ""), (151, None)]


def test_suffix_tree_counts_and_sums_to_one(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = [(i, t) for i, t in rows if i % 2]
    tree, counts = suffix_tree.learn(docs.where("doc_id % 2 = 1").select("text"))
    want = {}
    for _, t in train:
        for w in [*suffix_tree.words(t or ""), b""]:
            want[w] = want.get(w, 0) + 1
    assert {bytes(r["word"]): r["n"] for r in counts.collect()} == want
    n, v = sum(want.values()), len(want)
    assert (tree.n, tree.v) == (n, v) and len(tree.levels) == suffix_tree.DEPTH and any(x.kept.any() for x in tree.levels)
    got = {r["doc_id"]: r for r in suffix_tree.score(docs, tree, counts).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        ws = [*suffix_tree.words(t or ""), b""]
        base = sum(math.log10((want.get(w, 0) + 1) / (n + v + 1)) for w in ws)
        assert got[i]["n_tokens"] == len(ws) and got[i]["n_known"] == sum(w in want for w in ws) and abs(got[i]["base_score"] - base) < 1e-6
    # each state's probabilities, over the known words and the unknown one, sum to 1
    ids = np.arange(len(tree.counts))
    root = np.append(tree.root(tree.counts), tree.root(np.zeros(1)))
    for history in ([b"the"], [b"the", b"quick"], [b"w1", b"the", b"quick"], [b"w1"], [b"zzz"]):
        h = [tree.ids[w] for w in history]
        seqs = np.concatenate([np.append(h, x) for x in [*ids, -1]]).astype(np.int64)
        rest = np.zeros(len(seqs))
        rest[len(h) :: len(h) + 1] = root
        one = tree.score(seqs, np.arange(0, len(seqs), len(h) + 1), rest)[len(h) :: len(h) + 1]
        assert abs((10**one).sum() - 1) < 1e-9
    held = [i for i, _ in rows if i % 2 == 0]
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)


def test_suffix_tree_counts_pairs_exactly(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tree, _ = suffix_tree.learn(docs.select("text"))
    word = {i: w for w, i in tree.ids.items()}
    seen = {}
    for _, t in rows:
        ws = [*suffix_tree.words(t or ""), b""]
        for a, b, c in zip(ws, ws[1:], ws[2:]):
            seen[a, b, c] = seen.get((a, b, c), 0) + 1
    mask = (1 << suffix_tree.WORD_BITS) - 1
    for key, n in zip(tree.levels[2].keys.tolist(), tree.levels[2].count.tolist()):
        pair = tree.levels[1].keys[key >> suffix_tree.WORD_BITS]
        gram = (word[tree.levels[0].keys[pair >> suffix_tree.WORD_BITS]], word[pair & mask], word[key & mask])
        assert seen[gram] == n


def plain_tree(rows, depth, discount):
    """Counts, retained contexts and a scorer by the rules of the module's text, over tuples of words."""
    texts = [[*suffix_tree.words(t or ""), b""] for _, t in rows]
    word = {}
    for ws in texts:
        for w in ws:
            word[w] = word.get(w, 0) + 1
    n, v = sum(word.values()), len(word)
    d = (sum(c == 1 for c in word.values()) + 0.5) / (v + 1)
    root = lambda w: math.log10((word[w] - d if w in word else d * v) / n)
    grams = {}
    for ws in texts:
        for k in range(2, depth + 2):
            for i in range(len(ws) - k + 1):
                g = tuple(ws[i : i + k])
                grams[g] = grams.get(g, 0) + 1
    contexts = [{(w,): c for w, c in word.items() if c >= 2 and w != b""}]
    own = []
    for k in range(1, depth + 1):
        own.append({c: {g[-1]: m for g, m in grams.items() if len(g) == k + 1 and m >= 2 and g[:-1] == c} for c in contexts[-1]})
        contexts.append({c + (x,): m for c, nexts in own[-1].items() for x, m in nexts.items() if x != b""})
    chance, backoff, kept = {}, {}, set()
    for k in range(depth):
        for c, nexts in own[k].items():
            p = {x: (m - discount) / contexts[k][c] for x, m in nexts.items()}
            q = {x: 10 ** root(x) if k == 0 else chance[c[1:]][x] for x in nexts}
            rest_p, rest_q = max(1 - sum(p.values()), 1e-12), max(1 - sum(q.values()), 1e-12)
            gain = sum(p[x] * math.log(p[x] / q[x]) for x in p) + rest_p * math.log(rest_p / rest_q)
            chance[c], backoff[c] = p, math.log10(rest_p / rest_q)
            if nexts and contexts[k][c] * gain >= 0.5 * len(nexts) * math.log(n):
                kept |= {c[i:] for i in range(len(c))}

    def score(ws):
        total = 0.0
        for i, w in enumerate(ws):
            for k in range(min(depth, i), 0, -1):
                c = tuple(ws[i - k : i])
                if c in kept:
                    if w in chance[c]:
                        total += math.log10(chance[c][w])
                        break
                    total += backoff[c]
            else:
                total += root(w)
        return total

    return kept, score


def test_suffix_tree_against_plain_python(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = [(i, t) for i, t in rows if i % 2]
    tree, counts = suffix_tree.learn(docs.where("doc_id % 2 = 1").select("text"))
    kept, score = plain_tree(train, suffix_tree.DEPTH, suffix_tree.DISCOUNT)
    name, mask = {i: w for w, i in tree.ids.items()}, (1 << suffix_tree.WORD_BITS) - 1
    grams, got = [[(name[k],) for k in tree.levels[0].keys.tolist()]], set()
    for level in tree.levels[1:]:
        grams.append([grams[-1][k >> suffix_tree.WORD_BITS] + (name[k & mask],) for k in level.keys.tolist()])
    for level, own in zip(tree.levels, grams):
        got |= {g for g, k in zip(own, level.kept.tolist()) if k}
    assert got == kept and {len(g) for g in kept} == {1, 2, 3}
    for r in suffix_tree.score(docs, tree, counts).collect():
        assert abs(r["score"] - score([*suffix_tree.words(dict(rows)[r["doc_id"]] or ""), b""])) < 1e-6


def test_suffix_tree_takes_odd_rows(odd, clashing, none):
    for docs in (odd, clashing):
        tree, counts = suffix_tree.learn(docs.select("text").na.fill(""))
        got = suffix_tree.score(docs, tree, counts).collect()
        assert len(got) == len(ROWS) and all(math.isfinite(r["score"]) for r in got)
    tree, counts = suffix_tree.learn(none.select("text"))
    assert all(r["score"] == 0 and r["base_score"] == 0 for r in suffix_tree.score(odd, tree, counts).collect())
    assert suffix_tree.score(none, tree, counts).collect() == []
