import numpy as np
import xxhash
from pyspark.sql import types as T

from lodeseek.llm import simhash as sh
from lodeseek.llm._graph import components


def slow(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps):
    """Smallest member reachable by links of three bits."""
    root = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if bin(a ^ b).count("1") <= 3:
                    root[i] = min(root[i], root[j])
    return root


def test_fingerprints(odd):
    got = sh.fingerprints(odd).join(odd.select("doc_id", "text").dropDuplicates(), "doc_id").collect()
    assert len(got) >= 11 and all(r["fp"] % (1 << 64) == slow(r["text"]) for r in got)


def near_set(rng, n=60):
    base = [int(x) for x in rng.integers(0, 1 << 63, 12, dtype=np.uint64)]
    out = list(base)
    while len(out) < n:
        x = out[rng.integers(len(out))]
        for b in rng.choice(64, rng.integers(1, 6), replace=False):
            x ^= 1 << int(b)
        out.append(x)
    return list(dict.fromkeys(out))


def test_no_link_is_lost(spark, monkeypatch):
    for seed, rows in ((1, 4096), (2, 4096), (3, 3)):
        monkeypatch.setattr(sh, "CELL_ROWS", rows)  # small cells take the way by blocks
        fps = near_set(np.random.default_rng(seed))
        signed = [x - (1 << 64) if x >> 63 else x for x in fps]
        roots = components(sh.links(spark.createDataFrame([(x,) for x in signed], "fp long")))
        got = {r["node"]: r["root"] for r in roots.collect()}
        want = brute(fps)
        for i in range(len(fps)):
            for j in range(i):
                assert (want[i] == want[j]) == (got.get(signed[i], signed[i]) == got.get(signed[j], signed[j]))


def test_groups(odd, clashing, none):
    for docs in (odd, clashing):
        got = {(r["doc_id"], r["fp"]): r["component_id"] for r in sh.near_groups(docs).collect()}
        by = {i: c for (i, _), c in got.items()}
        assert by[1] == by[2] == by[None] == 1 and by[3] == by[4] == by[8] == 3 and by[5] == by[10] == 5
        kept = sh.keep_one(docs)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6, 7, 9]
    assert sh.near_groups(none).collect() == [] and sh.keep_one(none).collect() == []


def test_wide_kind_finds_near_copies(spark):
    rng = np.random.default_rng(7)
    words = np.array(["".join(rng.choice(list("etaoinshr"), rng.integers(2, 8))) for _ in range(3000)])
    texts, pairs = [], []
    for i in range(120):
        t = words[rng.integers(0, 3000, 300)]
        other = t.copy()
        for at in rng.choice(300, rng.integers(1, 8), replace=False):
            other[at] = "changed" + str(at)
        a, b = ({tuple(x[k : k + 5]) for k in range(296)} for x in (t, other))
        pairs.append(len(a & b) / len(a | b) >= 0.8)
        texts += [(i, " ".join(t)), (1000 + i, " ".join(other))]
    got = {r["doc_id"]: r["component_id"] for r in sh.near_groups(spark.createDataFrame(texts, "doc_id long, text string"), sh.WIDE).collect()}
    near = [i for i, p in enumerate(pairs) if p]
    assert len(near) > 50 and sum(got[1000 + i] == i for i in near) >= 0.9 * len(near)
    assert all(got[1000 + i] in (i, 1000 + i) and got[i] == i for i in range(120))


def test_wide_kind_takes_odd_rows(odd, clashing, none):
    for docs in (odd, clashing):
        assert sh.near_groups(docs, sh.WIDE).count() == 12
        assert sorted(r["doc_id"] for r in sh.keep_one(docs, sh.WIDE).collect()) == [1, 3, 5, 6, 7, 9, 10]  # of few different shingles, two more are many
    assert sh.keep_one(none, sh.WIDE).collect() == []


def test_blocks_and_projections_follow_the_number_of_fingerprints():
    assert [sh.blocks_for(n) for n in (1, 1000, 10**6, 10**8, 10**10)] == [5, 5, 6, 7, 10]
    sizes = [sh.projections_for(n) for n in (10, 10**5, 10**7, 10**9)]
    assert sizes == sorted(sizes) and sizes[0][0] < sizes[-1][0] and sizes[0][1] < sizes[-1][1]


def test_forest_by_star():
    from lodeseek.llm._cells import forest

    rng = np.random.default_rng(5)
    for n in (2, 3, 40, 200):
        for p in (0.01, 0.1, 0.9):
            m = rng.random((n, n)) < p
            m |= m.T | np.eye(n, dtype=bool)
            root = np.arange(n)
            for _ in range(n):
                root = np.where(m, root[None, :], n).min(axis=1)
            mine = np.arange(n)
            away, to = forest(n, lambda r: m[r])
            for _ in range(n):
                np.minimum.at(mine, away, mine[to])
                np.minimum.at(mine, to, mine[away])
            assert (mine == root).all() and len(away) == n - len(set(root.tolist()))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1000), (2000, 2001), (2001, 2000)], T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {2000: 2000, 2001: 2000}


def sets_of(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_are_groups_of_exact_links(spark, monkeypatch):
    """Texts of 0.7 to 0.8 that fingerprints can't tell from near ones stay apart; groups go over several blocks."""
    import random

    monkeypatch.setattr(sh, "GROUP_ROWS", 7)
    rng = random.Random(4)
    texts = []
    for g in range(14):
        words = [f"w{rng.randrange(4000)}" for _ in range(160)]
        for k in range(6):
            own = list(words)
            for _ in range([0, 1, 2, 3, 5, 8][k]):
                own[rng.randrange(160)] = f"x{rng.randrange(9999)}"
            texts.append(" ".join(own))
    rng.shuffle(texts)
    texts += [texts[3], None, "", "one two", "One two", "one three"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [sets_of(t) for t in texts]
    root = list(range(len(texts)))
    pairs = [(i, j) for i in root for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    for _ in range(9):
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    got = {r["doc_id"]: (r["component_id"], r["stays"]) for r in sh.near_copies(docs).collect()}
    # nothing is joined that links don't join, and few links are missed by the candidates
    assert all(root[i] == root[c] for i, (c, _) in got.items())
    assert sum(got[i][0] == got[j][0] for i, j in pairs) >= 0.9 * len(pairs) and len(pairs) > 60
    assert got[len(texts) - 2][0] == len(texts) - 3 and got[len(texts) - 1][0] == len(texts) - 1 and got[len(texts) - 4][0] == len(texts) - 5
    assert {i for i, (_, stays) in got.items() if stays} == {c for c, _ in got.values()} == {r["doc_id"] for r in sh.keep_one(docs, sh.WIDE).collect()}
