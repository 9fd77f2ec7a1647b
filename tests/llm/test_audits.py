"""The source mix, the source divergence audit and the filter audit against plain Python on small fixtures."""

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import permutations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeseek.llm import _common, divergence, filter_audit, source_mix

from .conftest import SCHEMA

LABELS = "doc_id long, quality int, toxic int"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def many(spark, n=400, sources=7):
    """Documents whose sources and languages differ in size; the first source holds a third and some have no name."""
    rows = []
    for i in range(n):
        source = "s0" if i % 3 == 0 else None if i % 11 == 0 else f"s{i % sources}"
        text = " ".join(f"w{(i * k) % 23} Tail{k % 5}" for k in range(1, 2 + i % 29)) if i % 17 else [None, "", " \n"][i % 3]
        rows.append((i, text, ["xx", "yy", None, ""][i % 4 if i % 5 else 0], source, 0))
    return spark.createDataFrame(rows, SCHEMA)


# source mix


def shares(sizes, weights, share, most):
    """Targets by resharing until none is above its cap, in exact fractions."""
    total, stopped = Fraction(share) * sum(sizes), set()
    while True:
        left = total - sum(most * sizes[i] for i in stopped)
        rest = sum(w for i, w in enumerate(weights) if i not in stopped)
        level = left / rest if rest else Fraction(0)
        more = {i for i in range(len(sizes)) if i not in stopped and level * weights[i] > most * sizes[i]}
        if not more:
            return [most * s if i in stopped else level * weights[i] for i, s in enumerate(sizes)]
        stopped |= more


@pytest.mark.parametrize(("weights", "share", "most", "block"), [((3, 1, 2), 1.5, 2, 16), ((1, 5), 0.25, 1, 7), ((1,), 2.0, 2, 1000)])
def test_a_mix_is_what_its_schedule_says(spark, weights, share, most, block):
    docs = many(spark)
    made = source_mix.mix(docs, weights, share, most, block)
    rows = {r["doc_id"]: r for r in made.taken().collect()}
    texts = {r["doc_id"]: (r["source"], words(r["text"])) for r in docs.collect()}
    names = sorted({s for s, _ in texts.values()}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len(w) for s, w in texts.values() if s == name) for name in names]
    aims = shares(sizes, [weights[i % len(weights)] for i in range(len(names))], share, most)
    # plain: shuffled by digest, as many whole passes as fit and a part of one more
    for name, size, aim in zip(names, sizes, aims):
        own = sorted((hashlib.md5(f"{i}:mix".encode()).hexdigest(), i) for i, (s, _) in texts.items() if s == name)
        t, at = int(aim + Fraction(1, 2)), 0
        for _, i in own:
            n = len(texts[i][1])
            want = t // size * n + max(0, min(n, t % size - at)) if size else 0
            assert (rows[i]["size"], rows[i]["source_size"], rows[i]["taken"]) == (n, size, want) and rows[i]["taken"] <= most * n
            assert rows[i]["target"] == pytest.approx(float(aim))
            at += n
    # the schedule: slots without gaps, each one source's; early parts of it hold the sources by their shares
    slots = sorted((r.asDict() for r in made.slots.collect()), key=lambda r: r["slot"])
    assert [r["slot"] for r in slots] == list(range(len(slots)))
    takes = Counter()
    for r in slots:
        assert r["take"] == takes[r["src"]]
        takes[r["src"]] += 1
    for k in (len(slots) // 4, len(slots) // 2):
        early = Counter(r["src"] for r in slots[:k])
        for src, n in takes.items():
            assert abs(early[src] - n * k / len(slots)) <= 3 + len(slots).bit_length() / 2
    # pieces of a slot lie end to end, and the words are the documents'
    said = {r["slot"]: r["text"].split(" ") for r in made.texts(docs).collect()}
    parts = defaultdict(list)
    for r in made.rows().collect():
        parts[r["slot"]].append((r["offset"], texts[r["doc_id"]][1][r["start"] : r["start"] + r["words"]]))
    for slot, own in parts.items():
        flat = [w for _, p in sorted(own) for w in p]
        assert [o for o, _ in sorted(own)] == [sum(len(p) for _, p in sorted(own)[:k]) for k in range(len(own))] and len(flat) <= block
        assert said[slot] == flat
    assert set(said) == set(parts) == {r["slot"] for r in slots}


def test_a_mix_runs_again_alike_on_other_partitions(spark):
    docs = many(spark)
    first = source_mix.mix(docs).taken().select("doc_id", "taken").collect()
    again = source_mix.mix(docs.repartition(7, "text")).taken().select("doc_id", "taken").collect()
    assert sorted(first) == sorted(again)


def test_a_mix_of_odd_rows(odd, none, clashing):
    rows = source_mix.mix(odd).taken().collect()
    assert len(rows) == odd.count() and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert sum(r["taken"] for r in rows) == sum(round(t) for t in {r["src"]: r["target"] for r in rows}.values())
    assert source_mix.mix(none).taken().count() == 0 and source_mix.mix(none).texts(none).count() == 0
    pick = lambda df: sorted(map(repr, source_mix.mix(df).taken().select("doc_id", "size", "target", "taken").collect()))
    assert pick(clashing) == pick(odd)
    with pytest.raises(ValueError):
        source_mix.mix(none, weights=(0,))


def test_ranks_count_reversed_bits(spark):
    bits, first, n = 7, 19, 60
    rev = lambda v: int(f"{v:0{bits}b}"[::-1], 2)
    rows = spark.range(first, first + n).select("id", source_mix.rank(F.col("id"), F.lit(first).cast("long"), F.lit(n).cast("long"), bits).alias("r")).collect()
    assert all(r["r"] == sum(rev(x) < rev(r["id"]) for x in range(first, first + n)) for r in rows)


def test_running_sums_and_places_go_level_by_level(spark):
    rows = _common.materialise(spark.range(500).select((F.col("id") % 2).alias("k"), F.expr("id div 2").alias("p"), (F.col("id") % 7).alias("v")), "t")
    for fan in (1000, 10, 3):
        for r in _common.before(rows, ["k"], "p", "v", 250, "b", fan).collect():
            assert r["b"] == sum((2 * p + r["k"]) % 7 for p in range(r["p"]))
    got = _common.numbered(spark.range(300).select(F.xxhash64("id").alias("h")), [F.col("h")], "at").collect()
    assert [r["h"] for r in sorted(got, key=lambda r: r["at"])] == sorted(r["h"] for r in got) and {r["at"] for r in got} == set(range(300))


# divergence


def diverged(rows, least, top):
    """The audit in plain Python, with whole numbers."""
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    times, seen, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, ts = lang or "", source or "", terms(text)
        groups.add((lang, source))
        times[lang, source].update(ts)
        seen[lang].update(set(ts))
    out = []
    for lang, source in groups:
        kept = [t for t, n in seen[lang].items() if n >= least]
        def share(n, kept=kept):
            whole = sum(n[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (n[t] + 2) // whole for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = share(times[lang, source]), share(sum((times[g] for g in groups if g[0] == lang), Counter()))
        pairs = []
        for _, other in (g for g in groups if g[0] == lang and g[1] != source):
            o = share(times[lang, other])
            pairs.append((sum(f(p[t], o[t]) for t in kept), other))
        best = [(f(p[t], q[t]), t) for t in kept if times[lang, source][t] and p[t] > q[t]]
        for part, found, n in (("pair", pairs, None), ("term", best, top)):
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:n], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize("passes", [1, 3, 64])
def test_divergence(spark, monkeypatch, passes):
    """An odd and an even number of sources, a language without kept terms, slices of a few terms, several passes."""
    monkeypatch.setattr(divergence, "PASS", passes)
    monkeypatch.setattr(divergence, "WIDTH", 8)
    monkeypatch.setattr(divergence, "HELD", 50)
    rows = [("xx", f"s{i % 6}" if i % 4 else None, " ".join(["été", "Ünder_the", "naïve", f"Word{chr(97 + i % 9)}", "tie", "eit", *["漢字"] * (i % 3), f"b{chr(97 + i % 5)}"][i % 4 :])) for i in range(160)]
    rows += [(None, "only", "alone here"), ("zz", "a", None), ("zz", "b", "rare"), ("yy", "p", "same same"), ("yy", "q", "same other same")] * 4
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = sorted(tuple(r) for r in divergence.audit(docs, least=3, top=4).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == diverged(rows, 3, 4)


def test_divergence_of_odd_rows(odd, none, clashing):
    assert divergence.audit(none).count() == 0
    got = sorted(tuple(r) for r in divergence.audit(odd).collect())
    assert got == diverged([(r["lang"], r["source"], r["text"]) for r in odd.collect()], 10, 10)
    assert got == sorted(tuple(r) for r in divergence.audit(clashing).collect())


def test_shares_of_large_counts_are_exact():
    import numpy as np

    for count, n, v in ((10**13, 10**13, 1), (7 * 10**12, 3 * 10**13, 10**9), (0, 10**14, 5)):
        assert divergence.share(np.array([count]), n, v).tolist() == [1 + 10**9 * (count + 2) // (n + 2 * v)]


# filter audit


def audited(docs, labels):
    """Every order, one document after the other."""
    fails = {}
    for k, (doc_id, text, _) in enumerate(docs):
        t, w = text or "", words(text)
        key = lambda i: (i is not None, i or 0)
        own = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search("[#$%&*|]", t))
        fails[k] = own + "E" * any((o or "") == t and key(i) < key(doc_id) for i, o, _ in docs)
    marks = {i: (any(q == 1 for j, q, _ in labels if i == j), any(x == 1 for j, _, x in labels if i == j)) for i, _, _ in docs}
    out = {}
    for part in {p or "" for _, _, p in docs}:
        own = [(fails[k], *marks[d[0]]) for k, d in enumerate(docs) if (d[2] or "") == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left, gone = own, []
            for step, f in enumerate(order, 1):
                removed = [x for x in left if f in x[0]]
                redundant = sum(f in x[0] for x in gone)
                left, gone = [x for x in left if f not in x[0]], gone + removed
                shapley[f] += len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), redundant, sum(x[0] == f for x in own), sum(x[1] for x in removed), sum(x[2] for x in removed)]
        for (p, order, step), r in out.items():
            if p == part:
                r.append(shapley[order[step - 1]])
    return out


def held(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


@pytest.mark.parametrize("parts", [1, 40])
def test_filter_audit(spark, monkeypatch, parts):
    """Groups of copies that go over many partitions, labels that say both, a document with two labels."""
    monkeypatch.setattr(filter_audit, "materialise", _common.materialise)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        texts = ["same text here", "W " * 300, "a b c d & e", " ".join(f"w{k}" for k in range(250)), "", None, "ÄÖÜ été", "LOUD one"]
        docs = [(i * 7 % 200, texts[i % 3 if i % 2 else i % 8], ["xx", None, "yy", ""][i % 4]) for i in range(200)] + [(7, texts[0], "xx"), (None, texts[0], "xx"), (None, texts[3], "yy")]
        labels = [(i, i % 2, (i // 2) % 2) for i in range(0, 150, 3)] + [(3, 1, 1), (None, 1, 1)]
        got = held(filter_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, LABELS)))
        want = audited(docs, [x for x in labels if x[0] is not None])
        assert len(got) == 600 * 3 and got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_texts_of_one_fingerprint_are_told_apart(spark, monkeypatch):
    """Full texts decide, whatever the fingerprint."""
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    docs = [(i, ["one", "two", "three"][i * i % 3], "xx") for i in range(30)]
    masked = filter_audit.masks(spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)).collect()
    firsts = {min(i for i, t, _ in docs if t == x) for x in {t for _, t, _ in docs}}
    assert {r["doc_id"] for r in masked if not r["mask"] & 16} == firsts


def test_filter_audit_of_odd_rows(spark, odd, none, clashing):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 1)], LABELS)
    got = held(filter_audit.audit(odd, labels))
    assert got == audited([(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()], [(1, 1, 0), (5, 1, 1)])
    assert held(filter_audit.audit(clashing, labels)) == got
    assert filter_audit.audit(none, labels).count() == 0 and held(filter_audit.audit(odd, labels.limit(0)))["en", "ABCDE", 1][4] == 0
