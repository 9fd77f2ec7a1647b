"""Source divergence audit: how far the sources of a language lie apart in their words, and which words tell.

Groups are the (lang, source) that occur. Terms are runs of letters A-Z (lower-cased) and of characters beyond
ASCII; a language keeps those in at least LEAST of its documents. A group's share of a term is smoothed over
the kept terms and scaled to whole numbers, and all that follows is arithmetic of whole numbers.

The vocabulary is dealt to slices by a hash. A group's counts in a slice are one compressed vector that stays in
the partition of (lang, slice, group); the vectors of its peers come to it in the rounds of a round-robin tournament, as
the circle method draws them, and each meeting evaluates both directions. A partition holds its own vector and one
guest. Each keeps a heap of its best terms. PASS rounds go in one shuffle, further ones in further passes, so that disk
stays bounded whatever the number of sources.

Null texts, languages and sources count as empty. Repeated rows are documents each for themselves. A language without
a kept term has pairs of value 0 and no terms; an empty table gives no rows. Other columns are left alone.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import discard, materialise, table

LEAST, SCALE, TOP = 10, 1_000_000_000, 10
#: Terms of a slice, and counts of its groups together, at most on average; counts that a task holds before it sends them on; rounds of a pass.
WIDTH, SLICE, HELD, PASS = 512, 1 << 19, 400_000, 64
#: A-Z to a-z, other ASCII to spaces, the rest as it is.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    return text.translate(_LETTERS).split()


def counted(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, source, term, count, total (the language's) of the kept terms; a row with an empty term for each group that occurs."""
    names = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("lang", "source")]
    rows = docs.select(names[0].alias("lang"), names[1].alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times, held, n = defaultdict(Counter), defaultdict(Counter), 0

        def flush() -> Iterator[pa.RecordBatch]:
            names, of, t, n_docs = [], [], [], []
            for key, own in held.items():
                names += [key] * len(own)
                t += own
                of += [times[key][x] for x in own]
                n_docs += own.values()
            columns = [pa.array([k[i] for k in names], pa.string()) for i in (0, 1)]
            yield pa.record_batch([*columns, pa.array(t, pa.binary()), pa.array(of, pa.int64()), pa.array(n_docs, pa.int64())], names=["lang", "source", "term", "count", "docs"])

        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text")):
                own, of = held[lang, source], Counter(terms(text.as_py()))
                n -= len(own)
                own[b""] += 1
                own.update(of.keys())
                times[lang, source].update(of)
                n += len(own)
                if n > HELD:
                    yield from flush()
                    times, held, n = defaultdict(Counter), defaultdict(Counter), 0
        yield from flush()

    made = rows.mapInArrow(count, "lang string, source string, term binary, count long, docs long").withColumn("term", F.col("term").cast("string"))
    # dealt by language and term once: sums of groups and of languages follow in place
    sums = made.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    own = Window.partitionBy("lang", "term")
    kept = sums.withColumns({"total": F.sum("count").over(own), "all": F.sum("docs").over(own)}).where((F.col("term") == "") | (F.col("all") >= least))
    return kept.select("lang", "source", "term", "count", "total")


def groups(counts: DataFrame) -> DataFrame:
    """lang, source, n (occurrences of kept terms), v (kept terms of the language), m (their occurrences in it), place (from 0), size (sources of the language)."""
    term = F.col("term") != ""
    sums = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    kept = counts.where(term).select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    both = sums.join(kept, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    own = Window.partitionBy("lang")  # a row a source
    return both.withColumns({"m": F.sum("n").over(own), "place": (F.row_number().over(own.orderBy("source")) - 1).cast("int"), "size": F.count("*").over(own).cast("int")})


def share(count: np.ndarray, n: int, v: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (n + 2 * v)), three digits at a time, so that nothing overflows."""
    rest, out, whole = count + 2, np.zeros(len(count), dtype=np.int64), np.int64(n + 2 * v)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


VECTOR = "lang string, slice int, source string, place int, size int, n long, v long, m long, width int, vector binary, terms binary"


def _pack(at: list[int], counts: list[int]) -> bytes:
    return zstandard.compress(np.diff(np.array(at, dtype="<i4"), prepend=np.int32(0)).astype("<i4").tobytes() + np.array(counts, dtype="<i8").tobytes(), 1)


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.decompress(blob)
    k = len(raw) // 12
    return np.cumsum(np.frombuffer(raw[: 4 * k], dtype="<i4")), np.frombuffer(raw[4 * k :], dtype="<i8")


def vectors(counts: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each group and slice: its counts under the places of the slice's terms, and for its own partition the terms with their totals."""
    row = found.agg(F.max(F.col("v") * F.col("size")), F.max("v")).first()
    slices = max(1, -(-(row[0] or 0) // SLICE), -(-(row[1] or 0) // WIDTH))
    heads = found.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select("lang", "slice", F.lit("").alias("term"), "source", F.lit(0).cast("long").alias("count"), F.lit(0).cast("long").alias("total"), "n", "v", "m", "place", "size")
    own = counts.where("term <> ''").select("lang", F.pmod(F.xxhash64("term"), F.lit(slices)).cast("int").alias("slice"), "term", "source", "count", "total", *[F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("v", "long"), ("m", "long"), ("place", "int"), ("size", "int"))])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by slice, the groups first and then the terms in order."""
        now, info, last, width = None, {}, None, 0
        at: dict[str, list[int]] = defaultdict(list)
        times: dict[str, list[int]] = defaultdict(list)
        words: dict[str, list[tuple[str, int]]] = defaultdict(list)

        def flush() -> Iterator[pa.RecordBatch]:
            for source, (n, v, m, place, size) in info.items():
                told = zstandard.compress("\n".join(f"{t} {k}" for t, k in words[source]).encode(), 1)
                yield pa.RecordBatch.from_pylist(
                    [{"lang": now[0], "slice": now[1], "source": source, "place": place, "size": size, "n": n, "v": v, "m": m, "width": width, "vector": _pack(at[source], times[source]), "terms": told}], schema=SCHEMA
                )

        for b in batches:
            for r in zip(*[b.column(c).to_pylist() for c in ("lang", "slice", "term", "source", "count", "total", "n", "v", "m", "place", "size")]):
                if now != r[:2]:
                    yield from flush()
                    now, info, last, width = r[:2], {}, None, 0
                    at, times, words = defaultdict(list), defaultdict(list), defaultdict(list)
                term, source = r[2], r[3]
                if term == "":
                    info[source] = r[6:]
                    continue
                if term != last:
                    last, width = term, width + 1
                at[source].append(width - 1)
                times[source].append(r[4])
                words[source].append((term, r[5]))
        yield from flush()

    SCHEMA = pa.schema([("lang", pa.string()), ("slice", pa.int32()), ("source", pa.string()), ("place", pa.int32()), ("size", pa.int32()), ("n", pa.int64()), ("v", pa.int64()), ("m", pa.int64()), ("width", pa.int32()), ("vector", pa.binary()), ("terms", pa.binary())])
    return heads.unionByName(own).repartition("lang", "slice").sortWithinPartitions("lang", "slice", "term", "source").mapInArrow(number, VECTOR)


def drawn(held: DataFrame, first: int, stop: int) -> DataFrame:
    """held, and each vector as a guest of the rounds first to stop - 1: home (the place of the group that it meets), round (0 for a group at home).

    In round r of the circle method the places x and y of n (even; one may be free) meet where x + y = r modulo
    n - 1; the last place meets the x with 2 * x = r. Of two that meet, the smaller place is home where the sum of both is even, else the larger.
    """
    n = F.col("size") + F.col("size") % 2
    last = F.col("place") == n - 1
    half = F.when(F.col("round") % 2 == 0, F.expr("round div 2")).otherwise(F.expr("(round + (size + size % 2) - 1) div 2")) % (n - 1)
    other = F.when(last, half).otherwise(F.when(F.pmod(2 * F.col("place"), n - 1) == F.col("round") % (n - 1), n - 1).otherwise(F.pmod(F.col("round") - F.col("place"), n - 1)))
    each = held.where("size > 1").withColumn("round", F.explode(F.expr(f"filter(sequence({first}, {stop - 1}), r -> r < size + size % 2)")))
    guests = each.withColumn("home", other.cast("int")).where(F.col("home") < F.col("size"))
    hosts = F.when((F.col("place") + F.col("home")) % 2 == 0, F.least("place", "home")).otherwise(F.greatest("place", "home"))
    guests = guests.where(hosts == F.col("home")).withColumn("terms", F.lit(None).cast("binary"))
    return held.withColumns({"round": F.lit(0), "home": F.col("place")}).unionByName(guests)


MET = "lang string, source string, part string, item string, value long"


def meetings(held: DataFrame, first: int, stop: int, top: int) -> DataFrame:
    """lang, source, part, item, value: of each slice the pairs' values in rounds first to stop - 1, and with round 1 the groups' best terms."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = p = None
        out: list[tuple] = []
        for b in batches:
            for r in b.select(["lang", "slice", "home", "round", "source", "n", "v", "m", "width", "vector", "terms"]).to_pylist():
                at, count = _unpack(r["vector"])
                full = np.zeros(r["width"], dtype=np.int64)
                full[at] = count
                own = share(full, r["n"], r["v"]) if r["width"] else full
                if r["round"] == 0:
                    key, p, source = (r["lang"], r["slice"], r["home"]), own, r["source"]
                    if first == 1 and len(at):
                        lines = zstandard.decompress(r["terms"]).decode().split("\n")
                        names, totals = zip(*[x.rsplit(" ", 1) for x in lines])
                        q = share(np.array(totals, dtype=np.int64), r["m"], r["v"])
                        mine = own[at]
                        value, above = apart(mine, q), mine > q
                        some = np.flatnonzero(above)
                        if len(some) > top:  # ties with the last one stay until names are compared
                            some = some[value[some] >= np.partition(value[some], len(some) - top)[len(some) - top]]
                        best = heapq.nsmallest(top, ((-int(value[i]), names[i].encode(), names[i]) for i in some.tolist()))
                        out += [(r["lang"], source, "term", name, -v) for v, _, name in best]
                elif key == (r["lang"], r["slice"], r["home"]):
                    value = int(apart(p, own).sum())  # the same from either side
                    out += [(r["lang"], source, "pair", r["source"], value), (r["lang"], r["source"], "pair", source, value)]
                else:
                    raise RuntimeError("a guest without its host")
                if len(out) >= 4096:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(),) * 4 + (pa.int64(),))], names=["lang", "source", "part", "item", "value"])

    return drawn(held, first, stop).repartition("lang", "slice", "home").sortWithinPartitions("lang", "slice", "home", "round").mapInArrow(meet, MET)


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank for docs (text, lang, source).

    part "pair": each other source of the language, by how far it lies from the group; "term": the group's top terms that it has more of than its language.
    """
    counts = materialise(counted(docs, least), "term-counts")
    found = materialise(groups(counts), "groups")
    held = materialise(vectors(counts, found), "vectors")
    discard(counts)
    rounds = (found.agg(F.max("size")).first()[0] or 1) + 1  # of an even number of places, and one on
    passes = [materialise(meetings(held, k, min(k + PASS, rounds), top), "meetings") for k in range(1, max(2, rounds), PASS)]
    parts = passes[0]
    for p in passes[1:]:
        parts = parts.unionByName(p)
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    by = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), F.asc("item"))
    ranked = pairs.unionByName(parts.where("part = 'term'")).withColumn("rank", F.row_number().over(by))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts FROM documents
), e AS (SELECT i, lang, source, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM e GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM e GROUP BY ALL),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS m FROM kept GROUP BY lang),
g AS (
  SELECT o.lang, o.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) o
  LEFT JOIN (SELECT c.* FROM c JOIN kept USING (lang, term)) c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.n + 2 * l.v) AS p,
    1 + 1000000000 * (k.total + 2) // (l.m + 2 * l.v) AS q
  FROM g JOIN l USING (lang) JOIN kept k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
), best AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM best))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""
