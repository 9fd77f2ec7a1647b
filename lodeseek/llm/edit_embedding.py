"""Document fingerprints by a randomised edit embedding.

A walk reads a text: at step j it stands at some character and writes it down; a random bit,
shared by all texts and given by j and the character, says whether it goes on to the next
character. After an edit two walks soon meet again, so that a small edit distance becomes a
small Hamming distance of what the walks wrote. A fingerprint samples the written string at
positions whose hash has at least some number of trailing zeros: the smallest number that leaves
at most 2 * SAMPLES positions. Texts of different lengths so share positions, and the samples of
a coarser level are among those of a finer one. A sample is four bits of the character's hash.

fingerprint: number of characters, level and samples, as "<n>.<level>.<hex digits>". The empty
text's is "0.0.".
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._cells import forest, groups, parted
from ._common import lookup, materialise, table, text_of
from ._graph import components

SAMPLES, PERIOD, CLASSES = 256, 4096, 64
#: Bytes of text that a task of edited() gets.
TASK_BYTES = 64_000_000
#: Ranges of doc_id at most: a row each comes to the driver, whatever the input's size; beyond 4 TB partitions grow instead.
RANGES = 1 << 19


def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x.astype(np.uint64) + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _advance() -> list[int]:
    """At [class * PERIOD + j mod PERIOD]: steps until the walk leaves a character of the class that it meets at step j."""
    bit = _mixed(np.arange(CLASSES * PERIOD), 11).reshape(CLASSES, PERIOD) & np.uint64(1)
    out = np.zeros((CLASSES, PERIOD), dtype=np.int64)
    for c in range(CLASSES):
        ones = np.flatnonzero(bit[c])
        ones = np.append(ones, ones[0] + PERIOD)
        j = np.arange(PERIOD)
        out[c] = ones[np.searchsorted(ones, j)] - j + 1
    return out.ravel().tolist()


_positions: dict[int, tuple[int, np.ndarray]] = {}


def positions(steps: int, level: int) -> np.ndarray:
    """Sampled positions below steps."""
    size, found = _positions.get(level, (0, np.zeros(0, np.int64)))
    if size < steps:
        size = max(1 << 16, 1 << (steps - 1).bit_length())
        found = np.concatenate([at + np.flatnonzero(_mixed(np.arange(at, min(at + (1 << 20), size)), 5) & np.uint64((1 << level) - 1) == 0) for at in range(0, size, 1 << 20)])
        _positions[level] = (size, found)
    return found[: np.searchsorted(found, steps)]


def first_positions(count: int, level: int) -> np.ndarray:
    """The first sampled positions of a level."""
    steps = max(1, count) << level
    while len(found := positions(steps, level)) < count:
        steps *= 2
    return found[:count]


def level_of(steps: int) -> int:
    level = 0
    while steps >> level > SAMPLES:
        level += 1
    while level < 60 and len(positions(steps, level)) > 2 * SAMPLES:
        level += 1
    return level


class Walk:
    """The walk over a text: steps[i] is the step at which it meets character i."""

    def __init__(self, text: str, before: "Walk | None" = None, take: int = 0):
        """before, take: the text starts with the first take characters of before's, whose walk is used again."""
        own = text[take:] if before else text
        code = np.frombuffer(own.encode("utf-32-le", "replace"), dtype="<u4")
        mixed = _mixed(code, 3)
        adv, m = _advance(), PERIOD - 1
        j = int(before.steps[take]) if before else 0
        classes = ((mixed & np.uint64(CLASSES - 1)) * np.uint64(PERIOD)).astype(np.int64).tolist()
        met = [j] + [j := j + adv[c + (j & m)] for c in classes]
        nibbles = ((mixed >> np.uint64(32)) & np.uint64(15)).astype(np.uint8)
        self.steps = np.array(met, dtype=np.int64)
        self.nibbles = nibbles
        if before:
            self.steps = np.concatenate([before.steps[:take], self.steps])
            self.nibbles = np.concatenate([before.nibbles[:take], nibbles])

    def fingerprint(self) -> str:
        n = len(self.nibbles)
        if not n:
            return "0.0."
        end = int(self.steps[-1])  # what a slow walk writes last is sampled as well
        level = level_of(end)
        got = self.nibbles[np.searchsorted(self.steps, positions(end, level), side="right") - 1]
        return f"{n}.{level}." + "".join(map("0123456789abcdef".__getitem__, got.tolist()))


def fingerprint(text: str) -> str:
    return Walk(text).fingerprint()


def _at_level(fp: str, level: int) -> tuple[np.ndarray, np.ndarray]:
    _, own, digits = fp.split(".")
    value = np.frombuffer(digits.encode(), dtype=np.uint8)
    where = first_positions(len(value), int(own))
    stay = _mixed(where, 5) & np.uint64((1 << level) - 1) == 0
    return where[stay], value[stay]


def likeness(a: str, b: str) -> float:
    """Share of the sampled positions of either text at which both wrote the same; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    level = max(int(a.split(".")[1]), int(b.split(".")[1]))
    (pa_, va), (pb, vb) = _at_level(a, level), _at_level(b, level)
    both = min(len(pa_), len(pb))
    return float((va[:both] == vb[:both]).sum() / max(1, len(pa_), len(pb)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint for each row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(map(fingerprint, texts), pa.string())], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


BANDS, BAND, CELL_ROWS = 24, 6, 1024
#: Ratio of the ranges whose positions are banded.
RANGE = 1.25


@lru_cache(maxsize=1024)
def _bands(level: int, size: int) -> np.ndarray:
    """BANDS sets of BAND of the first size positions of a level, by hash; a position is in as few of them as possible."""
    order = [np.argsort(_mixed(np.arange(size), 77 + (level << 40) + (k << 20)), kind="stable")[: size // BAND * BAND] for k in range(-(-BANDS // (size // BAND)))]
    found = np.sort(np.concatenate(order).reshape(-1, BAND)[:BANDS], axis=1)
    return np.unique(found, axis=0)


def _ranges(m: int, least: float) -> list[int]:
    """The largest ranges of at most m positions; of m and least * m or more positions two texts have one in common."""
    sizes = []
    while (size := math.ceil(BAND * RANGE ** len(sizes))) <= m:
        sizes.append(size)
    return sizes[-1 - math.ceil(math.log(1 / least, RANGE) - 1e-9) :]


def near_groups(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, fingerprint, class_id, group_id for each row: near-duplicates by bit-sampled banding and verification.

    class_id is the smallest doc_id with the fingerprint. A band is BAND samples at
    positions that a level and a range of its first positions give, so that longer texts band alike;
    each class is banded at its own level and the next coarser one, in the largest ranges it fills. Classes that
    share a band are linked if at the band's level their likeness is least or more; group_id is the
    smallest doc_id that links reach. Every two classes of a band are compared; a band yields a
    spanning forest. Fingerprints without any doc_id have null ids; the empty text has no band.
    """
    members = materialise(fingerprints(docs), "edit-fingerprints")
    classes = materialise(members.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id")), "edit-classes")

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for fp in b.column("fingerprint").to_pylist():
                own = int(fp.split(".")[1])
                for level in (own, own + 1):
                    value = _at_level(fp, level)[1]
                    for size in _ranges(len(value), least):
                        for k, pick in enumerate(_bands(level, size)):
                            text = f"{level}.{size}.{k}.".encode() + value[pick].tobytes()
                            rows.append((int.from_bytes(hashlib.sha256(text).digest()[:8], "little", signed=True), level, fp))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))], names=["cell", "level", "fingerprint"])

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["cell", "level", "part"]):
            fps, level = t.column("fingerprint").to_pylist(), t.column("level")[0].as_py()
            values = [_at_level(fp, level)[1] for fp in fps]
            size = np.array([len(v) for v in values])
            grid = np.zeros((len(fps), size.max()), dtype=np.uint8)
            for i, v in enumerate(values):
                grid[i, : len(v)] = v

            def near(rows: np.ndarray) -> np.ndarray:
                out = np.zeros((len(rows), len(fps)), dtype=bool)
                for k, i in enumerate(rows.tolist()):
                    same = ((grid[i] == grid) & (grid != 0)).sum(axis=1)
                    out[k] = same >= least * np.maximum(size[i], size)
                return out

            away, root = forest(len(fps), near)
            if len(away):
                yield pa.record_batch([pa.array([fps[i] for i in x.tolist()], pa.string()) for x in (away, root)], names=["fa", "fb"])

    cells = classes.select("fingerprint").mapInArrow(bands, "cell long, level long, fingerprint string")
    linked = parted(cells, ["cell", "level"], "fingerprint", CELL_ROWS).mapInArrow(edges, "fa string, fb string").distinct()
    # fingerprints stand for themselves under a 64-bit name; equal names would only join two groups
    roots = components(linked.select(F.xxhash64("fa").alias("a"), F.xxhash64("fb").alias("b")), "edit-groups")
    counted = members.groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")).withColumn("node", F.xxhash64("fingerprint"))
    named = materialise(counted.join(roots, "node", "left").select("fingerprint", "class_id", "n", F.coalesce("root", "node").alias("root")), "edit-roots")
    lowest = materialise(named.groupBy("root").agg(F.min("class_id").alias("group_id"), F.count("*").alias("classes")), "edit-lowest")
    keyed = materialise(lookup(named, lowest, "root", "classes").select("fingerprint", "class_id", "group_id", "n"), "edit-named")
    return lookup(members, keyed, "fingerprint", "n").select("doc_id", "fingerprint", "class_id", "group_id")


def edited(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edit with the next document's start.

    The next document is the one with the next smaller doc_id (null ids come last, equal ids in the
    order of their texts' hashes); after the last comes the first. Rows are dealt to ranges of
    doc_id; the last row of a range's predecessor needs the range's first row, so each range's
    first row goes to the range before too, and no order needs one task. Neighbouring ranges go to a
    partition until it has its share of all bytes; there are as many partitions as give TASK_BYTES each,
    or the session's number of shuffle partitions, if that is more. One document is its own next; null texts count as empty; no rows give none.
    """
    spark = docs.sparkSession
    doc_id = F.col("doc_id").cast("long")
    size = F.octet_length(text_of()) + 64
    total = docs.agg(F.sum(size.cast("long"))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-total // TASK_BYTES), RANGES // 8))
    n = ranges or 8 * tasks
    base = docs.select(doc_id.alias("doc_id"), F.xxhash64(text_of()).alias("h"), text_of().alias("text"))
    shares = F.split(F.lit(",".join(f"{i / n:.9f}" for i in range(1, n))), ",").cast("array<double>")  # one literal, however many there are
    found = docs.agg(F.percentile_approx(doc_id, shares, 5 * n)).first()[0] if n > 1 else None
    cuts = np.array(sorted(set(found or [])), dtype=np.int64)

    def number(ids: pd.Series, none: pd.Series, hashes: pd.Series) -> pd.Series:
        """Ranges count downwards: 0 has the largest ids; after them come 64 ranges of null ids, by falling hash."""
        some = len(cuts) - np.searchsorted(cuts, ids.to_numpy(np.int64), side="right")
        return pd.Series(np.where(none.to_numpy(bool), len(cuts) + 32 - (hashes.to_numpy(np.int64) >> 58), some))

    numbered = F.pandas_udf(number, "long")(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "h")  # no nulls: they would make floats of the ids
    rows = base.withColumn("range", numbered)
    place = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "h")
    narrow = docs.select(doc_id.alias("doc_id"), F.xxhash64(text_of()).alias("h"), size.alias("size"))
    firsts = narrow.withColumn("range", numbered).groupBy("range").agg(F.max(place).alias("first"), F.sum(F.col("size").cast("long")).alias("size")).orderBy("range").collect()  # a row a range
    filled = np.cumsum([r["size"] for r in firsts])
    middle = filled - np.array([r["size"] for r in firsts], dtype=np.int64) / 2 if firsts else filled
    to = {r["range"]: min(tasks - 1, int(m * tasks / filled[-1])) for r, m in zip(firsts, middle)}
    look = [(r["range"], r["first"]["doc_id"], r["first"]["h"], firsts[k - 1]["range"], to[r["range"]], to[firsts[k - 1]["range"]]) for k, r in enumerate(firsts)]
    ahead = F.broadcast(spark.createDataFrame(look, "range long, first_id long, first_h long, before long, task int, task_before int"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    marked = rows.join(ahead, "range").withColumn("before", F.when(is_first, F.col("before")))
    copies = F.array(F.struct("task", "range", F.lit(False).alias("ahead")), F.struct(F.col("task_before").alias("task"), F.col("before").alias("range"), F.lit(True).alias("ahead")))
    dealt = marked.select("doc_id", "h", "text", F.explode(F.filter(copies, lambda x: x["range"].isNotNull())).alias("to")).select("to.task", "to.range", "to.ahead", "doc_id", "h", "text")
    dealt = dealt.repartitionById(tasks, F.col("task")).drop("task").sortWithinPartitions("range", "ahead", F.desc_nulls_last("doc_id"), F.desc("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            out = []
            for r, a, i, t in zip(b.column("range").to_pylist(), b.column("ahead").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")):
                if last and last[0] == r and not last[1]:
                    out.append(_compare(last[2], last[3], last[4], last[5], t.as_py(), *(own := _own(t.as_py()))))
                else:
                    own = _own(t.as_py())
                last = (r, a, i, t.as_py(), *own)
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return dealt.mapInArrow(run, SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _own(text: str) -> tuple[Walk, str]:
    w = Walk(text)
    return w, w.fingerprint()


def _compare(doc_id, text: str, walk: Walk, fp: str, next_text: str, _, next_fp: str) -> tuple:
    k = len(text) // 3
    other = text[: len(text) - k] + next_text[:k]
    edited_fp = Walk(other, walk, len(text) - k).fingerprint()
    return (doc_id, len(text), hashlib.sha256(other.encode("utf-8", "replace")).hexdigest(), fp, edited_fp, likeness(fp, edited_fp), likeness(fp, next_fp))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited(table(spark, sf_dir, "documents"))
