"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by naive Bayes.

N-grams are runs of one to three word shapes (which kinds of characters a word holds, in which
order, and whether the word repeats one of the two before it), each with the octave of its share
of the text, and runs of one to three bytes. An indicator is scaled by the log-count ratio of the
two classes, documents are scaled to unit length, and the weights come from dual coordinate
descent. Margins become probabilities by a logistic fit on documents that the weights didn't see.

The model is fitted on the SAMPLE labelled documents whose ids hash lowest, or all if they are fewer, and on
the first of these in that order whose feature numbers fill SAMPLE_BYTES, which bounds the driver's memory; every
document is scored on its whole text. Nothing but the text is an input of a score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import free, materialise, table, text_of

#: Labelled documents that the model is fitted on, at most, and bytes of their feature numbers.
SAMPLE, SAMPLE_BYTES = 12_000, 128_000_000
BITS = 18
THRESHOLD = 0.3
FOLDS = 5
_shapes: dict[str, int] = {}


def _shape(word: str) -> int:
    """16 bits of a hash of the kinds of all characters of a word, each run of a kind counted once."""
    kinds = ["X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word]
    runs = [k for k, last in zip(kinds, ["", *kinds]) if k != last]
    return zlib.crc32("".join(runs).encode("utf-8", "replace")) & 0xFFFF


def _hash(codes: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (codes.astype(np.uint64) + np.uint64(kind << 56)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - BITS)).astype(np.int32)


def features(text: str) -> np.ndarray:
    """Sorted distinct feature numbers of a whole text."""
    words = text.split()
    out = []
    if words:
        if len(_shapes) > 200_000:
            _shapes.clear()
        for w in set(words):
            if w not in _shapes:
                _shapes[w] = _shape(w)
        again = np.array([w == a or w == b for w, a, b in zip(words, ["", *words], ["", "", *words])], dtype=np.uint64)
        one = np.array([_shapes[w] for w in words], dtype=np.uint64) * np.uint64(2) + again
        for n in range(1, min(3, len(words)) + 1):
            code = one[: len(one) - n + 1].copy()
            for k in range(1, n):
                code = code * np.uint64(1 << 17) + one[k : len(one) - n + 1 + k]
            found, count = np.unique(code, return_counts=True)
            octave = np.minimum(9, np.floor(-np.log2(count / len(code)))).astype(np.uint64)
            with np.errstate(over="ignore"):
                out += [_hash(found, n), _hash(found * np.uint64(11) + octave, 3 + n)]
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    seen = np.zeros(1 << 24, dtype=bool) if len(raw) > 1 << 22 else None
    for n in range(1, min(3, len(raw)) + 1):
        code = raw[: len(raw) - n + 1].copy()
        for k in range(1, n):
            code = (code << 8) | raw[k : len(raw) - n + 1 + k]
        if seen is None:
            code = np.unique(code)
        else:
            seen[:] = False
            seen[code] = True
            code = np.flatnonzero(seen)
        out.append(_hash(code, 8 + n))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int32)


@dataclass
class Model:
    """Scores by 1 / (1 + exp(-(slope * margin + shift)))."""

    ratio: np.ndarray
    weight: np.ndarray
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        r = self.ratio[found]
        return float((self.weight[found] * r).sum() / max(np.sqrt((r * r).sum()), 1e-12))

    def score(self, text: str) -> float:
        z = self.slope * self.margin(features(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def descend(rows: list[np.ndarray], ratio: np.ndarray, length: np.ndarray, y: np.ndarray, cost: np.ndarray, passes: int = 12, seed: int = 7) -> np.ndarray:
    """Dual coordinate descent for the hinge loss: a dual variable a row, within 0 and its cost. A row's values are ratio / length, made anew when it comes up."""
    w, a = np.zeros(len(ratio)), np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            f = rows[i]
            v = ratio[f] / length[i]
            g, norm = y[i] * (w[f] @ v) - 1, v @ v
            if norm == 0 or a[i] == 0 and g >= 0 or a[i] == cost[i] and g <= 0:
                continue
            new = min(max(a[i] - g / norm, 0.0), cost[i])
            w[f] += (new - a[i]) * y[i] * v
            moved = max(moved, abs(new - a[i]))
            a[i] = new
        if moved < 1e-3:
            break
    return w


def logistic(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, targets drawn in as in Platt's."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, b = np.column_stack([m, np.ones(len(m))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        v, g = p * (1 - p), (x * (t - p)[:, None]).sum(axis=0) - 1e-3 * b
        mm, m1, one = (v * m * m).sum() + 1e-3, (v * m).sum(), v.sum() + 1e-3
        step = np.array([one * g[0] - m1 * g[1], mm * g[1] - m1 * g[0]]) / (mm * one - m1 * m1)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return max(float(b[0]), 1e-3), float(b[1])


def fit(rows: list[np.ndarray], y: np.ndarray, size: int = 1 << BITS) -> Model:
    """rows: feature numbers of each document; y: 1 or -1. With one class or none, that class's share, smoothed."""
    up, down = int((y > 0).sum()), int((y <= 0).sum())
    if not up or not down:
        return Model(np.zeros(size), np.zeros(size), 1.0, float(np.log((up + 1) / (down + 1))))
    p, q = np.ones(size), np.ones(size)
    for n, of in ((p, np.flatnonzero(y > 0)), (q, np.flatnonzero(y <= 0))):
        for k in range(0, len(of), 256):
            n += np.bincount(np.concatenate([rows[i] for i in of[k : k + 256]]), minlength=size)
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    length = np.array([max(np.sqrt((ratio[f] * ratio[f]).sum()), 1e-12) for f in rows])
    cost = np.where(y > 0, 1.0, up / down)
    held = np.arange(len(rows)) % 4 == 3
    if not {1, -1} <= set(y[held].tolist()) or not {1, -1} <= set(y[~held].tolist()):
        held[:] = False
    part = [i for i in range(len(rows)) if not held[i]]
    w = descend([rows[i] for i in part], ratio, length[part], y[part], cost[part])
    test = np.flatnonzero(held) if held.any() else np.arange(len(rows))
    slope, shift = logistic(np.array([w[rows[i]] @ (ratio[rows[i]] / length[i]) for i in test]), y[test])
    return Model(ratio, w, slope, shift)


def fold() -> Column:
    """crc32 of the id as text, modulo FOLDS; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS


def _lowest(keyed: DataFrame, most: int) -> Column:
    """Whether a row's (h, doc_id) is among the `most` lowest of keyed; h has 63 bits.

    The bucket in which the bound lies is split by the next 9 bits until it has `most` rows or fewer; those are ordered here.
    """
    shift, prefix, n = 63, 0, 0
    while True:
        shift -= 9
        inside = keyed.where(F.shiftright("h", shift + 9) == prefix)
        by = {r["b"]: r["n"] for r in inside.groupBy(F.shiftright("h", shift).alias("b")).agg(F.count("*").alias("n")).collect()}  # 512 numbers at most
        at, end = prefix << 9, (prefix + 1) << 9
        while at < end and n + by.get(at, 0) <= most:
            n += by.get(at, 0)
            at += 1
        if at == end:
            return F.lit(True)
        if by[at] <= most or not shift:
            break
        prefix = at
    if n == most:
        return F.shiftright("h", shift) < at
    h, doc_id = sorted((r["h"], r["doc_id"]) for r in keyed.where(F.shiftright("h", shift) == at).select("h", "doc_id").collect())[most - n - 1]
    return (F.col("h") < h) | ((F.col("h") == h) & (F.col("doc_id") <= doc_id))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on labelled documents outside fold 0.

    Labels that are null or that contradict each other for an id are left out; of repeated ids
    one document counts. The labels chosen are SAMPLE, or all if they are fewer, so they may be broadcast.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(fold() != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("lo"), F.max("quality").alias("hi")).where("lo = hi")
    keyed = known.select("doc_id", F.col("lo").alias("quality"), F.shiftrightunsigned(F.xxhash64("doc_id"), 1).alias("h"))
    chosen = F.broadcast(keyed.where(_lowest(keyed, SAMPLE)).select(F.col("doc_id").alias("id"), "quality", "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t.as_py()).astype("<i4").tobytes() for t in b.column("text")]
            yield pa.record_batch([b.column("id"), b.column("h"), b.column("quality"), pa.array(found, pa.binary())], names=["id", "h", "quality", "found"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).join(chosen, F.col("doc_id") == F.col("id"))
    rows = texts.select("id", "h", F.col("quality").cast("int").alias("quality"), "text").mapInArrow(run, "id long, h long, quality int, found binary")
    once = materialise(rows.groupBy("id").agg(F.max(F.struct("h", "quality", "found")).alias("x")).select("id", "x.*"), "quality-sample")
    sizes = sorted((r["h"], r["id"], r["n"]) for r in once.select("h", "id", F.octet_length("found").alias("n")).collect())  # SAMPLE rows at most
    filled = np.cumsum([n for *_, n in sizes])
    if len(sizes) and filled[-1] > SAMPLE_BYTES:
        h, i, _ = sizes[max(0, int(np.searchsorted(filled, SAMPLE_BYTES, side="right")) - 1)]
        once = once.where((F.col("h") < h) | ((F.col("h") == h) & (F.col("id") <= i)))
    # by partitions: the sample is in the driver's memory once, in Python, and never whole in its JVM
    got = sorted(((r["h"], r["id"], r["quality"], np.frombuffer(r["found"], dtype="<i4")) for r in once.toLocalIterator()), key=lambda r: r[:2])
    y = np.array([1 if r[2] == 1 else -1 for r in got])
    return fit([r[3] for r in got], y)


def score(docs: DataFrame, model: Model, name: str = "__score") -> DataFrame:
    """docs with the column name, which they must not have: higher where label 1 is likelier. Null texts count as empty."""
    sent = docs.sparkSession.sparkContext.broadcast((model.ratio.astype(np.float32), (model.ratio * model.weight).astype(np.float32), model.slope, model.shift))

    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        ratio, product, slope, shift = sent.value
        for s in texts:
            out = np.empty(len(s))
            for i, t in enumerate(s):
                f = features(t)
                r = ratio[f].astype(np.float64)
                out[i] = slope * product[f].sum(dtype=np.float64) / max(np.sqrt(r @ r), 1e-12) + shift
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return docs.withColumn(name, F.pandas_udf(of, "double")(text_of()))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score is THRESHOLD or more, with all their columns."""
    own = free(docs.columns, "__score")
    return score(docs, train(docs, labels), own).where(F.col(own) >= THRESHOLD).drop(own)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold() == 0).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"))
