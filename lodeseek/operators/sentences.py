"""The persisted sentence index: for each term of the answer fields the sentences that it stands in, made when documents are taken."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import analyzers
from ..plans.bm25 import B, K1, text_column
from ..plans.postings import coded, cuts, dealt, ranks, runs
from ..schema import Index
from ..sources.segments import Segments, Table
from ..storage import materialise
from .semantic import sentence_at, sentences

_text, _int = T.StringType(), T.IntegerType()
TABLES = {
    "postings": Table(T.StructType().add("path", _text).add("term", _text).add("__key", _text).add("at", _int).add("times", _int).add("size", _int), ("path", "term", "__key", "at")),
    "sizes": Table(T.StructType().add("path", _text).add("__key", _text).add("sentences", _int).add("tokens", T.LongType()), ("path", "__key")),
}


#: Bytes of text that are split and counted at once (more only if one document has them), which bounds a worker's memory.
SLICE = 1 << 20


def counted(path: str, keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """Rows of the table of postings, sorted: of each text one without a term, with its numbers of sentences and tokens, then of each term and sentence."""
    doc, at, words, ends = [], [], [], [0]
    for i, t in enumerate(texts.to_pylist()):
        for k, s in enumerate(sentences(t)):
            doc.append(i)
            at.append(k)
            words += analyzers.split(s)
            ends.append(len(words))
    size, row, code, _, terms = coded(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.string())), None)
    doc, at, by_key = np.array(doc, dtype=np.int64), np.array(at, dtype=np.int64), ranks(keys)
    rank = np.empty(len(doc), np.int64)
    rank[np.lexsort((at, by_key[doc]))] = np.arange(len(doc))
    order, first = runs(row, code, terms, rank)
    row, code, times = row[order][first], code[order][first], np.diff(np.r_[first, len(order)])
    heads = np.argsort(by_key)
    numbers = np.bincount(doc, minlength=len(keys))[heads], np.bincount(doc, weights=size, minlength=len(keys)).astype(np.int64)[heads]
    term = pa.DictionaryArray.from_arrays(pa.array(code, pa.int32()), pa.array(terms, pa.string())).cast(pa.string())
    columns = [
        pa.array([path] * (len(heads) + len(row)), pa.string()), pa.concat_arrays([pa.nulls(len(heads), pa.string()), term]), keys.take(pa.array(np.r_[heads, doc[row]])),
        *[pa.array(np.r_[a, b], pa.int32()) for a, b in zip((*numbers, np.zeros(len(heads), np.int64)), (at[row], times, size[row]))],
    ]
    return pa.record_batch(columns, names=TABLES["postings"].schema.names)


class SentenceIndex:
    """Sentences of the fields that an index's semantic configurations name for answers, under path."""

    def __init__(self, spark: SparkSession, index: Index, path: str):
        self.spark, self.index, self.held = spark, index, Segments(spark, path, TABLES)
        self.paths = sorted({p for c in index.semantic.values() for p in c["answers"]})

    def build(self, docs: DataFrame) -> None:
        self.update(docs, None, docs.count(), 0)

    def update(self, new: DataFrame, old: DataFrame | None, n: int, gone: int, batch: int | None = None) -> None:
        """New documents (with __key), and those that they replace, of which the keys alone are looked at."""
        paths = self.paths
        texts = dealt(new, n).select("__key", *[text_column(self.index, p).alias(f"t{i}") for i, p in enumerate(paths)])

        def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sizes = sum((pc.binary_length(b.column(i + 1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(paths))), np.zeros(b.num_rows, np.int64))
                for lo, hi in cuts(sizes, SLICE):
                    part = b.slice(lo, hi - lo)
                    for i, p in enumerate(paths):
                        yield counted(p, part.column(0), part.column(i + 1))

        rows = self.held.ahead("postings", texts.mapInArrow(make, TABLES["postings"].schema), n, gone)
        sizes = rows.where("term IS NULL").select("path", "__key", F.col("at").alias("sentences"), F.col("times").alias("tokens"))
        self.held.append({"sizes": sizes}, old and old.select("__key"), n, gone, batch=batch)
        self.held.tidy()

    def answers(self, matched: DataFrame, paths: list[str], terms: list[str], top: int) -> DataFrame:
        """operators.semantic.answers() by looking the terms up."""
        keys = materialise(matched.select("__key"), "matched")
        own, distinct = F.col("path").isin(paths), list(dict.fromkeys(terms))
        row = self.held.read("sizes").where(own).join(keys, "__key", "left_semi").agg(F.sum("sentences").alias("n"), F.sum("tokens").alias("tokens")).first()
        n, mean = row["n"] or 0, (row["tokens"] or 0) / max(1, row["n"] or 0) or 1.0
        hits = materialise(self.held.read("postings").where(own & F.col("term").isin(distinct)).join(keys, "__key", "left_semi").select("__key", "path", "at", "term", "times", "size"), "sentence-hits")
        held = {r["term"]: r["n"] for r in hits.groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row a term
        times = lambda t: F.coalesce(F.max(F.when(F.col("term") == t, F.col("times"))), F.lit(0))
        each = hits.groupBy("__key", "path", "at").agg(F.max("size").alias("size"), *[times(t).alias(f"n{i}") for i, t in enumerate(distinct)])
        score = sum((F.lit(terms.count(t)) * _idf(n, held.get(t, 0)) * weight(F.col(f"n{i}"), F.col("size"), mean) for i, t in enumerate(distinct)), F.lit(0.0))
        order = sum((F.when(F.col("path") == p, i) .otherwise(0) for i, p in enumerate(paths)), F.lit(0))
        best = each.select("__key", "path", "at", order.alias("order"), score.alias("score")).orderBy(F.desc("score"), "__key", "order", "at").limit(top)
        text = F.coalesce(*[F.when(F.col("path") == p, text_column(self.index, p)) for p in paths])
        found = matched.join(F.broadcast(best), "__key").select("__key", "path", "order", "at", "score", sentence_at(text, F.col("at")).alias("text"))
        return found


def _idf(n: int, held: int) -> Column:
    return F.log(F.lit(1 + (n - held + 0.5) / (held + 0.5)))


def weight(times: Column, size: Column, mean: float) -> Column:
    return times * (K1 + 1) / (times + K1 * (1 - B + B * size / mean))
