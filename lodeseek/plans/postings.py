"""The persisted text index: postings, vocabulary and block bounds, in segments that batches of documents add.

A document's postings are made where it is tokenised, many documents at a time and without a shuffle: for
each path and term how often and where it stands. Documents of like size are put in blocks, and postings are sorted by path, term and block, so that
a term's postings are a range of pages and a block of it a part of them. The vocabulary has a
row for each path and term with sums over the documents (a batch adds what is new and takes off what it replaces, so
the sums are those of a rebuild), and says for three characters in which terms they stand. A batch writes what its
own documents hold and reads no others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import analyzers
from ..schema import Index
from ..sources.segments import SEGMENT, SMALL, Segments, Table
from .bm25 import text_column

_text, _int, _long = T.StringType(), T.IntegerType(), T.LongType()
#: Documents of a block.
BLOCK = 64
GRAM = 3
#: Documents that are dealt out before they are tokenised, as they may come in one file; more come in as many parts as there is work for; documents of a part.
FEW, PART = 1 << 20, 8192
#: Tokens that are counted and sorted at once (more only if one document has them), which bounds a worker's memory.
SLICE = 1 << 18
#: Of postings, most and least are the block's bounds for the term, on its first row.
TABLES = {
    "postings": Table(T.StructType().add("path", _text).add("term", _text).add("block", _long).add("__key", _text).add("times", _int).add("size", _int).add("positions", T.ArrayType(_int)).add("most", _int).add("least", _int), ("path", "term", "block", "__key")),
    "terms": Table(T.StructType().add("path", _text).add("term", _text).add("documents", _long).add("times", _long), ("path", "term"), ("documents", "times")),
    "grams": Table(T.StructType().add("path", _text).add("gram", _text).add("term", _text).add("n", _long), ("path", "gram", "term"), ("n",)),
    "blocks": Table(T.StructType().add("path", _text).add("term", _text).add("block", _long).add("most", _int).add("least", _int), ("path", "term", "block")),
}


def tokenised(docs: DataFrame, index: Index, paths: list[str]) -> DataFrame:
    """__key and a column of tokens, t0, t1 …, for each of paths; words that are yet to be stemmed, or rid of long ones, where the analyzer does so."""
    made = [analyzers.raw(text_column(index, p), index.at(p).analyzer).alias(f"t{i}") for i, p in enumerate(paths)]
    return docs.select("__key", *made)


def coded(lists: pa.Array, analyzer: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Of lists of raw tokens: tokens of each, and for each token, in order, its list, number and place; terms by number.

    Words are stemmed here, each distinct one of a batch once.
    """
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    values, offsets = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row, dictionary = np.repeat(np.arange(len(offsets)), offsets), values.dictionary_encode()
    words, code = dictionary.dictionary.to_pylist(), dictionary.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    made = analyzers.finished(words, analyzer)
    if made is not None:
        words = list(dict.fromkeys(t for t in made if t is not None))
        number = {t: i for i, t in enumerate(words)}
        code = np.array([number.get(t, -1) for t in made], dtype=np.int64)[code] if len(code) else code
        row, code = row[code >= 0], code[code >= 0]
    start = np.r_[0, np.cumsum(np.bincount(row, minlength=len(offsets)))]
    place = np.arange(len(row)) - start[row]
    gap = words.index(analyzers.GAP) if analyzers.GAP in words else -1
    real = code != gap
    size = np.bincount(row[real], minlength=len(offsets))
    return size, row[real], code[real], place[real], words


def ranks(values: pa.Array) -> np.ndarray:
    """Of each value its rank, by bytes."""
    order = pc.sort_indices(values).to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def runs(row: np.ndarray, code: np.ndarray, words: list[str], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of tokens by term and then by rank, a number for each row; where each term and row starts in it. Tokens of a term and row stay as they are."""
    by = ranks(pa.array(words, pa.string()))[code] * max(1, len(rank)) + rank[row]
    order = np.argsort(by, kind="stable")
    by = by[order]
    return order, np.flatnonzero(np.r_[True, by[1:] != by[:-1]]) if len(by) else np.zeros(0, np.int64)


def cuts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows, in order, whose sizes add up to most at most, or of one row that is larger alone."""
    total, lo = np.cumsum(sizes), 0
    while lo < len(total):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def counted(rows: pa.RecordBatch, paths: list[str], analyzers_: list[str | None], first_block: int) -> Iterator[pa.RecordBatch]:
    """Sorted postings of each path of tokenised rows, which lie in blocks as they follow each other."""
    block, keys = first_block + np.arange(rows.num_rows) // BLOCK, rows.column(0)
    rank = np.empty(rows.num_rows, np.int64)
    rank[np.lexsort((ranks(keys), block))] = np.arange(rows.num_rows)
    for i, (p, a) in enumerate(zip(paths, analyzers_)):
        size, row, code, place, words = coded(rows.column(i + 1), a)
        if not len(row):
            continue
        order, first = runs(row, code, words, rank)
        row, code, times = row[order][first], code[order][first], np.diff(np.r_[first, len(order)])
        positions = pa.ListArray.from_arrays(pa.array(np.r_[first, len(order)], pa.int32()), pa.array(place[order], pa.int32()))
        term = pa.DictionaryArray.from_arrays(pa.array(code, pa.int32()), pa.array(words, pa.string())).cast(pa.string())
        starts = np.r_[True, (code[1:] != code[:-1]) | (block[row[1:]] != block[row[:-1]])]
        at, most, least = np.flatnonzero(starts), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        most[at], least[at] = np.maximum.reduceat(times, at), np.minimum.reduceat(size[row], at)
        yield pa.record_batch(
            [
                pa.array([p] * len(row), pa.string()), term, pa.array(block[row], pa.int64()), keys.take(pa.array(row)), pa.array(times, pa.int32()), pa.array(size[row], pa.int32()), positions,
                pa.array(most, pa.int32(), mask=~starts), pa.array(least, pa.int32(), mask=~starts),
            ],
            names=TABLES["postings"].schema.names,
        )


def postings(docs: DataFrame, index: Index, paths: list[str], segment: int = 0) -> DataFrame:
    """The rows of the table of postings, in blocks, each slice of a batch sorted. Blocks of other segments have other numbers (or may share them, which only loosens their bounds)."""
    tokens, base = tokenised(docs, index, paths), (segment % (1 << 15)) << 48
    named = [index.at(p).analyzer for p in paths]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = base + (TaskContext.get().partitionId() << 28)
        for b in batches:
            sizes = sum((b.column(i + 1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(len(paths))), np.zeros(b.num_rows, np.int64))
            by_size = np.argsort(sizes, kind="stable")  # of a row by all its tokens
            for lo, hi in cuts(sizes[by_size], SLICE):
                yield from counted(b.take(pa.array(by_size[lo:hi])), paths, named, at)
                at += -(-(hi - lo) // BLOCK)

    return tokens.mapInArrow(make, TABLES["postings"].schema) if paths else tokens.sparkSession.createDataFrame([], TABLES["postings"].schema)


def dealt(docs: DataFrame, n: int) -> DataFrame:
    """n documents in as many parts as there is work for, as they may come in one file."""
    return docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, n // PART)) if SMALL < n <= FEW else docs


def grams_of(terms: DataFrame) -> DataFrame:
    """path, gram, term, n for the terms of rows of the vocabulary: n counts as many documents as the row does."""
    long = F.char_length("term") >= GRAM
    each = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("term") - (GRAM - 1)), lambda i: F.substring("term", i, F.lit(GRAM)))))
    return terms.where(long).select("path", "term", each.alias("gram"), F.col("documents").alias("n")).select("path", "gram", "term", "n")


@dataclass
class Expansion:
    """Terms of a path that a test hits: all of them, or null where they are more than may be named in a filter."""

    path: str
    terms: list[str] | None
    rows: DataFrame


class TextIndex:
    """Postings of an index's searchable fields under path. NAMED: see expand()."""

    NAMED = 4096

    def __init__(self, spark: SparkSession, index: Index, path: str):
        self.spark, self.index = spark, index
        self.paths = index.searchable()
        self.held = Segments(spark, path, TABLES)

    # building

    def build(self, docs: DataFrame) -> None:
        """Indexes docs (with __key), as the first segment."""
        self.update(docs, None)

    def update(self, new: DataFrame, old: DataFrame | None, n: int | None = None, gone: int = 0, batch: int | None = None) -> None:
        """A segment of new documents (with __key) that replace old ones (with __key, as they were); n, gone: how many, where that is known."""
        n = new.count() if n is None else n
        rows = self.held.ahead("postings", postings(dealt(new, n), self.index, self.paths, self.held.last + 1), n, gone)
        count = lambda df, sign: df.groupBy("path", "term").agg((F.count("*") * sign).alias("documents"), (F.sum("times") * sign).alias("times"))
        terms = count(rows, 1)
        if old is not None and gone:
            less = count(postings(old, self.index, self.paths), -1)
            terms = terms.unionByName(less).groupBy("path", "term").agg(F.sum("documents").alias("documents"), F.sum("times").alias("times"))
        terms = self.held.ahead("terms", terms, n, gone)
        sums = {f"tokens:{r['path']}": r["n"] for r in terms.groupBy("path").agg(F.sum("times").alias("n")).collect()}  # a row a path
        sums["documents"] = n - gone
        bounds = rows.where("most IS NOT NULL").select("path", "term", "block", "most", "least")
        keys = old.select("__key") if old is not None and gone else None
        self.held.append({"grams": grams_of(terms.repartition(self.spark.sparkContext.defaultParallelism)), "blocks": bounds}, keys, n, gone, sums, batch, dealt=("grams", "blocks"))
        self.held.tidy()

    # reading

    def totals(self) -> tuple[int, dict[str, int]]:
        """Documents, and tokens of each path."""
        sums = self.held.sums()
        return int(sums.get("documents", 0)), {p: int(sums.get(f"tokens:{p}", 0)) for p in self.paths}

    def postings(self) -> DataFrame:
        return self.held.read("postings")

    def terms(self) -> DataFrame:
        """path, term, documents, times of the vocabulary."""
        return self.held.read("terms").groupBy("path", "term").agg(F.sum("documents").alias("documents"), F.sum("times").alias("times")).where("documents > 0")

    def frequencies(self, wanted: list[tuple[str, str]]) -> dict[tuple[str, str], int]:
        """Documents that hold a term in a path."""
        if not wanted:
            return {}
        found = self.held.read("terms").where(either(wanted)).groupBy("path", "term").agg(F.sum("documents").alias("n")).collect()  # a row a wanted term
        return {(r["path"], r["term"]): r["n"] for r in found}

    def expand(self, path: str, test, grams: list[list[str]] | None = None, start: str | None = None) -> Expansion:
        return expand(self.held, path, test, grams, start, self.NAMED)


def expand(held: Segments, path: str, test, grams: list[list[str]] | None = None, start: str | None = None, named: int = 4096) -> Expansion:
    """Terms of path in the tables terms and grams of held that pass test (a function of the term's column).

    start: what they begin with, which bounds the scan; grams: sets of which a term holds at least one whole, which are looked up instead of the vocabulary.
    """
    if grams:
        wanted = sorted({g for some in grams for g in some})
        hits = held.read("grams").where((F.col("path") == path) & F.col("gram").isin(wanted)).groupBy("term").agg(F.collect_set("gram").alias("held"))
        whole = F.lit(False)
        for some in grams:
            whole = whole | (F.size(F.array_intersect("held", F.array(*map(F.lit, sorted(set(some)))))) == len(set(some)))
        rows = hits.where(whole & test(F.col("term"))).select("term")
    else:
        own = held.read("terms").where(F.col("path") == path)
        own = own.where(F.col("term").startswith(start)) if start else own
        rows = own.where(test(F.col("term"))).groupBy("term").agg(F.sum("documents").alias("n")).where("n > 0").select("term")
    found = [r["term"] for r in rows.limit(named + 1).collect()]
    return Expansion(path, sorted(found) if len(found) <= named else None, rows)


def either(wanted: list[tuple[str, str]]) -> Column:
    """Rows of one of the paths and terms; reaches the scan."""
    by: dict[str, list[str]] = {}
    for p, t in wanted:
        by.setdefault(p, []).append(t)
    out = F.lit(False)
    for p, ts in by.items():
        out = out | ((F.col("path") == p) & F.col("term").isin(ts))
    return out


__all__ = ["SEGMENT", "Expansion", "TextIndex", "either"]
