"""The persisted word index of suggesters: their fields' words with places and next words, and the vocabulary, kept up by batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.postings import GRAM, expand, grams_of
from ..schema import Index
from ..sources.segments import Segments, Table
from ..storage import discard, materialise
from .suggest import like, words

_text, _long = T.StringType(), T.LongType()
TABLES = {
    "words": Table(T.StructType().add("path", _text).add("low", _text).add("word", _text).add("next", _text).add("__key", _text).add("place", T.IntegerType()), ("path", "low", "__key", "place")),
    "terms": Table(T.StructType().add("path", _text).add("term", _text).add("documents", _long), ("path", "term"), ("documents",)),
    "grams": Table(T.StructType().add("path", _text).add("gram", _text).add("term", _text).add("n", _long), ("path", "gram", "term"), ("n",)),
}


class WordIndex:
    """Words of all fields that an index's suggesters name, under path."""

    def __init__(self, spark: SparkSession, index: Index, path: str):
        self.spark, self.index, self.held = spark, index, Segments(spark, path, TABLES)
        self.paths = sorted({p for own in index.suggesters.values() for p in own})

    def build(self, docs: DataFrame) -> None:
        self.update(docs, None, docs.count(), 0)

    def _rows(self, docs: DataFrame) -> DataFrame:
        out = None
        for p in self.paths:
            held = docs.select("__key", words(self.index, [p]).alias("w"))
            pairs = F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("word"), b.alias("next")))
            one = held.select("__key", F.posexplode(pairs).alias("place", "p")).select(F.lit(p).alias("path"), F.lower("p.word").alias("low"), "p.word", "p.next", "__key", "place")
            out = one if out is None else out.unionByName(one)
        return out if out is not None else self.spark.createDataFrame([], TABLES["words"].schema)

    def update(self, new: DataFrame, old: DataFrame | None, n: int, gone: int, batch: int | None = None) -> None:
        """New documents (with __key), and those that they replace, as they were."""
        rows = materialise(self._rows(new), "words")
        count = lambda df, sign: df.groupBy("path", F.col("low").alias("term")).agg((F.count("*") * sign).alias("documents"))
        terms = count(rows, 1)
        if old is not None and gone:
            terms = terms.unionByName(count(self._rows(old), -1)).groupBy("path", "term").agg(F.sum("documents").alias("documents"))
        terms = materialise(terms, "word-terms")
        self.held.append({"words": rows, "terms": terms, "grams": grams_of(terms)}, old and old.select("__key"), n, gone, batch=batch)
        discard(rows)
        discard(terms)
        self.held.tidy()

    def matching(self, paths: list[str], term: str, fuzzy: bool) -> Column | None:
        """Rows of words that match a term; null where too many words of the vocabulary do to be named."""
        cut = [0, len(term) // 2, len(term)] if fuzzy else [0, len(term)]  # an edit leaves one half of a word as it is
        grams = [[term[i : i + GRAM] for i in range(a, b - GRAM + 1)] for a, b in zip(cut, cut[1:])]
        out = F.lit(False)
        for p in paths:
            found = expand(self.held, p, lambda w: like(w, term, fuzzy), grams if all(grams) else None)
            if found.terms is None:
                return None
            out = out | ((F.col("path") == p) & F.col("low").isin(found.terms))
        return out

    def rows(self, paths: list[str], which: Column) -> DataFrame:
        """Those words of paths, with order (the path's place among paths)."""
        order = F.coalesce(*[F.when(F.col("path") == p, F.lit(i)) for i, p in enumerate(paths)])
        return self.held.read("words").where(F.col("path").isin(paths) & which).withColumn("order", order)
