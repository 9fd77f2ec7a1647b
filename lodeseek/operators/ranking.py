"""Ordering, paging tokens, nearest neighbours and rank fusion."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import invalid
from ..functions.vectors import METRICS
from ..paths import resolve
from ..schema import Index
from ..storage import materialise

RRF = 60


def keys(index: Index, clauses: list[str], score: bool = True) -> list[tuple[Column, bool]]:
    """What is sorted by, and whether it rises; the key settles ties. Without clauses, the score."""
    out = []
    for c in clauses or (["search.score() desc"] if score else []):
        name, _, way = c.strip().partition(" ")
        way = way.strip().lower() or "asc"
        if way not in ("asc", "desc"):
            raise invalid(f"order {c!r}")
        if name in ("@search.score", "search.score()"):
            if not score:
                raise invalid("there is no score to order by")
            col = F.col("__score")
        else:
            f = index.at(name)
            if f is None or not (f.sortable or f.key):
                raise invalid(f"{name} isn't sortable")
            col, many, _ = resolve(index, name)
            col = F.get(col, F.lit(0)) if many else col
        out.append((col, way == "asc"))
    return [*out, (F.col("__key"), True)]


def order(index: Index, clauses: list[str], score: bool = True) -> list[Column]:
    """Sort columns: nulls first when rising, last when falling."""
    return [col.asc_nulls_first() if rising else col.desc_nulls_last() for col, rising in keys(index, clauses, score)]


def after(matched: DataFrame, sorted_by: list[tuple[Column, bool]], last: list[str | None]) -> Column:
    """Rows that come after the one with the values last (as texts) in the order; the bound of the first column reaches the scan by itself."""
    kinds = [f.dataType for f in matched.select(*[c for c, _ in sorted_by]).schema]
    test, bound = F.lit(False), None
    for (col, rising), kind, text in reversed(list(zip(sorted_by, kinds, last, strict=True))):
        if text is None:
            beyond = col.isNotNull() if rising else F.lit(False)
            bound = None if rising else col.isNull()
        else:
            value = F.lit(text).cast(kind)
            beyond = col > value if rising else (col < value) | col.isNull()
            bound = col >= value if rising else (col <= value) | col.isNull()
        same = col.isNull() if text is None else col == value
        test = F.coalesce(beyond, F.lit(False)) | (F.coalesce(same, F.lit(False)) & test)
    return test if bound is None else bound & test


def numbers(sorted_by: list[tuple[Column, bool]]) -> list[Column]:
    """The values that after() takes, as texts."""
    return [c.cast("string").alias(f"k{i}") for i, (c, _) in enumerate(sorted_by)]


def nearest(docs: DataFrame, index: Index, path: str, vector: list[float], k: int) -> DataFrame:
    """__key and __score of the k best documents: exact scan, a heap for each task, no shuffle of the corpus."""
    f = index.at(path)
    if f is None or not f.vector:
        raise invalid(f"{path} is no vector")
    if len(vector) != f.dimensions:
        raise invalid(f"{path} has {f.dimensions} dimensions")
    score = METRICS[index.metric(f)](F.col(f"`{path}`"), vector)
    scored = docs.where(F.col(f"`{path}`").isNotNull()).select("__key", score.cast("float").cast("double").alias("__score"))
    return scored.orderBy(F.desc("__score"), F.asc("__key")).limit(k)


def best(lists: list[DataFrame]) -> DataFrame:
    """The best native score of each key."""
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out.groupBy("__key").agg(F.max("__score").alias("__score"))


def dealt(scored: DataFrame) -> DataFrame:
    """scored (__key, __score) in ranges of falling score and rising key, written once with each range's number, part: ranges so stay as they are however often they are read."""
    return materialise(scored.select("__key", "__score").repartitionByRange(F.desc("__score"), F.asc("__key")).withColumn("part", F.spark_partition_id()), "ranks")


def numbered(ranges: DataFrame) -> DataFrame:
    """__key and rank, from 1 on, of dealt() rows, without one task for all of them: how many rows the ranges before hold comes from a count by range."""
    local = ranges.withColumn("local", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("__score"), F.asc("__key"))))
    sizes = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row a range
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return local.join(F.broadcast(before), "part").select("__key", (F.col("local") + F.col("before")).alias("rank"))


def numbered_few(scored: DataFrame) -> DataFrame:
    """The same for the rows of a nearest-neighbour list, which are no more than its k."""
    return scored.select("__key", F.row_number().over(Window.orderBy(F.desc("__score"), F.asc("__key"))).alias("rank"))


def fuse(ranked: list[tuple[DataFrame, float]]) -> DataFrame:
    """Reciprocal-rank fusion: the sum of weight / (60 + rank) over lists of __key, rank."""
    out = None
    for df, w in ranked:
        one = df.select("__key", (F.lit(w) / (F.lit(RRF) + F.col("rank"))).alias("__score"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("__key").agg(F.sum("__score").alias("__score"))


def vector_hash(queries: list[dict]) -> str | None:
    return hashlib.sha256(json.dumps(queries, sort_keys=True).encode()).hexdigest()[:16] if queries else None


def token(state: dict) -> str:
    return base64.urlsafe_b64encode(json.dumps(state, sort_keys=True).encode()).decode()


def read_token(text: str, queries: list[dict]) -> dict:
    try:
        state = json.loads(base64.urlsafe_b64decode(text.encode()))
        assert isinstance(state, dict) and isinstance(state.get("skip"), int) and isinstance(state.get("after", []), list)
    except Exception:
        raise invalid("the token can't be read") from None
    if state.get("vectors") != vector_hash(queries):
        raise invalid("the token belongs to other vectors")
    return state
