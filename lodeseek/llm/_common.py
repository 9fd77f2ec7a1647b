"""What the operators share: written intermediates, free names, skew-safe lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import clear, discard, exists, mark, materialise, new_path, read_text, remove, shared_dir, write_text  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: At most this many keys can each hold more than 1/HEAVY_KEYS of the rows, so a
#: table of them may be broadcast whatever the size of the data.
HEAVY_KEYS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def lower_ascii(column: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, UPPER, LOWER)


def free(columns: list[str], wanted: str) -> str:
    """wanted, or wanted with as many underscores as make it a name that columns don't have."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def lookup(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int | None = None) -> DataFrame:
    """Inner join of rows with keyed (one row for each key; weight: how many rows have it).

    Keys with over 1/HEAVY_KEYS of all rows are at most HEAVY_KEYS: they are joined from a
    broadcast, and no task gets all rows of a hot key. The rest goes through a sort-merge join.
    keyed is read several times and should be a written table.
    """
    if total is None:
        total = keyed.agg(F.sum(weight)).first()[0] or 0
    heavy = F.broadcast(keyed.where(F.col(weight) > max(1, total // HEAVY_KEYS)))
    hot = rows.join(heavy, key)
    rest = rows.join(heavy.select(key), key, "left_anti").join(keyed.hint("merge"), key)
    return hot.unionByName(rest)


#: Rows that a step of a running sum brings together.
FAN = 4096


def before(rows: DataFrame, keys: list[str], place: str, value: str, places: int, out: str, fan: int = FAN) -> DataFrame:
    """rows with out: the sum of value over the rows of the same keys at smaller places.

    place: whole numbers below places, a row each. No task gets more than fan rows of a key: sums of
    cells of fan places are summed first. rows is read once a level and should be a written table.
    """
    sums = lambda df, keys, at: df.withColumn(out, F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if places <= fan:
        return sums(rows, keys or [F.lit(0)], place)
    cell, upper = free(rows.columns, "__cell"), free([*rows.columns, out], "__upper")
    celled = rows.withColumn(cell, F.expr(f"`{place}` div {fan}"))
    cells = materialise(celled.groupBy(*keys, cell).agg(F.sum(value).alias(value)), "cells")
    above = before(cells, keys, cell, value, -(-places // fan), upper, fan).drop(value)
    return sums(celled, [*keys, cell], place).join(above, [*keys, cell]).withColumn(out, F.col(out) + F.col(upper)).select(*rows.columns, out)


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with name: their place in the order, from 0 on, without one task for all of them."""
    part, n, first = (free(rows.columns, x) for x in ("__part", "__n", "__first"))
    dealt = materialise(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranges")
    counts = materialise(dealt.groupBy(part).agg(F.count("*").alias(n)), "range-counts")
    most = (counts.agg(F.max(part)).first()[0] or 0) + 1
    local = dealt.withColumn(name, F.row_number().over(Window.partitionBy(part).orderBy(*order)) - 1)
    return local.join(before(counts, [], part, n, most, first).drop(n), part).withColumn(name, (F.col(name) + F.col(first)).cast("long")).drop(part, first)
