"""Facets: value counts over all matches."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import invalid
from ..paths import resolve
from ..schema import NUMBERS, Index


def parse(index: Index, specs: list[str]) -> dict[str, int | None]:
    """Path and limit of each facet: "a", "a,count:5", "a,top:5", "*" (all top-level facetable ones), "$count"."""
    out: dict[str, int | None] = {}
    for s in specs:
        path, *options = [x.strip() for x in s.split(",")]
        limit = None
        for o in options:
            m = re.fullmatch(r"(?:count|top):(\d+)", o)
            if not m:
                raise invalid(f"facet option {o!r}")
            limit = int(m[1])
        if path == "*":
            out |= {f.name: limit for f in index.fields if f.facetable}
        elif path == "$count":
            out[path] = limit
        elif (f := index.at(path)) is None or not f.facetable:
            raise invalid(f"{path} isn't facetable")
        else:
            out[path] = limit
    return out


def counts(matched: DataFrame, index: Index, path: str, limit: int | None = None) -> DataFrame:
    """value, count: nulls don't count, repeated values of a collection do; most frequent first, then by typed text."""
    if path == "$count":
        return matched.agg(F.count(F.lit(1)).alias("count")).select(F.lit("$count").alias("value"), "count")
    col, many, f = resolve(index, path)
    one = matched.select((F.explode(col) if many else col).alias("value")).where("value IS NOT NULL")
    kind = "n:" if f.type in NUMBERS else "b:" if f.type == "Boolean" else "s:"
    out = one.groupBy("value").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.concat(F.lit(kind), F.col("value").cast("string")))
    return out.limit(limit) if limit is not None else out
