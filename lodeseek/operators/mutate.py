"""Batches of document actions against a state, as joins."""

from __future__ import annotations

import math
import re
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import SearchError
from ..schema import Field, Index, known

ACTIONS = ("upload", "merge", "mergeOrUpload", "delete")
_RULES = {
    "Time": r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,9})?$",
    "Duration": r"^-?P(?!$)(\d+Y)?(\d+M)?(\d+W)?(\d+D)?(T(?=\d)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$",
    "Binary": r"^(?:[A-Za-z0-9+/_-]{4})*(?:[A-Za-z0-9+/_-]{2}(?:==)?|[A-Za-z0-9+/_-]{3}=?)?$",
}


def parse_action(item: dict) -> tuple[str, dict]:
    """("upload", document) from {"@search.action": ..., fields} or {"action": ..., "document": ...}."""
    if not isinstance(item, dict):
        raise SearchError("InvalidRequest", "an action is no object")
    if isinstance(item.get("document"), dict):
        action, doc = item.get("action", "upload"), item["document"]
    else:
        action, doc = item.get("@search.action", "upload"), {k: v for k, v in item.items() if k != "@search.action"}
    if action not in ACTIONS:
        raise SearchError("UnsupportedAction", f"action {action!r}")
    return action, doc


_WHOLE = {"Int8": 7, "SByte": 7, "Int16": 15, "Int32": 31, "Int64": 63}


def shaped(f: Field, value: Any, element: bool = False) -> Any:
    """value as createDataFrame takes it for the field; ValueError where it is of another type."""
    if value is None:
        return None
    if f.vector or f.collection and not element:
        if not isinstance(value, (list, tuple)):
            raise ValueError(f"{f.name} needs a list")
        return [float(_real(f, x)) for x in value] if f.vector else [shaped(f, x, True) for x in value]
    if f.complex:
        if not isinstance(value, dict):
            raise ValueError(f"{f.name} needs an object")
        known({g.name for g in f.fields}, value)
        return {g.name: shaped(g, value.get(g.name)) for g in f.fields}
    if f.type == "GeographyPoint":
        if not (isinstance(value, dict) and value.get("type") == "Point" and isinstance(at := value.get("coordinates"), list) and len(at) == 2):
            raise ValueError(f"{f.name} needs a point")
        return {"type": "Point", "coordinates": [float(_real(f, x)) for x in at]}
    if f.type == "Boolean":
        if not isinstance(value, bool):
            raise ValueError(f"{f.name} needs true or false")
        return value
    if f.type in _WHOLE:
        x = _real(f, value)
        if x != int(x) or not -(2 ** _WHOLE[f.type]) <= x < 2 ** _WHOLE[f.type]:
            raise ValueError(f"{f.name} needs an {f.type}")
        return int(x)
    if f.type in ("Single", "Double", "Half"):
        return float(_real(f, value))
    if not isinstance(value, str):
        raise ValueError(f"{f.name} needs a text")
    return value


def _real(f: Field, value: Any) -> int | float:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ValueError(f"{f.name} needs a number")
    return value


def rows(index: Index, actions: list[dict]) -> list[tuple]:
    """The index's columns, __action, __seq, __given (fields that the document has, null ones too) and __why.

    A document with an unknown field or a value of another type is a row with nothing but its key, if that
    can be read, and the reason; the others aren't touched by it.
    """
    out = []
    for k, item in enumerate(actions):
        action, doc = parse_action(item)
        why, values = None, {}
        try:
            known({f.name for f in index.fields}, doc)
            values = {f.name: shaped(f, doc.get(f.name)) for f in index.fields}
        except ValueError as e:
            why = str(e)
            try:
                values = {index.key.name: shaped(index.key, doc.get(index.key.name))}
            except ValueError:
                values = {}
        out.append((*[values.get(f.name) for f in index.fields], action, k, [n for n in doc], why))
    return out


def violation(index: Index) -> Column:
    """Why a row breaks a rule that its Spark type doesn't keep already; null where it is fine."""

    def of(f: Field, col: Column) -> list[Column]:
        out = []
        if f.type in _RULES and not f.collection:
            out.append(F.when(col.isNotNull() & ~col.rlike(_RULES[f.type]), f"{f.name} is no {f.type}"))
        if f.vector:
            fine = (F.size(col) == f.dimensions) & F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            out.append(F.when(col.isNotNull() & ~F.coalesce(fine, F.lit(False)), f"{f.name} needs {f.dimensions} finite numbers"))
        for g in f.fields if not f.collection else ():
            out += of(g, col[g.name])
        return out

    checks = [F.when(F.col(f"`{index.key.name}`").isNull(), "there is no key")]
    for f in index.fields:
        checks += of(f, F.col(f"`{f.name}`"))
    return F.coalesce(*checks)


def fold(stored: DataFrame, batch: DataFrame, index: Index) -> DataFrame:
    """What a batch makes of the documents that it names: __key, old (as stored, or null), doc (from now on, or null) and log (seq, status) for each key.

    stored: the index's documents, or any part that holds those that the batch names. batch: the index's columns,
    __action, __seq (unique, rising) and, where known, __given and __why. Actions of a key are applied one
    after the other. A merge lays the fields that it has over the document: those that __given names, null ones too, or
    without that column those that aren't null; after a delete in the same batch it is laid over the stored one. A merge
    or delete without a document is 404; rows that break a rule are left out, see refused().
    """
    names = [f.name for f in index.fields]
    checked = _checked(batch, index)
    good = checked.where("__why IS NULL")
    row = F.struct("__seq", "__action", F.struct(*names).alias("doc"), "__given")
    earlier = lambda a, b: F.when(a["__seq"] < b["__seq"], -1).otherwise(1)
    per_key = good.groupBy("__key").agg(F.array_sort(F.collect_list(row), earlier).alias("steps"))
    old = stored.select(F.col(f"`{index.key.name}`").cast("string").alias("__key"), F.struct(*names).alias("old"))
    both = per_key.join(old, "__key", "left")
    laid = lambda base, x: F.struct(*[F.when(F.array_contains(x["__given"], n), x["doc"][n]).otherwise(base[n]).alias(n) for n in names])
    fresh = F.struct(F.col("old").alias("doc"), F.array().cast("array<struct<seq:bigint,status:int>>").alias("log"))

    def step(acc: Column, x: Column) -> Column:
        act, base = x["__action"], F.coalesce(acc["doc"], F.col("old"))
        exists = base.isNotNull()
        merges = act.isin("merge", "mergeOrUpload")
        doc = (
            F.when(act == "upload", x["doc"]).when(merges & exists, laid(base, x)).when(act == "mergeOrUpload", x["doc"])
            .when(act == "merge", acc["doc"])
        )
        status = F.when(act == "upload", 201).when(merges & exists, 200).when(act == "mergeOrUpload", 201).when(act == "merge", 404).when(exists, 200).otherwise(404)
        log = F.concat(acc["log"], F.array(F.struct(x["__seq"].cast("long").alias("seq"), status.cast("int").alias("status"))))
        return F.struct(doc.alias("doc"), log.alias("log"))

    return both.withColumn("end", F.aggregate("steps", fresh, step)).select("__key", "old", F.col("end.doc").alias("doc"), F.col("end.log").alias("log"))


def documents(folded: DataFrame, which: str, index: Index) -> DataFrame:
    """The index's columns and __key of the documents that fold() names old or doc."""
    return folded.where(F.col(which).isNotNull()).select(*[F.col(f"`{which}`.`{f.name}`").alias(f.name) for f in index.fields], "__key")


def results(folded: DataFrame, batch: DataFrame, index: Index) -> DataFrame:
    """__seq, key, status of each action."""
    done = folded.select("__key", F.explode("log").alias("r")).select(F.col("r.seq").alias("__seq"), F.col("__key").alias("key"), F.col("r.status").alias("status"))
    return done.unionByName(refused(batch, index))


def refused(batch: DataFrame, index: Index) -> DataFrame:
    """The rows that break a rule, with status 400."""
    return _checked(batch, index).where("__why IS NOT NULL").select(F.col("__seq").cast("long").alias("__seq"), F.col("__key").alias("key"), F.lit(400).alias("status"))


def _checked(batch: DataFrame, index: Index) -> DataFrame:
    why = F.coalesce(F.col("__why"), violation(index)) if "__why" in batch.columns else violation(index)
    names = [f.name for f in index.fields]
    given = F.col("__given") if "__given" in batch.columns else F.array_compact(F.array(*[F.when(F.col(f"`{n}`").isNotNull(), F.lit(n)) for n in names]))
    return batch.withColumns({"__why": why, "__given": given}).withColumn("__key", F.col(f"`{index.key.name}`").cast("string"))


def reasons(batch: DataFrame, index: Index) -> DataFrame:
    """__seq and why for the rows of a batch that break a rule."""
    why = F.coalesce(F.col("__why"), violation(index)) if "__why" in batch.columns else violation(index)
    return batch.select(F.col("__seq").cast("long").alias("__seq"), why.alias("why")).where("why IS NOT NULL")
