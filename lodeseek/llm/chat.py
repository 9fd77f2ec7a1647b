"""Chat formatting: collapses logged snapshots of a conversation, then renders what stays.

A conversation's turns are hashed one after the other, each hash taking in the one before. A
conversation whose last hash is an inner hash of another is a prefix of it and goes, by an
anti-join; of equal conversations the one with the smallest conv_id stays. DataFrame
operations only.

Turns are ordered by (turn, role, text), nulls first; null roles and texts count as empty,
repeated rows are repeated turns. Rows without a conv_id can't be told to belong together: each is
a conversation of its own, which never stays over an equal one with an id. No rows give no rows; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, table

START, SEP, STOP = "<|", "|>\n", "<|end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), hashes (of each prefix) for each conversation."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("turn"))
    made = rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    made = made.unionByName(rows.where("conv_id IS NULL").select("conv_id", F.array("turn").alias("turns")))
    step = "sha2(concat(element_at(a, -1), ':', char_length(x.role), ':', x.role, x.text), 256)"
    chain = F.expr(f"slice(aggregate(turns, array(''), (a, x) -> concat(a, array({step}))), 2, size(turns))")
    return made.withColumn("hashes", chain)


def render(turns):
    """<|role|>, a line break, the text and <|end|> for each turn."""
    return F.array_join(F.transform(turns, lambda x: F.concat(F.lit(START), x["role"], F.lit(SEP), x["text"], F.lit(STOP))), "")


def collapse(turns: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id, n_turns, copies (equal ones), kept, rendered (null unless kept)."""
    # written with a number for each, which names conversations without an id as well
    convs = materialise(conversations(turns).withColumn("row_id", F.monotonically_increasing_id()), "conversations")
    first = F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "row_id"))
    classes = convs.groupBy(F.element_at("hashes", -1).alias("whole")).agg(first.alias("first"), F.count("*").alias("copies"))
    inner = convs.select(F.explode(F.expr("slice(hashes, 1, size(hashes) - 1)")).alias("whole")).distinct()
    stay = materialise(classes.join(inner.hint("merge"), "whole", "left_anti"), "maximal")
    found = convs.join(stay.select(F.col("first.row_id").alias("row_id"), "copies"), "row_id", "left")
    kept = F.coalesce(F.col("copies"), F.lit(0)) > 0
    return found.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.coalesce("copies", F.lit(0)).cast("long").alias("copies"), kept.alias("kept"), F.when(kept, render("turns")).alias("rendered"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations"))


ORACLE_SQL = """
WITH c AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () ELSE 0 END AS lone FROM conversations),
t AS (
  SELECT conv_id, lone, row_number() OVER (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM c
), p AS (
  SELECT conv_id, lone, k, string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY k)
    OVER (PARTITION BY conv_id, lone ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s,
    count(*) OVER (PARTITION BY conv_id, lone) AS n FROM t
), whole AS (SELECT conv_id, lone, n, s FROM p WHERE k = n),
inner_ AS (SELECT DISTINCT s FROM p WHERE k < n),
classes AS (SELECT s, min(conv_id) AS first, min(lone) AS first_lone, count(*) AS copies FROM whole WHERE s NOT IN (SELECT s FROM inner_) GROUP BY s)
SELECT w.conv_id, w.n AS n_turns, coalesce(c.copies, 0) AS copies, c.copies IS NOT NULL AS kept,
  CASE WHEN c.copies IS NOT NULL THEN w.s END AS rendered
FROM whole w LEFT JOIN classes c ON w.s = c.s AND (w.conv_id = c.first OR w.conv_id IS NULL AND c.first IS NULL AND w.lone = c.first_lone)
"""
