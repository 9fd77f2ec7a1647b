"""Filter interaction audit: what each filter removes, in every order of the filters.

Filters are bits of a mask. A to D look at one text; E finds texts that a smaller doc_id has as well. For E
rows are sorted by ranges of (fingerprint, doc_id), within them by fingerprint, full text and doc_id, and
each is compared with its predecessor, so that a group of copies is cut into as many partitions as its size
asks for and no hash is trusted. Only a text with the first or last fingerprint of a partition can have a predecessor in
another one: the first rows of these few are compared by full text once more. All that an order of filters can count is a sum over
masks, so counters by part and mask (32 a part) are merged and the orders are read off them.

Null texts and parts count as empty; a null doc_id is smaller than any other. Rows of the same doc_id and text aren't copies of
each other. A document with several labels has a mark that any of them gives. An empty table gives no rows; other columns are
left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialise, table, text_of

FILTERS = "ABCDE"
#: Texts under so many words are short; distinct words and capitals are shares in percent.
WORDS, DISTINCT, CAPITALS, SIGNS = 200, 50, 3, b"#$%&*|"
_UPPER, _INNER = bytes(range(65, 91)), bytes(range(128, 192))  # A-Z; bytes that go on a code point


def mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()  # by ASCII white space, bytes being bytes
    n = len(words)
    short, same = n < WORDS, 100 * len(set(words)) < DISTINCT * n
    loud = 100 * (len(text) - len(text.translate(None, _UPPER))) > CAPITALS * len(text.translate(None, _INNER))
    return short | same << 1 | loud << 2 | (len(text.translate(None, SIGNS)) < len(text)) << 3


def masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, mask (bit k: it fails the k-th filter) and n (rows that are the same in all of it and the text) for docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_of().alias("text"))
    rows = rows.withColumns({"fp": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})
    dealt = rows.repartitionByRange("fp", F.col("doc_id").asc_nulls_first(), "tie").drop("tie").sortWithinPartitions("fp", F.col("text"), F.col("doc_id").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """text is given for the first rows of those texts that may go on in another partition."""
        head = last = before = first = None
        held: dict[tuple, list] = {}  # first rows of the texts of the fingerprint at hand, which may be the last one

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "part", "mask", "n", "fp", "text"])

        for b in batches:
            out = []
            for doc_id, name, fp, t in zip(b.column("doc_id").to_pylist(), b.column("part").to_pylist(), b.column("fp").to_pylist(), b.column("text")):
                raw = t.as_buffer().to_pybytes()
                if fp != last:
                    head = fp if head is None else head
                    out += held.values() if last == head else [(*r[:4], None, None) for r in held.values()]
                    held = {}
                if fp != last or raw != before:
                    last, before, first, own = fp, raw, doc_id, mask(raw)
                if doc_id != first:
                    out.append((doc_id, name, own | 16, 1, None, None))
                elif (name, raw) in held:
                    held[name, raw][3] += 1
                else:
                    held[name, raw] = [doc_id, name, own, 1, fp, t.as_py()]
            if out:
                yield batch(out)
        if held:
            yield batch(list(held.values()))

    made = materialise(dealt.mapInArrow(compare, "doc_id long, part string, mask int, n long, fp long, text string"), "masks")
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("there"), "doc_id")).over(Window.partitionBy("fp", "text"))
    again = F.when(least["doc_id"].eqNullSafe(F.col("doc_id")), 0).otherwise(16)
    open_ = made.where("text IS NOT NULL").select("doc_id", "part", F.col("mask").bitwiseOR(again).alias("mask"), "n")
    return made.where("text IS NULL").select("doc_id", "part", "mask", "n").unionByName(open_)


def counters(masked: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by part and mask, all told and with a label; sums of it for several inputs add up."""
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    n = lambda c: F.coalesce(F.sum(F.col(c) * F.col("n")), F.lit(0)).cast("long").alias(c)
    return masked.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.sum("n").alias("n"), n("good"), n("toxic"))


def orders(counted: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts, for each order of the filters and each step of it."""
    names = ",".join("".join(o) for o in permutations(FILTERS))
    bit = lambda k: F.expr(f"shiftleft(1, locate(substr(filter_order, {k}, 1), '{FILTERS}') - 1)")
    each = counted.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
    each = each.select("*", F.explode(F.split(F.lit(names), ",")).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    earlier = sum((F.when(F.col("step") > k, bit(k)).otherwise(0) for k in range(1, len(FILTERS))), F.lit(0))
    each = each.withColumns({"own": bit("step"), "before": earlier})
    fails, gone = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    of = lambda test, c="n": F.sum(F.when(test, F.col(c)).otherwise(0)).cast("long")
    # of the 120 orders, a filter is the first that the document fails in 120 / (number of filters that it fails)
    shapley = F.sum(F.when(fails, F.col("n") * F.expr("120 div bit_count(mask)")).otherwise(0)).cast("long")
    return each.groupBy("part", "filter_order", "step").agg(
        of(~fails & ~gone).alias("kept"), of(fails & ~gone).alias("removed"), of(fails & gone).alias("redundant"), of(F.col("mask") == F.col("own")).alias("unique_fails"),
        of(fails & ~gone, "good").alias("good_lost"), of(fails & ~gone, "toxic").alias("toxic_lost"), shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """orders() of docs (doc_id, text, part) with labels (doc_id, quality, toxic)."""
    return orders(materialise(counters(masks(docs, part), labels), "counters"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), m AS (
  SELECT doc_id, part, (len(w) < 200) AS a, (100 * len(list_distinct(w)) < 50 * len(w)) AS b,
    (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text)) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    (doc_id IS NOT NULL AND doc_id IS DISTINCT FROM min(doc_id) OVER (PARTITION BY text) OR doc_id IS NOT NULL AND bool_or(doc_id IS NULL) OVER (PARTITION BY text)) AS e FROM t
), k AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, coalesce(l.good, 0) AS good, coalesce(l.toxic, 0) AS toxic
  FROM m LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)
), n AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM k GROUP BY ALL),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)),
o AS (
  SELECT x1.name || x2.name || x3.name || x4.name || x5.name AS filter_order, [x1.bit, x2.bit, x3.bit, x4.bit, x5.bit] AS bits
  FROM f x1, f x2, f x3, f x4, f x5 WHERE x1.bit | x2.bit | x3.bit | x4.bit | x5.bit = 31
), s AS (
  SELECT filter_order, step, bits[step] AS own, list_sum(bits[1:step - 1]) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), z AS (SELECT filter_order, step, own, coalesce(before, 0)::INT AS before FROM s)
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (mask & (own | before) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & own > 0 AND mask & before > 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(1, bit_count(mask)))) FILTER (mask & own > 0), 0)::BIGINT AS shapley
FROM n, z GROUP BY part, filter_order, step
"""
