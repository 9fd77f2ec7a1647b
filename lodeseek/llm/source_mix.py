"""Mixing sources to target weights by a low-discrepancy schedule.

Targets share a number of words among the sources by weight; what lies above a source's cap is shared
anew among the others until nothing does. Within a source, documents are shuffled by a keyed digest of their
doc_id, laid end to end and cut in blocks of equal numbers of words. The mix is a sequence of slots, one
block each: point v of the van der Corput sequence falls to the source whose part of the cumulative weights
holds it, slots are numbered by the points' order, a source's slots are ranked, and its k-th slot takes its
block k modulo the number of its blocks. With n slots, points are whole numbers v of m bits, 2 ** m >= n, in the order
of their reversed bits; a source's part is a range of v, so each source gets the slots that its target
needs, exactly, and both ranks are sums over the bits of v: nothing is sorted or gathered for them.

Sources are ordered by code point, null last. Null texts have no words; documents without words are in no block and take
nothing. Repeated rows and rows of the same doc_id are documents each for themselves; a null doc_id is
shuffled as an empty one. An empty table gives no rows. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import before, lookup, materialise, numbered, table, text_of

WEIGHTS, SHARE, MOST, BLOCK, KEY = (3.0, 1.0, 2.0), 1.5, 2, 2048, "mix"
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a source that are summed up together, and slots that are dealt together.
TOGETHER, DEALT = 1024, 4096


@dataclass
class Mix:
    """documents: row_id, doc_id, size, source_size, target, src, start (words of the source before it).
    sources: src, source, size, weight, target, words (taken), slots, first (slots of the sources before), blocks.
    slots, pieces: see schedule() and blocks()."""

    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    pieces: DataFrame

    def rows(self) -> DataFrame:
        """The mix: slot, offset (words in the slot before), row_id, doc_id, start (words of the document before), words."""
        met = self.slots.hint("merge").join(self.pieces, ["src", "block"])  # what a Generate brings is planned by its input's size, which says nothing
        words = F.least(F.col("words"), F.col("limit") - F.col("offset"))
        return met.select("slot", "offset", "row_id", "doc_id", "start", words.alias("words")).where("words > 0")

    def taken(self) -> DataFrame:
        """documents with taken: the words that the mix takes of each, repeats counted."""
        n = self.rows().groupBy("row_id").agg(F.sum("words").alias("taken"))
        return self.documents.join(n, "row_id", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))

    def texts(self, docs: DataFrame) -> DataFrame:
        """slot and text: its words, joined by spaces. docs: the rows that the mix was made of, doc_id being unique."""
        ids = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_extract_all(text_of(), F.lit(f"({WORD})"), F.lit(1)).alias("all"))
        one = self.rows().join(ids, "doc_id").select("slot", "offset", F.slice("all", F.col("start").cast("int") + 1, F.col("words").cast("int")).alias("some"))
        return one.groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("offset", "some"))).alias("parts")).select("slot", F.array_join(F.flatten("parts.some"), " ").alias("text"))


def targets(sources: DataFrame, total: float, most: float) -> DataFrame:
    """sources (size, weight) with target: total by weight, but never above most * size; the excess is shared anew.

    A level is raised until nothing changes: each round is one aggregate that brings three numbers to the driver.
    """
    cap, level, stopped = F.col("size") * F.lit(float(most)), 0.0, -1
    while True:
        above = cap <= F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(above, cap).otherwise(0.0)).alias("caps"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("open"), F.count(F.when(above, 1)).alias("n")).first()
        if row["n"] == stopped or not row["open"]:
            break
        stopped, level = row["n"], max(0.0, total - row["caps"]) / row["open"]
    return sources.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")) if row["open"] else cap)


def rank(v: Column, first: Column, n: Column, bits: int) -> Column:
    """How many of first .. first + n - 1 come before v in the order of reversed bits."""
    out = F.lit(0).cast("long")
    for p in range(bits):
        low = v.bitwiseAND(F.lit((1 << p) - 1))  # before v: the same low p bits, and bit p is 0 where v has 1
        upto = lambda x: F.shiftright(x - 1 - low, p + 1)  # noqa: B023,E731
        out = out + F.when(F.shiftright(v, p).bitwiseAND(F.lit(1)) == 1, upto(first + n) - upto(first)).otherwise(0)
    return out


def schedule(sources: DataFrame, total: int, block: int) -> DataFrame:
    """slot (0 to total - 1), src, take (the source's slots before it), block, limit (words that it takes of the block) for each slot."""
    bits = max(1, (total - 1).bit_length())
    dealt = sources.where("slots > 0").select("*", F.explode(F.expr(f"sequence(0, (slots - 1) div {DEALT})")).alias("chunk")).repartition("src", "chunk")
    one = dealt.select("*", F.explode(F.expr(f"sequence(first + chunk * {DEALT}, first + least(slots, (chunk + 1) * {DEALT}) - 1)")).alias("v"))
    ranked = one.withColumns({"slot": rank(F.col("v"), F.lit(0).cast("long"), F.lit(total).cast("long"), bits), "take": rank(F.col("v"), F.col("first"), F.col("slots"), bits)})
    last = F.expr("words - (words div size) * size - (take - (words div size) * blocks) * " + str(block))  # of the pass that isn't whole
    limit = F.when(F.col("take") < F.expr("(words div size) * blocks"), F.lit(block).cast("long")).otherwise(F.least(F.lit(block).cast("long"), last))
    return ranked.select("slot", "src", "take", F.expr("take % blocks").alias("block"), limit.alias("limit"))


def blocks(documents: DataFrame, block: int) -> DataFrame:
    """src, block, offset (words in the block before), row_id, doc_id, start (words of the document before), words for each piece."""
    each = documents.where("size > 0").select("src", "row_id", "doc_id", "size", F.col("start").alias("at"), F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    begin, end = F.greatest(F.col("at"), F.col("block") * block), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    return each.select("src", "block", (begin - F.col("block") * block).alias("offset"), "row_id", "doc_id", (begin - F.col("at")).alias("start"), (end - begin).alias("words"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, key: str = KEY) -> Mix:
    """A mix of docs (doc_id, text, source) of share times all their words.

    weights: of the sources in order, repeated; most: how often a document may be taken; block: words a slot; key: of the shuffle.
    """
    if min(weights) <= 0 or not 0 <= share <= most or block < 1:
        raise ValueError("weights and block must be positive, and share at most most")
    name = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # null sorts first here, and is put last below
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{key}")))
    sized = materialise(
        docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), name.alias("name"), F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"), order.alias("order")),
        "sized",
    )
    found = numbered(sized.groupBy("name").agg(F.count("*").alias("n"), F.sum("size").alias("size")), [F.col("name") == "", F.col("name")], "src")
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    found = materialise(found.withColumn("weight", turn), "sources")
    size = found.agg(F.sum("size")).first()[0] or 0
    aimed = targets(found, share * size, most).withColumn("words", F.round("target").cast("long"))
    aimed = aimed.withColumn("blocks", F.expr(f"(size + {block - 1}) div {block}"))
    aimed = aimed.withColumn("slots", F.when(F.col("size") > 0, F.expr(f"(words div size) * blocks + (words % size + {block - 1}) div {block}")).otherwise(0).cast("long"))
    aimed = aimed.withColumn("buckets", F.expr(f"(n + {TOGETHER - 1}) div {TOGETHER}"))
    row = found.agg(F.count("*").alias("n"), F.max("n").alias("most")).first()
    sources = materialise(before(aimed, [], "src", "slots", row["n"], "first"), "sources")
    total = sources.agg(F.sum("slots")).first()[0] or 0

    known = sources.select("name", "src", "target", "buckets", F.col("size").alias("source_size"), "n")
    bucket = F.expr("conv(substr(order, 1, 8), 16, 10) * buckets div 4294967296")  # follows the order
    placed = lookup(sized, known, "name", "n").withColumn("bucket", bucket)
    own = Window.partitionBy("src", "bucket").orderBy("order", "doc_id", "size", "row_id").rowsBetween(Window.unboundedPreceding, -1)
    inner = placed.withColumn("inner", F.coalesce(F.sum("size").over(own), F.lit(0)))
    sums = before(materialise(placed.groupBy("src", "bucket").agg(F.sum("size").alias("words")), "bucket-words"), ["src"], "bucket", "words", -(-(row["most"] or 0) // TOGETHER), "outer").drop("words")
    documents = inner.join(sums, ["src", "bucket"]).select("row_id", "doc_id", "size", "source_size", "target", "src", (F.col("outer") + F.col("inner")).alias("start"))
    documents = materialise(documents, "placed")
    return Mix(documents, sources.withColumn("source", F.when(F.col("name") != "", F.expr("substr(name, 2)"))).drop("name", "n", "buckets"), schedule(sources, total, block), blocks(documents, block))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).taken().select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(source, chr(1114111)) AS s, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS k FROM documents
), n AS (
  SELECT s, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY s) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM d GROUP BY s
), r AS (
  SELECT *, 2 * source_size / w AS full_at, sum(source_size) OVER () AS whole,
    coalesce(sum(2 * source_size) OVER o, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS rest
  FROM n WINDOW o AS (ORDER BY 2 * source_size / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (SELECT max((1.5 * whole - capped) / rest) AS lam FROM r WHERE (1.5 * whole - capped) / rest <= full_at),
t AS (SELECT s, source_size, least(2 * source_size, lam * w)::DOUBLE AS target FROM r, level),
p AS (
  SELECT doc_id, size, source_size, target, round(target)::BIGINT AS words,
    coalesce(sum(size) OVER (PARTITION BY s ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t USING (s)
)
SELECT doc_id, size::BIGINT AS size, source_size, round(target, 6) AS target,
  CASE WHEN source_size = 0 THEN 0 ELSE (words // source_size) * size + greatest(0, least(size, words % source_size - start)) END::BIGINT AS taken FROM p
"""
