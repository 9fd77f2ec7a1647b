"""Exact dedup by a persistent digest index.

The index is a table bucketed and sorted by digest. New rows are reduced to one for each
digest, go through a sort-merge anti-join with the index, and what is new is appended.
DataFrame operations only.

A batch may be named. When it runs again, for instance because a job died before its rows were written, what it
brought before counts no more, so that it keeps the same rows: each run of a batch is put down under a name of its own, the
index notes which run of a named batch is the last one, and readers leave the earlier ones out.

Texts are equal when they are identical after lower-casing A-Z. Of equal new rows the one
with the largest doc_id stays (a null doc_id counts as smallest; of repeated rows with the
same doc_id any one stays); rows whose text an earlier batch brought are all dropped. Null
texts count as empty. Empty tables give empty results; other columns are left alone.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import exists, free, lookup, lower_ascii, materialise, new_path, read_text, table, text_of, write_text


def digest(column: str = "text"):
    """SHA-256 of the normalised text's UTF-8 bytes, 32 bytes."""
    return F.unhex(F.sha2(lower_ascii(text_of(column)), 256))


#: Holds the number of buckets; readers of the folder skip names with an underscore.
MANIFEST = "_digest_index.json"
#: Runs that don't count any more; beside it _batches has the last run of each named batch.
REPLACED = "_replaced.json"
NAME = re.compile(r"[A-Za-z0-9_-][A-Za-z0-9_.-]{0,99}")
SCHEMA = "digest BINARY, keep_id BIGINT, keep_row BIGINT, group_size BIGINT, batch STRING"


class DigestIndex:
    """Digests seen so far: digest, keep_id, keep_row, group_size, batch; bucketed by digest.

    The number of buckets is stored in the index's folder when it is made. A path that holds an
    index is opened again with that number, whatever the session's settings; asking for another
    is an error, and so is a folder of data without the number. close() forgets the session's
    table; the data stay.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = (path or new_path(spark, "digest-index")).rstrip("/")
        made = read_text(spark, f"{self.path}/{MANIFEST}")
        if made is None:
            if exists(spark, self.path) and not spark.read.schema(SCHEMA).parquet(self.path).isEmpty():
                raise ValueError(f"{self.path} holds data but no {MANIFEST}")
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            write_text(spark, f"{self.path}/{MANIFEST}", json.dumps({"buckets": self.buckets}))
        else:
            self.buckets = int(json.loads(made)["buckets"])
            if buckets not in (None, self.buckets):
                raise ValueError(f"{self.path} has {self.buckets} buckets, not {buckets}")
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({SCHEMA}) USING parquet OPTIONS (path '{self.path}') CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS")

    def close(self) -> None:
        """Drops the session's name of the table; DataFrames that were made of it go on."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _replaced(self) -> list[str]:
        """Runs of named batches that a later run replaced."""
        return json.loads(read_text(self.spark, f"{self.path}/{REPLACED}") or "[]")

    def read(self) -> DataFrame:
        gone, rows = self._replaced(), self.spark.table(self.name)
        return rows.where(~F.col("batch").isin(gone)) if gone else rows

    def _begin(self, batch: str | None) -> str:
        """A name for a run; of a named batch, the run before it is put among the replaced ones first, whether it came to its end or not."""
        run = uuid.uuid4().hex
        if batch is None:
            return run
        if not NAME.fullmatch(batch):
            raise ValueError(f"batch {batch!r}: letters, digits, dots, dashes and underscores are allowed")
        note = f"{self.path}/_batches/{batch}"
        before = read_text(self.spark, note)
        if before is not None:
            write_text(self.spark, f"{self.path}/{REPLACED}", json.dumps([*self._replaced(), before]))
        write_text(self.spark, note, run := f"{batch}@{run}")
        return run

    def add(self, rows: DataFrame, batch: str | None = None) -> str:
        """Appends the digests of rows (doc_id, row_id, digest) that the index hasn't from other batches; returns the run's name."""
        run = self._begin(batch)
        best = F.max(F.struct("doc_id", F.negative("row_id").alias("r")))
        # written first: else the anti-join would be pushed below the aggregate, and a hot digest's rows would meet in one task
        mine = materialise(rows.groupBy("digest").agg(best.alias("m"), F.count("*").alias("group_size")), "batch-digests")
        fresh = mine.join(self.read().select("digest").hint("merge"), "digest", "left_anti")
        out = fresh.select("digest", F.col("m.doc_id").alias("keep_id"), F.negative("m.r").alias("keep_row"), "group_size", F.lit(run).alias("batch"))
        out.repartition(self.buckets, "digest").write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)
        return run


def mark(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """One row for each of docs: doc_id, digest, keep_id, group_size, kept.

    group_size counts the batch that brought the text first.
    """
    own = index or DigestIndex(docs.sparkSession)
    rows = materialise(docs.select("doc_id", digest().alias("digest"), F.monotonically_increasing_id().alias("row_id")), "digests")
    batch = own.add(rows, batch)
    found = lookup(rows, own.read(), "digest", "group_size")
    if not index:
        own.close()
    kept = (F.col("batch") == batch) & (F.col("row_id") == F.col("keep_row"))
    return found.select("doc_id", "digest", "keep_id", "group_size", kept.alias("kept"))


def dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of docs that stay, with all their columns, whatever these are called. batch: a name under which the same rows may come again."""
    own = index or DigestIndex(docs.sparkSession)
    names = docs.columns
    batch = own.add(docs.select("doc_id", digest().alias("digest"), F.lit(0).cast("long").alias("row_id")), batch)
    key, keep, size, brought = (free(names, n) for n in ("__digest", "__keep", "__size", "__batch"))
    keyed = docs.select(digest().alias(key), *[F.col(f"`{c}`") for c in names])
    ours = own.read().select(F.col("digest").alias(key), F.col("keep_id").alias(keep), F.col("group_size").alias(size), F.col("batch").alias(brought))
    found = lookup(keyed, ours, key, size).where(F.col("doc_id").eqNullSafe(F.col(keep)) & (F.col(brought) == batch))
    if not index:
        own.close()
    return found.dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in names])


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mark(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
