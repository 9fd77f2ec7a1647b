"""Intermediates in the folder that driver and executors share, and how to clear them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Intermediates of this process, and the run that each belongs to.
_written: dict[str, str] = {}
_run: ContextVar[str] = ContextVar("run", default="")
#: Bytes of the batches that index builds send to Python, and how Spark calls that; who is at it, by session, and what held before.
BATCH_BYTES, BATCH_CONF = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
_lock, _at_it = threading.Lock(), {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    return f"file://{_own_folder()}"


@lru_cache(maxsize=1)
def _own_folder() -> str:
    """A folder of this process, which goes when it ends."""
    path = tempfile.mkdtemp(prefix="lodeseek-shared-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, so a lost
    executor costs a reread and not the work before it."""
    path = new_path(df.sparkSession, label)
    _written[path] = _run.get()
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._lodeseek_path = path
    return out


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Meanwhile the session's jobs send Python batches of few bytes: each task holds one several times over, in the JVM's buffers and in its worker."""
    with _lock:
        n, before = _at_it.get(id(spark), (0, None))
        if not n:
            before = spark.conf.get(BATCH_CONF, None)
            spark.conf.set(BATCH_CONF, f"{BATCH_BYTES}b")
        _at_it[id(spark)] = n + 1, before
    try:
        yield
    finally:
        with _lock:
            n, before = _at_it.pop(id(spark))
            if n > 1:
                _at_it[id(spark)] = n - 1, before
            elif before is None:
                spark.conf.unset(BATCH_CONF)
            else:
                spark.conf.set(BATCH_CONF, before)


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)


def discard(df: DataFrame) -> None:
    """Deletes what materialise() wrote for df; df must not be read afterwards."""
    remove(df.sparkSession, df._lodeseek_path)
    _written.pop(df._lodeseek_path, None)


def mark() -> str:
    """Begins a run: what this thread writes from now on belongs to it, for clear()."""
    _run.set(uuid.uuid4().hex)
    return _run.get()


def clear(spark: SparkSession, run: str | None = None, keep: Iterable[DataFrame] = ()) -> int:
    """Deletes the intermediates of a run, or all of this process, but for those of keep; returns how many went. Other runs' stay.

    Results are lazy: what hasn't been written or counted yet must be in keep, or can't be read any more.
    """
    stay = {d._lodeseek_path for d in keep}
    gone = [p for p, own in list(_written.items()) if run in (None, own) and p not in stay]
    for p in gone:
        remove(spark, p)
        _written.pop(p, None)
    return len(gone)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or null where there is none."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """Writes a small file under another name and moves it into place."""
    fs, p = file_system(spark, path)
    if not overwrite and fs.exists(p):
        raise FileExistsError(path)
    own = spark._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}-{uuid.uuid4().hex}")
    stream = fs.create(own, True)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    if overwrite:
        fs.delete(p, False)
    if not fs.rename(own, p):
        raise OSError(f"{path} can't be written")


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)
