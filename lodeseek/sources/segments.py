"""Tables in segments: a change writes a small segment and names the keys that it replaces, and reads nothing else.

A segment is a folder of rows in each of the tables, written once, and of tombstones: keys of which no
earlier segment's rows count any more. Which segments there are, and sums over their rows that
need no reading, stands in a list beside them, a file for each version; readers of another version aren't disturbed until
vacuum() deletes what the last one doesn't name. A version can bear the number of the batch that made it, so that a
batch that runs again starts from the version before it.

Segments of like size are merged once there are FAN of them at the end of the list: a row is written again a
number of times that grows with the logarithm of what follows it, and a reader meets a few segments for each size. Merging drops
rows that a later segment replaced, and the tombstones with them where nothing is left that they could hit. A first
segment may be a DataFrame from elsewhere (a base), which is read as it is until it is merged.
"""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import file_system, read_text, remove, small_batches, write_text

SEGMENT, DEAD = "__segment", "__dead"
#: Segments of like size that are merged; tombstones that may be broadcast; keys whose rows are one file.
FAN, BROADCAST_ROWS, SMALL = 8, 200_000, 2000


@dataclass
class Segment:
    """id: the folder's number; rows: keys that it brought; dead: its tombstones; sums: what a table adds up to, by name."""

    id: int
    rows: int
    dead: int = 0
    sums: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Table:
    """Rows with __key, which tombstones can hit, or without (summed: rows of all segments add up, and merging adds those with equal other columns)."""

    schema: T.StructType
    order: tuple[str, ...]
    summed: tuple[str, ...] = ()


def loose(t: T.DataType) -> T.DataType:
    """t, with nulls allowed everywhere, as files have it."""
    if isinstance(t, T.ArrayType):
        return T.ArrayType(loose(t.elementType))
    if isinstance(t, T.MapType):
        return T.MapType(loose(t.keyType), loose(t.valueType))
    return T.StructType([T.StructField(f.name, loose(f.dataType)) for f in t]) if isinstance(t, T.StructType) else t


class Segments:
    """tables by name, under path. base: rows of the one table that there is, from elsewhere, older than all segments."""

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, Table], base: DataFrame | None = None, version: int | None = None):
        self.spark, self.path, self.base = spark, path.rstrip("/"), base
        self.tables = {k: Table(loose(t.schema), t.order, t.summed) for k, t in tables.items()}
        self.open(version)

    # versions

    def _names(self, path: str) -> list[str]:
        fs, p = file_system(self.spark, path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def versions(self) -> list[int]:
        return sorted(int(x[6:-5]) for x in self._names(self.path) if x.startswith("_live-") and x.endswith(".json"))

    def _list(self, version: int) -> dict:
        text = read_text(self.spark, f"{self.path}/_live-{version}.json")
        if text is None:
            raise ValueError(f"{self.path} has no version {version}")
        return json.loads(text)

    def open(self, version: int | None = None) -> None:
        """A version, or the last one."""
        known = self.versions()
        self.last = known[-1] if known else -1
        self.version = self.last if version is None else version
        held = self._list(self.version) if self.version >= 0 else {"segments": [], "batch": None}
        self.segments, self.batch = [Segment(**s) for s in held["segments"]], held["batch"]

    def _earlier(self, batch: int) -> int | None:
        """The last version that no batch from this number on has made."""
        return next((v for v in reversed(self.versions()) if (made := self._list(v)["batch"]) is None or made < batch), None)

    def before(self, batch: int) -> None:
        """Opens the version that a batch of this number starts from."""
        found = self._earlier(batch)
        if found is None and self.versions():
            raise ValueError(f"{self.path} has no version from before batch {batch}")
        self.open(found)

    def _commit(self, segments: list[Segment], batch: int | None) -> None:
        version = self.last + 1
        write_text(self.spark, f"{self.path}/_live-{version}.json", json.dumps({"segments": [asdict(s) for s in segments], "batch": batch}))
        self.segments, self.version, self.last, self.batch = segments, version, version, batch

    def vacuum(self) -> None:
        """Deletes versions but the open one and the one before its batch, which may have to run again, and segments that neither names."""
        earlier = None if self.batch is None else self._earlier(self.batch)
        keep = {self.version} | ({earlier} if earlier is not None else set())
        used = {s["id"] for v in keep if v >= 0 for s in self._list(v)["segments"]}
        for v in self.versions():
            if v not in keep:
                remove(self.spark, f"{self.path}/_live-{v}.json")
        for t in (*self.tables, DEAD):
            for x in self._names(f"{self.path}/{t}"):
                if x.startswith(f"{SEGMENT}=") and int(x.partition("=")[2]) not in used:
                    remove(self.spark, f"{self.path}/{t}/{x}")

    # rows

    def sums(self) -> dict[str, float]:
        """What all segments add up to."""
        out: dict[str, float] = {}
        for s in self.segments:
            for k, n in s.sums.items():
                out[k] = out.get(k, 0) + n
        return out

    def rows(self) -> int:
        """Keys that the segments brought, replaced ones too; without a base."""
        return sum(s.rows for s in self.segments)

    def _scan(self, table: str, schema: T.StructType, segments: list[Segment]) -> DataFrame | None:
        held = [s for s in segments if (s.dead if table == DEAD else s.rows or self.tables[table].summed)]
        if not held:
            return None
        root = f"{self.path}/{table}"
        full = T.StructType([*schema, T.StructField(SEGMENT, T.IntegerType())])
        return self.spark.read.schema(full).option("basePath", root).parquet(*[f"{root}/{SEGMENT}={s.id}" for s in held])

    def dead(self, segments: list[Segment] | None = None) -> DataFrame | None:
        """__key and SEGMENT of the tombstones; broadcast where they are known to be few."""
        own = self.segments if segments is None else segments
        found = self._scan(DEAD, T.StructType().add("__key", T.StringType()), own)
        return F.broadcast(found) if found is not None and sum(s.dead for s in own) <= BROADCAST_ROWS else found

    def read(self, table: str, segments: list[Segment] | None = None, base: bool = True) -> DataFrame:
        """The rows that count, with SEGMENT: one scan and one anti-join, however many segments there are."""
        own, spec = self.segments if segments is None else segments, self.tables[table]
        full = T.StructType([*spec.schema, T.StructField(SEGMENT, T.IntegerType())])
        out, dead = self._scan(table, spec.schema, own), self.dead(own) if "__key" in spec.schema.names else None
        if dead is not None:
            gone = dead.select(F.col("__key").alias("__of"), F.col(SEGMENT).alias("__till"))
            if out is not None and len(own) > 1:
                out = out.join(gone, (F.col("__key") == F.col("__of")) & (F.col(SEGMENT) < F.col("__till")), "left_anti")
        if self.base is not None and base:
            first = self.base if dead is None else self.base.join(gone, F.col("__key") == F.col("__of"), "left_anti")
            first = first.select(*[F.col(f"`{f.name}`") for f in spec.schema], F.lit(-1).alias(SEGMENT))
            out = first if out is None else first.unionByName(out)
        return out if out is not None else self.spark.createDataFrame([], full)

    # changes

    def _write(self, table: str, rows: DataFrame, id_: int, order: tuple[str, ...], files: int | None) -> None:
        """files: how many, 0 for a sorted one of each part as it is dealt, or null for ranges of the order, as many as the size asks for."""
        held = rows.coalesce(files) if files else rows.repartitionByRange(*order) if files is None else rows
        held.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{table}/{SEGMENT}={id_}")

    def _typed(self, table: str, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.tables[table].schema])

    def ahead(self, table: str, rows: DataFrame, n: int, dead: int) -> DataFrame:
        """Writes a table's rows of the segment that append() makes next, with its n and dead, each part sorted as it is dealt; the rows, read back."""
        spec, own = self.tables[table], Segment(self.last + 1, n, dead)
        if not n and not spec.summed:
            return self.spark.createDataFrame([], spec.schema)
        with small_batches(self.spark):
            self._write(table, self._typed(table, rows), own.id, spec.order, 1 if n + dead <= SMALL else 0)
        return self._scan(table, spec.schema, [own]).drop(SEGMENT)

    def append(self, rows: dict[str, DataFrame], gone: DataFrame | None, n: int, dead: int, sums: dict[str, float] | None = None, batch: int | None = None, dealt: tuple[str, ...] = ()) -> None:
        """A segment of n keys' rows in each table, and of dead tombstones (gone: __key) for what earlier segments hold of these keys.

        Rows of the tables dealt are sorted in each part alone; others go by ranges.
        """
        id_ = self.last + 1
        small = n + dead <= SMALL
        files, due = 1 if small else None, []
        for t, df in rows.items():
            spec = self.tables[t]
            if n or spec.summed:
                due.append((t, self._typed(t, df), id_, spec.order, 0 if t in dealt and not small else files))
        if dead:
            due.append((DEAD, gone.select("__key"), id_, ("__key",), files))
        with ThreadPoolExecutor(max(1, len(due))) as side_by_side:
            list(side_by_side.map(lambda x: self._write(*x), due))
        self._commit([*self.segments, Segment(id_, n, dead, sums or {})], self.batch if batch is None else batch)

    def due(self) -> int:
        """How many of the last segments should be merged: those no larger than the last one's size class, once they are FAN."""
        size = lambda s: int(math.log(max(s.rows + s.dead, FAN), FAN))
        tail = 0
        for s in reversed(self.segments):
            if size(s) > size(self.segments[-1]):
                break
            tail += 1
        return tail if tail >= FAN else 0

    def merge(self, last: int | None = None, base_rows: int | None = None) -> None:
        """Writes the last segments, or all of them and the base, as one."""
        own = self.segments if last is None else self.segments[-last:]
        rest = self.segments[: len(self.segments) - len(own)]
        whole = last is None and self.base is not None
        id_, n = self.last + 1, sum(s.rows for s in own) + (base_rows or 0)
        small = n <= SMALL and not whole
        for t, spec in self.tables.items():
            rows = self.read(t, own, base=whole).drop(SEGMENT)
            if spec.summed:
                rows = rows.groupBy(*[c for c in spec.schema.names if c not in spec.summed]).agg(*[F.sum(c).alias(c) for c in spec.summed])
                rows = rows.where(" OR ".join(f"`{c}` <> 0" for c in spec.summed)).select(*spec.schema.names)
            self._write(t, rows, id_, spec.order, 1 if small else None)
        dead = 0
        if rest or self.base is not None and not whole:
            gone = self.dead(own)
            dead = sum(s.dead for s in own)
            if gone is not None:
                self._write(DEAD, gone.select("__key").distinct(), id_, ("__key",), 1 if dead <= SMALL else None)
        sums: dict[str, float] = {}
        for s in own:
            for k, x in s.sums.items():
                sums[k] = sums.get(k, 0) + x
        if whole:
            self.base = None
        self._commit([*rest, Segment(id_, n, dead, sums)], self.batch)

    def tidy(self) -> None:
        """Merges while it is due."""
        while k := self.due():
            self.merge(k)
