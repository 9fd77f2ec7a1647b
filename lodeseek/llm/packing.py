"""Packs tokenised documents into fixed-length sequences by cutting-stock column generation.

A document's ids are cut into pieces of the whole length, each a sequence of its own, and one
shorter rest. Rests are counted in units of UNIT tokens, rounded up; of rests of FINE tokens or less,
as many of one length go together as fill whole units, so that short ones leave no room unused. A
linear program over patterns (how many items of each size go in a sequence) is solved on that
histogram, of at most length / UNIT numbers: its columns are priced by a knapsack dynamic program. Patterns
are used a rounded-down number of times, what is left goes first-fit in decreasing length.
Rests are ranked within their length, and each pattern takes the next ranks of its lengths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import materialise, table, text_of
from ._tokens import ids_of

LENGTH, FINE, UNIT, END = 1024, 64, 8, 0
#: Ranks within a kind are given in so many strands at once.
STRANDS = 256
VOCABULARY = "byte_bpe_50k.json"


def best_pattern(price: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of sizes within room."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for r in range(1, room + 1):
        best[r] = best[r - 1]
        fit = np.searchsorted(sizes, r, side="right")
        if fit:
            v = best[r - sizes[:fit]] + price[:fit]
            k = int(v.argmax())
            if v[k] > best[r] + 1e-12:
                best[r], took[r] = v[k], k
    use, r = np.zeros(len(sizes)), room
    while r > 0:
        if took[r] < 0:
            r -= 1
        else:
            use[took[r]] += 1
            r -= sizes[took[r]]
    return float(best[room]), use


def solve(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 2e-4, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used, a basic solution of the linear program.

    Revised simplex. The sum of uses over the best column's value bounds the optimum from below, so
    the search stops within gap of it; each basis is feasible, so stopping after rounds costs only
    optimality. Demands are moved by less than a thousandth, as ties let the simplex run in circles.
    """
    m = len(sizes)
    demand = demand + np.random.default_rng(1).random(m) * 1e-3
    basis = np.diag(np.maximum(1, room // sizes).astype(float))
    inverse = np.diag(1 / np.diag(basis))
    x = inverse @ demand
    for _ in range(rounds):
        value, use = best_pattern(inverse.sum(axis=0), sizes, room)
        if value <= 1 + gap:
            break
        d = inverse @ use
        ratio = np.where(d > 1e-9, x / np.where(d > 1e-9, d, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * d, 0)
        x[out] = ratio[out]
        basis[:, out] = use
        row = inverse[out] / d[out]
        inverse -= np.outer(d, row)
        inverse[out] = row
    return basis, x


@dataclass
class Plan:
    """Segments of ranks by size: ranks start..stop-1 of a size go, each at a time, to sequences from first on."""

    size: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    each: np.ndarray
    first: np.ndarray
    sequences: int


def plan(histogram: dict[int, int], room: int) -> Plan:
    """Which ranks of which size go to which sequence; histogram: number of rests by size in 1..room."""
    sizes = np.array(sorted(s for s, n in histogram.items() if n > 0), dtype=np.int64)
    demand = np.array([histogram[s] for s in sizes.tolist()], dtype=np.int64)
    used: list[tuple[np.ndarray, int]] = []
    left = demand.copy()
    if len(sizes):
        patterns, x = solve(sizes, demand.astype(float), room)
        for p in np.argsort(-x):
            use = np.rint(patterns[:, p]).astype(np.int64)
            times = min([int(x[p] + 1e-9), *(left[use > 0] // use[use > 0]).tolist()])
            if times > 0:
                used.append((use, times))
                left -= times * use
    open_: list[tuple[int, np.ndarray]] = []
    for k in range(len(sizes) - 1, -1, -1):
        for _ in range(int(left[k])):
            at = next((i for i, (r, _) in enumerate(open_) if r >= sizes[k]), None)
            if at is None:
                open_.append((room, np.zeros(len(sizes), dtype=np.int64)))
                at = len(open_) - 1
            r, use = open_[at]
            use[k] += 1
            open_[at] = (r - int(sizes[k]), use)
    used += [(use, 1) for _, use in open_]
    done, first, rows = np.zeros(len(sizes), dtype=np.int64), 0, []
    for use, times in used:
        for k in np.flatnonzero(use):
            rows.append((sizes[k], done[k], done[k] + times * use[k], use[k], first))
        done += times * use
        first += times
    rows.sort(key=lambda r: (r[0], r[1]))
    return Plan(*(np.array([r[i] for r in rows], dtype=np.int64) for i in range(5)), first)


def kind_of(length: Column) -> Column:
    """Rests that are alike to the plan: those of one length up to FINE, those of as many units above."""
    return F.when(length <= FINE, length).otherwise(F.ceil(length / UNIT) + FINE).cast("long")


def items(counts: dict[int, int], room: int) -> tuple[dict[int, int], np.ndarray]:
    """Number of items by units, and segments (kind, first rank, rests an item, units, first item); counts: number of rests by kind."""
    demand: dict[int, int] = {}
    rows = []

    def add(kind: int, first: int, each: int, units: int, n: int) -> None:
        if n:
            rows.append((kind, first, each, units, demand.get(units, 0)))
            demand[units] = demand.get(units, 0) + n

    for kind, n in sorted(counts.items()):
        if kind > FINE:
            add(kind, 0, 1, kind - FINE, n)
            continue
        each = UNIT // math.gcd(kind, UNIT)
        whole = n // each if kind * each // UNIT <= room else 0
        add(kind, 0, each, kind * each // UNIT, whole)
        add(kind, whole * each, 1, -(-kind // UNIT), n - whole * each)
    return demand, np.array(rows, dtype=np.int64).reshape(-1, 5)


def cut(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """A row for each piece: uid (unique), doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uid = TaskContext.get().partitionId() << 33
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text")):
                    ids = ids_of(path, public_tokenizers.PATTERN, text.as_py(), end)
                    for s in range(0, len(ids), length):
                        piece = ids[s : s + length]
                        rows.append((uid, doc_id, s, len(piece), len(ids), piece.tobytes()))
                        uid += 1
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["uid", "doc_id", "start", "length", "doc_tokens", "ids"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return kept.mapInArrow(run, "uid long, doc_id long, start long, length long, doc_tokens long, ids binary")


def pack(docs: DataFrame, path: str, length: int = LENGTH, payload: Column | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset and payload.

    payload is made of a piece's columns before it travels; without it, ids. Null texts count
    as empty (one piece with the end id alone), null doc_ids stay null, repeated rows are packed
    each for itself, an empty table gives no rows. A piece of length is a sequence of its own;
    sequence ids are unique, not dense. length is a multiple of UNIT.
    """
    if length % UNIT:
        raise ValueError(f"length must be a multiple of {UNIT}")
    spark = docs.sparkSession
    carried = (F.col("ids") if payload is None else payload).alias("payload")
    pieces = materialise(cut(docs, path, length).select("uid", "doc_id", "start", "length", "doc_tokens", carried), "pieces")
    room, columns = length // UNIT, ("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "payload")
    rests = pieces.where(F.col("length") < length).select("uid", "length", kind_of(F.col("length")).alias("kind"), F.pmod(F.xxhash64("uid"), STRANDS).alias("strand"))
    strands = rests.groupBy("kind", "strand").agg(F.count("*").alias("n"))
    counts = {int(r["kind"]): int(r["n"]) for r in strands.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # FINE + room rows at most
    demand, segments = items(counts, room)
    made = plan(demand, room)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = int(made.stop.max(initial=0)) + 1
        at = made.size * top + made.start
        most = max(counts.values(), default=0) + 1
        kinds = segments[:, 0] * most + segments[:, 1]
        for b in batches:
            kind, rank = (b.column(c).to_numpy() for c in ("kind", "rank"))
            own = segments[np.searchsorted(kinds, kind * most + rank, side="right") - 1]
            size, rank = own[:, 3], own[:, 4] + (rank - own[:, 1]) // own[:, 2]
            k = np.searchsorted(at, size * top + rank, side="right") - 1
            seq = made.first[k] + (rank - made.start[k]) // made.each[k]
            yield pa.record_batch([b.column("uid"), b.column("length"), pa.array(seq)], names=["uid", "length", "sequence_id"])

    # (FINE + room) * STRANDS rows at most
    offsets = F.broadcast(strands.select("kind", "strand", (F.sum("n").over(Window.partitionBy("kind").orderBy("strand")) - F.col("n")).alias("before")))
    local = F.row_number().over(Window.partitionBy("kind", "strand").orderBy("uid")) - 1
    ranked = rests.withColumn("local", local).join(offsets, ["kind", "strand"]).select("uid", "length", "kind", (F.col("local") + F.col("before")).alias("rank"))
    placed = ranked.mapInArrow(place, "uid long, length long, sequence_id long")
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("uid")) - F.col("length")
    where = placed.select("uid", "sequence_id", before.alias("offset"))
    part = pieces.where(F.col("length") < length).join(where, "uid").select(*columns)
    whole = pieces.where(F.col("length") == length).withColumns({"sequence_id": F.col("uid") + made.sequences, "offset": F.lit(0).cast("long")}).select(*columns)
    return whole.unionByName(part)


def sequences(packed: DataFrame, length: int = LENGTH, pad: int = END) -> DataFrame:
    """sequence_id and ids (length numbers): the pieces of pack(), with ids as payload, joined and padded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column("parts").to_pylist():
                ids = np.full(length, pad, dtype=np.int32)
                for x in parts:
                    ids[x["offset"] : x["offset"] + x["length"]] = np.frombuffer(x["payload"], dtype="<u4")
                out.append(ids)
            yield pa.record_batch([b.column("sequence_id"), pa.array(out, pa.list_(pa.int32()))], names=["sequence_id", "ids"])

    grouped = packed.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "length", "payload")).alias("parts"))  # at most length pieces
    return grouped.mapInArrow(run, "sequence_id long, ids array<int>")


def digested(docs: DataFrame) -> DataFrame:
    found = pack(docs, public_tokenizers.path(VOCABULARY), payload=F.crc32("ids"))
    return found.withColumnRenamed("payload", "ids_crc32")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(table(spark, sf_dir, "documents"))
