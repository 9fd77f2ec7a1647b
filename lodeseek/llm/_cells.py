"""Members of cells, dealt so that no task gets a cell that grows with the data, and forests of their links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise


def parted(cells: DataFrame, keys: list[str], member: str, limit: int) -> DataFrame:
    """cells, in order of keys and the new column part (long) within partitions.

    A cell of at most limit rows is one part. A larger one is split in blocks by the member's hash,
    and each pair of blocks is a part: every two members still meet in one.
    """
    large = materialise(cells.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > limit), "large-cells")
    names = cells.columns
    out = cells.withColumn("part", F.lit(0).cast("long"))
    if not large.isEmpty():
        dealt = cells.join(large, keys).withColumn("blocks", F.ceil(F.col("n") / limit).cast("long")).withColumn("mine", F.pmod(F.xxhash64(member), F.col("blocks")))
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.least(o, F.col("mine")) * F.col("blocks") + F.greatest(o, F.col("mine")))
        dealt = dealt.select(*names, F.explode(pairs).alias("part"))
        out = out.join(large.select(*keys), keys, "left_anti").select(*names, "part").unionByName(dealt)
    return out.repartition(*keys, "part").sortWithinPartitions(*keys, "part")


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of rows that come sorted by long keys; a group may go on in the next batch. Groups of one are left out."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([*held, b]).combine_chunks()
        k = np.column_stack([t.column(c).to_numpy() for c in keys])
        cut = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        start, stop = np.r_[0, cut], np.r_[cut, len(k)]
        for s, e in zip(start[:-1].tolist(), stop[:-1].tolist()):
            if e - s > 1:
                yield t.slice(s, e - s)
        held = t.slice(int(start[-1])).to_batches()
    t = pa.Table.from_batches(held) if held else None
    if t is not None and t.num_rows > 1:
        yield t


def whole(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 1 << 18) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of about rows rows that hold whole groups, with each group's start and stop; rows come sorted by long keys."""
    held: list[pa.RecordBatch] = []
    size = 0

    def cuts(t: pa.Table) -> np.ndarray:
        k = np.column_stack([t.column(c).to_numpy() for c in keys])
        return np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1]

    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.num_rows
        if size >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            start = cuts(t)
            if len(start) > 1:
                last = int(start[-1])
                yield t.slice(0, last), start[:-1], start[1:]
                t = t.slice(last)
            held, size = t.to_batches(), 0  # a long group is looked at again only when as many rows have come on top
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        start = cuts(t)
        yield t, start, np.r_[start[1:], t.num_rows]


def spanning(n: int, i: np.ndarray, j: np.ndarray, root: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links (i, j) among n members; root: components so far, which it brings up to date."""
    root = np.arange(n) if root is None else root
    out: list[tuple[np.ndarray, np.ndarray]] = []
    open_ = root[i] != root[j]
    i, j = i[open_], j[open_]
    while len(i):
        hi, lo = np.maximum(root[i], root[j]), np.minimum(root[i], root[j])
        order = np.lexsort((lo, hi))
        hi, lo = hi[order], lo[order]
        first = np.r_[True, hi[1:] != hi[:-1]]
        root[hi[first]] = lo[first]  # each root hooks on a smaller one
        out.append((hi[first], lo[first]))
        while (root[root] != root).any():
            root[:] = root[root]
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2


def forest(n: int, near: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) of a spanning forest of the links among n members; near(rows): links of these members with all.

    Links within the largest component so far can't join anything, so only members outside it are compared with
    all, some at a time, and what they join needn't be any more. A tight group costs a few rows of its pairs.
    """
    root, done, many, edges = np.arange(n), np.zeros(n, dtype=bool), 1, []
    while True:
        rest = np.flatnonzero((root != np.bincount(root).argmax()) & ~done)
        if not len(rest):
            break
        rows = rest[np.unique(np.linspace(0, len(rest) - 1, min(many, len(rest))).astype(np.int64))]
        i, j = np.nonzero(near(rows))
        edges.append(spanning(n, rows[i], j, root))
        done[rows] = True
        many = min(2 * many, max(1, (1 << 21) // n))
    return tuple(np.concatenate(x) for x in zip(*edges)) if edges else (np.zeros(0, np.int64),) * 2
