"""SimHash near-dedup by segment popcounts.

A fingerprint's segments of two bits become a point of bit counts. The Manhattan distance of two
points is a lower bound of the fingerprints' Hamming distance: one differing bit moves one count
by one. So fingerprints within a radius lie within that Manhattan distance, and a grid over the
points finds them: points that share a cell are tested by Manhattan distance and then by the
fingerprints themselves.

NARROW is the operator's own kind: 64 bits of three-word shingles, radius 3. Its cells are the
points' projections on all but three of a number of blocks; of these at most three differ, so
every pair within the radius shares a cell and no link is lost. The number of blocks follows the
number of fingerprints, so that cells stay small.

WIDE is for near copies by the usual measure: five-word shingles, similarity 0.8 or more. A
fingerprint has 256 bits, as 64 can't tell such pairs from others, and the radius is RADIUS_WIDE. Its
cells are projections on segments chosen by hash; their number and that of projections follow
the number of fingerprints, for a chance of WIDE_RECALL or more to meet at a similarity of 0.8. Its links are
candidates: near_copies() compares the texts of each group that they make by their sets of shingles, every two of
them that aren't joined yet, and groups are what links of LEAST or more join.

Only distinct fingerprints are joined, and a cell yields the edges of a spanning forest
instead of its pairs. A cell of over CELL_ROWS fingerprints is split in blocks by hash, and
each pair of blocks is a unit of its own, so that no task gets a cell that grows with the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._cells import forest, groups, parted, spanning, whole
from ._common import free, lookup, materialise, table, text_of
from ._graph import components

SEED = 42
CELL_ROWS = 4096
#: Groups of at most so many rows are compared shift by shift, many groups at once.
SMALL = 64
LOW = 0x5555555555555555
RADIUS_WIDE, WIDE_RECALL, WIDE_CELL = 50, 0.98, 32
#: Similarity of near copies, and texts of a group that are compared in one task.
LEAST, GROUP_ROWS = 0.8, 1024


@dataclass(frozen=True)
class Kind:
    """shingle: words; lanes: 64-bit words of a fingerprint; radius: most differing bits of a link."""

    shingle: int
    lanes: int
    radius: int


NARROW, WIDE = Kind(3, 1, 3), Kind(5, 4, RADIUS_WIDE)


def _lanes(h: np.ndarray, lanes: int) -> Iterator[np.ndarray]:
    """h itself, then further hashes made of it."""
    yield h
    with np.errstate(over="ignore"):
        for k in range(1, lanes):
            x = (h ^ np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            yield x ^ (x >> np.uint64(32))


def shingles(text: str, kind: Kind = NARROW) -> np.ndarray:
    """Hashes of the shingles, repeats included; of a text of fewer words that of the whole, none without words."""
    words = text.encode("utf-8", "replace").lower().split()  # ASCII letters and white space only, as bytes have no others
    if not words:
        return np.zeros(0, dtype="<u8")
    if len(words) <= kind.shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        shifted = zip(*(words[i:] for i in range(kind.shingle)))
        hashes = [xxhash.xxh64_intdigest(b" ".join(x), SEED) for x in shifted]
    return np.array(hashes, dtype="<u8")


def lanes_of(text: str, kind: Kind = NARROW) -> np.ndarray:
    """A bit is 1 if it is set in over half of the shingles' hashes, repeats included; 0 without words."""
    hashes = shingles(text, kind)
    if not len(hashes):
        return np.zeros(kind.lanes, dtype="<u8")
    out = []
    for h in _lanes(hashes, kind.lanes):
        ones = np.zeros(64, dtype=np.int64)
        for i in range(0, len(h), 1 << 16):
            ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])
    return np.array(out, dtype="<u8")


def fingerprint(text: str) -> int:
    """The 64 bits of NARROW."""
    return int(lanes_of(text)[0])


def row_key():
    """Names a row by what it says; rows with the same doc_id and text are one."""
    return F.xxhash64(F.col("doc_id").cast("long"), text_of())


def fingerprints(docs: DataFrame, kind: Kind = NARROW) -> DataFrame:
    """doc_id, row_key, text_key and fp (a signed long, or bytes of more lanes than one) for each row; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [lanes_of(t.as_py(), kind) for t in b.column("text")]
            fp = pa.array(np.array(found, dtype="<u8").reshape(-1).view("<i8")) if kind.lanes == 1 else pa.array([x.tobytes() for x in found], pa.binary())
            yield pa.record_batch([b.column("doc_id"), b.column("row_key"), b.column("text_key"), fp], names=["doc_id", "row_key", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row_key"), F.xxhash64(text_of()).alias("text_key"), text_of().alias("text"))
    return rows.mapInArrow(run, f"doc_id long, row_key long, text_key long, fp {'long' if kind.lanes == 1 else 'binary'}")


def _counts(fp):
    """Two-bit segments of fp, each replaced by its number of ones."""
    half = F.shiftrightunsigned(fp, 1)
    return F.shiftleft(fp.bitwiseAND(half).bitwiseAND(LOW), 1).bitwiseOR(fp.bitwiseXOR(half).bitwiseAND(LOW))


def points(fp: np.ndarray) -> np.ndarray:
    """The same for an array."""
    half, low = fp >> np.uint64(1), np.uint64(LOW)
    return ((fp & half & low) << np.uint64(1)) | ((fp ^ half) & low)


def blocks_for(n: int, radius: int = NARROW.radius) -> int:
    """Blocks of segments: the fewest that leave cells of one point or less on average (a segment's count has 1.5 bits), 16 at most."""
    return next((b for b in range(5, 16) if 48 * (b - radius) / b >= math.log2(max(2, n))), 16)


def _masks(blocks: int, radius: int = NARROW.radius) -> list[int]:
    edges = [round(i * 32 / blocks) * 2 for i in range(blocks + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(x) for x in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def projections_for(n: int, recall: float = WIDE_RECALL) -> tuple[int, int]:
    """Segments of a cell, and projections, for n fingerprints of WIDE.

    Counts of two unrelated segments are equal with chance 3/8. At a similarity of 0.8 a bit differs with chance
    0.15, so a segment's counts are equal with chance 0.85^2 + 0.15^2 / 2. Cells have WIDE_CELL unrelated points at most.
    """
    k = max(4, math.ceil(math.log(max(1, n / WIDE_CELL)) / math.log(8 / 3)))
    meet = (0.85**2 + 0.15**2 / 2) ** k
    return k, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def _linked(point: np.ndarray, fp: np.ndarray, i, j, radius: int) -> np.ndarray:
    """Whether members i and j (index arrays that broadcast) are within the radius: Manhattan distance first, then the bits."""
    low = np.uint64(LOW)
    far = 0
    for k in range(fp.shape[1]):
        z = point[i, k] ^ point[j, k]
        lo, hi = z & low, (z >> np.uint64(1)) & low
        far = far + np.bitwise_count(lo).astype(np.int16) + 2 * np.bitwise_count(hi & ~lo)
    found = far <= radius
    at = np.nonzero(found)
    a, b = (np.broadcast_to(x, found.shape)[at] for x in (i, j))
    found[at] = np.bitwise_count(fp[a] ^ fp[b]).sum(axis=1, dtype=np.int64) <= radius
    return found


def _edges(batches: Iterator[pa.RecordBatch], kind: Kind) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Fingerprints at both ends of the edges of each cell's spanning forest."""
    for t, start, stop in whole(batches, ["mask", "cell", "part"]):
        column = t.column("fp").combine_chunks()
        if kind.lanes == 1:
            fp = column.to_numpy().view(np.uint64).reshape(-1, 1)
        else:
            fp = np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, kind.lanes)
        point, size = points(fp), stop - start
        found: list[tuple[np.ndarray, np.ndarray]] = []
        ends = np.repeat(np.where(size <= SMALL, stop, 0), size)  # of small groups' rows
        rows = np.flatnonzero(ends)
        for shift in range(1, min(SMALL, int(size.max(initial=1)))):
            rows = rows[rows + shift < ends[rows]]
            if not len(rows):
                break
            hit = rows[_linked(point, fp, rows, rows + shift, kind.radius)]
            found.append((hit, hit + shift))
        for s, e in zip(start[size > SMALL].tolist(), stop[size > SMALL].tolist()):
            all_ = np.arange(s, e)
            away, root = forest(e - s, lambda r: _linked(point, fp, (s + r)[:, None], all_[None, :], kind.radius))
            found.append((s + away, s + root))
        if found:
            i, j = spanning(len(fp), *(np.concatenate(x) for x in zip(*found)))
            if len(i):
                yield fp[i], fp[j]


def links(distinct: DataFrame, kind: Kind = NARROW, n: int | None = None) -> DataFrame:
    """Edges (a, b) among distinct fingerprints (fp): a forest with the components of the links of at most radius bits.

    Ends are fingerprints of one lane, or the 64-bit hash of longer ones. n: how many there are.
    """
    n = distinct.count() if n is None else n
    if kind.lanes == 1:
        point = _counts(F.col("fp"))
        masks = _masks(blocks_for(n, kind.radius), kind.radius)
        cells = distinct.select("fp", F.posexplode(F.array(*[point.bitwiseAND(m) for m in masks])).alias("mask", "cell"))
        cells = cells.select(F.col("mask").cast("long").alias("mask"), "cell", "fp")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for a, b in _edges(batches, kind):
                yield pa.record_batch([pa.array(a[:, 0].view(np.int64)), pa.array(b[:, 0].view(np.int64))], names=["a", "b"])

        return parted(cells, ["mask", "cell"], "fp", CELL_ROWS).mapInArrow(run, "a long, b long").distinct()

    k, many = projections_for(n)
    rng = np.random.default_rng(SEED)
    picks = [np.sort(rng.choice(32 * kind.lanes, min(k, 32 * kind.lanes), replace=False)) for _ in range(many)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.column("fp").slice(at, 1024)
                fp = np.frombuffer(b"".join(part.to_pylist()), dtype="<u8").reshape(-1, kind.lanes)
                two = np.unpackbits(points(fp).view(np.uint8).reshape(len(fp), -1), axis=1, bitorder="little")
                count = two[:, ::2].astype(np.uint64) + np.uint64(2) * two[:, 1::2]
                for m, pick in enumerate(picks):
                    with np.errstate(over="ignore"):
                        cell = np.zeros(len(fp), dtype=np.uint64)
                        for x in pick.tolist():
                            cell = (cell * np.uint64(3) + count[:, x]) * np.uint64(0x9E3779B97F4A7C15)
                            cell ^= cell >> np.uint64(32)
                    yield pa.record_batch([pa.array(np.full(len(fp), m)), pa.array(cell.view(np.int64)), part], names=["mask", "cell", "fp"])

    def run_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _edges(batches, kind):
            yield pa.record_batch([pa.array([x.tobytes() for x in y], pa.binary()) for y in (a, b)], names=["fa", "fb"])

    cells = distinct.select("fp").mapInArrow(project, "mask long, cell long, fp binary")
    found = parted(cells, ["mask", "cell"], "fp", CELL_ROWS).mapInArrow(run_wide, "fa binary, fb binary")
    return found.select(F.xxhash64("fa").alias("a"), F.xxhash64("fb").alias("b")).distinct()


def _candidates(rows: DataFrame, kind: Kind) -> DataFrame:
    """fp, low (the first row of it), n, root for each fingerprint of rows: a written table."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    node = F.col("fp") if kind.lanes == 1 else F.xxhash64("fp")
    classes = materialise(rows.groupBy("fp").agg(first.alias("low"), F.count("*").alias("n")).withColumn("node", node), "fingerprint-classes")
    roots = components(links(classes.select("fp"), kind, classes.count()), "simhash")
    return materialise(classes.join(roots, "node", "left").select("fp", "low", "n", F.coalesce("root", "node").alias("root")), "fingerprint-roots")


def near_groups(docs: DataFrame, kind: Kind = NARROW) -> DataFrame:
    """doc_id, row_key, fp, component_id, stays for each row of docs.

    component_id is the smallest doc_id of all documents that links of fingerprints reach. Null doc_ids take part
    and are never the smallest; a group of nothing else has a null component_id. stays marks the row
    with that doc_id (rows with the same doc_id and text alike). Repeated rows come out as often as
    they go in; no rows give none.
    """
    rows = materialise(fingerprints(docs, kind), "fingerprints")
    return _named(rows, _candidates(rows, kind), "fp")


def _named(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """rows with component_id and stays. named: key, low, n, root."""
    lowest = materialise(named.groupBy("root").agg(F.min("low").alias("low"), F.count("*").alias("classes")), "fingerprint-lowest")
    keyed = materialise(lookup(named.drop("low"), lowest, "root", "classes").select(key, "n", "low"), "fingerprint-components")
    stays = F.col("row_key") == F.col("low.row_key")
    return lookup(rows, keyed, key, "n").select("doc_id", "row_key", key, F.col("low.doc_id").alias("component_id"), stays.alias("stays"))


def _alike(sets: list[np.ndarray], least: float):
    """For forest(): which of all sets have a similarity (shared to all elements) of least or more to each of some rows."""
    size = np.array([len(x) for x in sets])
    all_, ends = np.concatenate(sets), np.cumsum(size)

    def near(rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), len(sets)), dtype=bool)
        for k, i in enumerate(rows.tolist()):
            own = sets[i]
            if not len(own):
                out[k] = size == 0
                continue
            at = np.minimum(np.searchsorted(own, all_), len(own) - 1)
            upto = np.r_[0, np.cumsum(own[at] == all_)]
            both = upto[ends] - upto[ends - size]
            out[k] = both >= least * (len(own) + size - both)
        return out

    return near


def near_copies(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, row_key, text_key, component_id, stays for each row of docs, as near_groups() has them: of groups that links of texts join.

    Texts are linked if the similarity of their sets of five-word shingles is least or more; a text of fewer words is one
    shingle, texts without words are linked. Candidates are groups of WIDE fingerprints. Within a group every two texts are compared
    but those that are joined already; a large group is split in blocks, and each pair of blocks is a unit of its own.
    """
    rows = materialise(fingerprints(docs, WIDE), "fingerprints")
    named = _candidates(rows, WIDE)
    placed = lookup(rows, named.select("fp", "n", "root"), "fp", "n").select("doc_id", "row_key", "text_key", "root")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key"))
    texts = materialise(placed.groupBy("root", "text_key").agg(first.alias("low"), F.count("*").alias("n")), "near-texts")
    several = texts.groupBy("root").agg(F.count("*").alias("texts")).where("texts > 1")
    chosen = texts.join(several, "root").select(F.col("low.row_key").alias("row_key"), "root", "text_key")
    key = free(docs.columns, "__key")
    met = docs.select(row_key().alias(key), text_of().alias("text")).join(chosen.withColumnRenamed("row_key", key).hint("merge"), key)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(shingles(t.as_py(), WIDE)).tobytes() for t in b.column("text")]
            yield pa.record_batch([b.column("root"), b.column("text_key"), pa.array(found, pa.binary())], names=["root", "text_key", "set"])

    sets = materialise(met.select("root", "text_key", "text").mapInArrow(hashed, "root long, text_key long, set binary").dropDuplicates(["root", "text_key"]), "shingle-sets")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["root", "part"]):
            found = [np.frombuffer(x, dtype="<u8") for x in t.column("set").to_pylist()]
            keys = t.column("text_key").to_numpy()
            away, root = forest(len(found), _alike(found, least))
            if len(away):
                yield pa.record_batch([pa.array(keys[away]), pa.array(keys[root])], names=["a", "b"])

    linked = parted(sets, ["root"], "text_key", GROUP_ROWS).select("root", "part", "text_key", "set").mapInArrow(edges, "a long, b long").distinct()
    roots = components(linked, "near-copies").withColumnRenamed("root", "own")
    final = texts.join(roots, texts["text_key"] == roots["node"], "left").select("text_key", "low", "n", F.coalesce("own", "text_key").alias("root"))
    return _named(rows, materialise(final, "near-roots"), "text_key")


def keep_one(docs: DataFrame, kind: Kind = NARROW) -> DataFrame:
    """The row with the smallest doc_id of each group, with all its columns; of repeated rows one. Groups of WIDE are near_copies()."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    key = free(docs.columns, "__key")
    found = near_copies(docs) if kind == WIDE else near_groups(docs, kind)
    stay = found.where("stays").select(F.col("row_key").alias(key)).distinct()
    return docs.withColumn(key, row_key()).join(stay.hint("merge"), key).dropDuplicates([key]).select(*names)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
