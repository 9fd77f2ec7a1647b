"""Training-order materialisation: fixed-stride shards of token ids in a keyed random order.

Documents are tokenised and cut into sequences of STRIDE ids (the last of a document is padded).
Sequences are numbered without gaps; a keyed Feistel network over the next power of four, walked
along its cycles until it falls below the number of sequences, gives each a slot. A shard holds
SHARD slots: its file has SHARD * STRIDE unsigned 16-bit ids, so slot s is at byte
(s mod SHARD) * STRIDE * 2 of shard s div SHARD, and a reader resumes at any slot. Shards are
written under another name and moved into place, so that a task that runs again does no harm.
Beside them stands a manifest (sequences, stride, shard, key) and, once all shards are there, a
mark of success that readers ask for; sequences' rows are returned from what the shards' job wrote.
Repeated rows are sequences each for themselves; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import materialise, new_path, read_text, remove, table, text_of, write_text
from ._tokens import encoder

STRIDE, SHARD, END, KEY = 256, 8192, 0, 20240229
VOCABULARY = "byte_bpe_50k.json"
MANIFEST, DONE = "_manifest.json", "_SUCCESS"
#: Sequences that a task gathers before it sends them on.
GATHER = 1 << 14


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """The finaliser of SplitMix64 on x and a round's key."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A keyed permutation of 0..n-1 and its inverse, on arrays."""

    def __init__(self, n: int, key: int = KEY, rounds: int = 6):
        self.n, self.half = n, np.uint64(max(1, (max(n - 1, 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [int(_mix(np.array([i], dtype=np.uint64), key & (2**63 - 1))[0]) for i in range(rounds)]

    def _network(self, x: np.ndarray, keys: list[int]) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & self.mask)
        return (right << self.half) | left  # halves swapped: the same network with keys reversed undoes it

    def _walk(self, x: np.ndarray, keys: list[int]) -> np.ndarray:
        x = self._network(np.asarray(x).astype(np.uint64), keys)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._network(x[out], keys)
        return x.astype(np.int64)

    def slots(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self.keys) if len(index) else np.zeros(0, np.int64)

    def indexes(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1]) if len(slot) else np.zeros(0, np.int64)


def write(docs: DataFrame, path: str, out: str, stride: int = STRIDE, shard: int = SHARD, key: int = KEY) -> DataFrame:
    """Writes the shards into the folder out, all of them before it returns, and gives a row for each sequence.

    doc_id, start, length (without padding), slot, shard, byte_offset, ids_crc32 (of the unpadded
    bytes). docs must give the same partitions each time it is read, as a table does: it is read
    once to count sequences and once to write them, and the second pass fails if a count differs.
    Null texts count as empty (a sequence with the end id alone); no rows give no shard. A folder
    with another manifest is refused; one with the same is written anew.
    """
    spark = docs.sparkSession
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, public_tokenizers.PATTERN)
        n = sum(len(encode(t.as_py())) // stride + 1 for b in batches for t in b.column("text"))  # the end id comes on top
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n], pa.int64())], names=["part", "n"])

    counts = {r["part"]: r["n"] for r in kept.mapInArrow(count, "part long, n long").collect()}  # two numbers a partition
    total, first = 0, {}
    for p in sorted(counts):
        first[p] = total
        total += counts[p]
    order, size = Permutation(total, key), stride * 2

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, public_tokenizers.PATTERN)
        part = TaskContext.get().partitionId()
        at, seen, held, heads, bodies = first.get(part, 0), 0, 0, [], []

        def flush() -> pa.RecordBatch:
            body = np.concatenate(bodies)
            ids, none, size_, n = np.array(heads, dtype="<i8").T
            head = np.repeat(np.column_stack([ids, none, np.cumsum(n) - n, size_, n]), n, axis=0)
            head[:, 2] = (np.arange(len(head)) - head[:, 2]) * stride
            head[:, 3] = np.minimum(head[:, 3] - head[:, 2], stride)
            head[:, 4] = order.slots(np.arange(at + seen, at + seen + held))
            by = np.argsort(head[:, 4])
            cuts = np.flatnonzero(np.diff(head[by, 4] // shard)) + 1
            pack = zstandard.ZstdCompressor(level=1).compress
            rows = [(int(head[g[0], 4] // shard), len(g), pack(head[g].tobytes() + body[g].tobytes())) for g in np.split(by, cuts)]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], names=["shard", "n", "blob"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = encode(text.as_py())
                size_ = len(ids) + 1
                n = -(-size_ // stride)
                body = np.full((n, stride), END, dtype="<u2")  # the end id, and padding with the same
                body.reshape(-1)[: size_ - 1] = ids
                heads.append((doc_id or 0, doc_id is None, size_, n))
                bodies.append(body)
                held += n
                if held >= GATHER:
                    yield flush()
                    seen, held, heads, bodies = seen + held, 0, [], []
        if held:
            yield flush()
        if seen + held != counts.get(part, 0):
            raise RuntimeError("the input's partitions changed between two reads")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(out)

        def flush(now: int, blobs: list[tuple[int, pa.Buffer]]) -> pa.RecordBatch:
            data, heads, crc = np.zeros((min(shard, total - now * shard), stride), dtype="<u2"), [], []
            for n, blob in blobs:
                raw = memoryview(zstandard.decompress(blob))
                head, body = np.frombuffer(raw[: n * 40], dtype="<i8").reshape(n, 5), raw[n * 40 :]
                data[head[:, 4] % shard] = np.frombuffer(body, dtype="<u2").reshape(n, stride)
                crc += [zlib.crc32(body[k * size : k * size + 2 * m]) for k, m in enumerate(head[:, 3].tolist())]
                heads.append(head)
            with store.open_output_stream(own := f"{folder}/.{uuid.uuid4().hex}") as f:
                f.write(data.tobytes())
            store.move(own, f"{folder}/shard-{now:08d}.bin")
            h = np.concatenate(heads)
            ids = pa.array(h[:, 0].copy(), pa.int64(), mask=h[:, 1].astype(bool))
            cols = [ids, *(pa.array(h[:, k].copy()) for k in (2, 3, 4)), pa.array(np.full(len(h), now)), pa.array(h[:, 4] % shard * size), pa.array(crc, pa.int64())]
            return pa.record_batch(cols, names=["doc_id", "start", "length", "slot", "shard", "byte_offset", "ids_crc32"])

        now, held = None, []
        for b in batches:
            for s, n, blob in zip(b.column("shard").to_pylist(), b.column("n").to_pylist(), map(pa.BinaryScalar.as_buffer, b.column("blob"))):
                if held and s != now:
                    yield flush(now, held)
                    held = []
                now = s
                held.append((n, blob))
        if held:
            yield flush(now, held)

    manifest = json.dumps({"sequences": total, "stride": stride, "shard": shard, "key": key}, sort_keys=True)
    if read_text(spark, f"{out}/{MANIFEST}") not in (None, manifest):
        raise ValueError(f"{out} holds other shards")
    remove(spark, f"{out}/{DONE}")
    write_text(spark, f"{out}/{MANIFEST}", manifest)
    dealt = kept.mapInArrow(deal, "shard long, n long, blob binary")
    # ranges of shards are known beforehand, so no pass is spent on sampling them
    files = max(1, -(-total // shard))
    parts = min(files, max(int(spark.conf.get("spark.sql.shuffle.partitions")), files // 4))
    sorted_ = dealt.repartitionById(parts, F.floor(F.col("shard") * parts / files).cast("int")).sortWithinPartitions("shard")
    rows = materialise(sorted_.mapInArrow(shards, "doc_id long, start long, length long, slot long, shard long, byte_offset long, ids_crc32 long"), "shard-rows")
    write_text(spark, f"{out}/{DONE}", str(files if total else 0))
    return rows


def read(spark: SparkSession, out: str, slot: int, n: int, stride: int = STRIDE, shard: int = SHARD) -> np.ndarray:
    """The n sequences from slot on, in training order, one sequential read a shard; an error where the shards aren't complete."""
    from pyarrow import fs

    made = json.loads(read_text(spark, f"{out}/{MANIFEST}") or "{}")
    if read_text(spark, f"{out}/{DONE}") is None or (made["stride"], made["shard"]) != (stride, shard):
        raise ValueError(f"{out} holds no complete shards of {shard} times {stride} ids")

    store, folder = fs.FileSystem.from_uri(out)
    found = []
    while n > 0:
        k, at = divmod(slot, shard)
        with store.open_input_file(f"{folder}/shard-{k:08d}.bin") as f:
            f.seek(at * stride * 2)
            got = np.frombuffer(f.read(min(n, shard - at) * stride * 2), dtype="<u2").reshape(-1, stride)
        if not len(got):
            break
        found.append(got)
        slot, n = slot + len(got), n - len(got)
    return np.concatenate(found) if found else np.zeros((0, stride), dtype="<u2")


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), new_path(spark, "shards"))
