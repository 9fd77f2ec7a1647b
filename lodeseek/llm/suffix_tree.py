"""LM scoring by a probabilistic suffix tree over words.

Words are what lies between white space after lower-casing A-Z; each text ends in one end symbol.
Contexts of up to DEPTH words (the model's order) that occur twice are candidates, whatever the
input's size, and next symbols that follow one twice get a probability of their own.
A context is retained if its next-symbol distribution diverges from the one of its suffix (the
context without its oldest word): count times Kullback-Leibler divergence over 0.5 * ln N for each
own probability. Suffixes of retained contexts are retained as well.

Smoothing takes DISCOUNT of each own count and leaves the rest of the mass to the suffix state, down
to the root: every word of the corpus, and one symbol for all other words, which gets the share of
words that were seen once. So each state's probabilities sum to 1 over the V known words and the
unknown one, as the base score's do. A text's score uses the longest retained suffix at each token.

Every training text is read whole and every count is exact. The tree of up to WHOLE training tokens
is broadcast. A larger one is never put together: see _added(). Words outside the HEAD most frequent
ones are looked up by a join, and have ids by falling counts as well if they occur twice.
"""

from __future__ import annotations

import gc
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import HEAVY_KEYS, discard, materialise, numbered, table, text_of

DEPTH, DISCOUNT = 3, 0.5
#: Training tokens of the largest tree that is broadcast.
WHOLE = 600_000
#: Contexts that occur more often, or more often than the root of SPAN times the tokens, and in over 1/SHARE of the tokens, are
#: dealt to several homes; tokens of a home, and homes of a task's group. By the root, what follows such contexts grows with the input.
HEAVY, SPAN, SHARE, HOME, HOMES = 1_000_000, 540, 4 * HEAVY_KEYS, 500_000, 2
WORD_BITS = 18
#: Words with an id of their own on every executor.
HEAD = 1 << WORD_BITS
#: Tokens whose n-grams are counted at once, and words that are counted at once.
CHUNK, WORDS = 4_000_000, 400_000
#: Bits of a uid that number the texts of a chunk of CHUNK / 4 tokens.
ROW_BITS = 21
END = b""


def words(text: str) -> list[bytes]:
    """Tokens without the end; bytes know no letters and white space but ASCII's."""
    return text.encode("utf-8", "replace").lower().split()


@dataclass
class Level:
    """Contexts of one length. keys: suffix-trie keys (context of one word less << WORD_BITS | last word), sorted."""

    keys: np.ndarray
    count: np.ndarray
    kept: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    backoff: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log10
    entries: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # context << WORD_BITS | next
    chance: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log10


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key, -1 where there is none."""
    if not len(keys):
        return np.full(len(wanted), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


class Ids(dict):
    """Ids of words; -1 for others, which are not added."""

    def __missing__(self, word: bytes) -> int:
        return -1


@dataclass
class Tree:
    ids: Ids
    counts: np.ndarray  # of the head's words
    n: int  # training tokens
    v: int  # distinct ones
    once: int  # seen once
    levels: list[Level] = field(default_factory=list)
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))  # beyond the head: counts, falling to 1, and the first id of each
    train: DataFrame | None = None  # the training texts of a tree that isn't whole, see _texts()

    @property
    def whole(self) -> bool:
        return self.n <= WHOLE and self.v <= HEAD

    @property
    def discount(self) -> float:
        return (self.once + 0.5) / (self.v + 1)

    def count_of(self, ids: np.ndarray) -> np.ndarray:
        """Counts of words that occur twice."""
        out = np.zeros(len(ids), np.int64)
        head = ids < len(self.counts)
        out[head] = self.counts[ids[head]]
        out[~head] = self.steps[0][np.searchsorted(self.steps[1], ids[~head], side="right") - 1]
        return out

    def root(self, count: np.ndarray) -> np.ndarray:
        """log10 probability of a word with a count at the root; 0 is the unknown word."""
        if not self.n:
            return np.zeros(len(count))
        return np.log10(np.where(count > 0, count - self.discount, self.discount * self.v) / self.n)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.n + self.v + 1))

    def contexts(self, ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """For each length k and token i, the context of the k tokens before i, or -1; first: tokens that start a text."""
        out: list[np.ndarray] = []
        for k, level in enumerate(self.levels):
            ended = np.full(len(ids) + 1, -1, dtype=np.int64)  # the context that ends at token i, at i + 1
            if k == 0:
                place = np.full(len(self.counts) + 1, -1, dtype=np.int64)  # the last one is for words without an id
                place[level.keys] = np.arange(len(level.keys))
                ended[1:] = place[ids]
            else:
                ok = np.flatnonzero((out[-1] >= 0) & (ids >= 0))
                ended[ok + 1] = find(level.keys, (out[-1][ok] << WORD_BITS) | ids[ok])
            ended[first] = -1
            out.append(ended[:-1])
        return out

    def score(self, ids: np.ndarray, first: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """log10 probability of each token; rest: root probabilities of the tokens."""
        out, found = np.zeros(len(ids)), np.zeros(len(ids), bool)
        at = self.contexts(ids, first)
        for level, c in zip(reversed(self.levels), reversed(at)):
            here = np.flatnonzero((c >= 0) & ~found)
            here = here[level.kept[c[here]]]
            known = ids[here] >= 0
            e = np.full(len(here), -1, dtype=np.int64)
            e[known] = find(level.entries, (c[here[known]] << WORD_BITS) | ids[here[known]])
            hit = e >= 0
            out[here[hit]] += level.chance[e[hit]]
            found[here[hit]] = True
            out[here[~hit]] += level.backoff[c[here[~hit]]]
        return np.where(found, out, out + rest)


def grow(tree: Tree, pairs: list[tuple[np.ndarray, np.ndarray]]) -> None:
    """Retains contexts and sets their probabilities; pairs: (entry keys, counts) by length, sorted."""
    mask = (1 << WORD_BITS) - 1
    suffix = [np.full(len(tree.levels[0].keys), -1)] if tree.levels else []
    for k in range(1, len(tree.levels)):
        low, last = tree.levels[k].keys >> WORD_BITS, tree.levels[k].keys & mask
        up = suffix[k - 1][low]
        suffix.append(find(tree.levels[k - 1].keys, last if k == 1 else (up << WORD_BITS) | last))
    shares, gains = [], []
    root = 10 ** tree.root(tree.counts)
    for k, (level, (keys, n)) in enumerate(zip(tree.levels, pairs)):
        c, a = keys >> WORD_BITS, keys & mask
        p = (n - DISCOUNT) / level.count[c]
        if k == 0:
            q = root[a]
        else:
            q = shares[k - 1][find(tree.levels[k - 1].entries, (suffix[k][c] << WORD_BITS) | a)]
        m = len(level.keys)
        sum_p, sum_q, own = (np.bincount(c, weights=x, minlength=m) for x in (p, q, np.ones(len(c))))
        rest_p, rest_q = np.maximum(1 - sum_p, 1e-12), np.maximum(1 - sum_q, 1e-12)
        gain = np.bincount(c, weights=p * np.log(p / q), minlength=m) + rest_p * np.log(rest_p / rest_q)
        level.entries, level.chance, level.backoff = keys, np.log10(p), np.log10(rest_p / rest_q)
        level.kept = (own > 0) & (level.count * gain >= 0.5 * own * np.log(max(tree.n, 2)))
        shares.append(p)
    for k in range(len(tree.levels) - 1, 0, -1):
        tree.levels[k - 1].kept[suffix[k][tree.levels[k].kept]] = True


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

    for b in batches:
        for t in b.column("text"):
            seen.update(words(t.as_py()))
            seen[END] += 1
            if len(seen) > WORDS:
                yield out()
                seen.clear()
    if seen:
        yield out()


def _head(train: DataFrame) -> tuple[Tree, DataFrame]:
    """A tree without contexts, and the written counts (word, n) of all words of train."""
    counts = materialise(train.select(text_of().alias("text")).mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    n, v, once = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum((F.col("n") == 1).cast("long")), F.lit(0))).first()
    steps = counts.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("step")).agg(F.count("*").alias("k")).collect()  # 512 at most
    least, total = 10**6, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        if total + r["k"] > HEAD:
            break
        total, least = total + r["k"], r["step"]
    head = counts.where(F.floor(F.log2("n") * 8) >= least).collect()  # HEAD rows at most
    head.sort(key=lambda r: (-r["n"], bytes(r["word"])))
    return Tree(Ids((bytes(r["word"]), i) for i, r in enumerate(head)), np.array([r["n"] for r in head], dtype=np.int64), n, v, once), counts


def _encode(docs: DataFrame, tree: Tree, training: Column) -> DataFrame:
    """A written table with a row for each of docs: uid, doc_id, training, n_tokens, sums of its words in the head (known, base, root), ids (32-bit, -1 - k for the text's k-th word outside the head), tail (those words and how often).

    Texts whose uids differ in the last ROW_BITS only are a chunk.
    """
    sent = docs.sparkSession.sparkContext.broadcast((tree.ids, tree.root(tree.counts), tree.base(tree.counts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, root, base = sent.value
        get, root, base = known.__getitem__, np.append(root, 0.0), np.append(base, 0.0)
        chunk, row, size = TaskContext.get().partitionId() << 19, 0, 0
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                uids, ids, words_, times, offsets = [], [], [], [], [0]
                for t in part.column("text"):
                    ws = words(t.as_py())
                    ws.append(END)
                    own = np.fromiter(map(get, ws), np.int32, len(ws))
                    far = np.flatnonzero(own < 0)
                    if len(far):
                        place: dict[bytes, int] = {}
                        own[far] = [-1 - place.setdefault(ws[k], len(place)) for k in far.tolist()]
                        words_ += place
                        times.append(np.bincount(-1 - own[far], minlength=len(place)))
                    ids.append(own)
                    offsets.append(len(words_))
                    if size >= CHUNK // 4:
                        chunk, row, size = chunk + 1, 0, 0
                    uids.append(chunk << ROW_BITS | row)
                    row, size = row + 1, size + len(ws)
                long = np.array(list(map(len, ids)))
                flat, first = np.maximum(np.concatenate(ids), -1), np.cumsum(long) - long
                tail = pa.StructArray.from_arrays([pa.array(words_, pa.binary()), pa.array(np.concatenate([np.zeros(0, np.int64), *times]), pa.int64())], names=["word", "n"])
                sums = [np.add.reduceat(x, first) for x in ((flat >= 0).astype(np.int64), base[flat], root[flat])]
                cols = [pa.array(uids, pa.int64()), part.column("doc_id"), part.column("training"), pa.array(long), *map(pa.array, sums), pa.array([x.tobytes() for x in ids], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tail)]
                yield pa.record_batch(cols, names=["uid", "doc_id", "training", "n_tokens", "known", "base", "root", "ids", "tail"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), training.alias("training"), text_of().alias("text"))
    return materialise(kept.mapInArrow(run, TEXT + ", tail array<struct<word:binary,n:bigint>>"), "suffix-ids")


TEXT = "uid long, doc_id long, training boolean, n_tokens long, known long, base double, root double, ids binary"


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all tokens of a slice of rows, -1 outside the head, and where each row starts."""
    each = [np.frombuffer(x.as_py(), dtype="<i4") for x in column]
    return np.maximum(np.concatenate(each), -1).astype(np.int64), np.cumsum([0, *map(len, each[:-1])])


def _looked(encoded: DataFrame, tree: Tree, counts: DataFrame) -> DataFrame:
    """uid, sums of a text's words outside the head (known2, base2, root2), and far: places k and ids of these, of counts that have ids."""
    n, v, d = float(tree.n), float(tree.v), tree.discount
    tail = encoded.select("uid", F.posexplode("tail").alias("k", "t")).select("uid", "k", "t.word", F.col("t.n").alias("times"))
    c = F.coalesce(F.col("n"), F.lit(0))
    root = F.log10(F.when(c > 0, c - d).otherwise(d * v) / n) if tree.n else F.lit(0.0)
    return tail.join(counts, "word", "left").groupBy("uid").agg(
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known2"), F.sum(F.col("times") * F.log10((c + 1) / (n + v + 1))).alias("base2"), F.sum(F.col("times") * root).alias("root2"),
        F.collect_list(F.when(F.col("id") >= 0, F.struct("k", "id"))).alias("far"),
    )


def _frequent(tree: Tree, encoded: DataFrame, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of a tree that is broadcast: by length, the contexts (set as the tree's levels) and, returned, their next words that occur at least so often."""
    spark, n = encoded.sparkSession, tree.n
    end = tree.ids.get(END, -1)
    keys = np.flatnonzero(tree.counts >= least).astype(np.int64)
    keys = keys[keys != end]
    counted = tree.counts[keys]
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    parts = max(spark.sparkContext.defaultParallelism, -(-n // CHUNK))
    rows = encoded.where("training").select("ids").coalesce(parts)
    for _ in range(DEPTH):
        if not len(keys):
            break
        tree.levels.append(Level(keys, counted))
        sent = spark.sparkContext.broadcast(Tree(Ids(), tree.counts, tree.n, tree.v, tree.once, tree.levels))
        got = _pairs(rows, sent, least).groupBy("pair").agg(F.sum("n").alias("n"))
        got = got.where(F.col("n") >= least).toPandas()  # half of WHOLE at most
        pair, times = got["pair"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
        order = np.argsort(pair)
        pair, times = pair[order], times[order]
        pairs.append((pair, times))
        longer = (pair & (HEAD - 1)) != end
        keys, counted = pair[longer], times[longer]
    return pairs


def longer_id(gram: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Id of a sequence with one more word before it."""
    z = gram.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (word + 3).view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(29))).view(np.int64)


def dealt(ids: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Numbers below n by ids."""
    return ((ids.view(np.uint64) >> np.uint64(8)) % np.asarray(n).astype(np.uint64)).astype(np.int64)


@dataclass
class Heavy:
    """Contexts that are dealt to several homes, shorter ones first: a few thousand of a length at most."""

    least: int
    top: int  # words with ids below are heavy
    words: list[tuple[int, ...]]  # newest first
    ids: np.ndarray
    count: np.ndarray
    suffix: np.ndarray  # place of the context without its oldest word, -1: the root
    kept: np.ndarray
    worth: np.ndarray  # what it and its suffixes add for a next word that none of them has

    def deepest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each token the place of its longest heavy context, or -1, and that one's length; rows[k]: the words k + 1 places before."""
        at, length = np.full(rows.shape[1], -1), np.zeros(rows.shape[1], np.int64)
        going = np.flatnonzero((rows[0] >= 0) & (rows[0] < self.top))
        gram, order = np.zeros(len(going), np.int64), np.argsort(self.ids)
        for k in range(DEPTH):
            gram = longer_id(gram, rows[k][going].astype(np.int64))
            found = find(self.ids[order], gram)
            going, gram = going[found >= 0], gram[found >= 0]
            at[going], length[going] = order[found[found >= 0]], k + 1
            if k + 1 < DEPTH:
                more = rows[k + 1][going] >= 0
                going, gram = going[more], gram[more]
        return at, length

    def spread(self) -> np.ndarray:
        """Homes that each is dealt to."""
        return -(-self.count // HOME) + 1


def _windows(ids: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Row k: the words k places before each token; -1 for words that occur once at most, and for all that is before these or before the text."""
    place = np.arange(len(ids)) - np.repeat(np.cumsum(long) - long, long)
    rows = np.full((DEPTH + 1, len(ids)), -1, np.int32)
    rows[0] = ids
    for k in range(1, DEPTH + 1):
        ok = place[k:] >= k
        if k > 1:
            ok &= rows[k - 1, k:] >= 0
        rows[k, k:] = np.where(ok, ids[:-k], -1)
    return rows


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Chunk, row and training of each text, and its ids, by texts of one chunk of some CHUNK / 4 tokens at most."""
    held: list[tuple[int, bool, np.ndarray]] = []
    size, last = 0, None

    def out():
        row = np.array([u & ((1 << ROW_BITS) - 1) for u, _, _ in held])
        return last, row, np.array([t for _, t, _ in held]), [x for _, _, x in held]

    for b in batches:
        for u, t, x in zip(b.column("uid").to_pylist(), b.column("training").to_pylist(), b.column("ids").to_pylist()):
            if held and (u >> ROW_BITS != last or size >= CHUNK // 2):
                yield out()
                held, size = [], 0
            held.append((u, t, np.frombuffer(x, dtype="<i4")))
            last, size = u >> ROW_BITS, size + len(held[-1][2])
    if held:
        yield out()


def _blocks(texts: DataFrame, heavy: Heavy, homes: int) -> DataFrame:
    """group, home, chunk, m, data: m tokens of a chunk with the DEPTH words before them, and their texts' rows.

    Tokens lie by the shortest context that isn't heavy, so all that share it share a home, with all longer contexts that end in it.
    """
    sent = texts.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        spread = known.spread()
        for chunk, row, training, each in _chunks(batches):
            long = np.array(list(map(len, each)))
            rows = _windows(np.concatenate(each), long)
            text = np.repeat(row << 1 | training, long).astype(np.int32)
            here = np.flatnonzero(rows[1] >= 0)
            rows, text = rows[:, here], text[here]
            home = dealt(longer_id(np.zeros(len(here), np.int64), rows[1].astype(np.int64)), homes)
            if len(known.ids):
                at, length = known.deepest(rows[1:])
                hot = np.flatnonzero(at >= 0)
                at, longer = at[hot], np.take_along_axis(np.concatenate([rows[1:], rows[:1] * 0 - 1])[:, hot], length[None, hot], axis=0)[0].astype(np.int64)
                key = np.where(longer >= 0, longer_id(known.ids[at], longer), longer_id(known.ids[at], (chunk << ROW_BITS | text[hot].astype(np.int64) >> 1)))
                home[hot] = (dealt(known.ids[at], homes) + dealt(key, spread[at])) % homes
            order = np.argsort(home.astype(np.uint16) if homes < 1 << 16 else home, kind="stable")
            flat, home = np.concatenate([rows, text[None, :]])[:, order], home[order]
            cuts = np.flatnonzero(np.r_[True, home[1:] != home[:-1], True]) if len(home) else np.zeros(1, np.int64)
            data = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                part = np.ascontiguousarray(flat[:, a:b])
                data.append(pa.compress(part.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True))
            at = home[cuts[:-1]].astype(np.int32)
            cols = [pa.array(at // HOMES), pa.array(at), pa.array(np.full(len(data), chunk, np.int64)), pa.array(np.diff(cuts)), pa.array(data, pa.binary())]
            yield pa.record_batch(cols, names=["group", "home", "chunk", "m", "data"])

    return texts.select("uid", "training", "ids").mapInArrow(run, "group int, home int, chunk long, m long, data binary")


def _homes(tree: Tree, heavy: Heavy, blocks: pa.Table, values: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each home of a group: chunk << ROW_BITS | row of its tokens, what the tree adds to each, and heavy contexts, see _home()."""
    home, chunks, m = (blocks.column(c).to_numpy() for c in ("home", "chunk", "m"))
    data, own = blocks.column("data"), values.column("home").to_numpy()
    for h in np.unique(home):
        mine = np.flatnonzero(home == h)
        out, at = np.empty((DEPTH + 2, int(m[mine].sum())), np.int32), 0
        for i in mine.tolist():
            k = int(m[i])
            raw = np.frombuffer(pa.decompress(data[i].as_buffer(), decompressed_size=k * 4 * (DEPTH + 2), codec="zstd"), np.uint8)
            out[:, at : at + k] = np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").reshape(DEPTH + 2, k)
            at += k
        found = values.filter(pa.array(own == h))
        key = found.column("h").to_numpy() << 32 | found.column("x").to_numpy()
        order = np.argsort(key)
        total, needed = _home(tree, heavy, out[:-1], (out[-1] & 1).astype(bool), (key[order], found.column("n").to_numpy()[order], found.column("value").to_numpy()[order]))
        yield np.repeat(chunks[mine] << ROW_BITS, m[mine]) | out[-1] >> 1, total, needed


def ranked(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs (a, b) among their distinct ones, and where each of these is first found."""
    key = a.astype(np.int64) << 32 | b
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    rank = np.empty(len(key), np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32) - 1
    return rank, order[new]


def _home(tree: Tree, heavy: Heavy, rows: np.ndarray, training: np.ndarray, values: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """What the tree adds to each token's score at the root, and the heavy contexts that are suffixes of retained ones; values: keys (place of a heavy context << 32 | next word), counts, worth."""
    m, least = rows.shape[1], 0.5 * float(np.log(max(tree.n, 2)))
    deep, depth = heavy.deepest(rows[1:]) if len(heavy.ids) else (np.full(m, -1), np.zeros(m, np.int64))
    total, hot = np.zeros(m), np.flatnonzero(deep >= 0)
    hot_n = np.zeros(len(hot), np.int64)
    if len(hot):
        at = find(values[0], deep[hot] << 32 | rows[0][hot])
        at[rows[0][hot] < 0] = -1
        hot_n[at >= 0] = values[1][at[at >= 0]]
        total[hot] = np.where(at >= 0, values[2][at], heavy.worth[deep[hot]]) if len(values[0]) else heavy.worth[deep[hot]]
    n = np.where(rows[0] >= 0, 2, 0)  # of the token after the context that is one word shorter
    own_n, context, entry, spans = np.zeros(m, np.int64), np.zeros(m, np.int32), rows[0], []
    for k in range(1, DEPTH + 1):
        word = rows[k]
        if k == 1:
            a = np.arange(m)
        else:
            a = a[(word[a] >= 0) & live[context[a]]]
        c, first = ranked(context[a], word[a])
        count = np.bincount(c, weights=training[a], minlength=len(first))
        up = context[a[first]]
        is_hot = depth[a[first]] >= k
        context = context.copy()
        context[a] = c
        b = a[n[a] >= 2]
        e, efirst = ranked(entry[b], word[b])
        times = np.rint(np.bincount(e, weights=training[b], minlength=len(efirst))).astype(np.int64)
        where = b[efirst]
        of = context[where]
        own = (times >= 2) & ~is_hot[of]
        p = (times - DISCOUNT) / np.maximum(count[of], 1)
        if k == 1:
            q = np.ones(len(where))
            q[own] = 10 ** tree.root(tree.count_of(rows[0][where[own]]))
        else:
            q = (n[where] - DISCOUNT) / np.maximum(own_n[where], 1)
        p, q, of = p[own], q[own], of[own]
        size = len(first)
        sum_p, sum_q, gain = (np.bincount(of, weights=x, minlength=size) for x in (p, q, p * np.log(p / q)))
        have = np.bincount(of, minlength=size)
        rest_p, rest_q = np.maximum(1 - sum_p, 1e-12), np.maximum(1 - sum_q, 1e-12)
        kept = (have > 0) & (count * (gain + rest_p * np.log(rest_p / rest_q)) >= least * have)
        back = np.log10(rest_p / rest_q)
        worth = np.zeros(len(where))
        worth[own] = np.log10(p / q) - back[of]
        live = (have > 0) | is_hot
        spans.append((a, c, up, is_hot, kept, back, b, e, worth, deep[a[first]]))
        entry = np.zeros(m, np.int32)
        entry[b] = e
        n = np.zeros(m, np.int64)
        n[b] = np.where(own, times, 0)[e]
        own_n = np.zeros(m, np.int64)
        own_n[a] = np.rint(count).astype(np.int64)[c]
        if len(hot):
            deeper, same = depth[hot] > k, depth[hot] == k
            n[hot[deeper]] = np.where(rows[0][hot[deeper]] >= 0, 2, 0)
            n[hot[same]] = hot_n[same]
            own_n[hot[same]] = heavy.count[deep[hot[same]]]
    needed = []
    for k in range(DEPTH, 0, -1):
        a, c, up, is_hot, kept, back, b, e, worth, place = spans[k - 1]
        kept &= ~is_hot
        if k > 1:
            below = spans[k - 2]
            below[4][up[kept]] = True
            needed.append(place[kept & below[3][up]])
        total[a] += np.where(kept, back, 0)[c]
        total[b] += worth[e] * kept[spans[k - 1][1][np.searchsorted(a, b)]]
    return total, np.unique(np.concatenate(needed)) if needed else np.zeros(0, np.int64)


def _counted_after(texts: DataFrame, heavy: Heavy, length: int) -> DataFrame:
    """h, x, n: how often words that occur twice after a heavy context of a length do."""
    sent = texts.sparkSession.sparkContext.broadcast(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for _, _, _, each in _chunks(batches):
            rows = _windows(np.concatenate(each), np.array(list(map(len, each))))
            rows = rows[:, (rows[0] >= 0) & (rows[1] >= 0) & (rows[1] < known.top)]
            at, size = known.deepest(rows[1:])
            ok = size == length
            key, n = np.unique(at[ok] << 32 | rows[0][ok], return_counts=True)
            yield pa.record_batch([pa.array(key), pa.array(n.astype(np.int64))], names=["key", "n"])

    got = texts.where("training").select("uid", "training", "ids").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where("n >= 2")
    return got.select(F.shiftright("key", 32).alias("h"), F.col("key").bitwiseAND(0xFFFFFFFF).alias("x"), "n")


def _heavy(tree: Tree, texts: DataFrame, least: int) -> tuple[Heavy, list[DataFrame]]:
    """Heavy contexts, not retained yet, and by length what follows them, see _counted_after()."""
    if len(tree.counts) and tree.counts[-1] <= least:
        top = int((tree.counts > least).sum())
    else:
        top = int(tree.steps[1][np.argmax(tree.steps[0] <= least)])
    count = tree.count_of(np.arange(top))
    empty = np.zeros(0, np.int64)
    heavy, tables = Heavy(least, top, [], empty, empty, empty, empty.astype(bool), empty.astype(float)), []
    found = [((w,), int(count[w])) for w in range(top)]
    for length in range(1, DEPTH + 1):
        if not found:
            break
        place = {w: k for k, w in enumerate(heavy.words)}
        found = [(w, c) for w, c in found if length == 1 or w[:-1] in place]
        heavy.words = heavy.words + [w for w, _ in found]
        ids = np.zeros(len(found), np.int64)
        for k in range(length):
            ids = longer_id(ids, np.array([w[k] for w, _ in found], np.int64))
        heavy = Heavy(
            least, top, heavy.words, np.append(heavy.ids, ids), np.append(heavy.count, [c for _, c in found]).astype(np.int64),
            np.append(heavy.suffix, [place.get(w[:-1], -1) for w, _ in found]).astype(np.int64), np.zeros(len(heavy.words), bool), np.zeros(len(heavy.words)),
        )
        tables.append(materialise(_counted_after(texts, heavy, length), "suffix-heavy"))
        found = [((r["x"], *heavy.words[r["h"]]), r["n"]) for r in tables[-1].where(F.col("n") > least).collect()]  # SHARE at most
    return heavy, tables


def _added(texts: DataFrame, tree: Tree) -> DataFrame:
    """uid (not below 0), added: what the tree adds to a text's score at the root.

    All contexts that end in a word, their next words and the tokens after them meet in one group, which tests the contexts
    and scores the tokens; only sums by text leave it. Heavy contexts span several groups. Their next words are counted
    before, and go to all groups that have their tokens.
    """
    spark, homes = texts.sparkSession, max(1, -(-tree.n // HOME))
    heavy, tables = _heavy(tree, texts, max(min(HEAVY, isqrt(SPAN * tree.n)), tree.n // SHARE))
    values = _heavy_values(texts, tree, heavy, tables, homes)
    sent = spark.sparkContext.broadcast((replace(tree, ids=Ids(), levels=[], train=None), heavy))

    def run(blocks: pa.Table, values: pa.Table) -> pa.Table:
        tree, heavy = sent.value
        if not len(blocks):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], names=["chunk", "m", "data"])
        keys, sums = [], []
        for key, total, _ in _homes(tree, heavy, blocks, values):
            new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            keys.append(key[new])
            sums.append(np.add.reduceat(total, new))
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate(sums), minlength=len(key))
        total, key = total[key >= 0], key[key >= 0]
        chunk, row = key >> ROW_BITS, (key & ((1 << ROW_BITS) - 1)).astype("<i4")
        cuts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True]) if len(key) else np.zeros(1, np.int64)
        data = [pa.compress(row[a:b].view(np.uint8).reshape(-1, 4).T.tobytes() + total[a:b].tobytes(), codec="zstd", asbytes=True) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        return pa.table([pa.array(chunk[cuts[:-1]]), pa.array(np.diff(cuts)), pa.array(data, pa.binary())], names=["chunk", "m", "data"])

    def summed(parts: pa.Table) -> pa.Table:
        rows, sums = [], []
        for k, data in zip(parts.column("m").to_pylist(), parts.column("data").to_pylist()):
            raw = pa.decompress(data, decompressed_size=k * 12, codec="zstd", asbytes=True)
            rows.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * k).reshape(4, -1).T).view("<i4").ravel())
            sums.append(np.frombuffer(raw, "<f8", k, 4 * k))
        row, back = np.unique(np.concatenate(rows), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate(sums), minlength=len(row))
        return pa.table([pa.array(parts.column("chunk")[0].as_py() << ROW_BITS | row.astype(np.int64)), pa.array(total)], names=["uid", "added"])

    blocks = _blocks(texts, heavy, homes).groupBy("group").cogroup(values.groupBy("group")).applyInArrow(run, "chunk long, m long, data binary")
    return blocks.groupBy("chunk").applyInArrow(summed, "uid long, added double")


VALUE = "group int, home int, h long, x long, n long, value double"


def _heavy_values(texts: DataFrame, tree: Tree, heavy: Heavy, tables: list[DataFrame], homes: int) -> DataFrame:
    """By home what follows the heavy contexts there: n, and the worth of the word after the context and its suffixes. Sets which of these are retained."""
    spark = texts.sparkSession
    if not tables:
        return spark.createDataFrame([], VALUE)
    size, n, d = np.array(list(map(len, heavy.words))), float(tree.n), tree.discount
    sent = spark.sparkContext.broadcast((tree.counts, tree.steps))
    up = np.where(heavy.suffix >= 0, heavy.count[heavy.suffix], 0)
    about = spark.createDataFrame(pd.DataFrame({"h": np.arange(len(size)), "s": heavy.suffix, "nc": heavy.count, "ns": up}))

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, steps = sent.value
        for b in batches:
            below = Tree(Ids(), counts, 0, 0, 0, steps=steps).count_of(b.column("x").to_numpy())
            yield pa.record_batch([b.column("h"), b.column("x"), b.column("n"), pa.array(below)], names=["h", "x", "n", "below"])

    shares, p = [], (F.col("n") - DISCOUNT) / F.col("nc")
    for k, t in enumerate(tables):
        if k == 0:
            rows, q = t.mapInArrow(rooted, "h long, x long, n long, below long").join(F.broadcast(about), "h"), (F.col("below") - d) / n
        else:
            below = tables[k - 1].select(F.col("h").alias("s"), "x", F.col("n").alias("below"))
            rows, q = t.join(F.broadcast(about), "h").join(below, ["s", "x"]), (F.col("below") - DISCOUNT) / F.col("ns")
        shares.append(rows.select("h", "x", "n", p.alias("p"), q.alias("q")))
    own, sum_p, sum_q, gain = (np.zeros(len(size)) for _ in range(4))
    for t in shares:
        for r in t.groupBy("h").agg(F.count("*").alias("own"), F.sum("p").alias("sp"), F.sum("q").alias("sq"), F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("gain")).collect():
            own[r["h"]], sum_p[r["h"]], sum_q[r["h"]], gain[r["h"]] = r["own"], r["sp"], r["sq"], r["gain"]
    rest_p, rest_q = np.maximum(1 - sum_p, 1e-12), np.maximum(1 - sum_q, 1e-12)
    kept = (own > 0) & (heavy.count * (gain + rest_p * np.log(rest_p / rest_q)) >= 0.5 * own * np.log(max(tree.n, 2)))
    heavy.worth, backoff = np.zeros(len(size)), np.log10(rest_p / rest_q)

    def suffixes() -> None:
        for k in range(len(size) - 1, -1, -1):
            if kept[k] and heavy.suffix[k] >= 0:
                kept[heavy.suffix[k]] = True

    suffixes()
    spread, start = heavy.spread(), dealt(heavy.ids, homes)

    def dealt_out(rows: DataFrame) -> DataFrame:
        where = spark.createDataFrame(pd.DataFrame({"h": np.arange(len(size)), "start": start, "spread": np.minimum(spread, homes)}))
        out = rows.join(F.broadcast(where), "h").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("spread") - 1)))
        home = ((F.col("start") + F.col("j")) % homes).cast("int")
        return out.select(F.floor(home / HOMES).cast("int").alias("group"), home.alias("home"), "h", "x", "n", "value")

    if (~kept & (own > 0)).any():  # they are suffixes of retained contexts, or go
        bare = dealt_out(reduce(DataFrame.unionByName, _with_suffixes(spark, heavy, [t.select("h", "x", "n", F.lit(0.0).alias("value")) for t in shares], size, np.zeros(len(size)))))
        both = spark.sparkContext.broadcast((replace(tree, ids=Ids(), levels=[], train=None), heavy))

        def needed(blocks: pa.Table, values: pa.Table) -> pa.Table:
            if not len(blocks):
                return pa.table([pa.array([], pa.int64())], names=["h"])
            return pa.table([pa.array(np.concatenate([x[2] for x in _homes(*both.value, blocks, values)]).astype(np.int64))], names=["h"])

        for r in _blocks(texts, heavy, homes).groupBy("group").cogroup(bare.groupBy("group")).applyInArrow(needed, "h long").distinct().collect():
            kept[r["h"]] = True
        suffixes()
    heavy.kept = kept
    worth = np.where(kept, backoff, 0.0)
    held = spark.createDataFrame(pd.DataFrame({"h": np.arange(len(size)), "kept": kept.astype(float), "back": worth}))
    parts = [t.join(F.broadcast(held), "h").select("h", "x", "n", (F.col("kept") * F.log10(F.col("p") / F.col("q"))).alias("value")) for t in shares]
    parts = _with_suffixes(spark, heavy, parts, size, worth)
    total = np.zeros(len(size))
    for k in range(len(size)):  # shorter ones come first
        total[k] = worth[k] + (total[heavy.suffix[k]] if heavy.suffix[k] >= 0 else 0)
    heavy.worth = total
    return _written(dealt_out(reduce(DataFrame.unionByName, parts)), "suffix-values")


def _with_suffixes(spark: SparkSession, heavy: Heavy, parts: list[DataFrame], size: np.ndarray, worth: np.ndarray) -> list[DataFrame]:
    """parts (h, x, n, value, by length) with a row for each word that follows the suffix, and the suffix's value added."""
    out = parts[:1]
    for k in range(1, len(parts)):
        mine = np.flatnonzero(size == k + 1)
        to = spark.createDataFrame(pd.DataFrame({"s": heavy.suffix[mine], "h": mine, "back": worth[mine]}))
        above = out[-1].select(F.col("h").alias("s"), "x", F.col("value").alias("base")).join(F.broadcast(to), "s")
        both = above.join(parts[k], ["h", "x"], "left")
        out.append(both.select("h", "x", F.coalesce("n", F.lit(0)).alias("n"), (F.col("base") + F.coalesce("value", "back")).alias("value")))
    return out


def _written(df: DataFrame, label: str) -> DataFrame:
    """df, written; the shuffle files behind it, several times the table, go at once and not when the driver happens to collect its garbage."""
    spark, out = df.sparkSession, materialise(df, label)
    del df
    gc.collect()
    spark._jvm.System.gc()
    return out


def _pairs(rows: DataFrame, sent, least: float) -> DataFrame:
    """Counts of (context of the tree's longest length, next word), where the word is frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        top = int(np.searchsorted(-tree.counts, -least, side="right"))  # ids go by falling counts
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(pair), pa.array(n.astype(np.int64))], names=["pair", "n"])

        for b in batches:
            for at in range(0, b.num_rows, 512):
                ids, first = _flat(b.column("ids").slice(at, 512))
                c = tree.contexts(ids, first)[-1]
                ok = (c >= 0) & (ids >= 0) & (ids < top)
                held.append((c[ok] << WORD_BITS) | ids[ok])
                size += len(held[-1])
                if size > CHUNK:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    return rows.mapInArrow(run, "pair long, n long")


def _whole(encoded: DataFrame, tree: Tree) -> DataFrame:
    """uid, added: what a broadcast tree adds to a text's score at the root."""
    sent = encoded.sparkSession.sparkContext.broadcast(Tree(Ids(), tree.counts, tree.n, tree.v, tree.once, tree.levels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = sent.value
        known_root = np.append(tree.root(tree.counts), 0.0)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                ids, first = _flat(part.column("ids"))
                root = known_root[ids]
                yield pa.record_batch([part.column("uid"), pa.array(np.add.reduceat(tree.score(ids, first, root) - root, first))], names=["uid", "added"])

    return encoded.select("uid", "ids").mapInArrow(run, "uid long, added double")


def _numbered(tree: Tree, counts: DataFrame) -> DataFrame:
    """counts of the words outside the head, with their ids (-1: the word occurs once, or the tree is whole)."""
    top = int(tree.counts.min()) if len(tree.counts) else None
    rest = counts if top is None else counts.where(F.col("n") < top)
    if tree.whole:
        return rest.withColumn("id", F.lit(-1).cast("long"))
    twice = rest.where("n >= 2")
    steps = sorted(((r["n"], r["k"]) for r in twice.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True)  # no more than the head's least count
    n, k = (np.array([x[i] for x in steps], dtype=np.int64) for i in (0, 1))
    tree.steps = np.append(n, 1), len(tree.counts) + np.append(0, np.cumsum(k))
    ids = numbered(twice, [F.desc("n"), F.asc("word")], "id").withColumn("id", F.col("id") + len(tree.counts))
    return ids.select("word", "n", "id").unionByName(rest.where("n < 2").withColumn("id", F.lit(-1).cast("long")))


def _texts(docs: DataFrame, tree: Tree, numbers: DataFrame, training: Column) -> DataFrame:
    """A written table of docs: as _encode(), with all words in the sums, and ids of all words that have one (others: -1)."""
    encoded = _encode(docs, tree, training)
    looked = _written(_looked(encoded, tree, numbers), "suffix-words")
    if tree.whole:
        joined = encoded.drop("tail").join(looked.drop("far"), "uid", "left")
        added = lambda c: (F.col(c) + F.coalesce(f"{c}2", F.lit(0))).alias(c)
        return _written(joined.select("uid", "doc_id", "training", "n_tokens", *map(added, ("known", "base", "root")), "ids"), "suffix-texts")

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(texts.column("uid").to_numpy())
        texts = texts.take(pa.array(order))
        uid = texts.column("uid").to_numpy()
        each = [np.frombuffer(x, dtype="<i4") for x in texts.column("ids").to_pylist()]
        long = np.array(list(map(len, each)))
        ids = np.concatenate(each)
        sums = [texts.column(c).to_numpy().copy() for c in ("known", "base", "root")]
        away = np.flatnonzero(ids < 0)
        key = np.repeat(np.arange(len(uid)), long)[away] << 32 | (-1 - ids[away]).astype(np.int64)
        ids[away] = -1
        if len(found):
            row = np.searchsorted(uid, found.column("uid").to_numpy())
            for x, c in zip(sums, ("known2", "base2", "root2")):
                x[row] += found.column(c).to_numpy()
            far = found.column("far").combine_chunks()
            far = far if isinstance(far, pa.ListArray) else far.chunk(0)
            times, far = far.value_lengths().to_numpy(zero_copy_only=False), far.flatten()
            have = np.repeat(row, times) << 32 | far.field("k").to_numpy(zero_copy_only=False).astype(np.int64)
            by = np.argsort(have)
            at = find(have[by], key)
            ids[away[at >= 0]] = far.field("id").to_numpy(zero_copy_only=False)[by][at[at >= 0]]
        rows = np.split(ids, np.cumsum(long)[:-1])
        cols = [*(texts.column(c) for c in ("uid", "doc_id", "training", "n_tokens")), *map(pa.array, sums), pa.array([x.tobytes() for x in rows], pa.binary())]
        return pa.table(cols, names=[c.split()[0] for c in TEXT.split(", ")])

    chunk = F.shiftright("uid", ROW_BITS).alias("chunk")
    both = encoded.drop("tail").groupBy(chunk).cogroup(looked.groupBy(chunk)).applyInArrow(run, TEXT)
    out = _written(both, "suffix-texts")
    discard(encoded)
    discard(looked)
    return out


def _scored(texts: DataFrame, added: DataFrame) -> DataFrame:
    joined = texts.drop("ids").join(added, "uid", "left")
    return joined.select(
        "doc_id", "training", "n_tokens", F.col("known").alias("n_known"), F.col("base").alias("base_score"), (F.col("root") + F.coalesce("added", F.lit(0.0))).alias("score")
    )


def learn(train: DataFrame) -> tuple[Tree, DataFrame]:
    """The tree of the texts in train (null: empty), and the written counts (word, n) of all its words."""
    tree, counts = _head(train)
    docs = train.select(F.lit(None).alias("doc_id"), "text")
    if tree.whole:
        grow(tree, _frequent(tree, _encode(docs, tree, F.lit(True)), 2))
    else:
        tree.train = _texts(docs, tree, _numbered(tree, counts), F.lit(True))
    return tree, counts


def score(docs: DataFrame, tree: Tree, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score for each row of docs (null texts: empty)."""
    texts = _texts(docs, tree, _numbered(tree, counts), F.lit(False))
    if tree.whole:
        return _scored(texts, _whole(texts, tree)).drop("training")
    both = texts.unionByName(tree.train.withColumn("uid", -1 - F.col("uid")))
    return _scored(texts, _added(both, tree)).drop("training")


def learn_and_score(docs: DataFrame, training: Column) -> tuple[Tree, DataFrame]:
    """The tree of the rows where training is true, and score() of all rows with that column; ids are looked up once."""
    tree, counts = _head(docs.where(training))
    texts = _texts(docs, tree, _numbered(tree, counts), training)
    if tree.whole:
        grow(tree, _frequent(tree, texts, 2))
        return tree, _scored(texts, _whole(texts, tree))
    return tree, _scored(texts, _added(texts, tree))


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree, found = learn_and_score(table(spark, sf_dir, "documents").select("doc_id", "text"), ~held_out())
    return found.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", F.lit(int(tree.n)).cast("long").alias("train_tokens"), "base_score", "score")
