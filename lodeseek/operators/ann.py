"""Approximate nearest neighbours: vectors in lists around centroids, of which a query reads the nearest.

Centroids come from k-means on at most SAMPLE rows; every row is then put in the list of its nearest centroid. There
are about sqrt(n) lists, LISTS at most; a list with over HOT times its share is split around centroids of its own rows. Rows are
sorted by list, so that a query reads the pages of the lists that it probes. A query probes lists by falling likeness of
their centroids until they hold efSearch rows, and as many as gave RECALL of the nearest of QUERIES sampled rows among
the sample, which is measured when the lists are made: vectors without clusters so end as a scan of most lists. Ranks
within the lists are exact.

Lists are kept under a path and opened again with their centroids. A batch adds its vectors to the lists as they are, and
tombstones for those that it replaces (see sources.segments); once the vectors brought since are as many as there were at first, the
lists are made anew.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..schema import Field, Index
from ..sources.segments import Segments, Table
from ..storage import materialise, read_text, write_text

SAMPLE, LISTS, QUERIES, RECALL, HOT = 20_000, 4096, 100, 0.97, 8
#: Rows and queries of a cell that nearest() compares at once, products in memory at a time, and parts that cells are dealt to at most.
GROUP, ASKED, CHUNK, CELLS = 8192, 4096, 1 << 22, 4096
LIST = "__list"


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _far(queries: np.ndarray, made: np.ndarray, metric: str) -> np.ndarray:
    """For each query how far each of made lies, in some measure."""
    return -(_unit(queries) @ _unit(made).T) if metric == "cosine" else (made**2).sum(axis=1) - 2 * (queries @ made.T)


def _nearest(x: np.ndarray, centroids: np.ndarray, metric: str) -> np.ndarray:
    return _far(x, centroids, metric).argmin(axis=1)


def centroids(x: np.ndarray, k: int, metric: str, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k-means, on unit vectors for the cosine."""
    x = _unit(x) if metric == "cosine" else x
    out = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, out, metric)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(out)
        np.add.at(total, own, x)
        out[n > 0] = total[n > 0] / n[n > 0, None]
        if metric == "cosine":
            out = _unit(out)
    return out


def probes(x: np.ndarray, made: np.ndarray, metric: str, k: int = 10) -> int:
    """The fewest lists that hold RECALL of the k nearest of sampled rows."""
    queries = x[:: max(1, len(x) // QUERIES)]
    best = np.argsort(_far(queries, x, metric), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(_far(queries, made, metric), axis=1, kind="stable"), axis=1)  # of each list, by query
    needed = np.sort(np.take_along_axis(place, _nearest(x, made, metric)[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(RECALL * len(needed)))]) + 1


def _array(rows: list, d: int) -> np.ndarray:
    return np.array([r[0] for r in rows], dtype=np.float64).reshape(-1, d)


class Lists:
    """The lists of a vector field, under path: opened where path holds some, else made of docs."""

    def __init__(self, spark: SparkSession, index: Index, f: Field, path: str, docs: DataFrame | None = None):
        self.spark, self.path, self.field, self.metric, self.d = spark, path.rstrip("/"), f.name, index.metric(f), f.dimensions
        vector = T.ArrayType(T.FloatType())
        self.held = Segments(spark, path, {"vectors": Table(T.StructType().add("__key", T.StringType()).add(LIST, T.IntegerType()).add(f.name, vector), (LIST, "__key"))})
        if self.held.version < 0:
            self._make(docs)
        else:
            self._open()

    # centroids, a file for each version of them: segments say which they were put by

    def _open(self) -> None:
        self.generation = int(max((s.sums.get("generation", 0) for s in self.held.segments), default=0))
        made = json.loads(read_text(self.spark, f"{self.path}/_centroids-{self.generation}.json"))
        self.probes, self.first = made["probes"], made["rows"]
        self.centroids = np.frombuffer(base64.b64decode(made["centroids"]), dtype="<f4").astype(np.float64).reshape(-1, self.d)
        self._count()

    def _count(self) -> None:
        sums = self.held.sums()
        self.sizes = np.array([sums.get(f"list:{i}", 0) for i in range(len(self.centroids))])
        self.n = int(sums.get("rows", 0))

    def _vectors(self, docs: DataFrame) -> DataFrame:
        return docs.where(F.col(f"`{self.field}`").isNotNull()).select("__key", F.col(f"`{self.field}`").cast(T.ArrayType(T.FloatType())).alias(self.field))

    def _assigned(self, rows: DataFrame, made: np.ndarray) -> DataFrame:
        metric = self.metric

        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series(_nearest(np.array(s.tolist(), dtype=np.float64), made, metric)) if len(s) else pd.Series([], dtype="int64")

        return rows.withColumn(LIST, F.pandas_udf(of, "int")(F.col(f"`{self.field}`")))

    def _make(self, docs: DataFrame) -> None:
        rows = self._vectors(docs)
        n = rows.count()
        some = rows if n <= SAMPLE else rows.orderBy(F.xxhash64("__key")).limit(SAMPLE)
        x = _array(some.select(F.col(f"`{self.field}`")).collect(), self.d)
        k = max(1, min(LISTS, round(n**0.5), len(x)))
        made = centroids(x, k, self.metric) if len(x) else np.zeros((0, self.d))
        for _ in range(3):  # hot lists are split until none is left or can be
            held = materialise(self._assigned(rows, made), "lists") if len(x) else rows.withColumn(LIST, F.lit(0))
            counted = {r[LIST]: r["n"] for r in held.groupBy(LIST).agg(F.count("*").alias("n")).collect()}  # a row a list
            share = max(1, n // max(1, len(made)))
            hot = sorted((i for i, m in counted.items() if m > HOT * share), key=lambda i: -counted[i])[: max(0, LISTS - len(made))]
            more = []
            for i in hot:
                y = np.unique(_array(held.where(F.col(LIST) == i).orderBy(F.xxhash64("__key")).select(F.col(f"`{self.field}`")).limit(SAMPLE // 10).collect(), self.d), axis=0)
                parts = min(len(y), counted[i] // share, LISTS - len(made) - len(more))
                more += list(centroids(y, parts, self.metric)) if parts > 1 else []
            if not more:
                break
            made = np.concatenate([made, np.array(more)])
        self.generation = getattr(self, "generation", -1) + 1
        self.probes, self.first = probes(x, made, self.metric) if len(x) else 0, n
        body = {"probes": self.probes, "rows": n, "centroids": base64.b64encode(made.astype("<f4").tobytes()).decode()}
        write_text(self.spark, f"{self.path}/_centroids-{self.generation}.json", json.dumps(body))
        self.centroids = made.astype("<f4").astype(np.float64)  # as they are read again
        self.held.segments = []  # what was there is in docs
        self.held.append({"vectors": held}, None, n, 0, {"rows": n, "generation": self.generation} | {f"list:{i}": m for i, m in counted.items()})
        self._count()

    def update(self, new: DataFrame, old: DataFrame, n: int, gone: int, batch: int | None = None) -> None:
        """A batch's documents (with __key) and those that they replace, as they were."""
        rows, less = materialise(self._assigned(self._vectors(new), self.centroids), "lists") if len(self.centroids) else self._vectors(new).withColumn(LIST, F.lit(0)), self._vectors(old)
        put = {r[LIST]: r["n"] for r in rows.groupBy(LIST).agg(F.count("*").alias("n")).collect()}  # a row a list
        m = less.count() if gone else 0
        sums = {"rows": sum(put.values()) - m} | {f"list:{i}": x for i, x in put.items()}  # sizes count replaced rows until the lists are made anew
        self.held.append({"vectors": rows}, old.select("__key"), sum(put.values()), gone, sums, batch)
        self.held.tidy()
        self._count()
        if self.held.rows() > 2 * max(self.first, 1000):
            self._make(materialise(self.held.read("vectors").select("__key", F.col(f"`{self.field}`")), "vectors"))

    # queries

    def probed(self, vector: list[float], least: int) -> DataFrame:
        """__key and vector of the lists that a query looks at."""
        lists = _lists_of(np.array([vector], dtype=np.float64), self.centroids, self.sizes, self.metric, least, self.probes)[0] if len(self.centroids) else []
        return self.held.read("vectors").where(F.col(LIST).isin(lists)).select("__key", F.col(f"`{self.field}`"))

    def nearest(self, queries: DataFrame, k: int, least: int) -> DataFrame:
        """query, __key, __score of the k nearest of each query (query, vector): queries meet the lists that they probe.

        Lists are put together in groups of up to GROUP rows, a larger one is dealt to several; a group's rows and a block of about ASKED
        of the queries that probe it are a cell, compared by matrix products in chunks. Each cell gives the k best of its own for a query.
        """
        sizes, made, d, metric, fewest, field = self.sizes, self.centroids, self.d, self.metric, self.probes, self.field
        kind = queries.schema["query"].dataType
        schema = T.StructType().add("query", kind).add("__key", T.StringType()).add("__score", T.DoubleType())
        if not len(made):
            return self.spark.createDataFrame([], schema)
        first, parts = _groups(sizes)
        groups, blocks = int((first + parts).max()), -(-queries.count() // ASKED) or 1

        def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                found = _lists_of(np.array(s.tolist(), dtype=np.float64).reshape(-1, d), made, sizes, metric, least, fewest)
                yield pd.Series([_by_group(x, first, parts) for x in found], dtype=object)

        def at(lists: pd.Series, dealt: pd.Series) -> pd.Series:
            own = lists.to_numpy()
            return pd.Series(first[own] + dealt.to_numpy() % parts[own])

        def cell(rows: pa.Table, asked: pa.Table) -> pa.Table:
            rows = rows.take(pc.sort_indices(rows["__key"]))
            vectors = lambda c: np.array(c.to_pylist(), dtype=np.float32).reshape(-1, d)
            i, j, score = _best(vectors(asked["vector"]), vectors(rows["own"]), asked["lists"].to_pylist(), rows[LIST].to_numpy(), k, metric)
            return pa.table([asked["query"].take(pa.array(i)), rows["__key"].take(pa.array(j)), pa.array(score)], names=["query", "__key", "__score"])

        by = F.explode(F.pandas_udf(of, "array<struct<at:int,lists:array<int>>>")("vector")).alias("x")
        block = F.pmod(F.xxhash64("query"), F.lit(blocks))
        asked = queries.select("query", F.col("vector").cast("array<float>").alias("vector"), by).select((block * groups + F.col("x.at")).alias("cell"), "query", "vector", "x.lists")
        dealt = F.pandas_udf(at, "long")(F.col(LIST), F.pmod(F.xxhash64("__key"), F.lit(1 << 20)))
        rows = self.held.read("vectors").select(LIST, "__key", F.col(f"`{field}`").alias("own"), dealt.alias("at"))
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        rows = rows.select((F.col("block").cast("long") * groups + F.col("at")).alias("cell"), LIST, "__key", "own")
        n = min(CELLS, 2 * groups * blocks)  # a number of their own: cells are small and take long, so that they aren't put together
        met = rows.repartition(n, "cell").groupBy("cell").cogroup(asked.repartition(n, "cell").groupBy("cell"))
        some = met.applyInArrow(cell, schema)
        return some.withColumn("in", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("__score"), F.asc("__key"))) <= k).where("in").drop("in")


def _groups(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first group of each list, and how many it is dealt to."""
    parts = np.maximum(1, -(-sizes.astype(np.int64) // GROUP))
    first, at, held = np.zeros(len(sizes), np.int64), 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > GROUP:
            at, held = at + 1, 0
        first[i] = at
        if parts[i] > 1:
            at, held = at + int(parts[i]), 0
        else:
            held += n
    return first, parts


def _by_group(lists: list[int], first: np.ndarray, parts: np.ndarray) -> list[dict]:
    out: dict[int, list[int]] = {}
    for x in lists:
        for g in range(int(first[x]), int(first[x] + parts[x])):
            out.setdefault(g, []).append(x)
    return [{"at": g, "lists": held} for g, held in out.items()]


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of each two rows, added in order, as functions.vectors does."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def _exact(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """METRICS of each two rows, as the float that they are ranked by."""
    if metric == "euclidean":
        out = 1 / (1 + np.sqrt(_summed(q - x, q - x)))
    else:
        out = _summed(q, x)
    if metric == "cosine":
        both = np.sqrt(_summed(x, x)) * np.sqrt(_summed(q, q))
        out = np.where(both == 0, 0.0, np.clip(out / np.where(both == 0, 1.0, both), -1.0, 1.0))
    return out.astype(np.float32).astype(np.float64)


def _best(q: np.ndarray, x: np.ndarray, lists: list[list[int]], own: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, row and score of the k best rows of each query, by score and then by row; lists: those that each query looks at, own: each row's.

    Products find all rows that may be among the best, up to what rounding may change, and these are scored one by one. Of
    equal rows of a list the first k stay, as the others can't be among the best.
    """
    if not len(x) or not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    _, same = np.unique(np.hstack([np.ascontiguousarray(x).view(np.int32), own.astype(np.int32)[:, None]]), axis=0, return_inverse=True)
    order = np.argsort(same.ravel(), kind="stable")
    n = np.bincount(same.ravel())
    rank = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
    row = np.sort(order[rank < k])
    x, own, q = x[row].astype(np.float64), own[row], q.astype(np.float64)
    names, place = np.unique(own, return_inverse=True)
    number = {int(l): i for i, l in enumerate(names)}
    looks = np.zeros((len(q), len(names)), bool)
    for i, ls in enumerate(lists):
        looks[i, [number[l] for l in ls if l in number]] = True
    sets, which = np.unique(looks, axis=1, return_inverse=True)  # lists that the same queries look at go together
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for c in range(sets.shape[1]):
        rows, asks = np.flatnonzero(which.ravel()[place] == c), np.flatnonzero(sets[:, c])
        y = x[rows]
        step = max(1, CHUNK // len(rows))
        for a in range(0, len(asks), step):
            some = asks[a : a + step]
            z = q[some]
            like = z @ y.T if metric == "dotProduct" else -_far(z, y, metric)
            kth = np.partition(like, len(rows) - k, axis=1)[:, len(rows) - k] if len(rows) > k else np.full(len(z), -np.inf)
            i, j = np.nonzero(like >= (kth - _slack(kth, z, y, metric))[:, None])
            found.append(_first(some[i], rows[j], _exact(z[i], y[j], metric), k))
    i, j, score = _first(*(np.concatenate(z) for z in zip(*found)), k) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    return i, row[j], score


def _slack(kth: np.ndarray, q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """By how much less likeness than kth a row may have that scores as high once scores are floats."""
    if metric == "cosine":
        return np.full(len(kth), 1e-6)
    qq, xx = (q**2).sum(axis=1), (x**2).sum(axis=1).max()
    far = np.sqrt(np.maximum(0, qq - np.where(np.isfinite(kth), kth, 0)))
    return (1e-6 * (1 + far) ** 2 if metric == "euclidean" else 1e-6 * np.sqrt(qq * xx)) + 1e-11 * (qq + xx)


def _first(i: np.ndarray, j: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each i, by score and then by j."""
    order = np.lexsort((j, -score, i))
    i, j, score = i[order], j[order], score[order]
    n = np.unique(i, return_counts=True)[1]
    keep = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) < k
    return i[keep], j[keep], score[keep]


def _lists_of(x: np.ndarray, made: np.ndarray, sizes: np.ndarray, metric: str, least: int, fewest: int) -> list[list[int]]:
    """For each of x the lists by falling likeness, fewest at least, until they hold least rows."""
    order = np.argsort(_far(x, made, metric), axis=1, kind="stable")
    full = (np.cumsum(sizes[order], axis=1) < least).sum(axis=1) + 1
    return [o[: max(n, fewest)].tolist() for o, n in zip(order, full.tolist())]
