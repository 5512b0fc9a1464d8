"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing with exact reranking.

Each of TABLES tables deals every vector to a bucket by several functions floor((a.x + b) / width), a being normal. Inner
products become distances by one more component that brings every vector to the largest norm. A query visits, in each
table, perturbed buckets in the order of their estimated success: given the query's projections, a neighbour's are taken as
normal, with slope and spread fitted on PILOT queries whose neighbours are found exactly. It visits buckets until the
tables together reach TARGET. Candidates of all tables are merged and ranked by their exact inner product in doubles.

The number of functions grows with the logarithm of the rows, so that buckets keep their size. Widths, offsets and spreads
are fitted on at most SAMPLE rows of least hash; every row is indexed. A bucket expected to hold more than CHUNK vectors is
split over several tasks, all of which its queries visit: no candidate is dropped. Of equal vectors one is indexed, with the
smallest ids of its copies, as many as an answer can hold. The sample's own scores give each query a floor, its
(2 k + 2)th best there, below which a candidate can't be among the k nearest, so that a bucket returns little.

Defined results: vectors that are null, empty, zero, of another than the most frequent length, or that hold null or
non-finite components take no part, nor do rows without an id; of repeated ids each row is a candidate, and the queries'
answers are the same; ties go to the smaller id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doppel.llm import shared

TABLES = 8
TARGET = 0.97
SAMPLE, PILOT = 16384, 64
CHUNK = 384
#: Buckets hold about so many rows, before the first and last cells.
BUCKET_ROWS = 1500
WIDTH = 1.6  # of a cell, in standard deviations of a projection


@dataclass
class Index:
    """What hashing needs: bounded by the dimension, TABLES and SAMPLE."""

    a: np.ndarray  # (d + 1, TABLES * functions)
    b: np.ndarray
    width: np.ndarray
    mean: np.ndarray  # of each projection
    norm: float
    functions: int
    slope: float
    spread: np.ndarray
    split: tuple[dict[int, int], ...]  # by table: chunks of buckets that are large
    floor: np.ndarray  # the sample, for the floors of queries

    def project(self, x: np.ndarray, query: bool) -> np.ndarray:
        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.column_stack([x, more]) @ self.a

    def cells(self, p: np.ndarray) -> np.ndarray:
        return np.floor((p - self.mean + self.b) / self.width).astype(np.int64)

    def key(self, table: int, cells: np.ndarray) -> np.ndarray:
        h = np.full(cells.shape[:-1], table + 1, np.uint64)
        for j in range(self.functions):
            h = shared.mix(h * np.uint64(0x9E3779B97F4A7C15) + cells[..., j].astype(np.uint64))
        return h.astype(np.int64)

    def probes(self, table: int, p: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each query its buckets, in the order of their estimated success, as many as its share of TARGET takes."""
        cols = slice(table * self.functions, (table + 1) * self.functions)
        own, width, b = p[:, cols] - self.mean[cols], self.width[cols], self.b[cols]
        want = 1 - (1 - TARGET) ** (1 / TABLES)
        expected = own * self.slope
        base = np.floor((expected + b) / width)
        steps = np.arange(-3, 4)
        cells = base[:, :, None] + steps
        lo = (cells * width[None, :, None] - b[None, :, None] - expected[:, :, None]) / self.spread[cols][None, :, None]
        hi = lo + (width / self.spread[cols])[None, :, None]
        chance = np.maximum(_normal(hi) - _normal(lo), 1e-12)
        todo, keep = np.arange(len(p)), 32
        while len(todo):
            score, path = np.ones((len(todo), 1)), np.zeros((len(todo), 1, 0), np.int64)
            for j in range(self.functions):  # the best `keep` beginnings hold those of the best `keep` buckets
                s = score[:, :, None] * chance[todo][:, j][:, None, :]
                grown = np.concatenate([np.repeat(path, len(steps), axis=1), np.tile(cells[todo][:, j][:, None, :], (1, path.shape[1], 1)).reshape(len(todo), -1, 1).astype(np.int64)], axis=2)
                s = s.reshape(len(todo), -1)
                top = np.argsort(-s, axis=1, kind="stable")[:, :keep]
                score, path = np.take_along_axis(s, top, 1), np.take_along_axis(grown, top[:, :, None], 1)
            reached = np.cumsum(score, axis=1)
            done = (reached[:, -1] >= want) | (score.shape[1] < keep) | (keep >= len(steps) ** self.functions)
            keys = self.key(table, path)
            for r in np.flatnonzero(done):
                yield todo[r], keys[r, : int(np.searchsorted(reached[r], want)) + 1]
            todo, keep = todo[~done], keep * 4


def _normal(x: np.ndarray) -> np.ndarray:
    """Cumulative normal distribution, by a logistic approximation (error below 2e-4)."""
    return 1 / (1 + np.exp(-np.clip(1.5976 * x + 0.07056 * x**3, -60, 60)))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1) if len(flat) else values.reshape(0, 1)


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, summed in one order whatever stands beside them."""
    return np.add.reduce(np.ascontiguousarray(q * v), axis=1)


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(_id, _vec) of the vectors that take part."""
    v = F.col("_vec")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) | ~F.exists(v, lambda x: x != 0)
    rows = rows.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).alias("_vec")).filter(F.col("_id").isNotNull() & v.isNotNull() & ~bad)
    length = rows.groupBy(F.size("_vec").alias("_d")).count().orderBy(F.desc("count"), "_d").limit(1).collect()
    return rows.filter(F.size("_vec") == (length[0]["_d"] if length else 0))


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """(_h1, _h2, _vec, _ids): each different vector with the `most` smallest ids of its copies, sorted."""
    hashed = rows.withColumns({"_h1": F.xxhash64("_vec"), "_h2": F.xxhash64("_vec", F.lit(1))})
    nth = F.row_number().over(Window.partitionBy("_h1", "_h2").orderBy("_id"))
    few = hashed.withColumn("_nth", nth).filter(F.col("_nth") <= most)  # limited within each task before the shuffle
    return few.groupBy("_h1", "_h2").agg(F.first("_vec").alias("_vec"), F.sort_array(F.collect_list("_id")).alias("_ids"))


def fit(vectors: DataFrame, k: int, seed: int = 2) -> Index | None:
    """An index from `vectors` (distinct, cut). None if there are none."""
    n, norm = vectors.select(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("_vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x)))).first()
    if not n:
        return None
    x = matrix(vectors.orderBy(F.xxhash64("_h1", F.lit(seed)), "_h1", "_h2").limit(SAMPLE).select("_vec").toArrow()["_vec"])
    rng = np.random.default_rng(seed)
    functions = max(3, int(np.ceil(np.log(max(2, n / BUCKET_ROWS)) / np.log(2)))) if n > 2 * BUCKET_ROWS else 2
    cols = TABLES * functions
    ix = Index(rng.normal(size=(x.shape[1] + 1, cols)), np.zeros(cols), np.ones(cols), np.zeros(cols), float(norm), functions, 0.0, np.ones(cols), tuple({} for _ in range(TABLES)), x)
    p = ix.project(x, False)
    ix.mean, sd = p.mean(0), np.maximum(p.std(0), 1e-9)
    ix.width = WIDTH * sd
    ix.b = rng.random(cols) * ix.width
    # the pilot queries' exact neighbours, of all rows: each task returns k for each
    pilot = x[:PILOT]
    shipped = vectors.sparkSession.sparkContext.broadcast(pilot)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shipped.value
        best, vec = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0, q.shape[1]))
        for b in batches:
            v = matrix(b.column(0))
            s = np.concatenate([best, q @ v.T], axis=1)
            top = np.argsort(-s, axis=1)[:, : k + 1]
            every = np.concatenate([vec, np.broadcast_to(v, (len(q), *v.shape))], axis=1)
            best, vec = np.take_along_axis(s, top, 1), np.take_along_axis(every, top[:, :, None], 1)
        rows = len(q) * best.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), best.shape[1])), pa.array(best.reshape(-1)), pa.FixedSizeListArray.from_arrays(pa.array(vec.reshape(-1)), q.shape[1]).cast(pa.list_(pa.float64())) if rows else pa.array([], pa.list_(pa.float64()))], names=["q", "s", "v"])

    found = vectors.select("_vec").mapInArrow(shared.trimmed(nearest), "q long, s double, v array<double>")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s")))
    near = found.withColumn("n", nth).filter(f"n between 2 and {k + 1}").select("q", "v").collect()
    if near:
        pq, pv = ix.project(pilot, True)[[r["q"] for r in near]] - ix.mean, ix.project(np.array([r["v"] for r in near]), False) - ix.mean
        ix.slope = float((pq * pv).sum() / max((pq * pq).sum(), 1e-12))
        ix.spread = np.maximum((pv - ix.slope * pq).std(0), 0.05 * sd)
    cells = ix.cells(p)
    for t in range(TABLES):
        keys, counts = np.unique(ix.key(t, cells[:, t * functions : (t + 1) * functions]), return_counts=True)
        for key, c in zip(keys, counts, strict=True):
            if (parts := int(np.ceil(c / len(x) * n / CHUNK))) > 1:
                ix.split[t][int(key)] = parts
    return ix


def search(rows: DataFrame, queries: DataFrame, *, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` (ids and vectors like `rows`) its k nearest of `rows` but itself."""
    spark = rows.sparkSession
    vectors = shared.cut(distinct_vectors(usable(rows, id_col, vec_col), k + 1), "vectors")
    asked = usable(queries, id_col, vec_col).withColumns({"_h1": F.xxhash64("_vec"), "_h2": F.xxhash64("_vec", F.lit(1))})
    want = shared.cut(asked.groupBy("_h1", "_h2").agg(F.first("_vec").alias("_vec")), "asked")
    index = fit(vectors, k)
    schema = "query_id long, rank int, vec_id long, score double"
    if index is None:
        return spark.createDataFrame([], schema)
    shipped = spark.sparkContext.broadcast(index)

    def deal(batches: Iterator[pa.RecordBatch], query: bool) -> Iterator[pa.RecordBatch]:
        ix = shipped.value
        for b in batches:
            x = matrix(b.column(2))
            p = ix.project(x, query)
            tasks, at = [], []
            if query:
                low = np.full(len(x), -np.inf)
                for i in range(0, len(x) if len(ix.floor) > 2 * k + 2 else 0, 128):
                    low[i : i + 128] = np.partition(x[i : i + 128] @ ix.floor.T, -2 * k - 2, axis=1)[:, -2 * k - 2]
                for t in range(TABLES):
                    for r, keys in ix.probes(t, p):
                        for key in keys.tolist():
                            for c in range(ix.split[t].get(key, 1)):
                                tasks.append((key ^ (c * 0x5851F42D4C957F2D)) & shared._MASK)
                                at.append(r)
                tasks, at = np.array(tasks, np.uint64).view(np.int64), np.array(at, np.int64)
            else:
                low = np.zeros(len(x))
                cells = ix.cells(p)
                for t in range(TABLES):
                    keys = ix.key(t, cells[:, t * ix.functions : (t + 1) * ix.functions])
                    if ix.split[t]:
                        own = b.column(0).to_numpy(zero_copy_only=False)
                        for r, key in enumerate(keys.tolist()):
                            if (parts := ix.split[t].get(key, 1)) > 1:
                                keys[r] = np.array([(key ^ ((int(own[r]) % parts) * 0x5851F42D4C957F2D)) & shared._MASK], np.uint64).view(np.int64)[0]
                    tasks.append(keys)
                    at.append(np.arange(len(x)))
                tasks, at = np.concatenate(tasks), np.concatenate(at)
            for i in range(0, len(at), 8192):
                s = pa.array(at[i : i + 8192])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tasks[i : i + 8192]), pa.array(np.full(len(s), query)), b.column(0).take(s), b.column(1).take(s), pa.array(low[at[i : i + 8192]]), b.column(2).take(s)],
                    names=["task", "query", "h1", "h2", "low", "vec"],
                )

    kind = f"task long, query boolean, h1 long, h2 long, low double, vec array<{dict(vectors.dtypes)['_vec'][6:-1]}>"
    spread = spark.sparkContext.defaultParallelism
    tasks = vectors.select("_h1", "_h2", "_vec").mapInArrow(shared.trimmed(lambda b: deal(b, False)), kind).unionByName(want.repartition(4 * spread, "_h1").select("_h1", "_h2", "_vec").mapInArrow(shared.trimmed(lambda b: deal(b, True)), kind))

    def match(group: pa.Table) -> pa.Table:
        is_q = group["query"].to_numpy(zero_copy_only=False).astype(bool)
        qa, va = np.flatnonzero(is_q), np.flatnonzero(~is_q)
        out = {c: np.zeros(0, np.int64) for c in ("q1", "q2", "v1", "v2")} | {"score": np.zeros(0)}
        parts = []
        if len(qa) and len(va):
            x, v = matrix(group["vec"].take(pa.array(qa))), matrix(group["vec"].take(pa.array(va)))
            low = group["low"].to_numpy()[qa]
            h = {c: group[c].to_numpy() for c in ("h1", "h2")}
            for i in range(0, len(qa), 256):
                s = x[i : i + 256] @ v.T
                if s.shape[1] > k + 1:
                    kth = np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1]
                else:
                    kth = np.full(len(s), -np.inf)
                r, c = np.nonzero(s >= np.maximum(kth, low[i : i + 256])[:, None] - 1e-9)
                parts.append((qa[i + r], va[c], exact_scores(x[i + r], v[c])))
            a, b, sc = (np.concatenate(y) for y in zip(*parts, strict=True))
            out = {"q1": h["h1"][a], "q2": h["h2"][a], "v1": h["h1"][b], "v2": h["h2"][b], "score": sc}
        return pa.table(out)

    pairs = tasks.groupBy("task").applyInArrow(match, "q1 long, q2 long, v1 long, v2 long, score double")
    pairs = pairs.groupBy("q1", "q2", "v1", "v2").agg(F.max("score").alias("score"))
    # copies of one vector tie: k + 1 different vectors hold the k + 1 nearest rows; equal scores beyond stay in by rank()
    few = pairs.withColumn("_r", F.rank().over(Window.partitionBy("q1", "q2").orderBy(F.desc("score")))).filter(F.col("_r") <= k + 1).drop("_r")
    ids = vectors.select(F.col("_h1").alias("v1"), F.col("_h2").alias("v2"), "_ids")
    near = few.join(ids, ["v1", "v2"]).select("q1", "q2", "score", F.explode("_ids").alias("vec_id"))
    order = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "vec_id")
    near = near.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1)
    lists = near.groupBy("q1", "q2").agg(F.array_sort(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("_near"))
    mine = asked.select(F.col("_h1").alias("q1"), F.col("_h2").alias("q2"), F.col("_id").alias("query_id"))
    got = mine.join(lists, ["q1", "q2"]).select("query_id", F.slice(F.filter("_near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("_near"))
    return got.select("query_id", F.posexplode("_near").alias("_p", "_x")).select("query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_x.vec_id").alias("vec_id"), F.col("_x.score").alias("score"))
