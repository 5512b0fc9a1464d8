"""Approximate retrieval by the displayed digits: hashed projections, and a proximity graph.

A displayed code is 6 first and 6 last digits. Projections hash the one-hot code in TABLES tables of DIMS normal projections
each; a query takes points within a radius in every dimension of a table, widening it until enough have votes. The graph
links each recipient to its nearest codes and is searched best first. Both rank by the number of differing digits.

Votes are a plan of joins: pairs of a look-alike and a recipient are met by victim, Arrow batches say in which round the first
table's radius reaches, and counts by round say where the look-alike stops. The graph's searches are
steps that depend on one another: a victim's recipients are worked on together there, a busy victim's queries in blocks.
"""

from __future__ import annotations

import functools
import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doppel.config import DetectorConfig
from doppel.functions import address
from doppel.operators import detect

TABLES, DIMS, CODE, RADIUS, GROWTH, ROUNDS = 8, 10, 12, 1.0, 1.5, 12
NEIGHBOURS, PROPOSALS, VISITED, SMALL = 16, 64, 64, 256
QUERIES = 4096
SEED = 1337
_RADII = np.array([RADIUS * GROWTH**r for r in range(ROUNDS)], np.float32)


@functools.cache
def weights() -> np.ndarray:
    return np.random.default_rng(SEED).normal(size=(TABLES, DIMS, CODE, 16)).astype(np.float32)


def codes(addresses: list[str]) -> np.ndarray:
    return np.array([[int(c, 16) for c in a[:6] + a[-6:]] for a in addresses], np.int64).reshape(-1, CODE)


def project(code: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(points, TABLES, DIMS): the sum over places of the weight of the digit there."""
    return sum(w[:, :, p, :][:, :, code[:, p]] for p in range(CODE)).transpose(2, 0, 1)


def differing(a: np.ndarray, code: np.ndarray) -> np.ndarray:
    return (code != a).sum(axis=1)


def by_votes(query: np.ndarray, at: np.ndarray, code: np.ndarray, places: np.ndarray, limit: int) -> np.ndarray:
    """Points in order of differing digits, then votes, then number."""
    want = max(1, min(limit, math.ceil(0.1 * len(code))))
    votes, radius = np.zeros(len(code), np.int64), RADIUS
    for _ in range(ROUNDS):
        votes += (np.abs(places - at) <= radius).all(axis=2).sum(axis=1)
        if (votes > 0).sum() >= want:
            break
        radius *= GROWTH
    found = np.flatnonzero(votes)
    order = np.lexsort((found, -votes[found], differing(query, code[found])))
    return found[order][:limit]


def build_graph(code: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """The nearest codes of each among its PROPOSALS by votes; of SMALL victims all points are weighed at once."""
    out, n = [], len(code)
    if n <= SMALL:
        far = (code[:, None] != code).sum(axis=2)
        first = np.searchsorted(_RADII, np.abs(places[:, None] - places).max(axis=3))
        some = (first.min(axis=2)[:, :, None] <= np.arange(ROUNDS)).sum(axis=1)  # points with votes, by round
        enough = some >= max(1, min(PROPOSALS + 1, math.ceil(0.1 * n)))
        stop = np.where(enough.any(axis=1), enough.argmax(axis=1), ROUNDS - 1)
        votes = np.maximum(stop[:, None, None] + 1 - first, 0).sum(axis=2)
        order = np.argsort(np.where(votes > 0, (far * 1000 + 999 - votes) * n + np.arange(n), np.iinfo(np.int64).max), axis=1)
        near = [[x for x in order[k, : min(np.count_nonzero(votes[k]), PROPOSALS + 1)].tolist() if x != k][:PROPOSALS] for k in range(n)]
    for k in range(n):
        if n <= SMALL:
            got = np.array(near[k] if len(near[k]) >= NEIGHBOURS else [x for x in range(n) if x != k], np.int64)
            distance = far[k, got]
        else:
            got = by_votes(code[k], places[k], code, places, PROPOSALS + 1)
            got = got[got != k][:PROPOSALS]
            distance = differing(code[k], code[got])
        out.append(got[np.lexsort((got, distance))][:NEIGHBOURS])
    return out


def by_graph(query: np.ndarray, at: np.ndarray, code: np.ndarray, places: np.ndarray, graph: list[np.ndarray], limit: int) -> np.ndarray:
    start = by_votes(query, at, code, places, 8)
    if not len(start):
        start = np.zeros(min(1, len(code)), np.int64)
    far = differing(query, code)
    heap, seen, visited = [(far[s], s) for s in start.tolist()], set(start.tolist()), []
    heapq.heapify(heap)
    while heap and len(visited) < VISITED:
        _, x = heapq.heappop(heap)
        visited.append(x)
        for y in graph[x].tolist():
            if y not in seen:
                seen.add(y)
                heapq.heappush(heap, (far[y], y))
    return np.array(sorted(visited, key=lambda x: (far[x], x))[:limit], np.int64)


def code(c) -> Column:
    """The 12 shown digits as one number."""
    return F.conv(F.concat(address.prefix_key(c, 6), address.suffix_key(c, 6)), 16, 10).cast("long")


def _plain(b: bytes) -> str:
    return b.hex() if len(b) == 20 else b[21:].decode()


def _reach(look: pa.Array, own: pa.Array) -> np.ndarray:
    """(rows, TABLES): the radius at which each table has the points of a row together. Addresses are packed."""
    (a, i), (c, j) = ((codes([_plain(v) for v in d.dictionary.to_pylist()]), d.indices.to_numpy()) for d in (look.dictionary_encode(), own.dictionary_encode()))
    pa_, pc_ = project(a, weights()), project(c, weights())
    out = np.zeros((len(look), TABLES), np.float32)
    for k in range(0, len(out), 4096):
        out[k : k + 4096] = np.abs(pc_[j[k : k + 4096]] - pa_[i[k : k + 4096]]).max(axis=2)
    return out


def _first_round(look: pa.Array, own: pa.Array) -> pa.Array:
    """The round of a point's first vote; ROUNDS if it has none."""
    return pa.array(np.searchsorted(_RADII, _reach(look, own).min(axis=1, initial=np.inf)).astype(np.int32))


def _votes(look: pa.Array, own: pa.Array, stop: pa.Array) -> pa.Array:
    """All votes up to a round."""
    first, last = np.searchsorted(_RADII, _reach(look, own)), stop.to_numpy(zero_copy_only=False)
    return pa.array(np.maximum(last[:, None] + 1 - first, 0).sum(axis=1).astype(np.int32))


def _differ(a: Column, c: Column) -> Column:
    both = a.bitwiseXOR(c)
    return sum((F.shiftright(both, 4 * k).bitwiseAND(F.lit(15)) != 0).cast("int") for k in range(CODE))


def voted(pairs: DataFrame, cps: DataFrame, limit: int, only: Column) -> DataFrame:
    """Candidate rows, as far as `only` holds, of what by_votes() gives for every look-alike, as a plan.

    Pairs of points are met as numbers and summed at once: what leaves a task is the count of each look-alike's votes by round. The
    round at which it stops goes back to its events, and those meet their victims' histories. Where more have votes than the limit,
    the last one within it goes along."""
    first, votes = F.arrow_udf(_first_round, "int"), F.arrow_udf(_votes, "int")
    key = ["victim", "lookalike"]
    pairs = pairs.withColumns({c: address.pack(c) for c in key})
    points = cps.select(address.pack("victim").alias("victim"), address.pack("recipient").alias("_r")).distinct()
    met = pairs.select(*key).distinct().join(points, "victim").withColumn("_f", first("lookalike", "_r"))
    counts = met.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *(F.count_if(F.col("_f") <= r).alias(f"_n{r}") for r in range(ROUNDS)))
    enough = F.greatest(F.lit(1), F.least(F.lit(limit), F.ceil(0.1 * F.col("_n"))))
    stop, most = F.lit(ROUNDS - 1), F.col(f"_n{ROUNDS - 1}")
    for r in reversed(range(ROUNDS - 1)):
        stop, most = (F.when(F.col(f"_n{r}") >= enough, x).otherwise(y) for x, y in ((F.lit(r), stop), (F.col(f"_n{r}"), most)))
    stops = counts.select(*key, stop.alias("_stop"), (most > limit).alias("_many"))
    crowd = stops.filter("_many").join(points, "victim").select(*key, F.struct(_differ(code(address.unpack("lookalike")), code(address.unpack("_r"))), -votes("lookalike", "_r", "_stop"), "_r").alias("_edge"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("_edge"))
    edges = crowd.filter(F.col("_edge")["col2"] < 0).withColumn("_nth", nth).filter(F.col("_nth") == limit).select(*key, "_edge")
    stops = stops.select(*key, "_stop").join(edges, key, "left")
    rows = detect.meet(pairs.join(stops, key), cps, only)
    look, own = address.pack("lookalike"), address.pack("recipient")
    rows = rows.withColumn("_place", F.struct(_differ(code("lookalike"), code("recipient")), -votes(look, own, "_stop"), own)).filter(F.col("_place")["col2"] < 0)
    return rows.filter(F.col("_edge").isNull() | (F.col("_place") <= F.col("_edge"))).drop("_place", "_stop", "_edge")


def retrieve(pairs: DataFrame, cps: DataFrame, cfg: DetectorConfig, graph: bool = False, only: Column | None = None) -> DataFrame:
    """Candidate rows like those of the exact retrievals; those only of which `only` holds."""
    limit = max(1, 2 * cfg.max_candidates_per_side) if cfg.max_candidates_per_side > 0 else 4096
    only = F.lit(True) if only is None else only
    rows = searched(pairs, cps, limit, only) if graph else voted(pairs, cps, limit, only)
    return rows.withColumns(detect.matched(cfg)).withColumns({"in_p": F.lit(True), "in_s": F.lit(True)})


def searched(pairs: DataFrame, cps: DataFrame, limit: int, only: Column) -> DataFrame:
    """Candidate rows (what scores need of them), as far as `only` holds, of what by_graph() gives for every look-alike.

    The rows come to their victim's points and stay if the search visits their recipient. A victim with more than QUERIES
    look-alikes is searched in as many blocks as that takes."""
    key, told = ["victim", "lookalike"], [*detect.EVENT, "p_symbol", "p_name", "p_missing"]
    pairs = pairs.select(*told).withColumns({c: address.pack(c) for c in key})
    busy = F.broadcast(pairs.groupBy("victim").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > QUERIES).select("victim", F.ceil(F.col("_n") / QUERIES).alias("_blocks")))
    blocks = F.coalesce("_blocks", F.lit(1))
    rows = detect.meet(pairs, cps.select("victim", *detect.HISTORY), only)
    rows = rows.withColumns({c: address.pack(c) for c in (*key, "recipient")})
    rows = rows.join(busy, "victim", "left").withColumn("_block", F.pmod(F.xxhash64("lookalike"), blocks)).drop("_blocks")
    points = cps.select(address.pack("victim").alias("victim"), address.pack("recipient").alias("recipient")).join(busy, "victim", "left")
    points = points.select("victim", "recipient", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("_block"))
    names = [c for c in rows.columns if c != "_block"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return left.select(names).slice(0, 0)
        ids = sorted(set(right.column("recipient").to_pylist()))
        code = codes([_plain(b) for b in ids])
        places, n = project(code, weights()), {b: k for k, b in enumerate(ids)}
        links, keep, known = build_graph(code, places), np.zeros(left.num_rows, bool), {}
        for k, (look, own) in enumerate(zip(left.column("lookalike").to_pylist(), left.column("recipient").to_pylist(), strict=True)):
            if look not in known:
                ask = codes([_plain(look)])
                known[look] = set(by_graph(ask[0], project(ask, weights())[0], code, places, links, limit).tolist())
            keep[k] = n[own] in known[look]
        return left.select(names).filter(pa.array(keep))

    got = rows.groupBy("victim", "_block").cogroup(points.groupBy("victim", "_block")).applyInArrow(search, rows.select(*names).schema)
    return got.withColumns({c: address.unpack(c) for c in (*key, "recipient")})
