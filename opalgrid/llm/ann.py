"""Nearest neighbours by collision counting over single projections.

Each of up to PROJECTIONS orthonormal directions gives one sorted array of the vectors' projections. A query opens a
window around its own projection in every array. Virtual rehashing widens all windows round by round: in each
array two pointers move outwards, and only the entries that they newly pass add to the collision counts. A vector that
collides in THRESHOLD of the arrays is verified by its distance.

A vector at distance d has projections that differ from the query's by d / sqrt(dimensions) on average, whatever the
data, as the directions are random. So for a window there is a distance up to which a vector reaches the threshold with a
probability of 1 - MISS. The search of a query ends when its K best verified vectors lie within that distance,
or within the one that no vector below the threshold can have.

Vectors are dealt to blocks; a block and a part of the queries are a task with the sorted arrays of the block, and the
K nearest of all blocks are merged. A block's own K best are no nearer than those of all, so more blocks widen windows and lose nothing.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, PROJECTIONS, THRESHOLD, MISS = 10, 32, 0.6, 0.02
#: Each round's window is so many times as wide as the last one's; the first holds about FIRST vectors an array.
WIDER, FIRST = 1.6, 64
#: Numbers in the vectors of one block, queries of one task.
BLOCK_NUMBERS, TASK_QUERIES = 2_000_000, 4_000
RESULT = "vec_id long, neighbor_id long, rank int, distance double"
FOUND = "vec_id long, neighbor_id long, distance double"


def directions(dim: int) -> np.ndarray:
    q, _ = np.linalg.qr(np.random.default_rng(31).normal(size=(dim, dim)))
    return np.ascontiguousarray(q[:, : min(dim, PROJECTIONS)])


@cache
def reach(m: int, need: int, miss: float) -> float:
    """Half-width of a window, by the mean difference of projections, in which `need` of m projections fall with a
    probability of 1 - miss."""
    tail = lambda p: sum(math.comb(m, i) * p**i * (1 - p) ** (m - i) for i in range(need))
    low, high = 0.0, 10.0
    for _ in range(60):
        x = (low + high) / 2
        low, high = (x, high) if tail(math.erf(x / math.sqrt(2))) > miss else (low, x)
    return high


def search(queries: np.ndarray, q_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int = K, miss: float = MISS) -> list[tuple[int, int, float]]:
    """(query id, neighbour id, distance) of the k nearest others of each query; fewer if data holds fewer."""
    n, dim = data.shape
    a = directions(dim)
    m = a.shape[1]
    own, at = data @ a.astype(data.dtype), queries @ a.astype(data.dtype)
    order = np.ascontiguousarray(np.argsort(own, axis=0, kind="stable").T.astype(np.int32))
    values = np.ascontiguousarray(np.take_along_axis(own.T, order, axis=1))
    need = max(1, math.ceil(THRESHOLD * m))
    # distance that a window of half-width 1 answers for: likely, and surely (all short of the threshold lie beyond in the other arrays)
    covers = max(math.sqrt(dim) / reach(m, need, miss), math.sqrt(m - need + 1) * (1 - 1e-6))
    norms = np.einsum("ij,ij->i", data, data, dtype=np.float64)
    last = float(max(own.max() - min(own.min(), at.min()), at.max() - own.min())) + 1e-6 if n else 0.0
    spread = float(np.median(values[:, int(n * 0.84)] - values[:, int(n * 0.16)])) if n else 0.0
    start = min(max(spread * FIRST / n, last * 1e-6), last) if n else 1.0
    out = []
    for q in range(len(queries)):
        p, x = at[q], queries[q].astype(np.float64)
        low = np.array([v.searchsorted(y) for v, y in zip(values, p)])
        high, counts = low.copy(), np.zeros(n, np.int16)
        done, found, near, radius = np.zeros(n, bool), [np.empty(0, np.int64)], [np.empty(0)], start
        best = np.full(k, np.inf)
        while True:
            radius = last if radius * WIDER > last else radius
            new_low = [v.searchsorted(y) for v, y in zip(values, p - radius)]
            new_high = [v.searchsorted(y, "right") for v, y in zip(values, p + radius)]
            passed = [order[j, a:b] for j in range(m) for a, b in ((new_low[j], low[j]), (high[j], new_high[j])) if a < b]
            low, high = new_low, new_high
            if passed:
                counts += np.bincount(np.concatenate(passed), minlength=n).astype(np.int16)
            new = np.flatnonzero((counts >= need) > done if radius < last else ~done)
            if len(new):
                done[new] = True
                products = data[new] @ queries[q] if len(new) < n // 4 else (data @ queries[q])[new]
                distance = np.maximum(norms[new] - 2.0 * products + x @ x, 0.0)
                other = ids[new] != q_ids[q]
                found.append(new[other])
                near.append(distance[other])
                best = np.partition(np.concatenate([best, near[-1]]), k - 1)[:k]
            far = math.sqrt(best.max())
            if radius >= last or far <= covers * radius * (1 + 1e-9):
                break
            # once k are known, no window wider than they need is opened
            radius = min(radius * WIDER, max(far / covers, radius)) if math.isfinite(far) else radius * WIDER
        found, distance = np.concatenate(found), np.concatenate(near)
        if len(found) > k:  # the nearest few, with room for rounding, are measured once more
            found = found[distance <= best.max() * (1 + 1e-4) + 1e-5 * (1 + x @ x)]
        d = np.sqrt(((data[found].astype(np.float64) - x) ** 2).sum(axis=1))
        out.extend((int(q_ids[q]), int(ids[found[b]]), float(d[b])) for b in np.lexsort((ids[found], d))[:k])
    return out


def _vectors(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in order and vectors, of rows with the same id the smallest vector."""
    ids, v = t.column("vec_id").to_numpy(), t.column("v").combine_chunks()
    x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(ids), -1)
    o = np.argsort(ids, kind="stable")
    ids, x = ids[o], x[o]
    again = np.flatnonzero(ids[1:] == ids[:-1])
    if len(again):
        o = np.lexsort((*x.T[::-1], ids))
        ids, x = ids[o], x[o]
        first = np.concatenate([[True], ids[1:] != ids[:-1]])
        ids, x = ids[first], x[first]
    return ids, x


def _pair(k: int, miss: float):  # noqa: ANN202
    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        found = search(*_vectors(q)[::-1], *_vectors(d)[::-1], k, miss) if q.num_rows and d.num_rows else []
        a, b, c = zip(*found) if found else ((), (), ())
        return pa.table({"vec_id": pa.array(a, pa.int64()), "neighbor_id": pa.array(b, pa.int64()), "distance": pa.array(c, pa.float64())})

    return run


def nearest(vectors: DataFrame, every: int = 1, k: int = K, miss: float = MISS) -> DataFrame:
    """The k nearest other vectors, by Euclidean distance, of every vector whose vec_id is divisible by `every`: vec_id, neighbor_id, rank
    from 1, distance. A true neighbour is missed with a probability of `miss` at most; distances are exact.

    Ties in distance go to the smaller id. Left out are null ids, and vectors that
    are null, empty, hold a null or a number that isn't finite, or whose length isn't the most frequent
    one (of equally frequent ones the smallest). Of rows with the same id one counts (the smallest vector). Fewer than k + 1 vectors give fewer
    neighbours, one vector or none an empty result; other columns are ignored.
    """
    v = F.col("embedding").cast("array<float>")
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and abs(x) < float('inf') and not isnan(x))")
    asked = (F.col("vec_id") % every == 0).cast("long")
    dims = good.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("count"), F.sum(asked).alias("asked")).orderBy(F.desc("count"), "d").first()
    if dims is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    good = good.filter(F.size("v") == dims["d"])
    blocks = max(1, math.ceil(dims["count"] * dims["d"] / BLOCK_NUMBERS))
    # few blocks: their queries are split further, to keep executors busy
    parts = max(math.ceil(dims["asked"] / TASK_QUERIES), min(8 // blocks, math.ceil(dims["asked"] / 64)), 1)
    dealt = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(n)).cast("int")
    q = good.filter(asked == 1).select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), dealt(11, parts).alias("part"))
    d = good.select("vec_id", "v", dealt(7, blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    found = q.groupBy("block", "part").cogroup(d.groupBy("block", "part")).applyInArrow(_pair(k, miss), FOUND)
    w = Window.partitionBy("vec_id").orderBy("distance", "neighbor_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("vec_id", "neighbor_id", "rank", "distance")
