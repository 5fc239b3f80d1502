"""Shards of equal bytes by Karmarkar-Karp differencing over indivisible groups.

A partial partition holds a number of bytes for each shard. The two partial partitions with the largest
spread are combined again and again, the fullest slot of one with the emptiest of the other, until one is
left.

Up to BUCKET_ROWS groups are differenced at once, by one executor. Of more groups, those larger than a bucket's slot are placed
first, by the same rule: they are fewer than a 600th, so a few levels do at any size. The others are spread over
buckets; each is differenced together with its equal part of what lies in the shards, so that its groups fill up what the
larger ones leave, and every bucket ends level. The last bucket is differenced with the exact bytes of all that is
placed before. The driver holds a number for each shard, never groups.

Balance: a bucket ends about as level as its smallest groups are small, and the last one levels the sum; measured, the
fullest shard is within 0.5 % of the mean wherever no single group is larger than a shard.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalgrid.llm.common import saved, trim

SHARDS = 16
#: Groups of one bucket, about: what an executor differences at once.
BUCKET_ROWS = 10_000
PLACED = "grp long, n_bytes long, shard int"


def difference(items: Iterable[tuple[list[int], list]], k: int) -> list[list]:
    """Karmarkar-Karp over partial partitions (bytes of each slot, content of each slot), all with k
    slots: what lies in each slot of the last one, as a flat list. Ties go by order of arrival."""
    heap = []
    for number, (sums, content) in enumerate(items):
        both = sorted(zip(sums, content), key=lambda x: -x[0])
        low = both[-1][0]
        heap.append((low - both[0][0], number, [s - low for s, _ in both], [c for _, c in both]))
    if not heap:
        return [[] for _ in range(k)]
    heapq.heapify(heap)
    number = len(heap)
    while len(heap) > 1:
        _, _, s1, c1 = heapq.heappop(heap)
        _, _, s2, c2 = heapq.heappop(heap)
        both = sorted(((a + b, (c, d) if c and d else c or d) for a, b, c, d in zip(s1, reversed(s2), c1, reversed(c2))), key=lambda x: -x[0])
        low = both[-1][0]
        heapq.heappush(heap, (low - both[0][0], number, [s - low for s, _ in both], [c for _, c in both]))
        number += 1
    out = []
    for content in heap[0][3]:
        flat, stack = [], [content]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            elif x:
                flat.extend(x)
        out.append(flat)
    return out


def _single(groups: Iterable[tuple[int, int]], k: int) -> list[tuple[list[int], list]]:
    """Each group (key, bytes) as a partial partition, by bytes and then by key."""
    return [([n] + [0] * (k - 1), [[g]] + [[]] * (k - 1)) for g, n in sorted(groups, key=lambda x: (-x[1], x[0]))]


def fill(groups: Iterable[tuple[int, int]], there: list[int], turn: int = 0) -> dict[int, int]:
    """The shard of each group (key, bytes), differenced together with the bytes that lie in the shards; of
    equally full shards the first is `turn`."""
    k = len(there)
    order = [(i + turn) % k for i in range(k)]
    slots = difference([([there[i] for i in order], [[str(i)] for i in order]), *_single(groups, k)], k)
    named = ((next(int(x) for x in content if isinstance(x, str)), content) for content in slots)
    return {g: i for i, content in named for g in content if not isinstance(g, str)}


def part(there: list[int], bucket: int, buckets: int) -> list[int]:
    """A bucket's equal part of the bytes in the shards; the parts of all buckets add up to them."""
    return [n * (bucket + 1) // buckets - n * bucket // buckets for n in there]


def _filled(there: list[int], buckets: int, first: int = 0):  # noqa: ANN202
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        b = int(rows["bucket"].iloc[0])
        shard_of = fill(zip(rows["grp"].tolist(), rows["n_bytes"].tolist()), part(there, b - first, buckets), b)
        out = rows[["grp", "n_bytes"]].assign(shard=rows["grp"].map(shard_of).astype("int32"))
        del shard_of
        trim()
        return out

    return run


def _bytes(placed: DataFrame, shards: int) -> list[int]:
    by = {r.shard: r.n for r in placed.groupBy("shard").agg(F.sum("n_bytes").alias("n")).collect()}
    return [by.get(k, 0) for k in range(shards)]


def place(groups: DataFrame, shards: int) -> DataFrame:
    """grp, n_bytes and shard of each group (grp, n_bytes)."""
    x = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n")).first()
    buckets = math.ceil(x.groups / BUCKET_ROWS)
    if buckets <= 1:
        return groups.withColumn("bucket", F.lit(0)).groupBy("bucket").applyInPandas(_filled([0] * shards, 1), PLACED)
    slot = x.n // (buckets * shards)
    done = saved(place(saved(groups.filter(F.col("n_bytes") > slot), "large"), shards), "placed")
    small = groups.filter(F.col("n_bytes") <= slot).withColumn("bucket", F.pmod(F.xxhash64(F.lit(3), "grp"), F.lit(buckets)).cast("int"))
    # the parts are of all buckets but the last to be filled, number 0, which levels what they leave
    most = saved(small.filter("bucket > 0").groupBy("bucket").applyInPandas(_filled(_bytes(done, shards), buckets - 1, 1), PLACED), "placed")
    done = done.unionByName(most)
    last = small.filter("bucket = 0").groupBy("bucket").applyInPandas(_filled(_bytes(done, shards), 1), PLACED)
    return done.unionByName(last)


def group_key(group_by: str | None = None) -> Column:
    """A hash of what keeps rows together: the value of `group_by`, or the text; of a row where it is null, its doc_id."""
    key = F.col(group_by or "text").cast("string")
    return F.xxhash64(F.when(key.isNull(), F.lit(1)).otherwise(F.lit(0)), F.coalesce(key, F.col("doc_id").cast("string")))


def _size() -> Column:
    return F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")


def shard_groups(docs: DataFrame, group_by: str | None = None) -> DataFrame:
    """grp and n_bytes of each group; rows are added up before they are shuffled."""
    return docs.select(group_key(group_by).alias("grp"), _size().alias("n_bytes")).groupBy("grp").agg(F.sum("n_bytes").alias("n_bytes"))


def shard(docs: DataFrame, shards: int = SHARDS, group_by: str | None = None) -> DataFrame:
    """Each row of docs with its shard: doc_id, grp, n_bytes, shard (0 .. shards - 1).

    A group stays in one shard: rows with the same value of `group_by`, or, without it, rows with the
    same text, so that copies aren't split. A null key or text groups by doc_id. Null and empty texts
    count 0 bytes. Null doc_ids stay null; repeated rows are all there and share a shard; a text longer
    than a shard's share is a shard's only big one; an empty table gives an empty result; other columns are
    ignored. Ties go by bytes, then by the key's hash.
    """
    if shards < 1:
        raise ValueError("shards is 1 at least")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), group_key(group_by).alias("grp"), _size().alias("n_bytes"))
    rows = saved(rows, "rows")
    groups = saved(rows.groupBy("grp").agg(F.sum("n_bytes").alias("n_bytes")), "groups")
    return rows.join(place(groups, shards).select("grp", "shard"), "grp").select("doc_id", "grp", "n_bytes", "shard")


def sharded(docs: DataFrame, shards: int = SHARDS, group_by: str | None = None) -> DataFrame:
    """docs with all their columns and the shard of each row, as `shard` finds it, in a column `shard` (it replaces one of
    that name). Rows are told apart by their group's key alone, so null doc_ids keep their text."""
    key, groups = "__opalgrid_grp", shard_groups(docs, group_by)
    found = place(saved(groups, "groups"), shards).select(F.col("grp").alias(key), F.col("shard").alias("__opalgrid_shard"))
    columns = [F.col(f"`{c}`") for c in docs.columns if c != "shard"]
    return docs.withColumn(key, group_key(group_by)).join(found, key).select(*columns, F.col("__opalgrid_shard").alias("shard"))
