"""What the operators of this subpackage share: scratch tables, checked broadcasts, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows of a key-only table up to which it is broadcast; beyond it Spark joins by shuffle.
BROADCAST_ROWS = 2_000_000
#: Bytes of text that one step of a vectorised kernel takes at once.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of `spark.checkpoint.dir`; only where it is unset and Spark runs locally, a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="opalgrid-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return base


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/opalgrid/{re.sub('[^a-z0-9]+', '-', name)}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of one Arrow batch: an executor holds a few at once for each task, in and out, beside its heap.
BATCH_BYTES = 8 << 20
_BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def narrow(df: DataFrame) -> DataFrame:
    """df, after the session's Arrow batches were limited to BATCH_BYTES where they may be larger."""
    conf = df.sparkSession.conf
    now = re.sub("[^0-9]", "", conf.get(_BATCHES) or "")
    if int(now or 0) > BATCH_BYTES:
        conf.set(_BATCHES, str(BATCH_BYTES))
    return df


def map_rows(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], more: Sequence[StructField] = ()) -> DataFrame:
    """df.mapInArrow(f) with all columns of df and those in `more`, whatever their names: f sees and gives them by their place."""
    fields = [*df.schema.fields, *more]
    inner = StructType([StructField(f"c{k}", x.dataType, True) for k, x in enumerate(fields)])
    return narrow(df).toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(f, inner).toDF(*(x.name for x in fields))


def keyed(df: DataFrame, keys: DataFrame, key: str, how: str) -> DataFrame:
    """df joined (`inner`, `left_semi` or `left_anti`) with a narrow table of keys. The keys are broadcast
    only if a count of them stays under BROADCAST_ROWS, else both sides are shuffled."""
    if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    return df.join(keys, key, how)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of a text column, nulls as 0."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def trim() -> None:
    """Give memory that is free back to the system, where its allocator can: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def buffers(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, nulls as empty, and the n + 1 offsets of its values."""
    if batch.null_count:
        batch = batch.fill_null("" if not pa.types.is_binary(batch.type) else b"")
    wide = pa.types.is_large_string(batch.type) or pa.types.is_large_binary(batch.type)
    _, off, data = batch.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[batch.offset : batch.offset + len(batch) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(batch) else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES, most_values: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Ranges of whole values of about `most` bytes and at most `most_values` each; a longer value is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(n, i + most_values, max(j, i + 1))
        yield i, j
        i = j


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def unit_hash(column: Column | str, seed: int) -> Column:
    """A uniform number in [0, 1) that depends on a value and a seed alone."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.col(column) if isinstance(column, str) else column), F.lit(1 << 30)) / float(1 << 30)).cast("double")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of an undirected graph given by edges: comp is the smallest node that can be reached.

    First every node goes to the smallest of its neighbourhood, which makes one node of each dense group.
    Among what edges are left, labels move to the smallest of the neighbourhood and then jump to the
    label of their label, so a chain of n nodes takes O(log n) rounds. Each round is a table in the
    shared folder, so that lineage stays short and a lost executor costs one round. Ends when no label
    changed; no edges give an empty table.
    """
    flat = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    turned = lambda e: e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = saved(turned(flat).groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("p")), "near")
    ends = flat.join(near, "u").select(F.col("p").alias("pu"), "v").join(near.select(F.col("u").alias("v"), "p"), "v")
    rest = saved(turned(ends.filter("pu != p").select(F.col("pu").alias("u"), F.col("p").alias("v"))).distinct(), "edges")
    labels = saved(rest.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("comp")), "labels")
    while not rest.isEmpty():
        least = rest.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("m"))
        step = labels.join(least, "node", "left").select("node", F.col("comp").alias("was"), F.least("comp", F.coalesce("m", "comp")).alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        step = saved(step.join(jump, "comp", "left").select("node", "was", F.least("comp", F.coalesce("far", "comp")).alias("comp")), "labels")
        labels = step.select("node", "comp")
        if step.filter("comp != was").isEmpty():
            break
    named = near.join(labels.withColumnRenamed("node", "p"), "p", "left")
    return saved(named.select(F.col("u").alias("node"), F.coalesce("comp", "p").alias("comp")), "components")
