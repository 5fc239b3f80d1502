"""Structured Streaming: windows, sessions, deduplication and idempotent upserts."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalgrid.operators.store import new_ids, seen_state


def source(spark: SparkSession, like: DataFrame, path: str, name: str = "*.parquet", files: int = 100) -> DataFrame:
    """A stream of the files of a folder, with the schema of a table that was read before."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", name).parquet(path)


def timed(events: DataFrame, at: str = "ts") -> DataFrame:
    return events.withColumn(at, F.col(at).cast("timestamp"))


def window_counts(events: DataFrame, width: str = "1 day", late: str = "2 days", slide: str | None = None, key: str = "event_type") -> DataFrame:
    """Events and their sum of values for each window and type; later ones than `late` are dropped."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return timed(events).withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), key, "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", key: str = "user_id") -> DataFrame:
    return timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct(events: DataFrame, keys: list[str], late: str = "2 days") -> DataFrame:
    """Each key once while the watermark remembers it."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def run(df: DataFrame, to: str, checkpoint: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """What is there now, then stop. The checkpoint makes a restart go on where it ended."""
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (w.foreachBatch(each) if each else w.format("parquet").option("path", to)).start().awaitTermination()


def upsert_into(folder: str, keys: list[str], at: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: first and last seen of each key as versions in a folder. A batch that is repeated after a
    failure writes its version again from the one before, so that nothing counts twice."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = f"{folder}/v={number - 1}"
        old = spark.read.parquet(before) if number else None
        seen_state(old, batch, keys, at).write.mode("overwrite").parquet(f"{folder}/v={number}")

    return each


def fresh(folder: str, key: str, out: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows with ids not seen in batches before, by batch; the first batch only marks its ids."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        ids = batch.select(key).distinct()
        if number:
            seen = spark.read.parquet(*(f"{folder}/b={k}" for k in range(number)))
            news = new_ids(batch, seen, key)
            news.write.mode("overwrite").parquet(f"{out}/b={number}")
            ids = news.select(key)
        ids.write.mode("overwrite").parquet(f"{folder}/b={number}")

    return each


def newest(folder: str) -> str:
    return str(max(Path(folder).glob("v=*"), key=lambda p: int(p.name[2:])))
