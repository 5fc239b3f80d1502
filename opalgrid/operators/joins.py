"""Joins by time and by range that don't compare every pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, columns: list[str]) -> DataFrame:
    """left with `columns` of the last row of right with the same keys and a time not after its own; nulls where there is none. Both sides go
    through one window over the keys, so a key costs its rows and not their product. Of rows of right at one time the one with the largest `columns` counts;
    rows of left without a time get nulls."""
    row = F.struct(*(F.col(f"`{c}`") for c in left.columns))
    a = left.select(*by, time, row.alias("__row"), F.lit(None).cast(right.select(F.struct(*columns).alias("x")).schema["x"].dataType).alias("__right"), F.lit(1).alias("__side"))
    b = right.filter(F.col(time).isNotNull()).select(*by, time, F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.struct(*columns).alias("__right"), F.lit(0).alias("__side"))
    before = Window.partitionBy(*by).orderBy(F.col(time).asc_nulls_first(), "__side", "__right")
    out = a.unionByName(b).withColumn("__last", F.last("__right", ignorenulls=True).over(before)).filter("__side = 1")
    return out.select("__row.*", *(F.col(f"__last.{c}").alias(f"{c}_before") for c in columns))


#: Rows of one class in one array, and comparisons that a task makes for one key.
CHUNK, CELL = 512, 1 << 27


def _plain(df: DataFrame) -> list[str]:
    """Columns that can be ordered and hashed."""
    return [f"`{c}`" for c, t in df.dtypes if "map<" not in t and t != "variant"]


def chunks(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Rows that agree in `by`, CHUNK at most to a row: `by` and an array `name` of structs of the other columns."""
    rest = [c for c in df.columns if c not in by]
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*_plain(df)))  # by content, so that a task that is run again deals alike
    return df.withColumn("__chunk", F.floor((place - 1) / CHUNK)).groupBy(*by, "__chunk").agg(F.collect_list(F.struct(*(F.col(f"`{c}`") for c in rest))).alias(name)).drop("__chunk")


def meet(left: DataFrame, right: DataFrame, by: list[str], left_rows: Column, right_rows: Column) -> DataFrame:
    """Inner join by equality of `by` for keys with many rows on both sides: the rows of left of a key are dealt to so many tasks that each makes
    CELL comparisons or so, and right's go to each of them. `*_rows` are the rows that a row stands for. So a key's work is spread, and only right's rows of one key are held."""
    n = left.groupBy(*by).agg(F.sum(left_rows).alias("__l"), F.count(F.lit(1)).alias("__k")).join(right.groupBy(*by).agg(F.sum(right_rows).alias("__r")), by)
    hot = n.withColumn("__cells", F.least("__k", F.ceil(F.col("__l").cast("double") * F.col("__r") / CELL)).cast("int")).filter("__cells > 1").select(*by, "__cells")
    cells = F.coalesce("__cells", F.lit(1))  # a key of `hot` stands for 2 * sqrt(CELL) rows or more, so the table is small
    dealt = left.join(F.broadcast(hot), by, "left").withColumn("__cell", F.pmod(F.xxhash64(*_plain(left)), cells).cast("int")).drop("__cells")
    every = right.join(F.broadcast(hot), by, "left").withColumn("__cell", F.explode(F.sequence(F.lit(0), cells - 1))).drop("__cells")
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)  # few bytes make many rows here, so none are put together
    keys = [*by, "__cell"]
    return dealt.repartition(tasks, *keys).join(every.repartition(tasks, *keys).hint("merge"), keys).drop("__cell")


def in_range(points: DataFrame, ranges: DataFrame, by: list[str], point: str, low: str, high: str, width: int) -> DataFrame:
    """Points with the ranges (both ends in) that hold them. Ranges are dealt to the stretches of `width` that they touch, so a point meets only those of
    its own stretch; `width` near a usual range's length keeps that few. Equal ranges are compared once with a point, and a stretch with many rows is several tasks."""
    own = points.withColumn("__b", F.floor(F.col(point) / width))
    dealt = ranges.filter(F.col(low) <= F.col(high)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    ends = dealt.withColumns({"__low": F.col(low), "__high": F.col(high)})
    met = meet(own, chunks(ends, [*by, "__b", "__low", "__high"], "__rows"), [*by, "__b"], F.lit(1), F.size("__rows"))
    rest = lambda df: [c for c in df.columns if c not in by]
    kept = [*by, *(f"`{c}`" for c in rest(points))]
    held = met.filter(F.col(point).between(F.col("__low"), F.col("__high"))).select(*kept, F.explode("__rows").alias("__row"))
    return held.select(*kept, *(F.col(f"__row.`{c}`").alias(c) for c in rest(ranges)))


def overlapping(left: DataFrame, right: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Pairs of rows that agree in `by` and whose arrays `a` (of left) and `b` (of right) share an item, each pair once. Rows meet by item, and the pair is
    kept at the first item that they share, so rows that share nothing never meet; equal arrays of right are compared once with a row of left."""
    items = lambda c: F.array_distinct(F.array_compact(c))
    x = left.withColumn("__item", F.explode(items(a)))
    y = chunks(right.withColumn("__set", items(b)), [*by, "__set"], "__rows").withColumn("__item", F.explode("__set"))
    met = meet(x, y, [*by, "__item"], F.lit(1), F.size("__rows")).filter(F.col("__item") == F.get(F.array_intersect(items(a), "__set"), F.lit(0)))
    rest = lambda df: [c for c in df.columns if c not in by]
    kept = [*by, *(f"`{c}`" for c in rest(left))]
    return met.select(*kept, F.explode("__rows").alias("__row")).select(*kept, *(F.col(f"__row.`{c}`").alias(c) for c in rest(right)))
