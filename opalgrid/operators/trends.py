"""Published and closed postings by period, growth, segments and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalgrid.functions.numbers import rint, share
from opalgrid.functions.text import known
from opalgrid.operators.metrics import as_metrics, one_row

WINDOWS = (30, 90, 180, 365)


def closed(p: DataFrame) -> DataFrame:
    """Postings last seen before the newest day on which any was seen, with closed_date."""
    newest = one_row(p.agg(F.max(F.to_date("last_seen_at")).alias("__newest")))
    return p.crossJoin(newest).filter(F.to_date("last_seen_at") < F.col("__newest")).withColumn("closed_date", F.to_date("last_seen_at")).drop("__newest")


def moves(p: DataFrame, *keep: str) -> DataFrame:
    """(day, published, gone and the labels kept): how many postings were published and last seen on a day. One pass over the postings: each
    gives up to two rows, counted before anything else. The newest day on which any was seen closes nothing, and which it is
    is told by the counts."""
    labels = [known(c).alias(c) for c in keep]
    day = lambda c, a, b: F.struct(F.to_date(c).alias("day"), F.lit(a).alias("published"), F.lit(b).alias("gone"))
    both = p.select(F.explode(F.array(day("publication_date", 1, 0), day("last_seen_at", 0, 1))).alias("x"), *labels).select("x.*", *keep).filter("day is not null")
    by = both.groupBy("day", *keep).agg(F.sum("published").alias("published"), F.sum("gone").alias("gone"))
    seen = F.max(F.when(F.col("gone") > 0, F.col("day")))
    # over a window of the days' counts; with labels, whose counts may be many, from the same aggregation by its reused exchange
    dated = by.crossJoin(one_row(by.agg(seen.alias("__newest")))) if keep else by.withColumn("__newest", seen.over(Window.partitionBy(F.lit(0))))
    left = dated.withColumn("gone", F.when(F.col("day") < F.col("__newest"), F.col("gone")).otherwise(F.lit(0))).drop("__newest")
    return left.filter("published > 0 or gone > 0")


def _period(grain: str) -> Column:
    return F.to_date(F.date_trunc(grain, "day")) if grain != "day" else F.col("day")


def counts(p: DataFrame, grain: str, name: str) -> DataFrame:
    """Published, closed, net and growth against the period before that has any row; growth from 0 is null.
    Weeks begin on Monday. The window is over periods, whose number doesn't grow with postings."""
    by = moves(p).groupBy(_period(grain).alias("d")).agg(F.sum("published").alias("published_count"), F.sum("gone").alias("closed_count"))
    before = F.lag("published_count").over(Window.orderBy("d"))
    growth = rint(F.try_divide((F.col("published_count") - before).cast("double"), before.cast("double")))
    return by.select(F.date_format("d", "yyyy-MM-dd").alias(name), "published_count", "closed_count", (F.col("published_count") - F.col("closed_count")).alias("net_change"), growth.alias("growth_rate")).orderBy(name)


def segments(p: DataFrame, grain: str, name: str) -> DataFrame:
    by = moves(p, "canton", "role_category").groupBy(_period(grain).alias("d"), "canton", "role_category").agg(F.sum("published").alias("published_count"), F.sum("gone").alias("closed_count"))
    return by.select(F.date_format("d", "yyyy-MM-dd").alias(name), "canton", "role_category", "published_count", "closed_count", (F.col("published_count") - F.col("closed_count")).alias("net_change")).orderBy(name, "canton", "role_category")


def monthly(p: DataFrame) -> DataFrame:
    """Published postings by calendar month, years together."""
    by = p.filter("publication_date is not null").groupBy(F.month("publication_date").alias("month")).agg(F.count(F.lit(1)).alias("vacancy_count"))
    total = F.sum("vacancy_count").over(Window.partitionBy(F.lit(0)))  # over twelve rows
    return by.select("month", "vacancy_count", share(F.col("vacancy_count"), total).alias("share")).orderBy("month")


def latest_publication(p: DataFrame) -> DataFrame:
    """One row: the latest day of publication as text; null if nothing was published."""
    return p.agg(F.date_format(F.max(F.to_date("publication_date")), "yyyy-MM-dd").alias("latest_publication_date"))


def summary(p: DataFrame, windows: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Totals and, for each window of N days up to the latest day, what was published in it and in the N days
    before, and the growth (null from 0). One pass over the counts by day."""
    days = moves(p)
    days = days.withColumn("latest", F.max("day").over(Window.partitionBy(F.lit(0))))  # over days, not postings
    age = F.datediff("latest", "day")
    cells = [F.sum("published").alias("published_total"), F.sum("gone").alias("closed_total")]
    for n in windows:
        cells += [F.sum(F.when(age < n, F.col("published")).otherwise(0)).alias(f"published_last_{n}_days"), F.sum(F.when((age >= n) & (age < 2 * n), F.col("published")).otherwise(0)).alias(f"published_previous_{n}_days")]
    row = days.agg(*cells)
    for n in windows:
        now, before = F.col(f"published_last_{n}_days"), F.col(f"published_previous_{n}_days")
        row = row.withColumn(f"growth_{n}_days", rint(F.try_divide((now - before).cast("double"), before.cast("double"))))
    return as_metrics(row)


def fastest_growing(p: DataFrame, by: str, days: int = 30) -> DataFrame:
    """Growth of each label's published postings in the last `days` against those before, both above 0."""
    dated = p.filter("publication_date is not null").select(known(by).alias(by), F.to_date("publication_date").alias("day"))
    age = F.datediff("latest", "day")
    both = dated.crossJoin(one_row(dated.agg(F.max("day").alias("latest")))).filter(age < 2 * days).groupBy(by).agg(F.count_if(age < days).alias("current_count"), F.count_if(age >= days).alias("previous_count"))
    change = F.col("current_count") - F.col("previous_count")
    return both.filter("current_count > 0 and previous_count > 0").select("*", change.alias("delta"), rint(change / F.col("previous_count")).alias("growth_rate")).orderBy(F.desc("growth_rate"), F.desc("delta"), by)
