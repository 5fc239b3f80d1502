"""What a dashboard makes of the published tables: map coverage, weighted cities, trend lines, growth, seasons, findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalgrid.functions.numbers import rint
from opalgrid.functions.scalars import city_keys, unmapped_class
from opalgrid.operators.metrics import one_row


def _known(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.col(c).isin("", "Unknown", "unknown")


def map_coverage(items: DataFrame, aliases: dict[str, str], label: str = "city", count: str = "vacancy_count") -> DataFrame:
    """One row: postings on the map, on several cities of it, and off it because the label is broad, missing or unmatched."""
    n, keys = F.col(count), city_keys(label, aliases)
    x = items.filter(n > 0).select(n.alias("n"), F.size(keys).alias("k"), unmapped_class(label).alias("c"))
    off = lambda c: F.coalesce(F.sum(F.when((F.col("k") == 0) & (F.col("c") == c), F.col("n"))), F.lit(0)).alias(f"{c}_vacancies")
    on = lambda cond, name: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias(name)
    out = x.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_vacancies"), on(F.col("k") > 0, "mapped_vacancies"), on(F.col("k") > 1, "multi_city_vacancies"), off("broad"), off("missing"), off("unmatched"))
    return out.withColumns({"mapped_share": F.coalesce(F.try_divide("mapped_vacancies", "total_vacancies"), F.lit(0.0)), "unmapped_vacancies": F.col("broad_vacancies") + F.col("missing_vacancies") + F.col("unmatched_vacancies")})


def weighted_cities(p: DataFrame, aliases: dict[str, str], city: str, *dimensions: str) -> DataFrame:
    """(city_key, dimension, label, vacancy_count, share, rank): postings by the cities that their label names, each city an equal
    part of a posting. The rows of `dimension` total are the cities themselves, by their rank."""
    keys = city_keys(city, aliases)
    # labels are few: what names a city is worked out once for each, not for each posting
    named = p.groupBy(city).agg(F.count(F.lit(1)).alias("n")).select(city, F.explode(keys).alias("city_key"), (F.lit(1.0) / F.size(keys)).alias("weight"))
    flat = p.groupBy(city, *dimensions).agg(F.count(F.lit(1)).alias("n")).join(named, city)
    w = (F.col("n") * F.col("weight")).alias("v")
    stacked = F.array(F.struct(F.lit("total").alias("dimension"), F.lit("").alias("label")), *(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("label")) for d in dimensions))
    sums = flat.select("city_key", F.explode(stacked).alias("x"), w).filter(F.col("x.label").isNotNull()).groupBy("city_key", "x.dimension", "x.label").agg(F.sum("v").alias("vacancy_count"))
    of = Window.partitionBy("city_key")
    whole = F.max(F.when(F.col("dimension") == "total", F.col("vacancy_count"))).over(of)
    out = sums.withColumn("share", rint(F.col("vacancy_count") / whole))
    ranked = Window.partitionBy(F.when(F.col("dimension") != "total", F.col("city_key")), "dimension").orderBy(F.desc("vacancy_count"), "label", "city_key")  # over the map's cities, and within one
    return out.withColumn("rank", F.row_number().over(ranked))


def top_roles(segments: DataFrame, limit: int) -> DataFrame:
    """Known roles by their published postings."""
    return segments.filter(_known("role_category")).groupBy("role_category").agg(F.sum("published_count").alias("published_count")).orderBy(F.desc("published_count"), "role_category").limit(limit)


def trend_lines(segments: DataFrame, period: str, limit: int) -> DataFrame:
    """(period, role_category, published_count) of the top roles over every period, 0 where there is nothing."""
    roles = F.broadcast(top_roles(segments, limit).select("role_category"))  # `limit` rows
    grid = segments.select(period).distinct().join(roles)
    have = segments.groupBy(period, "role_category").agg(F.sum("published_count").alias("published_count"))
    return grid.join(have, [period, "role_category"], "left").withColumn("published_count", F.coalesce("published_count", F.lit(0)))


def segment_growth(segments: DataFrame, period: str, days: int | None) -> DataFrame:
    """One row: what was published in the last `days` up to the latest period, in as many before, and the growth (null from 0). Without days
    the later half of the periods against the earlier one."""
    by = segments.groupBy(F.to_date(period).alias("d")).agg(F.sum("published_count").alias("n"))
    if days is None:
        place = F.row_number().over(Window.orderBy("d"))  # periods don't grow with postings
        x = by.withColumn("at", place).crossJoin(one_row(by.agg(F.count(F.lit(1)).alias("all"))))
        now, before = F.col("at") > F.floor(F.col("all") / 2), F.col("at") <= F.floor(F.col("all") / 2)
    else:
        x = by.crossJoin(one_row(by.agg(F.max("d").alias("latest"))))
        age = F.datediff("latest", "d")
        now, before = age < days, (age >= days) & (age < 2 * days)
    row = x.agg(*(F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(k) for k, c in (("current_count", now), ("previous_count", before))))
    return row.withColumn("growth_rate", rint(F.try_divide((F.col("current_count") - F.col("previous_count")).cast("double"), F.col("previous_count").cast("double"))))


def seasons(segments: DataFrame, period: str = "date") -> DataFrame:
    """Published postings by calendar month, with marks for the strongest and the weakest (the earlier of equals)."""
    by = segments.groupBy(F.month(F.to_date(period)).alias("month")).agg(F.sum("published_count").alias("vacancy_count"))
    ends = one_row(by.agg(F.max_by("month", F.struct("vacancy_count", -F.col("month"))).alias("strongest"), F.min_by("month", F.struct("vacancy_count", "month")).alias("weakest")))
    return by.crossJoin(ends).select("month", "vacancy_count", (F.col("month") == F.col("strongest")).alias("is_strongest"), (F.col("month") == F.col("weakest")).alias("is_weakest"))


def last_days(items: DataFrame, period: str, days: int | None) -> DataFrame:
    """Rows of the last `days` up to the latest date; rows without a date go. Without days all rows."""
    if days is None:
        return items
    latest = one_row(items.agg(F.max(F.to_date(period)).alias("__latest")))
    return items.crossJoin(latest).filter(F.datediff("__latest", F.to_date(period)).between(0, days - 1)).drop("__latest")


def client_filter(items: DataFrame, label: str, least: int = 0, hidden: tuple[str, ...] = ()) -> DataFrame:
    """Rows with a known label that isn't hidden and with `least` postings or more."""
    return items.filter(_known(label) & ~F.lower(label).isin(*[h.lower() for h in hidden] or [""]) & (F.col("vacancy_count") >= least))
