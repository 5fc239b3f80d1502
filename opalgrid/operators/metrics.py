"""Counts, shares, cross tables, salary, education and experience tables over postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalgrid.functions.numbers import annual, rint, share
from opalgrid.functions.text import known

DIMENSIONS = ("company", "role_category", "city", "canton", "seniority", "work_mode")


def one_row(df: DataFrame) -> DataFrame:
    """Marks the result of a global aggregate, one row by construction, for a broadcast."""
    return F.broadcast(df)


def as_metrics(row: DataFrame) -> DataFrame:
    """(metric, value) of a one-row table, one row for each column."""
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns))
    return row.select(F.explode(pairs).alias("m")).select("m.metric", "m.value")


def overview(p: DataFrame) -> DataFrame:
    """Postings, companies (null is none) and postings for each company, 2 decimals; null without companies."""
    row = p.agg(F.count(F.lit(1)).alias("total_vacancies"), F.countDistinct("company").alias("unique_companies"), F.count("company").alias("n"))
    return as_metrics(row.select("total_vacancies", "unique_companies", rint(F.try_divide(F.col("n").cast("double"), F.col("unique_companies")), 2).alias("average_vacancies_per_company")))


def distribution(p: DataFrame, column: str) -> DataFrame:
    """Label, count and share of all rows. Null and blank labels are `Unknown`. By count, then label."""
    counts = p.groupBy(known(column).alias(column)).agg(F.count(F.lit(1)).alias("vacancy_count"))
    total = one_row(p.agg(F.count(F.lit(1)).alias("n")))
    return counts.crossJoin(total).select(column, "vacancy_count", share(F.col("vacancy_count"), F.col("n")).alias("share")).orderBy(F.desc("vacancy_count"), column)


def distributions(p: DataFrame, columns: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """All distributions in one aggregation: each row is expanded to (dimension, label) pairs, which the
    partial aggregation folds before the one shuffle."""
    pairs = F.array(*(F.struct(F.lit(c).alias("dimension"), known(c).alias("label")) for c in columns))
    counts = p.select(F.explode(pairs).alias("x")).groupBy("x.dimension", "x.label").agg(F.count(F.lit(1)).alias("vacancy_count"))
    total = one_row(p.agg(F.count(F.lit(1)).alias("n")))
    return counts.crossJoin(total).select("dimension", "label", "vacancy_count", share(F.col("vacancy_count"), F.col("n")).alias("share"))


def crosstab(p: DataFrame, rows: str, columns: str, labels: list[str] | None = None) -> DataFrame:
    """Counts of label pairs, zero where there are none. Without `labels` they are those that occur."""
    if labels is None:
        labels = [r[0] for r in p.select(known(columns)).distinct().orderBy(known(columns)).collect()]
    return p.select(known(rows).alias(rows), known(columns).alias("__label")).groupBy(rows).pivot("__label", labels).agg(F.count(F.lit(1))).na.fill(0).orderBy(rows)


def annual_of(p: DataFrame) -> Column:
    return annual(F.col("salary_min"), F.col("salary_max"), F.col("salary_currency"), F.col("salary_unit"))


def salary_summary(p: DataFrame) -> DataFrame:
    """Count, coverage, mean, median, quartiles (linear interpolation), least and most of comparable salaries."""
    x = F.col("annual")
    row = p.select(annual_of(p).alias("annual")).agg(
        F.count(x).alias("salary_count"), share(F.count(x), F.count(F.lit(1))).alias("salary_coverage"), rint(F.avg(x), 2).alias("average_salary"), rint(F.median(x), 2).alias("median_salary"),
        rint(F.percentile(x, F.lit(0.25)), 2).alias("p25_salary"), rint(F.percentile(x, F.lit(0.75)), 2).alias("p75_salary"), rint(F.min(x), 2).alias("min_salary"), rint(F.max(x), 2).alias("max_salary"),
    )
    return as_metrics(row)


def salary_by(p: DataFrame, column: str, least: int = 1) -> DataFrame:
    """Salary figures, whole numbers, of groups with `least` salaries or more; rank by mean, count, label."""
    x = F.col("annual")
    groups = p.select(known(column).alias(column), annual_of(p).alias("annual")).filter(x.isNotNull()).groupBy(column).agg(F.count(x).alias("salary_count"), *(rint(f(x), 0).alias(f"{n}_salary") for n, f in (("average", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))))
    order = Window.orderBy(F.desc("average_salary"), F.desc("salary_count"), column)  # over groups, not postings
    return groups.filter(F.col("salary_count") >= max(1, least)).withColumn("rank", F.row_number().over(order)).orderBy("rank")


def education_summary(p: DataFrame, asks: Column) -> DataFrame:
    n, yes = F.count(F.lit(1)), F.count_if(asks)
    return as_metrics(p.agg(n.alias("total_vacancies"), yes.alias("higher_education_count"), (n - yes).alias("no_mention_count"), share(yes, n).alias("higher_education_share")))


def experience_summary(p: DataFrame) -> DataFrame:
    """Of columns exp_low and exp_high: mentions, their share, and mean and median of the lower end and of the middle."""
    low, mid = F.col("exp_low"), (F.col("exp_low") + F.coalesce("exp_high", "exp_low")) / 2
    return as_metrics(p.agg(F.count(F.lit(1)).alias("total_vacancies"), F.count(low).alias("experience_years_count"), share(F.count(low), F.count(F.lit(1))).alias("experience_years_share"), *(rint(f(x), 2).alias(f"{a}_{b}experience_years") for a, f in (("average", F.avg), ("median", F.median)) for b, x in (("min_", low), ("", mid)))))


def experience_by(p: DataFrame, column: str) -> DataFrame:
    """For each label: postings, share, mentions of years, and their mean and median; rank by postings, label.
    One aggregation: groups without a mention keep a count of 0 and null figures."""
    low, mid = F.col("exp_low"), (F.col("exp_low") + F.coalesce("exp_high", "exp_low")) / 2
    groups = p.groupBy(known(column).alias(column)).agg(F.count(F.lit(1)).alias("vacancy_count"), F.count(low).alias("experience_years_count"), *(rint(f(x), 2).alias(f"{a}_{b}experience_years") for a, f in (("average", F.avg), ("median", F.median)) for b, x in (("min_", low), ("", mid))))
    total = one_row(p.agg(F.count(F.lit(1)).alias("n")))
    order = Window.orderBy(F.desc("vacancy_count"), column)
    return groups.crossJoin(total).withColumn("share", share(F.col("vacancy_count"), F.col("n"))).drop("n").withColumn("rank", F.row_number().over(order)).orderBy("rank")


def nested_distribution(p: DataFrame, outer: str, inner: str) -> DataFrame:
    """(outer, label, count, share within, rank) of what a drill-down nests."""
    counts = p.groupBy(known(outer).alias(outer), known(inner).alias("label")).agg(F.count(F.lit(1)).alias("vacancy_count"))
    own = Window.partitionBy(outer)
    return counts.select("*", share(F.col("vacancy_count"), F.sum("vacancy_count").over(own)).alias("share"), F.row_number().over(own.orderBy(F.desc("vacancy_count"), "label")).alias("rank"))


def city_details(p: DataFrame, inner: tuple[str, ...] = ("role_category", "company", "work_mode")) -> DataFrame:
    """For each city its count and share and, as JSON, a ranked distribution of each inner dimension."""
    out = distribution(p, "city")
    for c in inner:
        items = nested_distribution(p, "city", c).groupBy("city").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label", "vacancy_count", "share"))), lambda x: F.struct(x["label"].alias("label"), x["vacancy_count"].alias("count"), x["share"].alias("share"), x["rank"].alias("rank")))).alias(f"{c}_distribution_json"))
        out = out.join(items, "city", "left")
    return out.orderBy(F.desc("vacancy_count"), "city")
