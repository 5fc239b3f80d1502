"""Rankings, pairs and summaries of list columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opalgrid.functions.numbers import share
from opalgrid.functions.taxonomy import CATEGORIES, category_of
from opalgrid.functions.text import known
from opalgrid.operators.metrics import as_metrics, one_row


def items(p: DataFrame, column: str, name: str, *keep: str) -> DataFrame:
    """A row for each item of a list column; null and empty lists give none; labels to keep are `Unknown` where null."""
    return p.select(*(known(c).alias(c) for c in keep), F.explode(column).alias(name)).filter(F.col(name).isNotNull())


def top(p: DataFrame, column: str, name: str, n: int = 20) -> DataFrame:
    """The n most frequent items with their share of all rows; ties by item."""
    total = one_row(p.agg(F.count(F.lit(1)).alias("n")))
    best = items(p, column, name).groupBy(name).agg(F.count(F.lit(1)).alias("vacancy_count")).orderBy(F.desc("vacancy_count"), name).limit(n)
    return best.crossJoin(total).select(name, "vacancy_count", share(F.col("vacancy_count"), F.col("n")).alias("share")).orderBy(F.desc("vacancy_count"), name)


def top_by(p: DataFrame, column: str, name: str, by: str, n: int = 20) -> DataFrame:
    """Items with a dense rank up to n in their group, ties all there, and their share of the group's rows."""
    counts = items(p, column, name, by).groupBy(by, name).agg(F.count(F.lit(1)).alias("vacancy_count"))
    rank = F.dense_rank().over(Window.partitionBy(by).orderBy(F.desc("vacancy_count")))
    best = counts.withColumn("rank", rank).filter(F.col("rank") <= n)
    totals = p.groupBy(known(by).alias(by)).agg(F.count(F.lit(1)).alias("n"))
    return best.join(totals, by).select(by, name, "vacancy_count", "rank", share(F.col("vacancy_count"), F.col("n")).alias("share_within_group")).orderBy(by, F.desc("vacancy_count"), name)


def summary(p: DataFrame, column: str) -> DataFrame:
    """Distinct items, mentions, rows with items and their share of all rows."""
    rows = p.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size(column) > 0).alias("vacancies_with_items"), F.sum(F.greatest(F.size(column), F.lit(0))).alias("total_mentions"))
    distinct = items(p, column, "item").agg(F.countDistinct("item").alias("distinct_items"))
    row = one_row(rows).crossJoin(distinct)
    return as_metrics(row.select("distinct_items", F.coalesce("total_mentions", F.lit(0)).alias("total_mentions"), "vacancies_with_items", share(F.col("vacancies_with_items"), F.col("n")).alias("vacancy_coverage")))


def pairs(p: DataFrame, column: str, n: int | None = 50) -> DataFrame:
    """Unordered pairs of distinct items of a row, most frequent first, ties by names. Pairs are made inside
    the row, so that no self-join is shuffled."""
    own = F.array_sort(F.array_distinct(F.array_compact(column)))
    both = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("skill_1"), y.alias("skill_2")))))
    counts = p.select(own.alias("s")).filter(F.size("s") > 1).select(F.explode(both).alias("x")).groupBy("x.skill_1", "x.skill_2").agg(F.count(F.lit(1)).alias("vacancy_count"))
    ordered = counts.orderBy(F.desc("vacancy_count"), "skill_1", "skill_2")
    return ordered if n is None else ordered.limit(n)


def taxonomy(p: DataFrame, column: str) -> DataFrame:
    """(row, category, skill) of known skills, each once for a row."""
    known_items = F.array_distinct(F.filter(column, lambda s: category_of(s).isNotNull()))
    return p.select(F.explode(known_items).alias("skill")).select(category_of(F.col("skill")).alias("category"), "skill")


def top_taxonomy(p: DataFrame, column: str, n: int = 20) -> DataFrame:
    total = one_row(p.agg(F.count(F.lit(1)).alias("n")))
    counts = taxonomy(p, column).groupBy("category", "skill").agg(F.count(F.lit(1)).alias("vacancy_count"))
    rank = F.dense_rank().over(Window.partitionBy("category").orderBy(F.desc("vacancy_count")))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n).crossJoin(total).select("category", "skill", "vacancy_count", share(F.col("vacancy_count"), F.col("n")).alias("share"), "rank").orderBy("category", F.desc("vacancy_count"), "skill")


def taxonomy_summary(p: DataFrame, column: str) -> DataFrame:
    """All seven categories, those without a mention with zeros."""
    rows = p.select(F.array_distinct(F.filter(column, lambda s: category_of(s).isNotNull())).alias("s"))
    totals = one_row(rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.array_contains(F.transform("s", category_of), c)).alias(c) for c in CATEGORIES)))
    by = taxonomy(p, column).groupBy("category").agg(F.countDistinct("skill").alias("distinct_items"), F.count(F.lit(1)).alias("total_mentions"))
    frame = totals.select(F.posexplode(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("vacancies_with_items"), F.col("n").alias("n")) for c in CATEGORIES))).alias("o", "x")).select("o", "x.*")
    return frame.join(by, "category", "left").orderBy("o").select("category", F.coalesce("distinct_items", F.lit(0)).alias("distinct_items"), F.coalesce("total_mentions", F.lit(0)).alias("total_mentions"), "vacancies_with_items", share(F.col("vacancies_with_items"), F.col("n")).alias("vacancy_coverage"))


def skill_role_matrix(p: DataFrame, column: str, roles: int = 5, skills: int = 10) -> DataFrame:
    """Counts of the most frequent skills in the most frequent roles, with shares within a role's row."""
    top_roles = p.groupBy(known("role_category").alias("role_category")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "role_category").limit(roles).select("role_category")
    every = items(p, column, "skill", "role_category")
    top_skills = every.groupBy("skill").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "skill").limit(skills).select("skill")
    # both lists are limited above to a few rows
    cells = every.join(F.broadcast(top_roles), "role_category", "left_semi").join(F.broadcast(top_skills), "skill", "left_semi").groupBy("role_category", "skill").agg(F.count(F.lit(1)).alias("vacancy_count"))
    full = F.broadcast(top_roles).crossJoin(F.broadcast(top_skills)).join(cells, ["role_category", "skill"], "left").na.fill(0, ["vacancy_count"])
    return full.withColumn("row_share", share(F.col("vacancy_count"), F.sum("vacancy_count").over(Window.partitionBy("role_category"))))


def weighted_split(p: DataFrame, label: str, separator: str = " / ") -> DataFrame:
    """Labels that name several places count for each of them in equal parts."""
    parts = F.array_distinct(F.filter(F.split(known(label), separator), lambda x: x != ""))
    return p.select(parts.alias("s")).select(F.explode("s").alias("place"), (F.lit(1.0) / F.size("s")).alias("w")).groupBy("place").agg(F.sum("w").alias("weight"))
