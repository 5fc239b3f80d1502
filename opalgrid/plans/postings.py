"""The tables at hand as postings, so that every operator runs on them; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCES = ("alpha", "beta", "gamma", "delta", "omega")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One posting for each order. Items are aggregated by order before the join, so that both sides of the only large
    join have the order's key as their partitioning; which of the dimensions are small is Spark's to see."""
    t = lambda n: table(spark, sf_dir, n)
    line = t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_shipdate").join(t("part").select("p_partkey", "p_name", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    first = F.min(F.struct("l_linenumber", "p_type", "p_name"))
    items = line.groupBy("l_orderkey").agg(first.alias("first"), F.array_sort(F.collect_set("p_name")).alias("skills_list"), F.max("l_shipdate").alias("last_seen_at"))
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    buyers = t("customer").select("c_custkey", "c_name", "c_nationkey").join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    o, k = t("orders"), F.col("o_orderkey")
    every = o.join(items, k == F.col("l_orderkey"), "left").join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left")
    return every.select(
        k.alias("_ord"), k.cast("string").alias("vacancy_id"), F.element_at(F.array(*map(F.lit, SOURCES)), (k % 5 + 1).cast("int")).alias("source"), F.col("first.p_name").alias("title"), F.col("c_name").alias("company"),
        F.col("first.p_type").alias("role_category"), F.col("n_name").alias("city"), F.col("r_name").alias("canton"), F.col("o_orderpriority").alias("seniority"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("work_mode"),
        F.lit(None).cast("string").alias("description_text"), F.col("o_orderdate").alias("publication_date"), "last_seen_at",
        F.when(k % 5 != 0, F.col("o_totalprice") * 0.5).alias("salary_min"), (F.col("o_totalprice") * 0.75).alias("salary_max"), F.when(k % 7 == 0, "EUR").otherwise("CHF").alias("salary_currency"), F.when(k % 3 == 0, "MONTH").otherwise("YEAR").alias("salary_unit"),
        F.coalesce("skills_list", F.array().cast("array<string>")).alias("skills_list"),
    )


SQL = """
items AS (
  SELECT l_orderkey, list_sort(list(DISTINCT p_name)) AS skills_list, max(l_shipdate) AS last_seen_at, min(printf('%05d', l_linenumber) || p_type || '|' || p_name) AS f
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
), postings AS (
  SELECT o_orderkey AS _ord, CAST(o_orderkey AS VARCHAR) AS vacancy_id, ['alpha', 'beta', 'gamma', 'delta', 'omega'][o_orderkey % 5 + 1] AS source, split_part(f, '|', 2) AS title, c_name AS company,
    substr(split_part(f, '|', 1), 6) AS role_category, n_name AS city, r_name AS canton, o_orderpriority AS seniority, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS work_mode,
    o_orderdate AS publication_date, last_seen_at, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice * 0.5 END AS salary_min, o_totalprice * 0.75 AS salary_max,
    CASE WHEN o_orderkey % 7 = 0 THEN 'EUR' ELSE 'CHF' END AS salary_currency, CASE WHEN o_orderkey % 3 = 0 THEN 'MONTH' ELSE 'YEAR' END AS salary_unit, coalesce(skills_list, []) AS skills_list
  FROM orders LEFT JOIN items ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
), mid AS (
  SELECT *, CASE salary_unit WHEN 'MONTH' THEN 12 ELSE 1 END * (coalesce(salary_min, salary_max) + coalesce(salary_max, salary_min)) / 2.0 AS m FROM postings
), paid AS (SELECT *, CASE WHEN salary_currency = 'CHF' AND m BETWEEN 20000 AND 300000 THEN m END AS annual FROM mid
), skill AS (SELECT _ord, role_category, canton, unnest(skills_list) AS skill FROM postings
), moves AS (
  SELECT CAST(publication_date AS DATE) AS day, canton, role_category, 1 AS published, 0 AS gone FROM postings WHERE publication_date IS NOT NULL
  UNION ALL SELECT CAST(last_seen_at AS DATE), canton, role_category, 0, 1 FROM postings WHERE CAST(last_seen_at AS DATE) < (SELECT max(CAST(last_seen_at AS DATE)) FROM postings)
)"""


def sql(rest: str) -> str:
    return "WITH " + SQL.strip() + rest
