"""Queries of this subpackage for the registry: each takes (spark, sf_dir) and covers its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opalgrid.llm import arc, secret_scan
from opalgrid.llm.ann import nearest
from opalgrid.llm.common import table
from opalgrid.llm.ctw import lm_score
from opalgrid.llm.decontaminate import leaks
from opalgrid.llm.language_id import language_id
from opalgrid.llm.mixing import mixing
from opalgrid.llm.ngram_join import ngram_join
from opalgrid.llm.pii import pii
from opalgrid.llm.sharding import shard


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents"))


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=100)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(table(spark, sf_dir, "documents"))


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arc.arc_to_warc(arc.pages_as_arc(table(spark, sf_dir, "pages")))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


OPERATORS = (
    op1_language_id,
    op2_secret_scan,
    op3_mixing,
    op4_lm_score,
    op5_decontaminate,
    op6_ngram_jaccard_join,
    op7_nearest_neighbours,
    op8_pii,
    op9_arc_to_warc,
    op10_sharding,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op2_secret_scan": secret_scan.SQL, "op9_arc_to_warc": arc.SQL}
