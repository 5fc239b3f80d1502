"""Documents to shards of training data in five stages; each reads what the one before has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opalgrid.llm import decontaminate, language_id, mixing, ngram_join, sharding
from opalgrid.llm.common import saved, table


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in whose text language identification finds a language, repeated rows as often as they are there. Null and
    empty texts go; a null doc_id does no harm; of equally likely languages the first in order counts, which decides nothing
    here."""
    return language_id.accepted(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the row with the smallest id, null ids last; of repeated rows one. Texts without
    words are in no class and stay."""
    return ngram_join.distinct(docs)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Null and empty texts have none and stay, rows with a null doc_id are decided by
    their text, repeated rows alike. An empty benchmark takes nothing out."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def weighted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken as often as the rates of their domains say: rows with a null doc_id once, repeated rows
    equally often, null and empty texts by a rate like others."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with all their columns and their shard. Copies share a shard; null and empty texts are 0 bytes; a
    null doc_id stays null."""
    return sharding.sharded(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identified),
    ("ngram_jaccard_join", distinct),
    ("benchmark_decontamination", unleaked),
    ("mixing", weighted),
    ("sharding", sharded),
]

#: Stages 1, 2 and 4 hold trained networks and a trie join: no SQL. The tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents. An empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, name)
    return docs
