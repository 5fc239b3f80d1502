"""The engine's Python functions under names for SQL. What is made of built-in functions needs no registration."""

from __future__ import annotations

from pyspark.sql import SparkSession

from opalgrid.functions.scalars import _url_candidates, pruned_json
from opalgrid.functions.taxonomy import _years
from opalgrid.operators.dedup import title_ratio

FUNCTIONS = {"opal_title_ratio": title_ratio, "opal_years": _years, "opal_pruned_json": pruned_json, "opal_url_candidates": _url_candidates}


def register_functions(spark: SparkSession) -> list[str]:
    for name, f in FUNCTIONS.items():
        spark.udf.register(name, f)
    return sorted(FUNCTIONS)
