"""Sources by name: each is a function from a session and options to a table of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opalgrid.sources import readers

Source = Callable[..., DataFrame]
SOURCES: dict[str, Source] = {"file": lambda spark, path: readers.load(spark, path), "import_csv": lambda spark, path, source: readers.import_csv(spark, path, source)[0], "import_json": lambda spark, path, source: readers.import_json(spark, path, source)[0]}


def register_source(name: str, source: Source) -> None:
    """A name that is taken raises: two boards under one name would be mixed up without a word."""
    if name in SOURCES:
        raise ValueError(f"there is a source {name} already")
    SOURCES[name] = source


def read_source(spark: SparkSession, name: str, **options: object) -> DataFrame:
    if name not in SOURCES:
        raise ValueError(f"no source {name}; there are {', '.join(sorted(SOURCES))}")
    return SOURCES[name](spark, **options)
