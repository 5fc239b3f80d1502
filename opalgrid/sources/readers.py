"""Scans: files by suffix, SQLite with absent columns, records under synonyms."""

from __future__ import annotations

import sqlite3
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opalgrid.functions.places import city_name, derived_canton
from opalgrid.functions.taxonomy import loader_seniority
from opalgrid.functions.text import clean, stable_id


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text: numbers are cast where they are used, so a file gives the same types every day."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")


def _json(spark: SparkSession, path: str) -> DataFrame:
    """One document (an array or object); where that can't be read, lines."""
    whole = spark.read.option("multiLine", True).json(path)
    return spark.read.json(path) if not whole.columns or "_corrupt_record" in whole.columns else whole


FORMATS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    ".csv": _csv,
    ".json": _json,
    ".jsonl": lambda spark, path: spark.read.json(path),
    ".parquet": lambda spark, path: spark.read.parquet(path),
}


def load(spark: SparkSession, path: str) -> DataFrame:
    """A dataset by the suffix of its name; an unknown suffix raises, and so does a file that isn't there."""
    suffix = Path(path).suffix.lower()
    if suffix in (".db", ".sqlite", ".sqlite3"):
        return sqlite(spark, path, "vacancies", VACANCY)
    if suffix not in FORMATS:
        raise ValueError(f"unsupported dataset format: {suffix or path}")
    return FORMATS[suffix](spark, path)


VACANCY = ("vacancy_id", "source", "title", "company", "place", "publication_date", "first_seen_at", "last_seen_at", "salary_min", "salary_max", "salary_currency", "salary_unit", "salary_text", "description_text", "analytics_json", "raw_json")


def sqlite(spark: SparkSession, path: str, table: str, columns: tuple[str, ...]) -> DataFrame:
    """Fixed columns of a table; those it lacks are null. A SQLite file is one machine's file, read here in
    batches by Arrow; what is larger belongs behind a JDBC source."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        have = {r[1] for r in con.execute(f'PRAGMA table_info("{table}")')}
        if not have:
            raise ValueError(f"no table {table} in {path}")
        cur = con.execute("SELECT " + ", ".join(f'CAST("{c}" AS TEXT)' if c in have else "NULL" for c in columns) + f' FROM "{table}" ORDER BY rowid')
        schema = pa.schema([(c, pa.string()) for c in columns])
        batches = []
        while rows := cur.fetchmany(50_000):
            batches.append(pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows)], schema=schema))
    return spark.createDataFrame(pa.Table.from_batches(batches, schema))


#: Field of an imported record and the keys it may stand under.
SYNONYMS = {"vacancy_id": "id jobId job_id", "title": "title jobTitle position", "company": "company companyName company_name", "place": "location place city", "url": "url link jobUrl", "publication_date": "postedAt datePosted published_at", "description_text": "description descriptionText"}


def import_records(df: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejected) of a table with columns under any of the synonyms: the first filled one counts.
    Rows without a title are rejected. A missing id is made from the fields."""
    have = {c.lower(): c for c in df.columns}

    def pick(names: str) -> Column:
        found = [clean(F.col(f"`{have[n.lower()]}`")) for n in names.split() if n.lower() in have]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    out = df.select(*(pick(v).alias(k) for k, v in SYNONYMS.items())).withColumn("source", F.lit(source))
    out = out.withColumn("vacancy_id", F.coalesce("vacancy_id", stable_id(source, "title", "company", "place", "url", "publication_date")))
    return out.filter("title is not null"), out.filter("title is null")


def import_json(spark: SparkSession, path: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Records of an array, of an envelope (data, records, results or items), of one object, or of lines."""
    df = _json(spark, path)
    for c, t in df.dtypes:
        if c in ("data", "records", "results", "items") and t.startswith("array<struct"):
            return import_records(df.select(F.explode(c).alias("x")).select("x.*"), source)
    return import_records(df, source)


def feed(df: DataFrame, pages: int, size: int) -> DataFrame:
    """Rows of a feed that are neither paused nor deactivated, newest first, cut to the pages asked for."""
    alive = df.filter(~F.coalesce(F.col("isPaused").cast("boolean"), F.lit(False)) & F.col("deactivatedOn").isNull())
    return alive.orderBy(F.desc("activeFrom"), F.desc("_id")).limit(pages * size)


_LISTS = "programming_languages frameworks_libraries cloud_platforms data_platforms databases platforms tools vendors protocols_standards methodologies domains tools_platforms".split()


def flatten_analytics(df: DataFrame, column: str = "analytics_json") -> DataFrame:
    """Classifier's JSON to columns: role, remote mode, years, seniority, place and company with what the row has as fallback, and
    all skill lists in one. The canton is the region's, else derived from locality, place and postal code. Malformed JSON
    gives nulls and empty lists."""
    shape = "role_family_primary string, remote_mode string, seniority_labels array<string>, job_location struct<locality: string, region: string, postal_code: string>, company struct<name: string>, experience_years struct<min: double, max: double>, " + ", ".join(f"{c} array<string>" for c in _LISTS)
    x = df.withColumn("__a", F.from_json(column, shape, {"mode": "PERMISSIVE"}))
    empty = F.array().cast("array<string>")
    where = F.coalesce(F.nullif(F.col("__a.job_location.locality"), F.lit("")), F.col("place"))
    labels = F.coalesce("__a.seniority_labels", empty)
    return x.withColumns({
        "role_category": F.col("__a.role_family_primary"), "work_mode": F.col("__a.remote_mode"), "seniority_labels": labels, "seniority": loader_seniority(F.col("title") if "title" in df.columns else F.lit(None).cast("string"), labels),
        "experience_years_min": F.col("__a.experience_years.min"), "experience_years_max": F.col("__a.experience_years.max"), "city": city_name(where), "canton": derived_canton("__a.job_location.region", where, F.col("place"), "__a.job_location.postal_code"),
        "company": F.coalesce(F.nullif(F.col("company"), F.lit("")), F.col("__a.company.name")), "skills": F.array_distinct(F.array_compact(F.flatten(F.array(*(F.coalesce(f"__a.{c}", empty) for c in _LISTS))))), **{f"{c}_list": F.coalesce(f"__a.{c}", empty) for c in _LISTS[:-1]},
    }).drop("__a")


def import_csv(spark: SparkSession, path: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Records of a CSV file; a byte order mark before the header is no part of a name. A file without a title column raises, and so
    does one that holds searches (terms and places to look for) instead of postings."""
    df = _csv(spark, path)
    df = df.toDF(*(c.lstrip("\ufeff").strip() for c in df.columns))
    have = {c.lower() for c in df.columns}
    if not have & {n.lower() for n in SYNONYMS["title"].split()}:
        what = "searches, not postings" if have & {"term", "search_term", "query"} else "no title column"
        raise ValueError(f"{path}: {what}")
    return import_records(df, source)
