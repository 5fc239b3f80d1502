"""Output tables as nested documents; counts rescaled to a distribution; key findings."""

from __future__ import annotations

import json
import math
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalgrid.functions.numbers import rint, share

VERSION = 4


def rescaled(details: DataFrame, distribution: DataFrame, key: str) -> DataFrame:
    """(key, label, count, share, target): counts within a key scaled so that they add up to what the distribution
    has for it; what comes to 0 or less goes. Keys of the distribution without details have none."""
    total = F.sum("vacancy_count").over(Window.partitionBy(key))
    d = details.withColumn("__total", total)
    x = distribution.select(key, F.col("vacancy_count").alias("target")).join(d, key)
    count = rint(F.try_divide(F.col("vacancy_count") * F.col("target"), F.col("__total").cast("double")))
    return x.select(key, "label", count.alias("count"), share(count, F.col("target")).alias("share"), "target").filter("count > 0")


def metric_map(df: DataFrame) -> dict[str, Any]:
    """A metric table as a map; whole numbers as integers."""
    return {r["metric"]: int(r["value"]) if r["value"] is not None and float(r["value"]).is_integer() else r["value"] for r in df.toLocalIterator()}


def records(df: DataFrame, label: str | None = None) -> list[dict[str, Any]]:
    rows = [r.asDict(recursive=True) for r in df.toLocalIterator()]
    return rows if label is None else [{"key": r[label], "label": r[label], **{k: v for k, v in r.items() if k != label}} for r in rows]


def grouped(df: DataFrame, key: str) -> dict[str, list[dict[str, Any]]]:
    out: dict[str, list[dict[str, Any]]] = {}
    for r in records(df):
        out.setdefault(r.pop(key), []).append(r)
    return dict(sorted(out.items()))


def cleaned(x: Any) -> Any:
    """A document without numbers that are none: NaN and infinities become null, at any depth."""
    if isinstance(x, dict):
        return {k: cleaned(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [cleaned(v) for v in x]
    return None if isinstance(x, float) and not math.isfinite(x) else x


def json_items(text: str | None) -> list:
    """A JSON list; anything else is an empty one."""
    try:
        x = json.loads(text) if text else []
    except ValueError:
        return []
    return x if isinstance(x, list) else []


def snapshot_day(day: str) -> str:
    """The day itself, if it is an ISO date; anything else raises."""
    return date.fromisoformat(day).isoformat()


#: Tables that a complete run has; what isn't there is listed as missing.
EXPECTED = ("overview_metrics", "salary_summary", "vacancy_trends_summary", "vacancy_trends_daily", "vacancy_trends_weekly", "vacancy_trends_monthly", "top_skills_overall", "city_map_details", "distribution_company", "distribution_city", "distribution_canton", "distribution_role_category", "distribution_seniority", "distribution_work_mode")
#: Sections of the documents that hold several tables.
SECTIONS = {
    "trends": {"summary": "vacancy_trends_summary", "daily": "vacancy_trends_daily", "weekly": "vacancy_trends_weekly", "monthly": "vacancy_trends_monthly", "segments_daily": "vacancy_trends_segments_daily", "segments_weekly": "vacancy_trends_segments_weekly"},
    "salary": {"summary": "salary_summary", "by_role": "salary_by_role_category", "by_seniority": "salary_by_seniority"},
    "skills": {"overall": "top_skills_overall", "taxonomy": "top_skill_taxonomy", "taxonomy_summary": "skill_taxonomy_summary", "pairs": "skill_cooccurrence_pairs", "by_role": "top_skills_by_role_category", "by_canton": "top_skills_by_canton"},
    "requirements": {"education": "education_requirements_summary", "experience": "experience_requirements_summary", "experience_by_seniority": "experience_by_seniority"},
}


def combined(made: dict[str, dict[str, Any]]) -> dict[str, dict[str, Any]]:
    """One document for each of SECTIONS; a section whose table is missing is null."""
    body = lambda n: next(iter(made[n].values())) if n in made else None
    return {name: {k: body(n) for k, n in parts.items()} for name, parts in SECTIONS.items()}


def documents(out: dict[str, DataFrame], day: str) -> dict[str, dict[str, Any]]:
    """Documents of the output tables that are there. These are reports, small by construction."""
    day = snapshot_day(day)
    made: dict[str, dict[str, Any]] = {}
    for name, df in out.items():
        if df.columns == ["metric", "value"]:
            made[name] = {"metrics": metric_map(df)}
        elif name.startswith("distribution_"):
            made[name] = {"items": records(df, df.columns[0])}
        elif name.startswith("top_skills_by_"):
            made[name] = {"groups": grouped(df, df.columns[0])}
        else:
            made[name] = {"items": records(df)}
    made |= combined(made)
    made["metadata"] = {"schema_version": VERSION, "snapshot_date": day, "available": sorted(out), "generated": sorted(made), "missing": sorted(set(EXPECTED) - set(out))}
    return cleaned(made)


def best(df: DataFrame, by: Column, *ties: str) -> DataFrame:
    return df.orderBy(by, *ties).limit(1)
