"""The batch run: from standardised postings to all output tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opalgrid.functions.places import TABLES
from opalgrid.functions.taxonomy import asks_degree, experience
from opalgrid.functions.text import name_key
from opalgrid.operators import dedup, metrics, skills, trends

#: Names of staffing agencies, in tables.json.
AGENCIES = tuple(TABLES["agencies"])


def without_agencies(p: DataFrame, names: tuple[str, ...] | DataFrame = AGENCIES) -> DataFrame:
    """Postings whose company isn't on a list of agencies, compared by key; a null company stays. A table of
    names is anti-joined by key."""
    key = name_key("company")
    if isinstance(names, DataFrame):
        keys = names.select(name_key(names.columns[0]).alias("__key")).filter("__key is not null").distinct()
        return p.withColumn("__key", key).join(keys, "__key", "left_anti").drop("__key")
    from_list = p.sparkSession.createDataFrame([(n,) for n in names], "n string")
    return without_agencies(p, from_list)


def covered(p: DataFrame, since: str = "2026-01-01") -> DataFrame:
    """Postings published on that day (UTC) or later; without a date, or a column of dates, none."""
    return p.filter(F.col("publication_date") >= F.lit(since).cast("timestamp")) if "publication_date" in p.columns else p.limit(0)


def enriched(p: DataFrame) -> DataFrame:
    text: list[Column | str] = [c for c in ("title", "description_text") if c in p.columns]
    e = p.withColumn("__exp", experience(*text)).withColumns({"exp_low": F.col("__exp.low"), "exp_high": F.col("__exp.high")}).drop("__exp")
    return e.withColumn("asks_degree", asks_degree(*text, *(["salary_text"] if "salary_text" in p.columns else [])))


def outputs(p: DataFrame, top: int = 20, top_pairs: int = 50, least: int = 1) -> dict[str, DataFrame]:
    """All output tables of standardised and enriched postings. Each is a plan of its own over `p`, which the caller
    writes or caches first."""
    out = {
        "overview_metrics": metrics.overview(p),
        "education_requirements_summary": metrics.education_summary(p, F.col("asks_degree")),
        "experience_requirements_summary": metrics.experience_summary(p),
        "experience_by_seniority": metrics.experience_by(p, "seniority"),
        "salary_summary": metrics.salary_summary(p),
        **{f"salary_by_{c}": metrics.salary_by(p, c, least) for c in ("role_category", "seniority")},
        **{f"distribution_{c}": metrics.distribution(p, c) for c in metrics.DIMENSIONS},
        "city_map_details": metrics.city_details(p),
        "top_skills_overall": skills.top(p, "skills_list", "skill", top),
        **{f"top_skills_by_{c}": skills.top_by(p, "skills_list", "skill", c, top) for c in ("role_category", "canton")},
        "top_skill_taxonomy": skills.top_taxonomy(p, "skills_list", top),
        "skill_taxonomy_summary": skills.taxonomy_summary(p, "skills_list"),
        "skill_cooccurrence_pairs": skills.pairs(p, "skills_list", top_pairs),
        "vacancy_trends_summary": trends.summary(p),
        "vacancy_trends_daily": trends.counts(p, "day", "date"),
        "vacancy_trends_weekly": trends.counts(p, "week", "week_start"),
        "vacancy_trends_monthly": trends.monthly(p),
        "vacancy_trends_segments_daily": trends.segments(p, "day", "date"),
        "vacancy_trends_segments_weekly": trends.segments(p, "week", "week_start"),
        **{f"crosstab_role_category_vs_{c}": metrics.crosstab(p, "role_category", c) for c in ("seniority", "work_mode")},
    }
    for name, single in (("programming_languages", "programming_language"), ("frameworks_libraries", "framework_library")):
        if f"{name}_list" in p.columns:
            out |= {f"top_{name}": skills.top(p, f"{name}_list", single, top), f"{name}_summary": skills.summary(p, f"{name}_list")}
    return out


def run(p: DataFrame, agencies: tuple[str, ...] | DataFrame = AGENCIES, since: str = "2026-01-01", **limits: int) -> dict[str, DataFrame]:
    """Deduplicate, leave out agencies, keep the covered dates, enrich, tabulate; in this order."""
    return outputs(enriched(covered(without_agencies(dedup.merged(p), agencies), since)), **limits)
