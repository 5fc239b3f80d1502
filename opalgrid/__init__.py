"""A PySpark-native analytics engine for listing data, and operators for training-data corpora (in `opalgrid.llm`).

The functions below are the engine's public interface; they are loaded when they are first asked for.
"""

from __future__ import annotations

from importlib import import_module

_API = {
    "load": "sources.readers", "sqlite": "sources.readers", "import_csv": "sources.readers", "import_json": "sources.readers", "import_records": "sources.readers", "flatten_analytics": "sources.readers", "write_csv": "sources.sinks",
    "standardise": "operators.standardise", "bind": "operators.standardise", "parse_list": "operators.standardise", "categorised": "operators.standardise", "classified": "operators.classify",
    "overview": "operators.metrics", "distribution": "operators.metrics", "distributions": "operators.metrics", "crosstab": "operators.metrics", "salary_summary": "operators.metrics", "salary_by": "operators.metrics", "education_summary": "operators.metrics", "experience_summary": "operators.metrics", "experience_by": "operators.metrics", "city_details": "operators.metrics",
    "top": "operators.skills", "top_by": "operators.skills", "pairs": "operators.skills", "list_summary": "operators.skills:summary", "taxonomy_summary": "operators.skills", "top_taxonomy": "operators.skills",
    "trend_counts": "operators.trends:counts", "trend_segments": "operators.trends:segments", "trend_summary": "operators.trends:summary", "monthly": "operators.trends", "closed": "operators.trends", "fastest_growing": "operators.trends",
    "matches": "operators.dedup", "clusters": "operators.dedup", "merged": "operators.dedup", "report": "operators.dedup", "Filters": "operators.search", "where": "operators.search", "page": "operators.search", "facet": "operators.search", "term_index": "operators.search",
    "upsert": "operators.store", "keep_first": "operators.store", "latest": "operators.store", "as_of": "operators.joins", "in_range": "operators.joins", "run": "plans.batch", "outputs": "plans.batch", "without_agencies": "plans.batch", "covered": "plans.batch",
    "SOURCES": "sources.registry", "register_source": "sources.registry", "read_source": "sources.registry", "register_functions": "functions.registry",
}
__all__ = sorted(_API)


def __getattr__(name: str):  # noqa: ANN202
    if name not in _API:
        raise AttributeError(f"opalgrid has no {name}")
    module, _, other = _API[name].partition(":")
    return getattr(import_module(f"opalgrid.{module}"), other or name)
