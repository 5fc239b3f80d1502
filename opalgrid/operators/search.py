"""Filtered, scored, paged search and facets."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opalgrid.functions.places import location_label
from opalgrid.functions.taxonomy import search_seniority
from opalgrid.functions.text import fold


@dataclass
class Filters:
    """What a search asks for; empty parts don't filter."""

    text: str = ""
    sources: list[str] = field(default_factory=list)
    company: str = ""
    places: list[str] = field(default_factory=list)
    skills: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    low: float | None = None
    high: float | None = None
    with_salary: bool = False
    currency: str = ""
    unit: str = ""
    since: str = ""
    until: str = ""
    date_field: str = "publication_date"
    seniority: list[str] = field(default_factory=list)


def words(text: str) -> list[str]:
    """Words of a query, with the marks that names of skills have."""
    return [w.lower() for w in re.findall(r"[\w.+#-]+", text)]


def contains(c: Column | str, term: str) -> Column:
    """Literal part of a text without case; null contains nothing."""
    return F.coalesce(F.contains(F.lower(F.col(c) if isinstance(c, str) else c), F.lit(term.lower())), F.lit(False))


def haystack(*columns: str) -> Column:
    return F.lower(F.concat_ws(" ", *columns))


TEXT = ("title", "company", "city", "description_text")


def where(p: DataFrame, f: Filters) -> DataFrame:
    """Rows that pass all filters; those on plain columns reach the scan."""
    if f.sources:
        p = p.filter(F.col("source").isin(f.sources))
    if f.date_field and f.since:
        p = p.filter(F.to_date(f.date_field) >= F.lit(f.since).cast("date"))
    if f.date_field and f.until:
        p = p.filter(F.to_date(f.date_field) <= F.lit(f.until).cast("date"))
    if f.with_salary:
        p = p.filter("salary_min is not null or salary_max is not null")
    if f.low is not None:
        p = p.filter(F.coalesce("salary_max", "salary_min") >= f.low)
    if f.high is not None:
        p = p.filter(F.coalesce("salary_min", "salary_max") <= f.high)
    for c, v in (("salary_currency", f.currency), ("salary_unit", f.unit)):
        if v:
            p = p.filter(F.upper(F.coalesce(c, F.lit(""))) == v.upper())
    for w in words(f.text):
        p = p.filter(F.greatest(*(contains(c, w) for c in TEXT)))
    for w in f.exclude:
        p = p.filter(~F.greatest(*(contains(c, w) for c in TEXT)))
    if f.company:
        p = p.filter(contains("company", f.company))
    if f.places:
        p = p.filter(F.greatest(F.lit(False), *(F.coalesce(F.contains(fold("city"), fold(F.lit(x))), F.lit(False)) for x in f.places)))
    for s in f.skills:  # every one of them
        p = p.filter(F.coalesce(F.array_contains(F.transform("skills_list", F.lower), s.lower()), F.lit(False)))
    if f.seniority:
        p = p.filter(search_seniority("title", F.array(F.lower(F.coalesce("seniority", F.lit(""))))).isin(f.seniority))
    return p


def score(f: Filters) -> Column:
    """20 for each word in the title, 8 company, 6 city, 2 description, and 3 for a salary."""
    out = F.when(F.coalesce("salary_min", "salary_max").isNotNull(), 3).otherwise(0)
    for w in words(f.text):
        for c, n in (("title", 20), ("company", 8), ("city", 6), ("description_text", 2)):
            out = out + F.when(contains(c, w), n).otherwise(0)
    return out.cast("long")


def ranked(p: DataFrame, f: Filters) -> DataFrame:
    """All hits with their score, best first: score, last seen, salary, id. A total order, so that pages fit."""
    return where(p, f).withColumn("score", score(f)).orderBy(F.desc("score"), F.desc("last_seen_at"), F.desc_nulls_last(F.coalesce("salary_max", "salary_min")), "vacancy_id")


def page(p: DataFrame, f: Filters, number: int = 1, size: int = 10) -> DataFrame:
    """One page of the ranked hits. The size is kept within 1 to 100, the number within what there is.
    `offset` and `limit` over an order are a top-k in Spark: no full sort is collected."""
    size = min(100, max(1, size))
    total = where(p, f).count()
    number = min(max(1, number), max(1, math.ceil(total / size)))
    return ranked(p, f).offset((number - 1) * size).limit(size)


def by_terms(p: DataFrame, terms: DataFrame, kinds: list[str], value: str) -> DataFrame:
    """Postings that have a term of one of these kinds: a semi-join with the term index, so no row is doubled."""
    ids = terms.filter(F.col("term_type").isin(kinds) & (F.lower("term_value") == value.lower())).select("vacancy_id")
    return p.join(ids, "vacancy_id", "left_semi")


def term_index(p: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(vacancy_id, term_type, term_value), each once: array columns exploded, plain ones as they are."""
    kinds = dict(p.dtypes)

    def terms(kind: str, c: str) -> Column:
        values = F.col(c) if kinds[c].startswith("array") else F.array(c)
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("term_type"), F.trim(v.cast("string")).alias("term_value")))

    lists = [terms(t, c) for t, c in columns.items()]
    rows = p.select("vacancy_id", F.explode(F.flatten(F.array_compact(F.array(*lists)))).alias("x")).select("vacancy_id", "x.*")
    return rows.filter("term_value is not null and term_value != ''").distinct()


def facet(p: DataFrame, column: str, k: int = 30) -> DataFrame:
    """The k most frequent values of a column, blanks and nulls left out."""
    return p.filter(F.trim(column) != "").groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def term_facets(terms: DataFrame, k: int = 80) -> DataFrame:
    """For each kind of term its k most frequent values, without case."""
    n = terms.groupBy("term_type", F.lower("term_value").alias("value")).agg(F.countDistinct("vacancy_id").alias("n"))
    return n.withColumn("position", F.row_number().over(Window.partitionBy("term_type").orderBy(F.desc("n"), "value"))).filter(F.col("position") <= k)


def popular_words(d: DataFrame, column: str, stop: list[str], least: int = 2, k: int | None = None) -> DataFrame:
    """Words by frequency: lower case, no marks, no pure numbers, no stop words; ties by word."""
    w = F.explode(F.split(F.trim(F.regexp_replace(F.lower(column), r"[^\p{L}\p{N}]+", " ")), " "))
    out = d.select(w.alias("word")).filter((F.length("word") >= least) & ~F.col("word").rlike("^[0-9]+$") & ~F.col("word").isin(stop)).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word")
    return out if k is None else out.limit(k)


def decision(haystack: Column, roles: list[str], seniority: list[str], both: bool) -> Column:
    """struct(passes, role, seniority, matched): whether any keyword of each group stands in the text. With two groups both
    must match, or either; with one that one; with none everything passes. matched lists the keywords, each once."""
    low, roles, seniority = F.lower(F.coalesce(haystack, F.lit(""))), [r for r in roles if r], [s for s in seniority if s]
    hits = lambda words: F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in words))) if words else F.array().cast("array<string>")
    a, b = hits(roles), hits(seniority)
    role, level = F.size(a) > 0, F.size(b) > 0
    passes = (role & level if both else role | level) if roles and seniority else role if roles else level if seniority else F.lit(True)
    none = F.lit(None).cast("boolean")
    return F.struct(passes.alias("passes"), (role if roles else none).alias("role"), (level if seniority else none).alias("seniority"), F.array_distinct(F.concat(a, b)).alias("matched"))


def includes(haystack: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a text has all of the first words and none of the others."""
    low, out = F.lower(F.coalesce(haystack, F.lit(""))), F.lit(True)
    for w in include:
        out = out & F.contains(low, F.lit(w.lower()))
    for w in exclude:
        out = out & ~F.contains(low, F.lit(w.lower()))
    return out


def cli_order(p: DataFrame, limit: int = 0) -> DataFrame:
    """By salary (upper, then lower end, each in place of the other; without either last), last seen and id, all from the largest; `limit` rows if above 0."""
    high, low = (F.coalesce(F.col(a), F.col(b), F.lit(-1)) for a, b in (("salary_max", "salary_min"), ("salary_min", "salary_max")))
    out = p.orderBy(high.desc(), low.desc(), F.coalesce(F.col("last_seen_at"), F.lit("")).desc(), F.coalesce(F.col("id"), F.lit("")).desc())
    return out.limit(limit) if limit > 0 else out


def place_facet(p: DataFrame, first: int = 150, then: int = 80) -> DataFrame:
    """Postings by place label: of each source the `first` most frequent spellings are counted, labelled and summed, and `then` labels stay."""
    spelled = p.filter(F.trim("place") != "").groupBy("source", "place").agg(F.count(F.lit(1)).alias("n"))
    kept = spelled.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n"), "place"))).filter(F.col("k") <= first)
    labelled = kept.withColumn("value", location_label("place")).filter("value != ''").groupBy("value").agg(F.sum("n").alias("n"))
    return labelled.orderBy(F.desc("n"), "value").limit(then)


def by_keyword(p: DataFrame, terms: DataFrame, keywords: list[str]) -> DataFrame:
    """Rows that match every keyword: in one of their terms, in the keywords matched before, or in the classifier's JSON. One aggregation of
    the terms serves all keywords."""
    words = [k.lower() for k in keywords if k]
    if not words:
        return p
    value = F.lower("term_value")
    hit = [F.max(F.contains(value, F.lit(w))).alias(f"__k{i}") for i, w in enumerate(words)]
    some = terms.groupBy("vacancy_id").agg(*hit)
    out, no = p.join(some, "vacancy_id", "left"), F.lit(False)
    for i, w in enumerate(words):
        own = [F.contains(F.lower(c), F.lit(w)) for c in ("keywords_matched_json", "analytics_json")]
        out = out.filter(F.coalesce(F.col(f"__k{i}"), no) | F.coalesce(own[0], no) | F.coalesce(own[1], no))
    return out.select(p.columns)
