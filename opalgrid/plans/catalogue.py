"""Queries of the registry and the SQL that each must agree with."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opalgrid.functions import scalars
from opalgrid.functions.numbers import share
from opalgrid.functions.taxonomy import EDUCATION, asks_degree, experience, matched_skills
from opalgrid.functions.text import TITLE_STOP, company_key, jaccard, name_key, text_key, tokens
from opalgrid.operators import dedup, frontend, joins, metrics, search, skills, standardise, store, trends
from opalgrid.plans import batch, snapshots
from opalgrid.plans.postings import postings, sql, table
from opalgrid.sources import pages
from opalgrid.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def add(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLE[name] = oracle


def on_postings(name: str, f: Callable[[DataFrame], DataFrame], oracle: str | None = None) -> None:
    add(name, lambda spark, d: f(postings(spark, d)), sql(oracle) if oracle else None)


def _r(x: str, k: int = 4) -> str:
    return f"round_even(CAST({x} AS DOUBLE) * 1e{k}, 0) / 1e{k}"


def _metrics(cells: dict[str, str], source: str) -> str:
    return f"SELECT unnest([{', '.join(repr(k) for k in cells)}]) AS metric, unnest([{', '.join(f'CAST({v} AS DOUBLE)' for v in cells.values())}]) AS value FROM {source}"


def _u(c: str) -> str:
    return f"coalesce(CASE WHEN trim({c}) <> '' THEN {c} END, 'Unknown')"


N = "(SELECT count(*) FROM postings)"

# ---- counts and shares

on_postings("overview_metrics", metrics.overview, " " + _metrics({"total_vacancies": "count(*)", "unique_companies": "count(DISTINCT company)", "average_vacancies_per_company": _r("count(company) / nullif(count(DISTINCT company), 0)", 2)}, "postings"))
for _c in metrics.DIMENSIONS:
    on_postings(f"distribution_{_c}", lambda p, c=_c: metrics.distribution(p, c), f" SELECT {_u(_c)} AS {_c}, count(*) AS vacancy_count, {_r(f'count(*) / {N}')} AS share FROM postings GROUP BY 1")
on_postings("distributions_all", metrics.distributions, " " + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {_u(c)} AS label, count(*) AS vacancy_count, {_r(f'count(*) / {N}')} AS share FROM postings GROUP BY 2" for c in metrics.DIMENSIONS))
_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
for _c, _labels in (("seniority", _PRIORITIES), ("work_mode", ("F", "O", "Unknown"))):
    on_postings(f"crosstab_role_{_c}", lambda p, c=_c: metrics.crosstab(p, "role_category", c), f" SELECT {_u('role_category')} AS role_category, " + ", ".join(f"count(*) FILTER ({_u(_c)} = '{x}') AS \"{x}\"" for x in _labels) + " FROM postings GROUP BY 1")
_Q = {"salary_count": "count(annual)", "salary_coverage": _r("count(annual) / nullif(count(*), 0)"), "average_salary": _r("avg(annual)", 2), "median_salary": _r("median(annual)", 2), "p25_salary": _r("quantile_cont(annual, 0.25)", 2), "p75_salary": _r("quantile_cont(annual, 0.75)", 2), "min_salary": _r("min(annual)", 2), "max_salary": _r("max(annual)", 2)}
on_postings("salary_summary", metrics.salary_summary, " " + _metrics(_Q, "paid"))
for _c in ("role_category", "seniority"):
    on_postings(f"salary_by_{_c}", lambda p, c=_c: metrics.salary_by(p, c, 10), f""", g AS (SELECT {_u(_c)} AS {_c}, count(*) AS salary_count, {_r("avg(annual)", 0)} AS average_salary, {_r("median(annual)", 0)} AS median_salary, {_r("min(annual)", 0)} AS min_salary, {_r("max(annual)", 0)} AS max_salary
    FROM paid WHERE annual IS NOT NULL GROUP BY 1 HAVING count(*) >= 10) SELECT *, CAST(row_number() OVER (ORDER BY average_salary DESC, salary_count DESC, {_c}) AS INTEGER) AS rank FROM g""")  # fmt: skip
on_postings("city_detail_items", lambda p: metrics.nested_distribution(p, "city", "role_category"), f""", c AS (SELECT {_u("city")} AS city, {_u("role_category")} AS label, count(*) AS vacancy_count FROM postings GROUP BY 1, 2)
SELECT *, {_r("vacancy_count / sum(vacancy_count) OVER (PARTITION BY city)")} AS share, CAST(row_number() OVER (PARTITION BY city ORDER BY vacancy_count DESC, label) AS INTEGER) AS rank FROM c""")  # fmt: skip
on_postings("city_details", metrics.city_details)
on_postings("city_detail_rescaled", lambda p: snapshots.rescaled(metrics.nested_distribution(p, "city", "work_mode"), metrics.distribution(p.filter("source != 'omega'"), "city"), "city"), f""", c AS (SELECT {_u("city")} AS city, {_u("work_mode")} AS label, count(*) AS n FROM postings GROUP BY 1, 2
), s AS (SELECT *, sum(n) OVER (PARTITION BY city) AS total FROM c), t AS (SELECT {_u("city")} AS city, count(*) AS target FROM postings WHERE source <> 'omega' GROUP BY 1
), r AS (SELECT city, label, {_r("n * target / CAST(total AS DOUBLE)")} AS count, target FROM s JOIN t USING (city)) SELECT city, label, count, {_r("count / target")} AS share, target FROM r WHERE count > 0""")  # fmt: skip

# ---- lists

_TOP = "count(*) AS vacancy_count"
on_postings("top_skills_overall", lambda p: skills.top(p, "skills_list", "skill", 20), f" SELECT skill, {_TOP}, {_r(f'count(*) / {N}')} AS share FROM skill GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
for _c in ("role_category", "canton"):
    on_postings(f"top_skills_by_{_c}", lambda p, c=_c: skills.top_by(p, "skills_list", "skill", c, 20), f""", g AS (SELECT {_u(_c)} AS {_c}, skill, {_TOP} FROM skill GROUP BY 1, 2), r AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY {_c} ORDER BY vacancy_count DESC) AS INTEGER) AS rank FROM g
    ), t AS (SELECT {_u(_c)} AS {_c}, count(*) AS n FROM postings GROUP BY 1) SELECT {_c}, skill, vacancy_count, rank, {_r("vacancy_count / n")} AS share_within_group FROM r JOIN t USING ({_c}) WHERE rank <= 20""")  # fmt: skip
on_postings("skill_pairs", lambda p: skills.pairs(p, "skills_list", 50), f" SELECT a.skill AS skill_1, b.skill AS skill_2, {_TOP} FROM skill a JOIN skill b ON a._ord = b._ord AND a.skill < b.skill GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 50")
on_postings("skill_pairs_all", lambda p: skills.pairs(p, "skills_list", None), f" SELECT a.skill AS skill_1, b.skill AS skill_2, {_TOP} FROM skill a JOIN skill b ON a._ord = b._ord AND a.skill < b.skill GROUP BY 1, 2")
on_postings("list_summary", lambda p: skills.summary(p, "skills_list"), " " + _metrics({"distinct_items": "(SELECT count(DISTINCT skill) FROM skill)", "total_mentions": "(SELECT count(*) FROM skill)", "vacancies_with_items": "count(*) FILTER (len(skills_list) > 0)", "vacancy_coverage": _r("count(*) FILTER (len(skills_list) > 0) / count(*)")}, "postings"))
on_postings("skill_role_matrix", lambda p: skills.skill_role_matrix(p, "skills_list"), f""", a AS (SELECT {_u("role_category")} AS role_category FROM postings GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5), b AS (SELECT skill FROM skill GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10
), c AS (SELECT {_u("role_category")} AS role_category, skill, {_TOP} FROM skill GROUP BY 1, 2), f AS (SELECT role_category, skill, coalesce(vacancy_count, 0) AS vacancy_count FROM a CROSS JOIN b LEFT JOIN c USING (role_category, skill))
SELECT *, {_r("vacancy_count / nullif(sum(vacancy_count) OVER (PARTITION BY role_category), 0)")} AS row_share FROM f""")  # fmt: skip
on_postings("weighted_places", lambda p: skills.weighted_split(p.withColumn("place", F.concat_ws(" / ", "city", "canton")), "place"), ", s AS (SELECT unnest([city, canton]) AS place FROM postings) SELECT place, count(*) * 0.5 AS weight FROM s GROUP BY 1")

# ---- trends

for _g, _name, _d in (("day", "date", "day"), ("week", "week_start", "CAST(date_trunc('week', day) AS DATE)")):
    on_postings(f"trends_{_g}", lambda p, g=_g, n=_name: trends.counts(p, g, n), f""", g AS (SELECT {_d} AS d, CAST(sum(published) AS BIGINT) AS published_count, CAST(sum(gone) AS BIGINT) AS closed_count FROM moves GROUP BY 1), l AS (SELECT *, lag(published_count) OVER (ORDER BY d) AS b FROM g)
    SELECT strftime(d, '%Y-%m-%d') AS {_name}, published_count, closed_count, published_count - closed_count AS net_change, {_r("(published_count - b) / nullif(b, 0)")} AS growth_rate FROM l""")  # fmt: skip
    on_postings(f"trends_segments_{_g}", lambda p, g=_g, n=_name: trends.segments(p, g, n), f""" SELECT strftime({_d}, '%Y-%m-%d') AS {_name}, {_u("canton")} AS canton, {_u("role_category")} AS role_category, CAST(sum(published) AS BIGINT) AS published_count, CAST(sum(gone) AS BIGINT) AS closed_count,
    CAST(sum(published) - sum(gone) AS BIGINT) AS net_change FROM moves GROUP BY 1, 2, 3""")  # fmt: skip
on_postings("trends_monthly", trends.monthly, f" SELECT CAST(month(publication_date) AS INTEGER) AS month, {_TOP}, {_r(f'count(*) / (SELECT count(publication_date) FROM postings)')} AS share FROM postings WHERE publication_date IS NOT NULL GROUP BY 1")


def _summary_sql() -> str:
    cells = {"published_total": "sum(published)", "closed_total": "sum(gone)"}
    for n in trends.WINDOWS:
        cells |= {f"published_last_{n}_days": f"coalesce(sum(published) FILTER (age < {n}), 0)", f"published_previous_{n}_days": f"coalesce(sum(published) FILTER (age >= {n} AND age < {2 * n}), 0)"}
    for n in trends.WINDOWS:
        a, b = cells[f"published_last_{n}_days"], cells[f"published_previous_{n}_days"]
        cells[f"growth_{n}_days"] = _r(f"({a} - {b}) / nullif({b}, 0)")
    return ", aged AS (SELECT *, (SELECT max(day) FROM moves) - day AS age FROM moves) " + _metrics(cells, "aged")


on_postings("trends_summary", trends.summary, _summary_sql())
on_postings("fastest_growing", lambda p: trends.fastest_growing(p, "role_category", 90), f""", a AS (SELECT {_u("role_category")} AS role_category, (SELECT max(CAST(publication_date AS DATE)) FROM postings) - CAST(publication_date AS DATE) AS age FROM postings
), g AS (SELECT role_category, count(*) FILTER (age < 90) AS current_count, count(*) FILTER (age BETWEEN 90 AND 179) AS previous_count FROM a GROUP BY 1) SELECT *, current_count - previous_count AS delta, {_r("(current_count - previous_count) / previous_count")} AS growth_rate FROM g WHERE current_count > 0 AND previous_count > 0""")  # fmt: skip
on_postings("closed_postings", lambda p: trends.closed(p).select("vacancy_id", F.date_format("closed_date", "yyyy-MM-dd").alias("closed_date")), " SELECT vacancy_id, strftime(last_seen_at, '%Y-%m-%d') AS closed_date FROM postings WHERE CAST(last_seen_at AS DATE) < (SELECT max(CAST(last_seen_at AS DATE)) FROM postings)")
on_postings("coverage_filter", lambda p: batch.covered(p, "2000-01-01").select("vacancy_id", "source"), " SELECT vacancy_id, source FROM postings WHERE publication_date >= TIMESTAMP '2000-01-01'")

# ---- search

_F = search.Filters(text="o", low=50_000, high=200_000, currency="CHF", since="1996-01-01", sources=["alpha", "beta"])
_HIT = "lower(title) LIKE '%o%' OR lower(company) LIKE '%o%' OR lower(city) LIKE '%o%'"
_WHERE = f"source IN ('alpha', 'beta') AND publication_date >= TIMESTAMP '1996-01-01' AND coalesce(salary_max, salary_min) >= 50000 AND coalesce(salary_min, salary_max) <= 200000 AND salary_currency = 'CHF' AND ({_HIT})"
_SCORE = "3 + CASE WHEN lower(title) LIKE '%o%' THEN 20 ELSE 0 END + CASE WHEN lower(company) LIKE '%o%' THEN 8 ELSE 0 END + CASE WHEN lower(city) LIKE '%o%' THEN 6 ELSE 0 END"
on_postings("search_filters", lambda p: search.where(p, _F).select("vacancy_id", "source", "title"), f" SELECT vacancy_id, source, title FROM postings WHERE {_WHERE}")
on_postings("search_page", lambda p: search.page(p, _F, 2, 25).select("vacancy_id", "score"), f" SELECT vacancy_id, CAST({_SCORE} AS BIGINT) AS score FROM postings WHERE {_WHERE} ORDER BY score DESC, last_seen_at DESC, coalesce(salary_max, salary_min) DESC, vacancy_id LIMIT 25 OFFSET 25")
_KINDS = {"skill": "skills_list", "city": "city", "role": "role_category"}
_TERMS = ", terms AS (SELECT vacancy_id, 'skill' AS term_type, unnest(skills_list) AS term_value FROM postings UNION SELECT vacancy_id, 'city', city FROM postings UNION SELECT vacancy_id, 'role', role_category FROM postings)"
on_postings("term_index", lambda p: search.term_index(p, _KINDS), _TERMS + " SELECT * FROM terms WHERE trim(term_value) <> ''")
on_postings("search_terms_semi", lambda p: search.by_terms(p, search.term_index(p, _KINDS), ["city"], "NATION_1").select("vacancy_id", "company"), " SELECT vacancy_id, company FROM postings WHERE lower(city) = 'nation_1'")
on_postings("facet_source", lambda p: search.facet(p, "source"), " SELECT source AS value, count(*) AS n FROM postings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
on_postings("facet_terms", lambda p: search.term_facets(search.term_index(p, _KINDS)), _TERMS + ", c AS (SELECT term_type, lower(term_value) AS value, count(DISTINCT vacancy_id) AS n FROM terms WHERE trim(term_value) <> '' GROUP BY 1, 2), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY term_type ORDER BY n DESC, value) AS INTEGER) AS position FROM c) SELECT * FROM r WHERE position <= 80")

# ---- duplicates


def _two(p: DataFrame) -> DataFrame:
    """The postings again under other sources, as another board would have them: a day later and with a suffix in the company."""
    other = p.withColumns({"_ord": F.col("_ord") + 10_000_000_000, "source": F.concat("source", F.lit("2")), "company": F.concat("company", F.lit(" AG")), "publication_date": F.expr("publication_date + interval 1 day"), "vacancy_id": F.concat(F.lit("x"), "vacancy_id")})
    return p.unionByName(other)


on_postings("dedup_pairs", lambda p: dedup.matches(_two(p)))
on_postings("dedup_report", lambda p: dedup.report(_two(p)))
on_postings("dedup_merged", lambda p: dedup.merged(_two(p)).select("vacancy_id", "source", "company", "duplicate_count", F.size("skills_list").alias("n_skills")))
on_postings("agency_anti_join", lambda p: batch.without_agencies(p, p.filter("canton = 'ASIA'").select("company").distinct()).select("vacancy_id", "company"), " SELECT vacancy_id, company FROM postings WHERE lower(company) NOT IN (SELECT lower(company) FROM postings WHERE canton = 'ASIA' AND company IS NOT NULL) OR company IS NULL")


def _jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Customers against suppliers of one nation by the tokens of their names."""
    a = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), tokens("c_name", TITLE_STOP, 2).alias("a"))
    b = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), tokens("s_name", TITLE_STOP, 2).alias("b"))
    return joins.overlapping(a, b, ["nation"], "a", "b").select("c_custkey", "s_suppkey", jaccard(F.col("a"), F.col("b")).alias("j")).filter("j > 0")


_TOK = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 2))"
add("jaccard_pairs", _jaccard_pairs, f"WITH a AS (SELECT c_custkey, c_nationkey, {_TOK.format('c_name')} AS a FROM customer), b AS (SELECT s_suppkey, s_nationkey, {_TOK.format('s_name')} AS b FROM supplier), j AS (SELECT c_custkey, s_suppkey, len(list_intersect(a, b)) AS i, len(list_distinct(a || b)) AS u FROM a JOIN b ON c_nationkey = s_nationkey) SELECT c_custkey, s_suppkey, i / u AS j FROM j WHERE i > 0")

# ---- text


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


_STOP = ["the", "and", "der", "die", "und", "les", "des", "que", "los"]
_FOLD = "replace(strip_accents(lower({0})), 'ß', 'ss')"
add("popular_words", lambda s, d: search.popular_words(_docs(s, d), "text", _STOP, 3), f"WITH w AS (SELECT unnest(string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')) AS word FROM documents) SELECT word, count(*) AS n FROM w WHERE length(word) >= 3 AND NOT regexp_full_match(word, '[0-9]+') AND word NOT IN ({', '.join(repr(x) for x in _STOP)}) GROUP BY 1")
add("accent_keys", lambda s, d: _docs(s, d).groupBy(F.sha2(text_key("text"), 256).alias("key")).agg(F.count(F.lit(1)).alias("n")), f"SELECT sha256(trim(regexp_replace({_FOLD.format('text')}, '[^a-z0-9]+', ' ', 'g'))) AS key, count(*) AS n FROM documents GROUP BY 1")
add("company_keys", lambda s, d: table(s, d, "customer").select("c_custkey", company_key(F.concat("c_name", F.lit(" Holding AG"))).alias("key"), name_key("c_name").alias("name")), "SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS key, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS name FROM customer")
add("education_share", lambda s, d: _docs(s, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(asks_degree("text")).alias("hits"), share(F.count_if(asks_degree("text")), F.count(F.lit(1))).alias("share")), f"WITH h AS (SELECT lang, regexp_matches({_FOLD.format('text')}, '{EDUCATION}') AS hit FROM documents) SELECT lang, count(*) AS n, count(*) FILTER (hit) AS hits, {_r('count(*) FILTER (hit) / count(*)')} AS share FROM h GROUP BY 1")
add("experience_by_lang", lambda s, d: metrics.experience_by(_docs(s, d).withColumn("x", experience("text")).select("lang", F.col("x.low").alias("exp_low"), F.col("x.high").alias("exp_high")), "lang"))
add("skill_matcher", lambda s, d: _docs(s, d).select("doc_id", F.explode(matched_skills("text")).alias("skill")).groupBy("skill").agg(F.count(F.lit(1)).alias("n")))
add("html_text", lambda s, d: pages.page_text(table(s, d, "pages")).select("page_id", "title", "n_chars"))
add("page_titles", lambda s, d: table(s, d, "pages").select("page_id", pages.title("html").alias("title")), "SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title\\s*>', 1), '\\s+', ' ', 'g')), '') AS title FROM pages")
add("postal_cantons", lambda s, d: table(s, d, "part").select("p_partkey", standardise.postal_canton((F.col("p_size") * 200).cast("int")).alias("canton")), "SELECT p_partkey, CASE " + " ".join(f"WHEN p_size * 200 BETWEEN {a} AND {b} THEN '{k}'" for a, b, k in standardise.POSTAL) + " END AS canton FROM part")

# ---- state

add("keep_first", lambda s, d: store.keep_first(table(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type"), "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) SELECT event_id, user_id, event_type FROM r WHERE k = 1")
add("latest_turn", lambda s, d: store.latest(table(s, d, "conversations"), ["conv_id"], ["turn", "role", "text"]).select("conv_id", "turn", "role"), "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS k FROM conversations) SELECT conv_id, turn, role FROM r WHERE k = 1")
add("json_props", lambda s, d: table(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k")), "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")


def _batches(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(s, d, "events").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    best = lambda x: x.groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"))
    return best(e.filter("ts < '2024-01-15'")), best(e.filter("ts >= '2024-01-15'"))


_B = "WITH e AS (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S') AS t FROM events), a AS (SELECT user_id, min(t) AS first_seen, max(t) AS last_seen, count(*) AS n FROM e WHERE t < '2024-01-15' GROUP BY 1), b AS (SELECT user_id, min(t) AS first_seen, max(t) AS last_seen, count(*) AS n FROM e WHERE t >= '2024-01-15' GROUP BY 1)"
add("upsert_state", lambda s, d: store.upsert(*_batches(s, d), "user_id", once=("first_seen",)), _B + " SELECT user_id, coalesce(a.first_seen, b.first_seen) AS first_seen, CASE WHEN b.user_id IS NOT NULL THEN b.last_seen ELSE a.last_seen END AS last_seen, CASE WHEN b.user_id IS NOT NULL THEN b.n ELSE a.n END AS n FROM a FULL JOIN b USING (user_id)")
_PAIR = ["user_id", "event_type"]
add("new_ids", lambda s, d: store.new_ids(table(s, d, "events").filter("ts >= '2024-01-03'").select(F.concat_ws("/", "user_id", "event_type").alias("k")).distinct(), table(s, d, "events").filter("ts < '2024-01-03'").select(F.concat_ws("/", "user_id", "event_type").alias("k")), "k"), "SELECT DISTINCT user_id || '/' || event_type AS k FROM events WHERE ts >= '2024-01-03' EXCEPT SELECT user_id || '/' || event_type FROM events WHERE ts < '2024-01-03'")
add("seen_state", lambda s, d: store.seen_state(None, table(s, d, "events").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), ["user_id", "event_type"], "ts"), "SELECT user_id, event_type, min(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS first_seen, max(strftime(ts, '%Y-%m-%d %H:%M:%S')) AS last_seen FROM events GROUP BY 1, 2")
on_postings("token_cost", lambda p: store.token_cost(p, "title", 0.05, 0.4, 280), " SELECT count(*) AS records, CAST(sum(CAST(ceil(length(coalesce(title, '')) / 4) AS BIGINT)) AS BIGINT) AS input_tokens, count(*) * 280 AS output_tokens, round_even((sum(CAST(ceil(length(coalesce(title, '')) / 4) AS BIGINT)) * 0.05 + count(*) * 280 * 0.4) / 1e6 * 1e6, 0) / 1e6 AS cost_usd FROM postings")

# ---- streams: what is there now goes through a stream into the shared folder and is read back


def _scratch(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="opalgrid-")
    return f"{base}/opalgrid-stream-{uuid.uuid4().hex}"


def _streamed(plan: Callable[[DataFrame], DataFrame], mode: str = "append") -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        like, to = table(spark, d, "events"), _scratch(spark)
        out = plan(streams.source(spark, like, d, "events.parquet"))
        schema = out.schema
        each = (lambda batch, n: batch.write.mode("overwrite").parquet(f"{to}/out")) if mode == "complete" else None
        streams.run(out, f"{to}/out", f"{to}/checkpoint", mode, each)
        return spark.read.schema(schema).parquet(f"{to}/out")

    return query


add("stream_windows", _streamed(lambda e: streams.window_counts(e).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n"), "complete"), "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
add("stream_distinct", _streamed(lambda e: streams.distinct(e, ["user_id", "event_type"]).select("user_id", "event_type")), "SELECT DISTINCT user_id, event_type FROM events")
# in complete mode, as sessions that are open at the end would never be appended
add("stream_sessions", _streamed(lambda e: streams.sessions(e).select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n"), "complete"), """WITH l AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM g GROUP BY user_id, k""")

# ---- a dashboard's aggregates over the published tables

_WEEKS = ", seg AS (SELECT CAST(date_trunc('week', day) AS DATE) AS d, {0} AS role_category, CAST(sum(published) AS BIGINT) AS n FROM moves GROUP BY 1, 2)".format(_u("role_category"))
_weekly = lambda p: trends.segments(p, "week", "week_start")
on_postings("trend_top_roles", lambda p: frontend.top_roles(_weekly(p), 3), _WEEKS + " SELECT role_category, CAST(sum(n) AS BIGINT) AS published_count FROM seg WHERE role_category NOT IN ('', 'Unknown', 'unknown') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
on_postings("trend_lines", lambda p: frontend.trend_lines(_weekly(p), "week_start", 3), _WEEKS + """, r AS (SELECT role_category FROM seg WHERE role_category <> 'Unknown' GROUP BY 1 ORDER BY sum(n) DESC, 1 LIMIT 3), g AS (SELECT DISTINCT d FROM seg)
SELECT strftime(g.d, '%Y-%m-%d') AS week_start, r.role_category, coalesce(n, 0) AS published_count FROM g CROSS JOIN r LEFT JOIN seg ON seg.d = g.d AND seg.role_category = r.role_category""")  # fmt: skip
for _n, _days in (("year", 365), ("halves", None)):
    _now, _before = ("age < 365", "age >= 365 AND age < 730") if _days else ("k > floor(c / 2)", "k <= floor(c / 2)")
    on_postings(f"trend_growth_{_n}", lambda p, days=_days: frontend.segment_growth(_weekly(p), "week_start", days), _WEEKS + f""", w AS (SELECT d, sum(n) AS n FROM seg GROUP BY 1), a AS (SELECT *, (SELECT max(d) FROM w) - d AS age, row_number() OVER (ORDER BY d) AS k, count(*) OVER () AS c FROM w
    ), s AS (SELECT CAST(coalesce(sum(n) FILTER ({_now}), 0) AS BIGINT) AS current_count, CAST(coalesce(sum(n) FILTER ({_before}), 0) AS BIGINT) AS previous_count FROM a) SELECT *, {_r("(current_count - previous_count) / nullif(previous_count, 0)")} AS growth_rate FROM s""")  # fmt: skip
on_postings("trend_seasons", lambda p: frontend.seasons(trends.segments(p, "day", "date")), ", m AS (SELECT CAST(month(day) AS INTEGER) AS month, CAST(sum(published) AS BIGINT) AS vacancy_count FROM moves GROUP BY 1) SELECT *, month = (SELECT month FROM m ORDER BY vacancy_count DESC, month LIMIT 1) AS is_strongest, month = (SELECT month FROM m ORDER BY vacancy_count, month LIMIT 1) AS is_weakest FROM m")
on_postings("trend_last_days", lambda p: frontend.last_days(trends.counts(p, "day", "date"), "date", 90).select("date", "published_count"), ", g AS (SELECT day, CAST(sum(published) AS BIGINT) AS published_count FROM moves GROUP BY 1) SELECT strftime(day, '%Y-%m-%d') AS date, published_count FROM g WHERE (SELECT max(day) FROM g) - day <= 89")
on_postings("client_filter", lambda p: frontend.client_filter(metrics.distribution(p, "company"), "company", 12, ("Customer#000000001",)).select("company", "vacancy_count"), " SELECT company, count(*) AS vacancy_count FROM postings WHERE trim(company) <> '' AND lower(company) <> 'customer#000000001' GROUP BY 1 HAVING count(*) >= 12")
_NATIONS = {f"nation {k}": f"n{k}" for k in range(20)}
on_postings("map_cities", lambda p: frontend.weighted_cities(p.withColumn("place", F.concat_ws(" und ", "city", F.when(F.col("work_mode") == "O", F.lit("Nation 3")))), _NATIONS, "place", "role_category"), f""", x AS (SELECT DISTINCT city, work_mode, 'n' || substr(city, 8) AS a, CASE WHEN work_mode = 'O' THEN 'n3' END AS b FROM postings
), k AS (SELECT p._ord, p.role_category, list_filter(list_distinct([CASE WHEN CAST(substr(p.city, 8) AS INTEGER) < 20 THEN 'n' || substr(p.city, 8) END, CASE WHEN p.work_mode = 'O' THEN 'n3' END]), lambda z: z IS NOT NULL) AS keys FROM postings p
), e AS (SELECT unnest(keys) AS city_key, 1.0 / len(keys) AS w, role_category FROM k WHERE len(keys) > 0), t AS (SELECT city_key, 'total' AS dimension, '' AS label, CAST(sum(w) AS DOUBLE) AS vacancy_count FROM e GROUP BY 1 UNION ALL SELECT city_key, 'role_category', role_category, CAST(sum(w) AS DOUBLE) FROM e WHERE role_category IS NOT NULL GROUP BY 1, 3
), s AS (SELECT *, max(vacancy_count) FILTER (dimension = 'total') OVER (PARTITION BY city_key) AS whole FROM t) SELECT city_key, dimension, label, vacancy_count, {_r("vacancy_count / whole")} AS share, CAST(row_number() OVER (PARTITION BY CASE WHEN dimension <> 'total' THEN city_key END, dimension ORDER BY vacancy_count DESC, label, city_key) AS INTEGER) AS rank FROM s""")  # fmt: skip
on_postings("latest_publication", trends.latest_publication, " SELECT strftime(max(publication_date), '%Y-%m-%d') AS latest_publication_date FROM postings")
on_postings("cube_counts", lambda p: p.cube("canton", "work_mode").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level")), " SELECT canton, work_mode, count(*) AS n, CAST(grouping(canton, work_mode) AS INTEGER) AS level FROM postings GROUP BY CUBE (canton, work_mode)")

# ---- joins, sets, frames and scalar functions over the tables


def _purchases(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return joins.as_of(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'click'").select("user_id", "ts", "event_id"), ["user_id"], "ts", ["event_id"]).select("event_id", "event_id_before")


add("join_as_of", _purchases, "SELECT a.event_id, b.event_id AS event_id_before FROM (SELECT * FROM events WHERE event_type = 'purchase') a ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts")
add("join_range", lambda s, d: joins.in_range(table(s, d, "part").select("p_partkey", "p_size"), table(s, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 45).alias("low"), (F.col("s_suppkey") % 45 + F.col("s_nationkey") % 4).alias("high")), [], "p_size", "low", "high", 4).select("p_partkey", "s_suppkey"), "SELECT p_partkey, s_suppkey FROM part JOIN supplier ON p_size BETWEEN s_suppkey % 45 AND s_suppkey % 45 + s_nationkey % 4")
add("set_intersect", lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(s, d, "supplier").select("s_nationkey")), "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
add("set_except", lambda s, d: table(s, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(s, d, "orders").select("o_custkey")), "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")


def _frames(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("event_type").orderBy("day")
    by = table(s, d, "events").groupBy("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return by.select("event_type", "day", F.sum("n").over(w.rowsBetween(-6, 0)).alias("week"), F.lead("n").over(w).alias("next"), F.first("n").over(w).alias("first"), F.ntile(4).over(w).alias("quarter"))


add("frames", _frames, "WITH c AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, day, CAST(sum(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS BIGINT) AS week, lead(n) OVER (PARTITION BY event_type ORDER BY day) AS next, first_value(n) OVER (PARTITION BY event_type ORDER BY day) AS first, CAST(ntile(4) OVER (PARTITION BY event_type ORDER BY day) AS INTEGER) AS quarter FROM c")
add("scalar_functions", lambda s, d: table(s, d, "part").select("p_partkey", F.col("p_name").like("%e%").alias("liked"), F.col("p_name").rlike("^(?:[a-z]+ ?)+$").alias("whole"), F.unbase64(F.base64(F.encode("p_name", "UTF-8"))).cast("string").alias("coded"), scalars.clamp(F.col("p_size").cast("double"), 10.0, 40.0).alias("clamped"), F.round(F.sqrt(F.col("p_size").cast("double")), 6).alias("root"), F.floor(F.log10(F.col("p_partkey") + 1.0)).alias("digits"), F.size(F.slice(F.split("p_name", " "), 1, 2)).alias("words"), F.col("p_size").bitwiseAND(7).cast("int").alias("bits"), F.lower(F.substring("p_type", 1, 5)).alias("kind")), "SELECT p_partkey, p_name LIKE '%e%' AS liked, regexp_full_match(p_name, '(?:[a-z]+ ?)+') AS whole, p_name AS coded, CAST(least(40, greatest(10, p_size)) AS DOUBLE) AS clamped, round(sqrt(p_size), 6) AS root, CAST(floor(log10(p_partkey + 1)) AS BIGINT) AS digits, CAST(len(string_split(p_name, ' ')[1:2]) AS INTEGER) AS words, CAST(p_size & 7 AS INTEGER) AS bits, lower(substr(p_type, 1, 5)) AS kind FROM part")
add("stop_words", lambda s, d: search.popular_words(_docs(s, d), "text", sorted({*_STOP, *"el la de".split()}), 2).orderBy(F.desc("n"), "word").limit(50), f"WITH w AS (SELECT unnest(string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')) AS word FROM documents) SELECT word, count(*) AS n FROM w WHERE length(word) >= 2 AND NOT regexp_full_match(word, '[0-9]+') AND word NOT IN ({', '.join(repr(x) for x in sorted({*_STOP, 'el', 'la', 'de'}))}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
