"""Queries over small inline tables whose results are known row by row: functions that the test tables have no input for.

Each is a query like any other; its SQL lists the rows that have to come out.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opalgrid.functions import places, scalars, text
from opalgrid.functions.taxonomy import experience, loader_seniority, matched_skills, search_seniority
from opalgrid.operators import classify, dedup, frontend, search, standardise, store
from opalgrid.sources import pages, readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
_SQL = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]", "array<double>": "DOUBLE[]"}


def _literal(v: object, kind: str) -> str:
    if v is None:
        return f"CAST(NULL AS {_SQL[kind]})"
    if isinstance(v, list):
        return f"CAST([{', '.join(_literal(x, kind[6:-1]) for x in v)}] AS {_SQL[kind]})"
    return f"CAST({repr(v) if not isinstance(v, str) else chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39)} AS {_SQL[kind]})"


def golden(name: str, given: str, rows: list[tuple], f: Callable[[DataFrame], DataFrame], found: str, want: list[tuple]) -> None:
    """A query that applies f to `rows` of the schema `given`, and must give the rows `want` of the schema `found`."""
    QUERIES[name] = lambda spark, d: f(spark.createDataFrame(rows, given))
    kinds = [x.split() for x in found.split(", ")]
    body = " UNION ALL ".join("SELECT " + ", ".join(f"{_literal(v, k)} AS {c}" for v, (c, k) in zip(r, kinds)) for r in want)
    ORACLE[name] = body or "SELECT " + ", ".join(f"CAST(NULL AS {_SQL[k]}) AS {c}" for c, k in kinds) + " WHERE false"


def mapped(name: str, pairs: list[tuple], f: Callable[[Column], Column], kind: str = "string", given: str = "string") -> None:
    """f over one column: (input, output) of each row."""
    golden(name, f"id int, x {given}", [(k, a) for k, (a, _) in enumerate(pairs)], lambda df: df.select("id", f(F.col("x")).alias("y")), f"id int, y {kind}", [(k, b) for k, (_, b) in enumerate(pairs)])


# ---- places

mapped("place_city", [("8000 Zurich", "Zürich"), ("Zuerich", "Zürich"), ("basle", "Basel"), ("neuchatel", "Neuchâtel"), ("Baden AG", "Baden"), ("8400 / Winterthur ZH", "Winterthur"), ("Lucerne", "Luzern"), ("n/a", None), (None, None), ("Bern XX", "Bern XX")], places.city_name)
mapped("place_named_canton", [("Appenzell Innerrhoden", "AI"), ("Grisons", "GR"), ("Saint Gallen", "SG"), ("Basel Land", "BL"), ("zh", "ZH"), ("Genève", "GE"), ("Bavaria", None), ("", None), (None, None)], places.named_canton)
mapped("place_single_code", [("Zug, ZG", "ZG"), ("BE or ZH", None), ("Bern BE, BE", "BE"), ("IT in Bern", None), (None, None)], places.single_code)
mapped("place_suffix_code", [("Baden AG", "AG"), ("AG Baden", None), ("Foo XX", None), (None, None)], places.suffix_code)
mapped("place_postal", [("CH-8001 Zürich", "ZH"), ("1201 Genève", "GE"), ("Raum 99999", None), ("3011", "BE"), (None, None)], places.postal_in)
mapped("place_city_canton", [("Winterthur", "ZH"), ("Campus Lausanne West", "VD"), ("Bern and Zürich", None), ("Nowhere", None), (None, None)], places.city_canton)
golden("place_derived_canton", "id int, region string, locality string, place string, postal string", [
    (1, "ZH", "Bern", None, None), (2, None, "Baden AG", None, None), (3, None, "3011 Bern", None, None), (4, "Elsewhere", "Lausanne", None, "8000"), (5, None, "Nowhere", None, "CH-9000"), (6, None, None, "Zug", None), (7, None, None, None, "12"), (8, "", "-", "Basel, BS", None),
], lambda df: df.select("id", places.derived_canton("region", "locality", "place", "postal").alias("canton")), "id int, canton string", [(1, "ZH"), (2, "AG"), (3, "BE"), (4, "VD"), (5, "SG"), (6, "ZG"), (7, None), (8, "BS")])
golden("place_canton_code", "id int, canton string, city string", [(1, "Zürich", None), (2, None, "Lausanne"), (3, "Region X", "Bern"), (4, "Region X", "Y"), (5, None, None)], lambda df: df.select("id", standardise.canton_code("canton", "city").alias("canton")), "id int, canton string", [(1, "ZH"), (2, "VD"), (3, "BE"), (4, "Region X"), (5, None)])
mapped("place_label", [("Zurich, Switzerland", "Zürich"), ("Zürich / zurich / ZH", "Zürich"), ("Bern (BE) und Basel", "Bern / Basel"), ("Geneva and Lausanne", "Genève / Lausanne"), ("ch", ""), (None, "")], places.location_label)
mapped("place_terms", [("Geneva", ["geneva", "geneve", "genf", "genève"]), ("Thun", ["thun"]), ("zuerich", ["zuerich", "zurich", "zürich"]), (None, [])], lambda c: F.array_sort(places.location_terms(c)), "array<string>")

# ---- payloads

_PAYLOAD = {"role_family_primary": "data_ai", "remote_mode": "hybrid", "seniority_labels": ["senior", "junior"], "job_location": {"locality": "8000 Zurich", "region": "", "postal_code": "8000"}, "company": {"name": "Acme"}, "experience_years": {"min": 3, "max": 5}, "tools": ["git"], "databases": ["redis", "git"]}
golden("flatten_analytics", "vacancy_id string, title string, place string, company string, analytics_json string", [
    ("1", "Senior Engineer", "Bern", None, json.dumps(_PAYLOAD)), ("2", "Engineer", "Bern", "Own", json.dumps({"job_location": {"locality": "Bern", "region": "BE"}})), ("3", None, "Lugano", None, "{broken"), ("4", "Engineer", "Biel", None, json.dumps({"seniority_labels": ["mid", "manager"], "job_location": {"postal_code": "2502"}})),
], lambda df: readers.flatten_analytics(df).select("vacancy_id", "role_category", "work_mode", "city", "canton", "company", "seniority", "experience_years_min", "experience_years_max", "skills"), "vacancy_id string, role_category string, work_mode string, city string, canton string, company string, seniority string, experience_years_min double, experience_years_max double, skills array<string>", [
    ("1", "data_ai", "hybrid", "Zürich", "ZH", "Acme", "senior", 3.0, 5.0, ["redis", "git"]), ("2", None, None, "Bern", "BE", "Own", None, None, None, []), ("3", None, None, "Lugano", "TI", None, None, None, None, []), ("4", None, None, "Biel", "BE", None, "manager", None, None, []),
])
golden("payload_merge", "id int, a string, b string", [(1, '{"tools":["git"],"job_location":{"locality":"Bern","region":"BE"}}', '{"tools":[],"job_location":{"locality":"Thun"},"other":1,"remote_mode":"remote"}'), (2, '{"tools":["x"]}', None), (3, None, '{"tools":["y"]}')], lambda df: df.select("id", scalars.merged_json("a", "b", places.TABLES["override_fields"]).alias("merged")), "id int, merged string", [(1, '{"job_location":{"locality":"Thun","region":"BE"},"remote_mode":"remote","tools":["git"]}'), (2, '{"tools":["x"]}'), (3, '{"tools":["y"]}')])
mapped("json_pruned", [('{"a":null,"b":"","c":[],"d":{"e":""},"f":0,"g":false,"h":[null,"x",[]]}', '{"f":0,"g":false,"h":["x"]}'), ("[1]", "{}"), ("{oops", "{}"), (None, "{}")], scalars.pruned_json)
mapped("json_redacted", [('{"term":"x","proxy_url":"http://p","csv_path":""}', '{"has_csv_path":false,"has_proxy_url":true,"term":"x"}'), (None, '{"has_csv_path":false,"has_proxy_url":false}')], lambda c: scalars.redacted_json(c, ("proxy_url", "csv_path")))
mapped("json_array", [('["a","b"]', ["a", "b"]), ('{"a":1}', []), ("oops", []), (None, [])], scalars.json_array, "array<string>")

# ---- classifier

_BOARD = "id int, title string, company string, place string, description_text string, description_html string, raw string, schema string"
_ROWS = [
    (1, "Senior Data Engineer", "Acme", "Zurich", "Build Python and SQL pipelines in a hybrid setup. Fluent English and German required.", None, '{"employmentGrades":[80,100],"listingTags":[{"name":"quickApply"}]}', '{"employmentType":["FULL_TIME"],"occupationalCategory":"Data Engineering","industry":"IT","hiringOrganization":{"name":"Acme Group","sameAs":"https://example.com"},"jobLocation":{"address":{"addressLocality":"Zurich","postalCode":"8000"}}}'),
    (2, "Software Engineer", "Acme", "Bern", "You bring 5+ years of professional experience. Remote.", None, '{"workload":"80% - 100%","listingTags":["quickApply","QuickApply"],"company":{"name":"","website":"https://a.example","logoImage":{"src":"l.png"}},"jobLocationSlug":"bern"}', None),
    (3, "Clerk", "Foo", None, " ", None, '{"expLevel":"Junior","detailPayload":{"experienceLevel":["Senior"]},"languageSkills":[{"language":"Italian"},"German"],"jobType":"Temp"}', '{"jobLocationType":"TELECOMMUTE","jobLocation":[{"address":{"addressLocality":"Thun"}}]}'),
    (4, None, None, None, None, None, None, None),
]
golden("classify_roles", _BOARD, _ROWS, lambda df: classify.classified(df).select("id", "role_family_primary", "seniority_labels", "spoken_languages", "remote_mode", F.col("experience_years.min").alias("years"), "confidence"), "id int, role_family_primary string, seniority_labels array<string>, spoken_languages array<string>, remote_mode string, years int, confidence string", [
    (1, "data_ai", ["senior"], ["english", "german"], "hybrid", None, "high"), (2, "software_engineering", ["senior"], [], "remote", 5, "high"), (3, None, ["junior", "senior"], ["german", "italian"], "remote", None, "low"), (4, None, [], [], None, None, "low"),
])
golden("classify_board", _BOARD, _ROWS, lambda df: classify.classified(df).select("id", "listing_tags", "employment_types", F.col("workload_percent.min").alias("low"), F.col("workload_percent.max").alias("high"), F.col("employer.name").alias("employer"), F.col("employer.website").alias("website"), F.col("employer.logo").alias("logo"), F.col("job_location.locality").alias("locality"), F.col("job_location.postal_code").alias("postal"), F.col("job_location.job_location_slug").alias("slug")), "id int, listing_tags array<string>, employment_types array<string>, low int, high int, employer string, website string, logo string, locality string, postal string, slug string", [
    (1, ["quickApply"], ["FULL_TIME"], 80, 100, "Acme Group", "https://example.com", None, "Zurich", "8000", None), (2, ["quickApply"], [], 80, 100, "Acme", "https://a.example", "l.png", "Bern", None, "bern"), (3, [], ["Temp"], None, None, "Foo", None, None, "Thun", None, None), (4, [], [], None, None, None, None, None, None, None, None),
])
golden("seniority_choice", "id int, title string, labels array<string>", [(1, "Lead Engineer", ["senior", "manager"]), (2, "Senior Manager", ["senior", "manager"]), (3, "Clerk", ["junior", "mid"]), (4, "Clerk", ["intern"]), (5, "Intern", ["intern"]), (6, "Clerk", []), (7, None, None)], lambda df: df.select("id", loader_seniority("title", F.col("labels")).alias("loader"), search_seniority("title", F.coalesce("labels", F.array().cast("array<string>"))).alias("search")), "id int, loader string, search string", [(1, "manager", "manager"), (2, None, "manager"), (3, "mid", "mid"), (4, None, "intern"), (5, "intern", "intern"), (6, None, None), (7, None, None)])
mapped("dedupe_items", [(["A b", " a  B ", "c", ""], ["A b", "c"]), ([], [])], classify.once, "array<string>", "array<string>")
mapped("skills_in_text", [("We use Python, C# and .NET with Postgres", True), ("pythonic", False), (None, False)], lambda c: F.array_contains(matched_skills(c, ["python"]), "python"), "boolean")

# ---- scores, lists, labels, map

mapped("score_clamped", [("87.5", 88), ("86.5", 86), ("-3", 0), ("140", 100), ("x", 0), (None, 0)], scalars.score, "int")
golden("score_probability", "id int, stated string, keyword double, overall double", [(1, "77", 10.0, 10.0), (2, "0", 80.0, 60.0), (3, None, 100.0, 100.0), (4, "x", 200.0, 200.0)], lambda df: df.select("id", scalars.pass_probability("stated", "keyword", "overall").alias("p"), scalars.status_band(scalars.pass_probability("stated", "keyword", "overall")).alias("band")), "id int, p int, band string", [(1, 77, "warning"), (2, 71, "warning"), (3, 94, "pass"), (4, 100, "pass")])
mapped("short_list", [([" a  b ", "A B", None, "", "c"], ["a b", "c"]), ([str(k) for k in range(20)], [str(k) for k in range(12)]), (["x" * 300], ["x" * 220]), (None, [])], scalars.short_list, "array<string>", "array<string>")
mapped("map_label", [("Zürich (ZH), CH", "zurich zh"), ("Raum Bern / Office", "bern"), ("Basel-Stadt", "basel"), (None, "")], scalars.city_label)
mapped("map_unmapped", [(None, "missing"), ("Unknown", "missing"), ("Greater Zurich Region", "broad"), ("home office", "broad"), ("Switzerland", "broad"), ("Atlantis", "unmatched")], scalars.unmapped_class)
_CITIES = {"zurich": "zurich", "bern": "bern", "st gallen": "st_gallen", "geneva": "geneva", "geneve": "geneva"}
mapped("map_keys", [("Zürich", ["zurich"]), ("Bern oder Zürich", ["zurich", "bern"]), ("Raum St. Gallen", ["st_gallen"]), ("Genève", ["geneva"]), ("Bernex", []), (None, [])], lambda c: scalars.city_keys(c, _CITIES), "array<string>")
golden("map_point", "id int, lon double, lat double", [(1, 5.85, 47.85), (2, 10.55, 45.75), (3, 8.2, 46.8)], lambda df: df.withColumn("p", scalars.map_point("lon", "lat")).select("id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y")), "id int, x double, y double", [(1, 191.0, 358.0), (2, 1109.0, 942.0), (3, 650.0, 650.0)])
golden("map_bubble", "id int, n double, most double", [(1, 25.0, 100.0), (2, 100.0, 100.0)], lambda df: df.withColumn("b", scalars.bubble("n", "most")).select("id", F.round("b.radius", 6).alias("radius"), F.round("b.opacity", 6).alias("opacity")), "id int, radius double, opacity double", [(1, 26.0, 0.46), (2, 47.0, 0.72)])
mapped("axis_ticks", [(7.0, [0.0, 2.0, 4.0, 6.0, 8.0]), (100.0, [0.0, 50.0, 100.0]), (3.0, [0.0, 1.0, 2.0, 3.0]), (0.0, [0.0, 1.0])], scalars.ticks, "array<double>", "double")
mapped("label_pretty", [("data_ai", "Data Ai"), ("on-site/REMOTE", "On-Site/Remote"), ("QA", "Quality"), ("", "n/a"), (None, "n/a")], lambda c: scalars.pretty(c, {"qa": "Quality"}))
golden("map_coverage", "city string, vacancy_count int", [("Zürich", 10), ("Bern oder Zürich", 4), ("Region Romandy", 3), (None, 2), ("Atlantis", 1), ("Geneva", 0)], lambda df: frontend.map_coverage(df, _CITIES), "total_vacancies long, mapped_vacancies long, multi_city_vacancies long, broad_vacancies long, missing_vacancies long, unmatched_vacancies long, mapped_share double, unmapped_vacancies long", [(20, 14, 4, 3, 2, 1, 0.7, 6)])

# ---- urls, ids, dates, money, texts

mapped("url_candidates", [("HTTPS://Ex.org/A/?q=1#x", ["HTTPS://Ex.org/A/?q=1#x", "https://ex.org/A", "https://ex.org/A?q=1"]), ("plain/", ["plain", "plain/"]), (None, [])], scalars.url_candidates, "array<string>")
mapped("url_canonical", [("HTTP://Ex.org//a//b/?q#f", "http://ex.org/a/b"), ("https://e.org", "https://e.org"), (None, None)], text.canonical_url)
golden("identity_key", "id int, url string, board string, title string, company string", [(1, "https://e.org/a", "7", "t", "c"), (2, None, " 7 ", "t", "c"), (3, " ", "", "Té", "c"), (4, None, None, "TE", "C")], lambda df: df.select("id", scalars.identity_key(F.col("url"), F.col("board"), "title", "company").alias("key")), "id int, key string", [(1, "url:https://e.org/a"), (2, "board:7"), *((k, f"fingerprint:{hashlib.sha1(b'te|c').hexdigest()[:20]}") for k in (3, 4))])
mapped("run_id", [("2026-06-13T10:11:12+00:00", "2026-06-13T10-11-12+00-00"), (None, None)], scalars.run_id)
mapped("asked_date", [("2026-01-31", "2026-01-31"), (" 31.01.2026 ", "2026-01-31"), ("", ""), (None, ""), ("1.1.2026", None), ("x", None)], scalars.asked_date)
golden("posted_at", "id int, a string, b string", [(1, "yesterday", "2026-01-02"), (2, "2026-01-03T10:00:00", "2026-01-02"), (3, "", "today"), (4, None, None)], lambda df: df.select("id", scalars.posted_at("a", "b").alias("posted_at")), "id int, posted_at string", [(1, "2026-01-02"), (2, "2026-01-03T10:00:00"), (3, "today"), (4, None)])
mapped("iso_string", [("2026-01-02 03:04:05", "2026-01-02T03:04:05Z"), (None, None)], lambda c: scalars.iso_string(c.cast("timestamp")))
mapped("iso_dates", [("2026-02-03T00:00:00Z", "2026-02-03"), ("3.2.2026", "2026-02-03"), ("03/02/2026", "2026-02-03"), ("soon", None), (None, None)], lambda c: text.iso_date(c).cast("string"))
golden("salary_struct", "id int, raw string, schema string", [
    (1, '{"salary":{"range":{"minValue":100000,"maxValue":120000},"currency":"CHF","unit":"YEAR"}}', None), (2, None, '{"baseSalary":{"currency":"EUR","value":{"value":50,"unitText":"HOUR"}}}'), (3, "{}", '{"baseSalary":{"currency":"USD","value":7000}}'), (4, '{"salaryText":"on request"}', None), (5, None, None), (6, '{"salary":"CHF 90k"}', None),
], lambda df: df.withColumn("s", scalars.salary_struct("raw", "schema")).select("id", F.col("s.low").alias("low"), F.col("s.high").alias("high"), F.col("s.currency").alias("currency"), F.col("s.unit").alias("unit"), scalars.salary_display("s").alias("shown")), "id int, low long, high long, currency string, unit string, shown string", [
    (1, 100000, 120000, "CHF", "YEAR", "CHF 100000-120000 / year"), (2, 50, 50, "EUR", "HOUR", "EUR 50 / hour"), (3, 7000, 7000, "USD", None, "USD 7000"), (4, None, None, None, None, "on request"), (5, None, None, None, None, None), (6, None, None, None, None, "CHF 90k"),
])
golden("salary_ranges", "id int, x string", [(1, "CHF 90'000 - 110'000 / year"), (2, "EUR 40 bis 50 pro Stunde"), (3, "USD 500 to 700"), (4, "nothing"), (5, None)], lambda df: df.withColumn("m", text.money("x")).select("id", F.col("m.currency").alias("currency"), F.col("m.low").alias("low"), F.col("m.high").alias("high"), F.col("m.unit").alias("unit")), "id int, currency string, low long, high long, unit string", [(1, "CHF", 90000, 110000, "YEAR"), (2, "EUR", 40, 50, "HOUR"), (3, "USD", 500, 700, None), (4, None, None, None, None), (5, None, None, None, None)])
golden("workload_range", "id int, x string", [(1, "80% - 100 %"), (2, "60%"), (3, "none")], lambda df: df.withColumn("w", text.workload("x")).select("id", F.col("w.low").alias("low"), F.col("w.high").alias("high")), "id int, low int, high int", [(1, 80, 100), (2, 60, 60), (3, None, None)])
mapped("capped_text", [("x" * 79, None), ("y" * 80, "y" * 80), ("z" * 12_001, "z" * 12_000), (None, None)], scalars.capped_text)
golden("reusable_detail", "id int, skipped boolean, html string, body string, schema string, raw string", [(1, True, "<p>", "x", None, None), (2, False, None, "x", None, None), (3, False, " ", "", "{}", None), (4, None, None, None, None, '{"salaryText":"5"}'), (5, False, None, None, '{"a":1}', None)], lambda df: df.select("id", scalars.reusable_detail(F.col("skipped"), F.col("html"), F.col("body"), F.col("schema"), scalars.salary_struct("raw", "schema")).alias("reusable")), "id int, reusable boolean", [(1, False), (2, True), (3, False), (4, True), (5, True)])
mapped("list_parsed", [('["a","b","a"]', ["a", "b"]), ("['it''s'".replace("''", "'") + ", 'x']", ["it's", "x"]), ("a; b|c,a", ["a", "b", "c"]), ("", []), (None, [])], standardise.parse_list, "array<string>")
mapped("missing_texts", [(" N/A ", None), ("a  b", "a b"), ("--", None), ("not_specified", None), (None, None)], text.clean)
mapped("years_asked", [("You bring at least 3 to 5 years of experience", 3.0), ("Our company has 20 years of history", None), (None, None)], lambda c: experience(c)["low"], "double")

# ---- search, state, pages, duplicates

golden("role_filter", "id int, title string, body string", [(1, "Senior Java Developer", ""), (2, "Java Developer", ""), (3, "Senior Clerk", ""), (4, "Clerk", "java"), (5, None, None)], lambda df: df.withColumn("d", search.decision(F.concat_ws(" ", "title", "body"), ["java"], ["senior"], True)).select("id", F.col("d.passes").alias("passes"), F.col("d.matched").alias("matched"), search.decision(F.concat_ws(" ", "title", "body"), ["java"], ["senior"], False)["passes"].alias("either")), "id int, passes boolean, matched array<string>, either boolean", [(1, True, ["java", "senior"], True), (2, False, ["java"], True), (3, False, ["senior"], True), (4, False, ["java"], True), (5, False, [], False)])
golden("text_filter", "id int, title string, company string, place string", [(1, "Java Dev", "Acme", "Bern"), (2, "Java Dev", "Agency", "Bern"), (3, "Clerk", "Acme", None)], lambda df: df.filter(search.includes(F.concat_ws(" ", "title", "company", "place"), ["java", "bern"], ["agency"])).select("id"), "id int", [(1,)])
golden("cli_order", "id string, salary_min int, salary_max int, last_seen_at string", [("a", 1, 9, "2"), ("b", None, 9, "3"), ("c", 5, None, "1"), ("d", None, None, "9"), ("e", 1, 9, "2")], lambda df: search.cli_order(df, 4).select("id"), "id string", [("b",), ("e",), ("a",), ("c",)])
golden("place_facet", "source string, place string", [("x", "Zurich")] * 3 + [("x", "Zürich")] * 2 + [("y", "Bern, CH")] * 2 + [("y", " "), ("y", None), ("x", "Basel")], lambda df: search.place_facet(df), "value string, n long", [("Zürich", 5), ("Bern", 2), ("Basel", 1)])
golden("keyword_semi", "vacancy_id string, keywords_matched_json string, analytics_json string", [("1", None, '{"tools":["Docker"]}'), ("2", '["docker"]', None), ("3", None, None), ("4", None, None)], lambda df: search.by_keyword(df, df.sparkSession.createDataFrame([("3", "tool", "Docker Compose"), ("4", "tool", "git")], "vacancy_id string, term_type string, term_value string"), ["docker"]).select("vacancy_id"), "vacancy_id string", [("1",), ("2",), ("3",)])
golden("llm_candidates", "vacancy_id string, source string, publication_date string, first_seen_at string, last_seen_at string, llm_analysis_json string", [("1", "a", "2026-01-02", "2026-01-01", None, None), ("2", "a", None, "2026-01-05", None, "{}"), ("3", "a", None, "2026-01-05", None, '{"x":1}'), ("4", "b", None, "2026-01-05", None, " "), ("5", "a", None, "2025-12-01", None, "")], lambda df: store.llm_candidates(df, "a", since="2026-01-01").select("vacancy_id"), "vacancy_id string", [("2",), ("1",)])
golden("backfill_candidates", "vacancy_id string, source string, url string, salary_min string, salary_max string, salary_text string", [("1", "a", "u", None, None, None), ("2", "a", "", None, None, None), ("3", "a", "u", "1", None, None), ("4", "b", "u", None, None, None), ("5", "a", "u", None, None, " ")], lambda df: store.backfill_candidates(df, "a").select("vacancy_id"), "vacancy_id string", [("1",), ("5",)])
golden("url_latest", "vacancy_id string, url string, last_seen_at string", [("1", "https://e.org/a/", "1"), ("2", "https://e.org/a", "2"), ("3", "https://e.org/b", "3")], lambda df: store.by_url(df, "HTTPS://E.org/a").select("vacancy_id"), "vacancy_id string", [("2",)])
golden("recent_rows", "id int, t string", [(1, "2026-01-03 00:00:00"), (2, "2026-01-01 00:00:00"), (3, "2026-01-01 00:00:01"), (4, None)], lambda df: df.filter(store.recent(F.col("t").cast("timestamp"), F.lit("2026-01-03 00:00:00").cast("timestamp"), 48)).select("id"), "id int", [(1,), (2,), (3,)])
golden("query_grid", "term string, location string", [("x", "Bern"), ("y", "Basel")], lambda df: store.query_grid(df.select("term"), df.select("location")), "term string, location string, number int, total int", [("x", "Bern", 1, 4), ("x", "Basel", 2, 4), ("y", "Bern", 3, 4), ("y", "Basel", 4, 4)])
golden("page_lines", "page_id int, html string", [(1, "<title>T</title><p>Hello</p><p>hello</p><script>x</script><p>a</p><p>B &amp; C&#33;</p>"), (2, None)], lambda df: pages.page_lines(df).select("page_id", "title", "body"), "page_id int, title string, body string", [(1, "T", "Hello\nB & C!"), (2, None, None)])
golden("new_postings", "vacancy_id string", [("1",), ("2",), ("3",)], lambda df: store.new_ids(df, df.filter("vacancy_id = '2'"), "vacancy_id"), "vacancy_id string", [("1",), ("3",)])

_DUP = [(1, "v1", "alpha", "Data Engineer", "Acme AG", "2026-01-01", "short text", ["python"], "CHF 1"), (2, "v2", "beta", "Data Engineer", "Acme", "2026-01-03", "a longer text here", ["Python", "sql"], "CHF 100 - 200"), (3, "v3", "gamma", "Data Engineer", "ACME Ltd", None, None, [], None), (4, "v4", "alpha", "Nurse", "Other", "2026-01-01", None, None, None), (5, "v5", "beta", "Data Engineer", "Acme", "2026-03-01", None, [], None)]
_DUP_IN = "_ord long, vacancy_id string, source string, title string, company string, publication_date string, description_text string, skills_list array<string>, salary_text string"


def _dup(df: DataFrame) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.withColumns({"publication_date": F.col("publication_date").cast("timestamp"), "city": F.lit("Bern"), **{c: none for c in ("canton", "role_category", "seniority", "work_mode")}})


golden("dedup_pairs_inline", _DUP_IN, _DUP, lambda df: dedup.matches(_dup(df)).select("a", "b", F.round("total", 4).alias("total")), "a long, b long, total double", [(1, 2, 0.86), (1, 3, 0.825), (2, 3, 0.825), (3, 5, 0.825)])
golden("dedup_merged_inline", _DUP_IN, _DUP, lambda df: dedup.merged(_dup(df)).select("vacancy_id", F.date_format("publication_date", "yyyy-MM-dd").alias("day"), "description_text", "skills_list", "sources", "duplicate_count", "salary_text"), "vacancy_id string, day string, description_text string, skills_list array<string>, sources array<string>, duplicate_count long, salary_text string", [("v2", "2026-01-01", "a longer text here", ["python", "sql"], ["alpha", "beta", "gamma"], 4, "CHF 100 - 200"), ("v4", "2026-01-01", None, [], ["alpha"], 1, None)])
golden("dedup_report_inline", _DUP_IN, _DUP, lambda df: dedup.report(_dup(df)).select("duplicate_group_id", "is_first", "group_size", "vacancy_id"), "duplicate_group_id string, is_first boolean, group_size long, vacancy_id string", [("cross-source-00001", True, 4, "v1"), *(("cross-source-00001", False, 4, f"v{k}") for k in (2, 3, 5))])
golden("dedup_clusters_numbered", "_ord long, cluster long", [(3, 3), (5, 3), (1, 1), (9, 9)], lambda df: dedup.numbered(df), "_ord long, cluster long, number int, group_id string", [(1, 1, 1, "cluster-00001"), (3, 3, 2, "cluster-00002"), (5, 3, 2, "cluster-00002"), (9, 9, 3, "cluster-00003")])
