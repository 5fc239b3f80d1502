"""Operators on inline rows."""

from __future__ import annotations

import json
import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from opalgrid.functions import text
from opalgrid.functions.numbers import annual, rint
from opalgrid.functions.taxonomy import SKILLS, asks_degree, loader_seniority, matched_skills, matching_text, search_seniority, skill_pattern, years_of
from opalgrid.operators import dedup, joins, metrics, search, skills, standardise, store, trends
from opalgrid.plans import batch, snapshots
from opalgrid.sources import pages, readers, sinks
from opalgrid.streaming import streams


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_text(spark):
    lit = F.lit
    assert one(spark, text.text_key(lit("  Zürich — Straße №1 "))) == "zurich strasse no1"
    assert one(spark, text.company_key(lit("Acme Holding AG"))) == "acme"
    assert one(spark, text.clean(lit(" N/A "))) is None and one(spark, text.clean(lit(" a   b "))) == "a b"
    assert one(spark, text.known(lit("  "))) == "Unknown"
    assert one(spark, text.canonical_url(lit("HTTPS://Ex.COM//a//b/?q=1#x"))) == "https://ex.com/a/b"
    m = one(spark, text.money(lit("CHF 90'000 - 110'000 / year")))
    assert (m.currency, m.low, m.high, m.unit) == ("CHF", 90000, 110000, "YEAR")
    assert tuple(one(spark, text.workload(lit("80% - 100 %")))) == (80, 100)
    assert str(one(spark, text.iso_date(lit("3.2.2024")))) == "2024-02-03" and one(spark, text.iso_date(lit("soon"))) is None
    assert one(spark, text.instant(lit("2026-04-14T08:00:00+02:00:00"))) is not None and one(spark, text.instant(lit("x"))) is None
    assert one(spark, rint(F.lit(0.00015))) == 0.0001 and one(spark, rint(F.lit(2.5), 0)) == 2
    assert one(spark, annual(F.lit(5000.0), F.lit(None).cast("double"), F.lit("chf"), F.lit("Month"))) == 60000
    assert one(spark, annual(F.lit(30.0), F.lit(40.0), F.lit("CHF"), F.lit("HOUR"))) is None


def test_taxonomy(spark):
    assert len(SKILLS) == 101
    find = lambda s: one(spark, matched_skills(F.lit(s), ["c++", "csharp", "dotnet", "java", "rest", "go", "ci_cd"]))
    assert find("C#, .NET and C++ with CI/CD") == ["c++", "csharp", "dotnet", "ci_cd"]
    assert find("the rest of the day, java island") == [] and find("REST API, Golang") == ["rest", "go"]
    assert find("rest of it." + " x" * 60 + " a REST service") == ["rest"]
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert one(spark, loader_seniority(F.lit("Senior Lead"), arr("senior", "manager"))) is None
    assert one(spark, loader_seniority(F.lit("Dev"), arr("Junior", "senior"))) == "senior" and one(spark, loader_seniority(F.lit("Dev"), arr("intern"))) is None
    assert one(spark, search_seniority(F.lit("Head of Interns"), arr())) == "manager"
    assert one(spark, asks_degree(F.lit("Abschluss in Informatik"))) and not one(spark, asks_degree(F.lit("none")))
    assert years_of("you have 3 to 5 years") == (3.0, 5.0) and years_of("our company has over 20 years of experience") is None and years_of("") is None
    assert years_of("2+ years of experience; minimum 5 years") == (2.0, None)


ROWS = [
    (1, "a", "1", "Data Engineer", "Acme AG", "data", "Zürich", "ZH", "senior", "remote", datetime(2026, 1, 5), datetime(2026, 1, 20), 100000.0, 120000.0, ["python", "sql"]),
    (2, "b", "2", "Data Engineer (m/w)", "ACME", "data", "Zurich", "ZH", "senior", None, datetime(2026, 1, 7), datetime(2026, 1, 25), None, None, ["sql", "spark"]),
    (3, "a", "3", "Cook", "Inn", None, "Bern", "BE", None, "onsite", datetime(2026, 1, 7), datetime(2026, 1, 25), 60000.0, None, []),
    (4, "b", "4", "Porter", None, "hotel", " ", None, None, None, None, None, None, None, None),
]
SCHEMA = "_ord long, source string, vacancy_id string, title string, company string, role_category string, city string, canton string, seniority string, work_mode string, publication_date timestamp, last_seen_at timestamp, salary_min double, salary_max double, skills_list array<string>"


@pytest.fixture(scope="module")
def p(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({"description_text": F.lit(None).cast("string"), "salary_currency": F.lit("CHF"), "salary_unit": F.lit("YEAR")}).cache()


def m(df):
    return {r.metric: r.value for r in df.collect()}


def test_metrics(p):
    assert m(metrics.overview(p)) == {"total_vacancies": 4, "unique_companies": 3, "average_vacancies_per_company": 1.0}
    assert [tuple(r) for r in metrics.distribution(p, "canton").collect()] == [("ZH", 2, 0.5), ("BE", 1, 0.25), ("Unknown", 1, 0.25)]
    x = metrics.crosstab(p, "role_category", "seniority")
    assert x.columns == ["role_category", "Unknown", "senior"] and [tuple(r) for r in x.collect()] == [("Unknown", 1, 0), ("data", 0, 2), ("hotel", 1, 0)]
    s = m(metrics.salary_summary(p))
    assert s["salary_count"] == 2 and s["salary_coverage"] == 0.5 and s["median_salary"] == 85000 and s["p25_salary"] == 72500
    assert [r.seniority for r in metrics.salary_by(p, "seniority").collect()] == ["senior", "Unknown"] and metrics.salary_by(p, "seniority", 2).count() == 0
    assert json.loads(metrics.city_details(p).filter("city = 'Bern'").first().company_distribution_json) == [{"label": "Inn", "count": 1, "share": 1.0, "rank": 1}]
    assert m(metrics.overview(p.limit(0)))["average_vacancies_per_company"] is None


def test_skills(p):
    assert [tuple(r) for r in skills.top(p, "skills_list", "skill", 2).collect()] == [("sql", 2, 0.5), ("python", 1, 0.25)]
    assert [tuple(r) for r in skills.pairs(p, "skills_list").collect()] == [("python", "sql", 1), ("spark", "sql", 1)]
    assert skills.top_by(p, "skills_list", "skill", "role_category", 1).first()["share_within_group"] == 1.0
    t = {r.category: r for r in skills.taxonomy_summary(p, "skills_list").collect()}
    assert len(t) == 7 and t["language"].total_mentions == 3 and t["cloud"].vacancies_with_items == 0
    assert skills.top_taxonomy(p, "skills_list").count() == 3 and m(skills.summary(p, "skills_list"))["vacancy_coverage"] == 0.5


def test_trends(p):
    day = [tuple(r) for r in trends.counts(p, "day", "date").collect()]
    assert day == [("2026-01-05", 1, 0, 1, None), ("2026-01-07", 2, 0, 2, 1.0), ("2026-01-20", 0, 1, -1, -1.0)]
    assert m(trends.summary(p, (14,)))["published_last_14_days"] == 2
    assert trends.segments(p, "week", "week_start").count() == 3 and trends.monthly(p).first().share == 1.0


def test_dedup(p):
    pairs = dedup.matches(p).collect()
    assert [(r.a, r.b) for r in pairs] == [(1, 2)]
    got = {r.cluster: r for r in dedup.merged(p).collect()}
    assert len(got) == 3 and got[1].duplicate_count == 2 and got[1].skills_list == ["python", "sql", "spark"] and got[1].sources == ["a", "b"] and got[1].vacancy_id == "1"
    assert [(r.duplicate_group_id, r.vacancy_id) for r in dedup.report(p).collect()] == [("cross-source-00001", "1"), ("cross-source-00001", "2")]
    assert dedup.merged(p.limit(0)).count() == 0


def test_search(p):
    f = search.Filters(text="data engineer")
    assert [r.vacancy_id for r in search.page(p, f, 9, 1).collect()] == ["2"] and search.ranked(p, f).first().score == 43
    assert [r.vacancy_id for r in search.where(p, search.Filters(skills=["SQL"], sources=["b"])).collect()] == ["2"]
    assert search.where(p, search.Filters(places=["zurich"])).count() == 2 and search.where(p, search.Filters(low=70000.0)).count() == 1
    terms = search.term_index(p, {"skill": "skills_list", "city": "city"})
    assert terms.count() == 7 and search.by_terms(p, terms, ["skill"], "SQL").count() == 2


def test_store(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, None)], "id string, first int, llm string")
    new = spark.createDataFrame([("b", 5, "new"), ("c", 6, None), ("a", 9, "y")], "id string, first int, llm string")
    got = {r.id: (r.first, r.llm) for r in store.upsert(old, new, "id", once=("first",), fill=("llm",)).collect()}
    assert got == {"a": (1, "x"), "b": (2, "new"), "c": (6, None)}
    assert [r.id for r in store.new_ids(new, old, "id").collect()] == ["c"]
    k = spark.createDataFrame([("1",), ("p:1",), ("2",)], "id string")
    assert sorted(r.id for r in store.prefix_keys(k, "id", "p:").collect()) == ["p:1", "p:2"]
    nulls = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4)], "id string, n int")
    assert sorted(r.n for r in store.keep_first(nulls, ["id"], ["n"]).collect()) == [1, 2, 3]


def test_standardise(spark):
    df = spark.createDataFrame([(None, "data", "3011 Bern BE", "", "senior", "n/a", "['Python', 'K8s']", "90000"), ("X", "data", "Zurich", "Zürich", "", "remote", "Golang|foo, foo", "bad")], "company_name string, role_category string, place string, state string, seniority_level string, remote_mode string, detected_skills string, salary_from string")
    a, b = standardise.standardise(df).orderBy("company").collect()
    assert (a.city, a.canton, a.work_mode, a.salary_min) == ("Bern", "BE", None, 90000.0) and a.skills_list == ["python", "kubernetes"] and a.tool_skills_list == ["kubernetes"]
    assert (b.city, b.canton, b.salary_min) == ("Zürich", "ZH", None) and b.skills_list == ["go", "foo"]
    with pytest.raises(ValueError, match="canton, city"):
        standardise.standardise(spark.createDataFrame([("x",)], "company string"))
    with pytest.raises(ValueError, match="no rows"):
        standardise.standardise(df.limit(0))


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,title\n1,"a\nb"\n')
    assert readers.load(spark, str(tmp_path / "a.csv")).first().title == "a\nb"
    (tmp_path / "a.json").write_text('{"items": [{"jobTitle": "Cook", "id": "7"}, {"jobTitle": " "}]}')
    good, bad = readers.import_json(spark, str(tmp_path / "a.json"), "x")
    assert [(r.vacancy_id, r.title) for r in good.collect()] == [("7", "Cook")] and bad.count() == 1
    with sqlite3.connect(tmp_path / "a.db") as con:
        con.execute("create table vacancies (vacancy_id text, title text)")
        con.execute("insert into vacancies values ('1', 'x')")
    r = readers.load(spark, str(tmp_path / "a.db")).first()
    assert (r.vacancy_id, r.company) == ("1", None)
    with pytest.raises(ValueError, match="unsupported"):
        readers.load(spark, "x.xml")
    a, b = spark.createDataFrame([("s", "1", 1)], "source string, vacancy_id string, n int"), spark.createDataFrame([("s", "1", "z"), ("s", None, "y")], "source string, vacancy_id string, q string")
    assert store.union_sources([a, b]).count() == 2
    assert pages.embedded_object('x = {"a": "}", b: {c: 1}} tail', "x =") == '{"a": "}", b: {c: 1}}' and pages.embedded_object("x = {", "x =") is None
    ld = '<script type="application/ld+json">{"@type": "Org"}</script><script type="application/ld+json"> {"@type": ["JobPosting"], "t": 1} </script>'
    assert one(spark, F.get_json_object(pages.json_ld(F.lit(ld)), "$.t")) == "1" and one(spark, pages.json_ld(F.lit("x"))) is None
    assert one(spark, text.html_text(F.lit("<style>a{}</style><p>A&amp;B</p><p>c<br>d</p>"))) == "A&B\nc\nd"
    sinks.write_report({"t": spark.createDataFrame([("=1", -2)], "a string, b int")}, str(tmp_path / "r"))
    assert (tmp_path / "r/t.csv").read_text().split() == ["a,b", "'=1,-2"]


def test_batch_and_snapshots(p, tmp_path):
    out = batch.run(p, ("Inn",), "2026-01-01")
    assert len(out) == 28 and m(out["overview_metrics"])["total_vacancies"] == 1
    docs = snapshots.documents({k: out[k] for k in ("overview_metrics", "distribution_city", "top_skills_by_canton")}, "2026-01-31")
    assert "salary_summary" in docs["metadata"]["missing"] and docs["trends"]["daily"] is None and set(docs["skills"]["by_canton"]) and docs["skills"]["overall"] is None
    assert snapshots.cleaned({"a": [float("nan"), 1.5], "b": float("inf")}) == {"a": [None, 1.5], "b": None} and snapshots.json_items('{"a": 1}') == [] == snapshots.json_items("oops") and snapshots.json_items("[1]") == [1]
    with pytest.raises(ValueError):
        snapshots.documents({}, "soon")
    sinks.write_snapshots(docs, str(tmp_path))
    assert json.loads((tmp_path / "distribution_city.json").read_text())["items"][0]["label"] == "Zürich"
    r = snapshots.rescaled(metrics.nested_distribution(p, "canton", "work_mode"), metrics.distribution(p.filter("_ord != 2"), "canton"), "canton")
    assert {(x.canton, x.label, x["count"]) for x in r.collect()} == {("ZH", "remote", 0.5), ("ZH", "Unknown", 0.5), ("BE", "onsite", 1.0), ("Unknown", "Unknown", 1.0)}


def test_streams(spark, tmp_path):
    rows = [(k, datetime(2024, 1, 1, k), k % 2, "t", 1.0) for k in range(6)]
    e = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = streams.source(spark, e, str(tmp_path / "in"))
    streams.run(s, "", str(tmp_path / "c1"), each=streams.upsert_into(str(tmp_path / "state"), ["user_id"], "ts"))
    assert spark.read.parquet(streams.newest(str(tmp_path / "state"))).count() == 2
    e.withColumn("event_id", F.col("event_id") + 3).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = streams.source(spark, e, str(tmp_path / "in"), files=1)
    streams.run(s, "", str(tmp_path / "c2"), each=streams.fresh(str(tmp_path / "seen"), "event_id", str(tmp_path / "new")))
    assert spark.read.parquet(str(tmp_path / "new/b=1")).count() == 3


def test_stream_sessions_over_the_whole_table(spark):
    from datetime import UTC

    from opalgrid.plans.catalogue import QUERIES

    folder = "/root/testdata/sf0.001"
    times: dict[int, list] = {}
    for r in spark.read.parquet(f"{folder}/events.parquet").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts")).collect():
        times.setdefault(r.user_id, []).append(r.ts)
    want = []
    for user, ts in times.items():
        found = []
        for at in sorted(ts):
            if found and at < found[-1][1] + 1_800_000_000:
                found[-1][1:] = [at, found[-1][2] + 1]
            else:
                found.append([at, at, 1])
        want += [(user, str(datetime.fromtimestamp(first // 1_000_000, UTC).replace(tzinfo=None)), n) for first, _, n in found]
    got = [(r.user_id, r.start, r.n) for r in QUERIES["stream_sessions"](spark, folder).collect()]
    assert sorted(got) == sorted(want)


def test_skills_are_found_in_one_reading(spark):
    texts = ["Ruby on Rails, docker-compose; Azure DevOps!", "google or-tools/c++20 (.NET core) C/C++", "the rest of java", "", None, "ansi c# c#", "rest of it." + " x" * 60 + " a REST api"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    plain = F.array_compact(F.array(*(F.when(matching_text("text").rlike(skill_pattern(k)), F.lit(k)) for k in SKILLS)))  # one pattern for each skill
    got = rows.select("k", matched_skills("text").alias("got"), plain.alias("want")).orderBy("k").collect()
    assert [r.got for r in got] == [r.want for r in got] and got[0].got == ["ruby", "rails", "docker", "azure_devops", "devops"] and got[4].got == []
    plan = rows.select(F.explode(matched_skills("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("RLIKE") <= 3


def test_range_join_deals_full_stretches_to_several_tasks(spark, monkeypatch):
    points = spark.createDataFrame([(k % 3, k, k % 7) for k in range(300)] + [(0, 999, None)], "g int, id int, at int")
    ranges = spark.createDataFrame([(k % 3, 1000 + k, k % 6, k % 6 + k % 4 - 1) for k in range(200)] + [(0, 7, 5, None)], "g int, r int, low int, high int")
    want = sorted(tuple(r) for r in points.join(ranges, "g").filter("at between low and high").select("g", "id", "at", "r", "low", "high").collect())
    assert sorted(tuple(r) for r in joins.in_range(points, ranges, ["g"], "at", "low", "high", 4).collect()) == want
    monkeypatch.setattr(joins, "CELL", 200)
    monkeypatch.setattr(joins, "CHUNK", 3)
    got = joins.in_range(points, ranges, ["g"], "at", "low", "high", 4)
    assert got.columns == ["g", "id", "at", "r", "low", "high"] and sorted(map(tuple, got.collect())) == want
    one_stretch = joins.in_range(points.drop("g"), ranges.drop("g"), [], "at", "low", "high", 100).withColumn("task", F.spark_partition_id())
    assert one_stretch.select("task").distinct().count() > 4


def test_rows_meet_by_what_they_share(spark, monkeypatch):
    a = spark.createDataFrame([(k % 2, k, [f"t{k % 5}", "all", f"u{k % 3}"][: k % 4]) for k in range(60)] + [(0, 99, None)], "g int, id int, a array<string>")
    b = spark.createDataFrame([(k % 3, k, [f"u{k % 3}", "all", f"t{k % 7}", None][: k % 5]) for k in range(50)] + [(1, 99, None)], "g int, r int, b array<string>")
    jac = text.jaccard(F.col("a"), F.array_compact("b"))
    want = sorted((r.id, r.r, r.j) for r in a.join(b, "g").select("id", "r", jac.alias("j")).filter("j > 0").collect())
    monkeypatch.setattr(joins, "CELL", 50)
    monkeypatch.setattr(joins, "CHUNK", 2)
    got = joins.overlapping(a, b, ["g"], "a", "b")
    assert got.columns == ["g", "id", "a", "r", "b"] and sorted((r.id, r.r, r.j) for r in got.select("id", "r", jac.alias("j")).collect()) == want and len(want) > 200
    from opalgrid.plans.catalogue import QUERIES

    met = QUERIES["jaccard_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "__item" in met  # by nation alone every customer met every supplier


def test_dedup_without_dates_and_across_windows(spark):
    from itertools import combinations

    days = [None, datetime(2026, 1, 1), datetime(2026, 1, 14), datetime(2026, 1, 16), datetime(2026, 1, 29), datetime(2026, 3, 1)]
    rows = [(k, "abc"[k % 3], str(k), "Data Engineer", f"Acme {k % 2}", "x", "Bern", "BE", "s", "m", days[k // 6 % 6]) for k in range(48)]
    p = spark.createDataFrame(rows, "_ord long, source string, vacancy_id string, title string, company string, role_category string, city string, canton string, seniority string, work_mode string, publication_date timestamp").withColumns({"description_text": F.lit(None).cast("string"), "skills_list": F.array(F.lit("SQL"), F.concat(F.lit("Zürich"), F.col("_ord") % 2))})
    near = lambda a, b: a is None or b is None or abs((a - b).days) <= 14
    want = [(a[0], b[0]) for a, b in combinations(rows, 2) if a[4] == b[4] and a[1] != b[1] and near(a[10], b[10])]
    assert sorted((r.a, r.b) for r in dedup.matches(p).collect()) == want
    assert {(r.cluster, r.duplicate_count, tuple(r.skills_list)) for r in dedup.merged(p).collect()} == {(0, 24, ("SQL", "Zürich0")), (1, 24, ("SQL", "Zürich1"))}
    assert [r.group_size for r in dedup.report(p).collect()] == [24] * 48
    plan = dedup.clusters(p)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and "FlatMapGroupsInPandas" not in plan  # no call of Python for each company
