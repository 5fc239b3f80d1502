"""One posting on several boards: blocked fuzzy matching, components, merged rows and a report."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from opalgrid.functions.numbers import rint
from opalgrid.functions.text import BODY_STOP, TITLE_STOP, company_key, jaccard, text_key, tokens

MAX_DAYS, LEAST_TITLE, LEAST_TOTAL = 14, 0.72, 0.82
_EPS = 1e-9


@F.pandas_udf(DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio; the first argument is the row that came first."""
    return pd.Series([(1.0 if x == y else SequenceMatcher(None, x, y).ratio()) if x and y else 0.0 for x, y in zip(a, b)])


def keyed(p: DataFrame) -> DataFrame:
    day = F.coalesce(F.to_date("publication_date"), *(F.to_date(c) for c in ("first_seen_at", "last_seen_at") if c in p.columns))
    key = lambda c: text_key(c)
    return p.select(
        F.col("_ord"), company_key("company").alias("block"), key("source").alias("src"), key("title").alias("title_key"), tokens("title", TITLE_STOP, 2).alias("title_tokens"), tokens("description_text", BODY_STOP, 4).alias("body_tokens"),
        key("city").alias("city_key"), F.upper(key("canton")).alias("canton_key"), key("role_category").alias("role_key"), key("seniority").alias("seniority_key"), key("work_mode").alias("mode_key"), day.alias("day"),
    )


def _same(name: str) -> Column:
    a, b = F.col(f"a.{name}"), F.col(f"b.{name}")
    return F.when((a == "") | (b == ""), 0.5).when(a == b, 1.0).otherwise(0.0)


def matches(p: DataFrame) -> DataFrame:
    """(block, a, b, title, total) of rows of different sources and one company that are the same posting.

    All but the title ratio is native and comes first; a bound on the ratio by the lengths of both titles
    leaves few pairs for Python. Rows meet by company and window of MAX_DAYS + 1 days: a row is in its own window and in the next one, and a pair
    counts where the later row's window is. So the pairs of a large company grow with its days, not with the square of its rows; rows without a date, which match any date, meet
    by company alone. Rows without a company or title match nothing.
    """
    k = keyed(p).filter("block != '' and title_key != ''")
    names = k.columns
    slot = F.floor(F.datediff("day", F.lit("1970-01-01")) / (MAX_DAYS + 1))
    # one exchange serves both sides of the join of dated rows, and rows without a date as well: filters that name one side only would make two of it
    dated = k.filter("day is not null").select(*names, F.posexplode(F.array(slot, slot + 1)).alias("moved", "slot")).repartition("block", "slot")
    undated = k.filter("day is null")
    gap = F.abs(F.datediff("a.day", "b.day"))
    ac, bc, acity, bcity = (F.col(x) for x in ("a.canton_key", "b.canton_key", "a.city_key", "b.city_key"))
    near = (ac == "") | (bc == "") | (ac == bc) | ((acity != "") & (acity == bcity))
    both = (F.col("a.src") != F.col("b.src")) & (F.coalesce(gap, F.lit(0)) <= MAX_DAYS) & near
    pair = lambda l, r, on: l.alias("a").join(r.alias("b"), (F.col("a.block") == F.col("b.block")) & (F.col("a._ord") < F.col("b._ord")) & on & both).select(*(F.struct(*(F.col(f"{q}.{c}") for c in names)).alias(q) for q in "ab"))
    # both in their own window or one of them in the next: each pair once
    joined = pair(dated, dated, (F.col("a.slot") == F.col("b.slot")) & (F.col("a.moved") + F.col("b.moved") < 2))
    own = lambda q: F.col(f"{q}.moved") <= F.length("a.block") - F.length("b.block")  # that is 0, of equal blocks
    joined = joined.unionByName(pair(undated, dated, own("b"))).unionByName(pair(dated, undated, own("a"))).unionByName(pair(undated, undated, F.lit(True)))
    place = F.when((acity != "") & (acity == bcity), 1.0).when((ac != "") & (ac == bc), 0.8).when((acity != "") != (bcity != ""), 0.6).when((ac != "") != (bc != ""), 0.55).otherwise(0.5)
    day = F.when(gap.isNull(), 0.5).when(gap == 0, 1.0).when(gap <= 3, 0.9).when(gap <= 7, 0.75).when(gap <= MAX_DAYS, 0.6).otherwise(0.0)
    body = F.when((F.size("a.body_tokens") == 0) | (F.size("b.body_tokens") == 0), 0.5).otherwise(jaccard(F.col("a.body_tokens"), F.col("b.body_tokens")))
    rest = place * 0.2 + day * 0.15 + body * 0.1 + _same("role_key") * 0.05 + _same("seniority_key") * 0.025 + _same("mode_key") * 0.025
    la, lb = F.length("a.title_key"), F.length("b.title_key")
    pairs = joined.select(F.col("a.block").alias("block"), F.col("a._ord").alias("a"), F.col("b._ord").alias("b"), F.col("a.title_key").alias("ta"), F.col("b.title_key").alias("tb"), rest.alias("rest"), jaccard(F.col("a.title_tokens"), F.col("b.title_tokens")).alias("jac"), (2.0 * F.least(la, lb) / (la + lb)).alias("bound"))
    best = F.greatest("jac", "bound")
    pairs = pairs.filter(best >= F.greatest(F.lit(LEAST_TITLE), (LEAST_TOTAL - F.col("rest")) / 0.45) - 4 * _EPS)
    title = F.greatest("jac", F.when(F.col("ta") == F.col("tb"), 1.0).otherwise(title_ratio("ta", "tb")))
    scored = pairs.withColumn("title", title).withColumn("total", F.col("title") * 0.45 + F.col("rest"))
    return scored.filter((F.col("title") >= LEAST_TITLE) & (F.col("total") >= LEAST_TOTAL - _EPS)).select("block", "a", "b", "title", "total")


def _union_find(edges: pd.DataFrame) -> pd.DataFrame:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(edges["a"], edges["b"]):
        x, y = root(int(a)), root(int(b))
        parent[max(x, y)] = min(x, y)
    nodes = sorted(parent)
    return pd.DataFrame({"_ord": nodes, "cluster": [root(x) for x in nodes]}, dtype="int64")


def _by_block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Clusters of the edges of whole blocks, which come one after the other; edges of the last block wait for the next batch."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        last = batch["key"] == batch["key"].iloc[-1]
        if held and held[-1]["key"].iloc[0] == batch["key"].iloc[-1]:
            held.append(batch)  # still the same block
            continue
        yield _union_find(pd.concat([*held, batch[~last]]))
        held = [batch[last]]
    if held:
        yield _union_find(pd.concat(held))


def found(p: DataFrame) -> DataFrame:
    """(_ord, cluster) of the rows that are joined with another. Edges don't leave a company, so its few edges are joined on their own; one call takes many companies."""
    edges = matches(p).select(F.xxhash64("block").alias("key"), "a", "b")
    return edges.repartition("key").sortWithinPartitions("key").mapInPandas(_by_block, "_ord long, cluster long")


def clusters(p: DataFrame) -> DataFrame:
    """(_ord, cluster) of every row: cluster is the first row that it is joined with in any number of steps."""
    return p.select("_ord").join(found(p), "_ord", "left").select("_ord", F.coalesce("cluster", "_ord").alias("cluster"))


def merged(p: DataFrame, clustered: DataFrame | None = None) -> DataFrame:
    """One row for each cluster: all columns of its fullest row, first and last dates, the longest description,
    and salary text, the lists of all rows in order without repetition, and the sources."""
    every = p.join(clustered, "_ord") if clustered is not None else p.join(found(p), "_ord", "left").withColumn("cluster", F.coalesce("cluster", "_ord"))
    plain = [c for c, t in p.dtypes if c not in ("_ord", "publication_date", "first_seen_at", "last_seen_at", "description_text", "salary_text") and not (t == "array<string>" and c.endswith("_list"))]
    filled = sum((F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), 1).otherwise(0) for c in plain), F.lit(0))
    size = F.coalesce(F.length("description_text"), F.lit(0))
    rank = F.struct(filled, size, F.coalesce(F.size("skills_list"), F.lit(0)), -F.col("_ord"))
    none = F.array().cast("array<string>")
    kinds = [c for c, t in p.dtypes if t == "array<string>" and c.endswith("_list")]

    def rows(c: str) -> Column:
        """Items of all rows in order."""
        return F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_ord", F.coalesce(c, none).alias("l")))), lambda x: x["l"]))

    def union(c: str) -> Column:
        """The first spelling of each item; items that differ in case or accents are one. Each item's key is made once."""
        keys = F.transform(c, text_key)
        firsts = lambda k: F.filter(c, lambda _, i: F.array_position(k, F.get(k, i)) == i + 1)
        return F.element_at(F.transform(F.array(keys), firsts), 1)

    longest = lambda c: F.trim(F.max_by(c, F.struct(F.coalesce(F.length(c), F.lit(0)), -F.col("_ord"))))
    texts = [longest(c).alias(c) for c in ("description_text", "salary_text") if c in p.columns]
    dates = [f(c).alias(c) for c, f in (("publication_date", F.min), ("first_seen_at", F.min), ("last_seen_at", F.max)) if c in p.columns]
    sources = F.array_sort(F.array_distinct(F.transform(F.collect_set("source"), F.trim)))
    out = every.groupBy("cluster").agg(F.max_by(F.struct(*plain), rank).alias("row"), *dates, *texts, *(rows(c).alias(c) for c in kinds), sources.alias("sources"), F.count(F.lit(1)).alias("duplicate_count"))
    names = [d for d in ("publication_date", "first_seen_at", "last_seen_at", "description_text", "salary_text") if d in p.columns]
    return out.select("cluster", "row.*", *names, *(union(c).alias(c) for c in kinds), "sources", "duplicate_count")


def report(p: DataFrame, clustered: DataFrame | None = None) -> DataFrame:
    """Rows of clusters of two or more, the first row first, with a group number in the order of first rows."""
    clustered = clustered if clustered is not None else found(p)
    n = Window.partitionBy("cluster")
    several = clustered.withColumn("n", F.count(F.lit(1)).over(n)).filter("n > 1")
    number = several.select("cluster").distinct().withColumn("k", F.row_number().over(Window.orderBy("cluster")))  # over duplicates' groups only
    return p.join(several, "_ord").join(number, "cluster").select(F.format_string("cross-source-%05d", "k").alias("duplicate_group_id"), (F.col("_ord") == F.col("cluster")).alias("is_first"), F.col("n").alias("group_size"), "vacancy_id", "source", "company", "title").orderBy("duplicate_group_id", F.desc("is_first"), "source", "vacancy_id")


def share_removed(p: DataFrame, clustered: DataFrame) -> DataFrame:
    return clustered.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("cluster").alias("kept")).select("rows", "kept", rint(1 - F.col("kept") / F.col("rows")).alias("removed_share"))


def numbered(clustered: DataFrame) -> DataFrame:
    """All clusters, single rows too, numbered by their first row."""
    number = clustered.select("cluster").distinct().withColumn("number", F.row_number().over(Window.orderBy("cluster")))
    return clustered.join(number, "cluster").select("_ord", "cluster", "number", F.format_string("cluster-%05d", "number").alias("group_id"))
