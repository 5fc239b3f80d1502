"""Tables that are kept between runs: upserts, seen state, new and first rows, keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key. Rows with a null in a key are all kept."""
    full = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.when(full, F.row_number().over(w)).otherwise(1)).filter("__n = 1").drop("__n")


def latest(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return keep_first(df, keys, [F.desc(c) if isinstance(c, str) else c for c in order])


def union_sources(frames: list[DataFrame], keys: tuple[str, ...] = ("source", "vacancy_id")) -> DataFrame:
    """Union by name, absent columns null; of rows with the same keys the one of the earlier source and row.
    A single input stays as it is."""
    if len(frames) == 1:
        return frames[0]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (f.withColumn("__source", F.lit(k)) for k, f in enumerate(frames)))
    order = ["__source", *(["_ord"] if "_ord" in every.columns else sorted(set(every.columns) - {*keys, "__source"}))]
    have = [k for k in keys if k in every.columns]
    return (keep_first(every, have, order) if have else every).drop("__source")


def upsert(old: DataFrame, new: DataFrame, key: str, once: tuple[str, ...] = (), fill: tuple[str, ...] = ()) -> DataFrame:
    """`new` over `old` by key, in one full outer join: columns in `once` never change, those in `fill` only where
    they were null, the rest is replaced. Rows of one side only stay or come in. To be written to a new
    directory, which then takes the old one's place."""
    o, n = old.alias("o"), new.alias("n")
    hit = F.col(f"n.{key}").isNotNull()
    out = []
    for c in old.columns:
        if c not in new.columns:
            out.append(F.col(f"o.{c}").alias(c))
        elif c == key or c in once or c in fill:
            out.append(F.coalesce(f"o.{c}", f"n.{c}").alias(c))
        else:
            out.append(F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
    out += [F.col(f"n.{c}").alias(c) for c in new.columns if c not in old.columns]
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*out)


def new_ids(batch: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return batch.filter(F.col(key).isNotNull()).dropDuplicates([key]).join(seen.select(key), key, "left_anti")


def seen_state(seen: DataFrame | None, batch: DataFrame, keys: list[str], at: str) -> DataFrame:
    """First and last time of each key, of the state so far and a batch: two aggregates over their union."""
    rows = batch.select(*keys, F.col(at).alias("first_seen"), F.col(at).alias("last_seen"))
    if seen is not None:
        rows = seen.select(*keys, "first_seen", "last_seen").unionByName(rows)
    return rows.groupBy(*keys).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def refresh_terms(old: DataFrame, new: DataFrame) -> DataFrame:
    """Terms of postings in `new` replace all that these postings had."""
    return old.join(new.select("vacancy_id").distinct(), "vacancy_id", "left_anti").unionByName(new)


def prefix_keys(df: DataFrame, key: str, prefix: str) -> DataFrame:
    """Ids without the prefix get it, unless the prefixed id is there: then the old row goes."""
    bare = ~F.col(key).startswith(prefix)
    there = df.filter(F.col(key).startswith(prefix)).select(F.col(key).alias("__there")).distinct()
    moved = df.filter(bare).withColumn("__new", F.concat(F.lit(prefix), F.col(key))).join(there, F.col("__new") == F.col("__there"), "left_anti").withColumn(key, F.col("__new")).drop("__new")
    return df.filter(~bare).unionByName(moved)


def hydrate(p: DataFrame, cache: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Details that a row lacks, from a cache of rows by key; the row's own values win."""
    c = cache.select(F.col(key), *(F.col(x).alias(f"__{x}") for x in columns))
    return p.join(c, key, "left").withColumns({x: F.coalesce(x, f"__{x}") for x in columns}).drop(*(f"__{x}" for x in columns))


def run_totals(runs: DataFrame, counters: list[str], by: str = "source") -> DataFrame:
    return runs.groupBy(by).agg(*(F.sum(c).alias(c) for c in counters))


def token_cost(p: DataFrame, column: str, price_in: float, price_out: float, out_tokens: int) -> DataFrame:
    """Records, tokens (4 characters each, rounded up) and price by price for a million tokens."""
    t = F.ceil(F.length(F.coalesce(column, F.lit(""))) / 4)
    row = p.agg(F.count(F.lit(1)).alias("records"), F.coalesce(F.sum(t), F.lit(0)).alias("input_tokens"))
    return row.withColumn("output_tokens", F.col("records") * out_tokens).withColumn("cost_usd", F.rint((F.col("input_tokens") * price_in + F.col("output_tokens") * price_out) / 1e6 * 1e6) / 1e6)


def llm_candidates(p: DataFrame, source: str | None = None, missing: bool = True, since: str | None = None, until: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows to analyse: of a source, without an analysis, first seen in a range of days; the newest first by publication, else first, else
    last sight, then by id."""
    out = p if source is None else p.filter(F.col("source") == source)
    if missing:
        out = out.filter(F.coalesce(F.trim("llm_analysis_json"), F.lit("")).isin("", "{}"))
    day = F.substring("first_seen_at", 1, 10)
    out = out if since is None else out.filter(day >= since)
    out = out if until is None else out.filter(day <= until)
    out = out.orderBy(F.coalesce("publication_date", "first_seen_at", "last_seen_at").desc_nulls_last(), "vacancy_id")
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def backfill_candidates(p: DataFrame, source: str, ids: list[str] | None = None) -> DataFrame:
    """Rows of a source that have a url and no salary at all; of these ids, if any are given."""
    bare = F.coalesce(*(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in ("salary_min", "salary_max", "salary_text"))).isNull()
    out = p.filter((F.col("source") == source) & (F.coalesce(F.trim("url"), F.lit("")) != "") & bare)
    return out if not ids else out.filter(F.col("vacancy_id").isin(ids))


def by_url(p: DataFrame, url: str) -> DataFrame:
    """The row last seen under any spelling of a url, with or without a slash at its end."""
    from urllib.parse import urlparse, urlunparse

    u = urlparse(url.strip())
    plain = u._replace(scheme=u.scheme.lower(), netloc=u.netloc.lower(), fragment="")
    names = sorted({x.rstrip("/") for x in (url.strip(), urlunparse(plain), urlunparse(plain._replace(query="")))})
    return p.filter(F.rtrim(F.col("url"), F.lit("/")).isin(names)).orderBy(F.desc("last_seen_at"), "vacancy_id").limit(1)


def recent(t: Column, now: Column, hours: int) -> Column:
    """Whether a time is at most so many hours ago; a null isn't."""
    return F.coalesce(t >= now - F.make_interval(hours=F.lit(hours)), F.lit(False))


def query_grid(terms: DataFrame, locations: DataFrame) -> DataFrame:
    """Every term with every location in their orders, numbered: a search plan of a few rows each, made on the driver."""
    a, b = ([r[0] for r in x.collect()] for x in (terms, locations))
    pairs = [(t, p, k + 1, len(a) * len(b)) for k, (t, p) in enumerate((t, p) for t in a for p in (b or [""]))]
    return terms.sparkSession.createDataFrame(pairs, "term string, location string, number int, total int")
