"""The pipeline over a small folder, each stage against what was planted for it."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline

ITEM = "A farmer has 12 cows and gives 5 of them to Maria before he sells 12 more cows at the old market of the town."
ENGLISH = "the river house of morning light which carries stones to every open garden where people sing about their mother and father in summer".split()
GERMAN = "der fluss haus wenn zwischen schnell jung kurz wolke zwei quelle durch kuchen vogel fenster und nicht auch ich buch gelb im sommer".split()


def write(spark, folder, docs, labels):
    wide = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("grp", "shard", "rate", "keep", "t1", "a.b"):  # names that the operators use themselves, and one with a dot
        wide = wide.withColumn(c, F.lit("x"))
    wide.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_each_stage_catches_what_is_planted(spark, tmp_path):
    rng = random.Random(1)
    docs = []
    for k in range(200):
        lang = "en" if k % 2 else "de"
        t = " ".join(f"{w}{rng.choice(['', 'a', 'o', 'er'])}" for w in rng.choices(ENGLISH if k % 2 else GERMAN, k=60)).capitalize() + "."
        docs.append((k, t, lang, f"s{k % 3}", len(t)))
    docs += [(1000 + k, docs[3][1] + " more words", "en", "s0", 0) for k in range(5)] + [(2000, "4711 0815 12345 " * 30, None, "s1", 0), (2001, docs[5][1] + " " + ITEM, "en", "s1", 0), (2002, None, None, None, None), (None, docs[7][1] + " other end", "en", "s", 0)]
    alone = " ".join(rng.choices(ENGLISH, k=90))
    docs += [(3000, alone, "en", "s", 0)] * 2 + [(None, "the summer of " + " ".join(rng.choices(ENGLISH, k=70)), "en", "s", 0)] * 2 + [(3001, " ".join(f"{w}{k}" for k, w in enumerate(rng.choices(ENGLISH, k=30_000))), "en", "s", 0)]
    write(spark, tmp_path, docs, [(k, int(k % 3 > 0), int(k % 10 == 0)) for k in range(100)])
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    one = corpus_pipeline.saved(stages["language_id"](spark, d, str(tmp_path)), "t1")
    assert one.columns == d.columns and 2000 not in ids(one) and 2002 not in ids(one) and len(ids(one) & set(range(200))) >= 198
    two = stages["ngram_jaccard_join"](spark, d, str(tmp_path))
    assert ids(two) & {3, *range(1000, 1005)} == {3} and ids(two) >= set(range(200)) - {3}
    times = Counter(r.doc_id for r in two.collect())
    assert times[3000] == times[None] == times[3001] == 1 and two.columns == d.columns
    three = stages["benchmark_decontamination"](spark, d, str(tmp_path))
    assert ids(d) - ids(three) == {2001} and three.columns == d.columns
    four = stages["mixing"](spark, d, str(tmp_path))
    assert four.columns == d.columns and four.count() > 0
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert set(out[0].asDict()) == {*d.columns} and all(r.text for r in out)
    assert out and max(r.shard for r in out) < 16 and not {r.doc_id for r in out} & {2000, 2001, 2002}
    assert all(len({r.shard for r in out if r.doc_id == i}) == 1 for i, n in Counter(r.doc_id for r in out).items() if n > 1)


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "sharding"] and corpus_pipeline.ORACLE_SQL is None
