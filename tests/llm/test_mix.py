import os

import pytest
from pyspark.sql import functions as F

from estrado.llm import mix

pytestmark = pytest.mark.skipif(not os.path.exists(mix.VOCABULARY), reason="no vocabulary")
TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("nadie", 0.1, 5)]


def documents(spark, n=3000):
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, " A ").when(F.col("id") % 10 < 8, "b").when(F.col("id") % 10 < 9, "C").otherwise("otra").alias("source"), F.expr("repeat('palabra ', cast(1 + id % 50 as int))").alias("text"))
    return df.selectExpr("*", "1 as copies", "2 as h")


def targets(spark):
    return spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")


def test_shares_and_caps(spark):
    rows = {r.source: r for r in mix.shares(documents(spark), targets(spark)).collect()}
    present = {s: w / 1.0 for s, w, _ in TARGETS if s != "nadie"}
    for source, share in present.items():
        assert rows[source].actual_share == pytest.approx(share / sum(present.values()), abs=0.003)
        assert rows[source].most_copies <= rows[source].max_repeats
    assert rows["nadie"].used_tokens == 0
    assert any(r.used_tokens == r.held * r.max_repeats for r in rows.values())


def test_copies_differ_by_one_within_a_source_and_total_is_kept(spark):
    out = mix.mix(documents(spark), targets(spark), total=20_000)
    per = out.groupBy("source").agg((F.max("copies") - F.min("copies")).alias("d"))
    assert all(r.d <= 1 for r in per.collect())
    assert out.agg(F.sum(F.col("n_tokens") * F.col("copies"))).first()[0] == pytest.approx(20_000, abs=120)
    assert out.count() == out.select("doc_id").distinct().count()


def test_the_choice_is_the_same_at_any_partitioning(spark):
    one = {tuple(r) for r in mix.mix(documents(spark).repartition(7), targets(spark)).collect()}
    assert one == {tuple(r) for r in mix.mix(documents(spark).coalesce(1), targets(spark)).collect()}


def test_tokens_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", ""), (3, None, "hola"), (4, "a", "hola mundo"), (None, "a", "x"), (4, "a", "hola mundo")], "doc_id long, source string, text string")
    assert {r.n_tokens for r in mix.count_tokens(df).where("doc_id in (1, 2)").collect()} == {0}
    got = mix.mix(df, targets(spark)).collect()
    assert {r.doc_id for r in got} == {4} and len({r.copies for r in got}) == 1
    assert mix.mix(df.limit(0), targets(spark)).count() == 0 and mix.mix(df, targets(spark).limit(0)).count() == 0


def test_more_than_the_caps_allow_gives_all_they_allow(spark):
    rows = {r.source: r for r in mix.shares(documents(spark), targets(spark), total=10**9).collect()}
    assert all(r.used_tokens == r.held * r.max_repeats for r in rows.values())


def test_any_number_of_sources_is_planned_in_blocks(spark):
    docs = spark.range(900).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 30).alias("source"), F.expr("repeat('palabra ', cast(1 + id % 7 as int))").alias("text"))
    aims = spark.range(40).select(F.concat(F.lit("s"), F.col("id")).alias("source"), F.lit(0.025).alias("target_share"), (1 + F.col("id") % 3).cast("int").alias("max_repeats"))
    sized = mix._sized(docs, mix.VOCABULARY)
    one = sorted(map(tuple, mix.plan(sized, aims).collect()))
    assert len(one) == 40 and one == sorted(map(tuple, mix.plan(sized, aims, block=7).collect()))


def test_no_source_misses_its_share_by_more_than_a_document(spark):
    """Against the stated targets, on documents of very uneven sizes."""
    rows = spark.createDataFrame([(n, "abc"[n % 3], "palabra " * (1 + n * n % 900)) for n in range(600)], "doc_id long, source string, text string")
    out = mix.mix(rows, targets(spark), total=60_000)
    used = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("n")).collect()}
    largest = mix.count_tokens(rows).agg(F.max("n_tokens")).first()[0]
    for source, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(used[source] - 60_000 * share) <= largest / 2 + 1
