import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from estrado.operators import answers, search

DOCS = {1: "la ley y la demanda", 2: "Ley suprema", 3: "demanda demanda costas", 4: "", 5: "nada que ver"}


def index(spark):
    return search.lexical_index(spark.createDataFrame([*DOCS.items(), (6, None)], "id int, text string"), "id", "text")


def expected(question):
    docs = {k: Counter(t.split()) for k, t in DOCS.items()}
    n, avg = len(docs), sum(sum(c.values()) for c in docs.values()) / len(docs)
    df = Counter(w for c in docs.values() for w in c)
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in raw.items()}
    return {k: round(sum(idf.get(w, 0) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg)) for w in question.lower().split()), 6) for k, c in docs.items()}


def test_bm25_like_the_formula_with_zero_scores_filled(spark):
    asked = spark.createDataFrame([(1, "La demanda demanda LEY")], "qid int, question string")
    rows = search.lexical_top(index(spark), search.question_terms(asked), 10).collect()
    assert {r.key: r.score for r in rows} == pytest.approx(expected("la demanda demanda ley"))
    assert [r.key for r in sorted(rows, key=lambda r: r["rank"])] == sorted(DOCS, key=lambda k: (-expected("la demanda demanda ley")[k], k))


def test_only_the_question_is_lowered(spark):
    asked = spark.createDataFrame([(1, "SUPREMA LEY")], "qid int, question string")
    hits = {r.key for r in search.bm25(index(spark), search.question_terms(asked)).collect()}
    assert hits == {1, 2}  # 2 by its small-lettered word only


@pytest.mark.parametrize("block", [3, 4096])
def test_nearest_points_like_all_pairs(spark, block):
    r = random.Random(2)
    rows = [(n, [r.gauss(0, 1) for _ in range(8)]) for n in range(60)]
    rows += [(100, rows[3][1]), (101, [0.0] * 8), (102, None), (None, rows[0][1])]
    points = spark.createDataFrame(rows, "key long, embedding array<double>")
    asked = points.where("key % 7 = 0").withColumnRenamed("key", "qid")
    some = points.where("key is not null and embedding is not null")
    want = search.best(search.dense(asked, some), 5).select("qid", "key", "score", "rank")
    got = search.dense_top(asked, points, 5, block=block).select("qid", "key", "score", "rank")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert search.dense_top(asked, points.limit(0), 5).count() == 0 and search.dense_top(asked.limit(0), points, 5).count() == 0


def test_fusion_weights(spark):
    d = spark.createDataFrame([(1, 10, 0.5), (1, 11, 0.4)], "qid int, key int, score double")
    x = spark.createDataFrame([(1, 11, 2.0), (1, 12, 3.0)], "qid int, key int, score double")
    assert {r.key: r.score for r in search.fuse(d, x).collect()} == {10: 0.5, 11: 1.4, 12: 4.5}


def test_boost_counts_substrings_and_each_article(spark):
    schema = "q string, c array<struct<main_source:string,cited_articles:array<int>>>, m string, i string"
    rows = [("Ley de 2023", [("CPC", [3, 7])], "", ""), ("según cpc", [("CPC", [3, 7])], "", ""), ("daños", [(None, [9])], "Daños", "sobre daños"), ("x", None, None, None), ("x", [("A", None)], "", "")]
    got = spark.createDataFrame(rows, schema).select(search.boost(F.col("q"), F.col("c"), F.col("m"), F.col("i"))).collect()
    assert [r[0] for r in got] == pytest.approx([0.3, 0.6, 0.6, 0.0, 0.0])


def test_rerank_and_build(spark):
    docs = spark.createDataFrame([(1, "costas del juicio"), (2, "daños y perjuicios")], "key int, text string")
    built = search.build_indexes(docs, "key", "text")
    asked = spark.createDataFrame([(7, "daños")], "qid int, question string").join(built["points"].where("key = 2").select("embedding"), how="cross")
    rescored = lambda f: f.join(docs, "key").select("qid", "key", search.overlap_rerank(F.lit("daños"), F.col("text")).alias("score"))
    top = search.hybrid(asked, built["points"], built, 1, rerank=rescored).first()
    assert (top.key, top.score) == (2, 1.0)


def test_indexes_survive_on_disk(spark, tmp_path):
    built = index(spark) | {"points": spark.range(1).select(F.col("id").alias("key"))}
    search.save_indexes(built, str(tmp_path))
    again = search.load_indexes(spark, str(tmp_path))
    assert {n: t.count() for n, t in again.items()} == {n: t.count() for n, t in built.items()}
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        search.load_indexes(spark, str(tmp_path / "none"))["terms"].count()


HIT = "qid int, rank int, expediente string, section string, paragraph string, path string, score double, idea_central string, materia_preliminar string, articulos_citados array<struct<main_source:string,cited_articles:array<int>>>"


def test_groups_keep_first_seen_order(spark):
    hits = spark.createDataFrame([(1, 2, "B", "S2", "y" * 301, "p2", 2.0, "otra", "M", [("L", [2]), ("L", [1])]), (1, 1, "B", "S1", " x\ny ", "p1", 3.0, "idea", "M", [("L", [1])]), (1, 3, None, None, None, None, None, None, None, None)], HIT)
    groups = {r.expte: r for r in answers.group_hits(hits).collect()}
    assert groups["B"].idea_central == "idea" and [tuple(a.cited_articles) for a in groups["B"].articulos_citados] == [(1,), (2,)]
    context = answers.context_grouped(answers.group_hits(hits)).first().context
    assert context.startswith("===== FALLO B =====\nGENERAL: Materia: M; Artículos: L 1, L 2; Idea: idea\nDETALLE §S1: x y\nDETALLE §S2: " + "y" * 300 + "…\n")
    flat = answers.flatten_hits(answers.group_hits(hits)).where("expte = 'N/A'").first()
    assert (flat.section, flat.paragraph, flat.score) == ("", "", 0.0)


def test_summaries_conversations_requests(spark):
    md = spark.createDataFrame([(1, "[12] «a» [12]  «b » [x/3] «c»")], "k int, md string")
    assert [tuple(r) for r in answers.summaries(md, "k", "md").collect()] == [(1, "12", "b")]
    turns = spark.createDataFrame([(1, n, f"q{n}", "r" * 120) for n in range(1, 8)], "c int, t int, q string, a string")
    assert [r.t for r in answers.last_turns(turns, "c", "t").orderBy("turn_no").collect()] == [3, 4, 5, 6, 7]
    assert answers.history(turns, "c", "t", "q", "a").first().context.startswith("Pregunta 1: q3\nRespuesta 1: " + "r" * 100 + "...")
    asks = spark.createDataFrame([("  ab ", 5), ("abc", 21), ("abc", 1), (None, 1), ("x" * 501, 1)], "question string, top_n int")
    assert [r.reason for r in answers.valid_requests(asks).collect()] == ["too short", "top_n", None, "too short", "too long"]


def test_top_by_words_and_by_postings(spark, tmp_path):
    r = random.Random(4)
    rows = [(n, " ".join(r.choice("abcdefghij") for _ in range(r.randint(0, 30)))) for n in range(80)]
    built = search.lexical_index(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    asked = search.question_terms(spark.createDataFrame([(q, " ".join(r.choice("abcxyz") for _ in range(3))) for q in range(9)], "qid long, question string"))
    want = sorted(map(tuple, search.best(search.bm25(built, asked), 6).select("qid", "key", "score", "rank").collect()))
    for block in (4096, 2):
        assert sorted(map(tuple, search.bm25_top(built, asked, 6, block).select("qid", "key", "score", "rank").collect())) == want
    search.save_indexes(built, str(tmp_path))
    loaded = search.load_indexes(spark, str(tmp_path), ("postings", "lengths", "corpus", "terms"))
    top = lambda i: sorted(map(tuple, search.lexical_top(i, asked, 6).select("qid", "key", "score", "rank").collect()))
    assert top(loaded) == top(built) and search.tokenizer_of(loaded) == "raw"


def test_questions_are_cut_as_the_index_was(spark, monkeypatch):
    monkeypatch.setattr(search, "LARGE", 3)
    rows = spark.createDataFrame([(n, "Demanda ordinaria") for n in range(5)], "key long, text string")
    index = search.build_indexes(rows, "key", "text")
    assert search.tokenizer_of(index) == "normalized"
    asked = spark.createDataFrame([(1, "y DEMANDA")], "qid long, question string").withColumn("embedding", search.embed(F.col("question"), query=True))
    assert search.hybrid(asked, index["points"], index).where("in_lexical").count() == 5
    assert search.question_terms(asked, tokenizer="normalized").count() == 1


def test_nearest_by_distance_like_all_pairs(spark):
    from estrado.functions import vectors as V

    r = random.Random(6)
    points = spark.createDataFrame([(n, [r.gauss(0, 1) for _ in range(4)]) for n in range(50)], "key long, embedding array<double>")
    asked = points.where("key % 9 = 0").withColumnRenamed("key", "qid")
    want = search.best(search.dense(asked, points, measure=V.euclidean), 5, ascending=True)
    cols = ["qid", "key", "score", "rank"]
    assert sorted(map(tuple, search.nearest(asked, points.repartition(7)).select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


def test_upsert_replaces_and_adds(spark, tmp_path):
    path = f"{tmp_path}/points"
    frame = lambda rows: spark.createDataFrame(rows, "key long, v string")
    search.upsert(spark, path, frame([(1, "a"), (2, "b"), (None, "x")]))
    search.upsert(spark, path, frame([(2, "c"), (3, "d"), (3, "d")]))
    search.upsert(spark, path, frame([]))
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_question_prefix(spark):
    seen = spark.createDataFrame([(" hola ",), (None,)], "t string")
    same = lambda c: c
    assert [r[0] for r in seen.select(search.embed(F.col("t"), same, query=True)).collect()] == [search.QUERY_PREFIX + " hola ", None]
    assert [r[0] for r in seen.select(search.embed(F.col("t"), same)).collect()] == ["hola", None]
