import random

import pytest
from pyspark.sql import functions as F

from estrado.operators import evaluate as E


def test_elo_like_a_loop(spark):
    r = random.Random(5)
    matches = [(g, n, *r.sample("abcd", 2), r.choice([0.0, 0.5, 1.0])) for g in (1, 2) for n in range(30)]
    want = {}
    for g, _, a, b, s in sorted(matches):
        ra, rb = want.get((g, a), 1500.0), want.get((g, b), 1500.0)
        ea = 1 / (1 + 10 ** ((rb - ra) / 400))
        want[g, a], want[g, b] = ra + 32 * (s - ea), rb + 32 * (1 - s - (1 - ea))
    r.shuffle(matches)
    df = spark.createDataFrame(matches, "g int, n int, player_a string, player_b string, result double")
    got = {(x.g, x.player): x.rating for x in E.leaderboard(E.elo(df, ["n"], ["g"]), "g").collect()}
    assert got == pytest.approx(want)


def test_ranks_and_best_question(spark):
    asked = spark.createDataFrame([(1, "d"), (2, "d"), (3, "e"), (4, "f")], "qid int, expected string")
    hits = spark.createDataFrame([(1, "x", 1), (1, "d", 2), (1, "d", 3), (2, "d", 4), (3, "x", 1)], "qid int, doc string, rank int")
    ranked = E.ranks(asked, hits)
    assert {r.qid: r["rank"] for r in ranked.collect()} == {1: 2, 2: 4, 3: 0, 4: 0}
    top = E.top_accuracy(ranked).first()
    assert (top.top1, top.top3, top.top5, top.mean_rank) == (0, 0.25, 0.5, 3)
    best = E.best_by_document(ranked).first()
    assert (best.documents, best.documents_with_hits, best.mean_best_rank) == (3, 1, 2)
    assert E.top_accuracy(ranked.where("qid > 2")).first().mean_rank == 0


def test_consistency(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 2, "x"), ("b", 1, "x"), ("c", 1, None), ("c", 2, None)]
    got = {r.case: r for r in E.consistency(spark.createDataFrame(rows, "case string, run int, item string"), "case", "run", "item").collect()}
    assert (got["a"].consistency, got["a"].common, got["a"].total, got["a"].variance) == (0.5, 1, 2, 0.25)
    assert got["b"].consistency == got["c"].consistency == 1.0 and got["b"].variance == 0


def test_likeness_of_answers(spark):
    df = spark.createDataFrame([(1, "ley uno", "ley uno"), (2, "ley uno", "otra cosa"), (3, "", "x y"), (4, None, "a")], "k int, a string, b string")
    got = {r.k: r.similarity for r in E.tfidf_cosine(df, "k", "a", "b").collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
    assert df.select(E.word_jaccard(F.lit("A b"), F.lit("b c"))).first()[0] == pytest.approx(0.333333)


def test_runs_judges_and_tournament(spark):
    a = spark.createDataFrame([("t1", 0.5), ("t2", 0.5), ("t3", 0.5), ("t4", 1.0)], "test string, accuracy double")
    b = spark.createDataFrame([("t1", 0.6), ("t2", 0.4), ("t3", 0.53)], "test string, accuracy double")
    assert {r.test: r.verdict for r in E.compare_runs(a, b, "test").collect()} == {"t1": "improved", "t2": "degraded", "t3": "stable"}
    said = spark.createDataFrame([(" a ",), ("B",), ("quizá",), (None,)], "s string").select(E.judged(F.col("s"))).collect()
    assert [r[0] for r in said] == ["A", "B", "EMPATE", "EMPATE"]
    pairs = E.pairings(spark.createDataFrame([("p",), ("q",), ("r",)], "player string"), spark.createDataFrame([(1,), (2,)], "qid int"))
    assert pairs.count() == 6
    matches = E.tournament(pairs, lambda p, q: F.when(p == "r", "Error 5").otherwise(p), lambda q, x, y: F.lit("A"))
    assert [(m.player_a, m.result) for m in matches.collect()] == [("p", 1.0), ("p", 1.0)]
    assert {r.player: (r.wins, r.losses) for r in E.tallies(matches).collect()} == {"p": (2, 0), "q": (0, 2)}
