"""Evaluation: set metrics, retrieval ranks, robustness, consistency, pairwise ratings."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estrado.functions import sets as S
from estrado.functions import text as T

ROBUST, SENSITIVE, CONSISTENT, CHANGED = 0.7, 0.3, 0.8, 0.05
START, GAIN = 1500.0, 32.0
#: Words without weight in the likeness of two answers; a short list of our own, fixed values.
STOPWORDS = ("the", "of", "and", "to", "in", "is", "that", "it", "for", "on", "with", "as", "by", "at", "from", "an", "be", "this", "or", "are")


def mean_metrics(rows: DataFrame) -> DataFrame:
    """Means over files of precision, recall and F1, and the share of exact matches."""
    return rows.agg(F.count("*").alias("files"), *[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("precision", "recall", "f1")], F.round(F.avg("accuracy"), 6).alias("accuracy"))


def robustness(rows: DataFrame, similarity: str = "similarity") -> DataFrame:
    """Mean similarity, and how many pairs reach 0.7."""
    ok = F.count_if(F.col(similarity) >= ROBUST)
    return rows.agg(F.count("*").alias("pairs"), F.round(F.avg(similarity), 6).alias("mean_similarity"), ok.alias("robust"), F.round(S.ratio(ok, F.count("*")), 6).alias("robust_rate"))


def sensitivity(rows: DataFrame, similarity: str = "similarity") -> DataFrame:
    """Mean dissimilarity, and how many pairs differ by 0.3 or more."""
    far = 1 - F.col(similarity)
    yes = F.count_if(far >= SENSITIVE)
    return rows.agg(F.count("*").alias("pairs"), F.round(F.avg(far), 6).alias("mean_dissimilarity"), yes.alias("sensitive"), F.round(S.ratio(yes, F.count("*")), 6).alias("sensitive_rate"))


def content_changed(original: Column, modified: Column, kept_citations: Column) -> Column:
    """Another length and text with more than 0.7 of the citations kept."""
    return (F.length(original) != F.length(modified)) & (original != modified) & (kept_citations > ROBUST)


def ranks(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """``questions`` (qid, expected, ...) with ``rank`` of the first hit on the expected document, 0 if there is none."""
    first = hits.groupBy("qid", F.col("doc").alias("expected")).agg(F.min("rank").alias("rank"))
    return questions.join(first, ["qid", "expected"], "left").withColumn("rank", F.coalesce("rank", F.lit(0)))


def _top(k: int) -> Column:
    return F.round(F.avg(F.col("rank").between(1, k).cast("double")), 6).alias(f"top{k}")


def top_accuracy(ranked: DataFrame, *by: str) -> DataFrame:
    """Shares of questions with the expected document among the first 1, 3, 5, and the mean rank of those found."""
    found = F.when(F.col("rank") > 0, F.col("rank"))
    return ranked.groupBy(*by).agg(F.count("*").alias("questions"), _top(1), _top(3), _top(5), F.round(F.coalesce(F.avg(found), F.lit(0.0)), 6).alias("mean_rank"))


def best_by_document(ranked: DataFrame) -> DataFrame:
    """Each document by its best question: shares of documents found among the first 1, 3, 5, and the mean best rank."""
    docs = ranked.groupBy("expected").agg(F.coalesce(F.min(F.when(F.col("rank") > 0, F.col("rank"))), F.lit(0)).alias("rank"))
    hit = F.count_if(F.col("rank") > 0)
    return docs.agg(F.count("*").alias("documents"), _top(1), _top(3), _top(5), hit.alias("documents_with_hits"), F.round(S.ratio(F.sum("rank"), F.greatest(hit, F.lit(1))), 6).alias("mean_best_rank"))


def summary_by_type(ranked: DataFrame, kind: str) -> DataFrame:
    """Accuracy of every type and of all in one pass."""
    found = F.when(F.col("rank") > 0, F.col("rank"))
    rolled = ranked.groupingSets([[kind], []], kind).agg(F.grouping_id().alias("g"), F.count("*").alias("questions"), _top(1), _top(3), _top(5), F.round(F.coalesce(F.avg(found), F.lit(0.0)), 6).alias("mean_rank"))
    return rolled.select(F.when(F.col("g") == 1, "(all)").otherwise(F.col(kind)).alias("kind"), "questions", "top1", "top3", "top5", "mean_rank")


def consistency(responses: DataFrame, case: str, run: str, item: str) -> DataFrame:
    """(case, runs, common, total, consistency, variance, mean_count) of the item sets of a case's runs.

    A run without items is a row with a null item; fewer than two runs, or nothing returned at all, are consistent.
    """
    runs = responses.groupBy(case, run).agg(F.countDistinct(item).alias("n"))
    size = runs.groupBy(case).agg(F.count("*").alias("runs"), F.round(F.var_pop("n"), 6).alias("variance"), F.round(F.avg("n"), 6).alias("mean_count"))
    held = responses.where(F.col(item).isNotNull()).groupBy(case, item).agg(F.countDistinct(run).alias("in_runs"))
    both = size.join(held, case, "left").groupBy(case, "runs", "variance", "mean_count").agg(F.count_if(F.col("in_runs") == F.col("runs")).alias("common"), F.count("in_runs").alias("total"))
    score = F.when((F.col("runs") < 2) | (F.col("total") == 0), 1.0).otherwise(S.ratio(F.col("common"), F.col("total")))
    return both.select(case, "runs", "common", "total", F.round(score, 6).alias("consistency"), F.when(F.col("runs") < 2, 0.0).otherwise(F.col("variance")).alias("variance"), "mean_count")


def tfidf_cosine(pairs: DataFrame, key: str, a: str, b: str, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """(key, similarity): TF-IDF cosine over the two texts as the whole corpus, words of two or more letters or digits.

    Smooth idf ln(3 / (1 + df)) + 1. A text that is null, or has no words left, gives 0. ``stopwords`` takes the place of
    the library's own list, which is too long to be stated here: pass it for scores that equal the library's. A pair's
    words never leave its row.
    """
    words = lambda c: F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(*stopwords))

    @F.pandas_udf("double")
    def cosine(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_tfidf(p, q) for p, q in zip(x, y)], dtype="float64")

    return pairs.select(key, F.round(cosine(words(F.col(a)), words(F.col(b))), 6).alias("similarity"))


def _tfidf(x: Iterable[str] | None, y: Iterable[str] | None) -> float:
    if x is None or y is None:
        return 0.0
    p, q = Counter(x), Counter(y)
    both, alone = math.log(3 / 3) + 1, math.log(3 / 2) + 1
    weigh = lambda c, other: {w: n * (both if w in other else alone) for w, n in c.items()}
    u, v = weigh(p, q), weigh(q, p)
    size = math.sqrt(sum(n * n for n in u.values())) * math.sqrt(sum(n * n for n in v.values()))
    return sum(n * v[w] for w, n in u.items() if w in v) / size if size else 0.0


def word_jaccard(a: Column, b: Column) -> Column:
    """Likeness of two texts by their small-lettered words."""
    return F.round(S.jaccard(T.tokens(F.lower(a)), T.tokens(F.lower(b))), 6)


def judged(reply: Column) -> Column:
    """A judge's reply as A, B or EMPATE; anything else is a draw."""
    said = F.upper(T.strip(reply))
    return F.when(said.isin("A", "B", "EMPATE"), said).otherwise("EMPATE")


def pairings(players: DataFrame, questions: DataFrame, player: str = "player") -> DataFrame:
    """(player_a, player_b, qid): every pair of the few configurations under test on every question."""
    a, b = players.select(F.col(player).alias("player_a")), players.select(F.col(player).alias("player_b"))
    return a.join(b, F.col("player_a") < F.col("player_b")).crossJoin(questions.select("qid"))


def expected_score(a: Column, b: Column) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), (b - a) / 400))


def elo(matches: DataFrame, order: list[str], group: list[str] | None = None, k: float = GAIN, start: float = START) -> DataFrame:
    """(group..., match_no, player_a, player_b, result, before and after of both): the ordered fold of ratings.

    ``matches`` has (player_a, player_b, result) with result 1, 0.5 or 0 for player_a. Each match depends on the one
    before, so a group is one task; ratings of independent groups run in parallel.
    """
    keys = group or []
    kept = [*keys, *order, "player_a", "player_b", "result"]

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        rating: dict[str, float] = {}
        out = []
        for n, row in enumerate(part.sort_values(order, kind="stable").itertuples(index=False), 1):
            a, b = rating.get(row.player_a, start), rating.get(row.player_b, start)
            won = 1 / (1 + 10 ** ((b - a) / 400))
            rating[row.player_a] = a + k * (row.result - won)
            rating[row.player_b] = rating.get(row.player_b, start) if row.player_a == row.player_b else b + k * ((1 - row.result) - (1 / (1 + 10 ** ((a - b) / 400))))
            out.append((*[getattr(row, g) for g in keys], n, row.player_a, row.player_b, row.result, a, b, rating[row.player_a], rating[row.player_b]))
        return pd.DataFrame(out, columns=[*keys, "match_no", "player_a", "player_b", "result", "a_before", "b_before", "a_after", "b_after"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in matches.schema.fields if f.name in keys), "match_no int, player_a string, player_b string, result double, a_before double, b_before double, a_after double, b_after double"])
    return matches.select(*kept).groupBy(*keys).applyInPandas(fold, ddl)


def leaderboard(history: DataFrame, *group: str) -> DataFrame:
    """(group..., player, rating, place) after the last match."""
    sides = history.select(*group, F.explode(F.array(F.struct(F.col("player_a").alias("player"), F.col("a_after").alias("rating"), "match_no"), F.struct(F.col("player_b").alias("player"), F.col("b_after").alias("rating"), "match_no"))).alias("s"))
    last = sides.groupBy(*group, F.col("s.player").alias("player")).agg(F.max_by("s.rating", "s.match_no").alias("rating"))
    return last.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("rating").desc(), "player")))


def tallies(matches: DataFrame) -> DataFrame:
    """(player, matches, wins, losses, ties, win_rate)."""
    a = matches.select(F.col("player_a").alias("player"), F.col("result").alias("r"))
    b = matches.select(F.col("player_b").alias("player"), (1 - F.col("result")).alias("r"))
    n = F.count("*")
    wins = F.count_if(F.col("r") == 1)
    return a.unionByName(b).groupBy("player").agg(n.alias("matches"), wins.alias("wins"), F.count_if(F.col("r") == 0).alias("losses"), F.count_if(F.col("r") == 0.5).alias("ties"), F.round(S.ratio(wins, n), 6).alias("win_rate"))


def compare_runs(first: DataFrame, second: DataFrame, key: str, value: str = "accuracy") -> DataFrame:
    """(key, diff, verdict): better or worse by more than 0.05, else stable; tests of both runs only."""
    diff = F.col("b") - F.col("a")
    both = first.select(key, F.col(value).alias("a")).join(second.select(key, F.col(value).alias("b")), key)
    return both.select(key, F.round(diff, 6).alias("diff"), F.when(diff > CHANGED, "improved").when(diff < -CHANGED, "degraded").otherwise("stable").alias("verdict"))


def tournament(pairs: DataFrame, answer: Callable[[Column, Column], Column], judge: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """``pairs`` (player_a, player_b, qid) as matches; pairs of which an answer holds an error message are left out."""
    rows = pairs.withColumns({"_a": answer(F.col("player_a"), F.col("qid")), "_b": answer(F.col("player_b"), F.col("qid"))})
    rows = rows.where(~F.contains("_a", F.lit("Error")) & ~F.contains("_b", F.lit("Error")))
    verdict = judged(judge(F.col("qid"), F.col("_a"), F.col("_b")))
    return rows.select("player_a", "player_b", "qid", F.when(verdict == "A", 1.0).when(verdict == "B", 0.0).otherwise(0.5).alias("result"))
