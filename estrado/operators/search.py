"""Lexical, dense and hybrid retrieval for batches of questions. Indexes are ordinary tables."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estrado.functions import text as T
from estrado.functions import vectors as V
from estrado.plans.scratch import materialize

#: Usual constants of BM25 (Okapi): saturation, length, and the share of the mean idf that replaces a negative one.
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Corpus size from which the tokenizer ``auto`` normalises.
LARGE = 50_000
K_DENSE, K_LEX = 30, 30


class Index(dict[str, DataFrame]):
    """The tables of an index and, while it is not stored, the documents' words (key, words, dl) that they come from."""

    words: DataFrame | None = None

    def __or__(self, more: dict[str, DataFrame]) -> Index:
        out = Index(super().__or__(more))
        out.words = self.words
        return out


def lexical_index(documents: DataFrame, key: str, text: str, tokenizer: str = "raw") -> Index:
    """Tables ``postings`` (key, term, tf, dl), ``lengths`` (key, dl), ``corpus`` (n, avgdl, tokenizer) and ``terms`` (term, df, idf).

    Null texts are left out, empty ones have length 0. One pass counts documents, lengths and terms at once, combined on the
    map side; a document's postings are only built where they are asked for. The tokenizer in use stands in ``corpus``.
    """
    rows = documents.where(F.col(text).isNotNull())
    if tokenizer == "auto":
        tokenizer = "normalized" if rows.limit(LARGE + 1).count() > LARGE else "raw"
    words = rows.select(F.col(key).alias("key"), T.tokens(F.col(text), tokenizer).alias("words")).withColumn("dl", F.size("words"))
    # No word is empty, so the empty one stands for the document itself.
    seen = words.select("dl", F.explode(F.concat(F.array(F.lit("")), F.array_distinct("words"))).alias("term"))
    seen = materialize(seen.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("dl"))).alias("length")))
    corpus = seen.where("term = ''").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"), F.sum("length").alias("length"))
    corpus = corpus.select("n", F.try_divide("length", "n").alias("avgdl"), F.lit(tokenizer).alias("tokenizer"))
    df = seen.where("term <> ''").select("term", "df")
    idf = df.crossJoin(F.broadcast(corpus)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))  # corpus: one row
    mean = idf.agg(F.avg("raw").alias("mean"))
    terms = idf.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))  # mean: one row
    postings = words.select("key", "dl", F.explode("words").alias("term")).groupBy("key", "dl", "term").agg(F.count("*").alias("tf"))
    index = Index(postings=postings.select("key", "term", "tf", "dl"), lengths=words.select("key", "dl"), corpus=corpus, terms=terms)
    index.words = words
    return index


def tokenizer_of(index: dict[str, DataFrame]) -> str:
    """The tokenizer an index was built with; questions are cut by the same."""
    return index["corpus"].first()["tokenizer"]


def question_terms(questions: DataFrame, question: str = "question", tokenizer: str = "raw") -> DataFrame:
    """(qid, term, times) of the small-lettered questions."""
    return questions.select("qid", F.explode(T.tokens(F.lower(question), tokenizer)).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))


def _weights(index: dict[str, DataFrame], asked: DataFrame) -> DataFrame:
    return asked.join(index["terms"], "term").select("qid", "term", (F.col("times") * F.col("idf")).alias("w"))


def bm25(index: dict[str, DataFrame], asked: DataFrame) -> DataFrame:
    """(qid, key, score) of all documents with a word of the question; only postings of asked words are read on."""
    hits = index["postings"].join(_weights(index, asked), "term").crossJoin(F.broadcast(index["corpus"]))  # corpus: one row
    part = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("qid", "key").agg(F.round(F.sum(part), 6).alias("score"))


def bm25_top(index: Index, asked: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(qid, key, score, rank): the k best of ``bm25``, from the documents' words in one pass.

    The stated questions go to the tasks in blocks of bounded size; a task scores each document once for all of them and
    passes on k rows a question, so no row per question and document is ever made.
    """
    qids = asked.select("qid").distinct()
    count = max(1, -(-qids.count() // block))
    avgdl = index["corpus"].first()["avgdl"]
    found = []
    for n in range(count):  # about block questions each, one after the other
        part = asked.where(F.pmod(F.xxhash64("qid"), F.lit(count)) == n) if count > 1 else asked
        weights: dict[str, list[tuple[Any, float]]] = {}
        for r in _weights(index, part).collect():
            weights.setdefault(r["term"], []).append((r["qid"], r["w"]))
        found.append(index.words.select(F.col("key").cast("long"), "words").mapInArrow(_bm25_of(weights, avgdl, k), _SCORED))
    return best(functools.reduce(DataFrame.unionByName, found), k)


def _bm25_of(weights: dict[str, list[tuple[Any, float]]], avgdl: float | None, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import heapq

        top: dict[Any, list[tuple[float, int]]] = {}
        for batch in batches:
            for key, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = words.as_py()
                tf: dict[str, int] = {}
                for w in own:
                    if w in weights:
                        tf[w] = tf.get(w, 0) + 1
                scores: dict[Any, float] = {}
                base = K1 * (1 - B + B * len(own) / avgdl) if tf else 0.0
                for w, n in tf.items():
                    gain = n * (K1 + 1) / (n + base)
                    for qid, weight in weights[w]:
                        scores[qid] = scores.get(qid, 0.0) + weight * gain
                for qid, score in scores.items():
                    held, one = top.setdefault(qid, []), (round(score, 6), -key)
                    if len(held) < k:
                        heapq.heappush(held, one)
                    elif one > held[0]:
                        heapq.heapreplace(held, one)
        rows = [(qid, -key, score) for qid, held in top.items() for score, key in held]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64()))], names=["qid", "key", "score"])

    return run


def best(scored: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    """The k best of each question with their rank; ties go to the smaller key."""
    score = F.col("score").asc() if ascending else F.col("score").desc()
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(score, "key"))).where(F.col("rank") <= k)


def lexical_top(index: dict[str, DataFrame], asked: DataFrame, k: int = K_LEX) -> DataFrame:
    """(qid, key, score, rank); documents without any word of the question follow with score 0, smaller keys first."""
    scored = materialize((bm25_top(index, asked, k) if getattr(index, "words", None) is not None else best(bm25(index, asked), k)).select("qid", "key", "score"))
    # Negative scores come after the zeros. Of the first 2k keys at least k are without a word wherever fewer than k have one.
    fill = asked.select("qid").distinct().crossJoin(F.broadcast(index["lengths"].select("key").orderBy("key").limit(2 * k)))
    rest = fill.join(scored, ["qid", "key"], "left_anti").withColumn("score", F.lit(0.0))
    return best(scored.unionByName(rest), k)


def _doubles(column: str) -> Column:
    return F.col(column).cast("array<double>")


def dense(questions: DataFrame, points: DataFrame, vector: str = "embedding", measure: Callable[[Column, Column], Column] = V.cosine) -> DataFrame:
    """(qid, key, score) of every question against every point. A stated question set is compared with all points."""
    asked = questions.select("qid", _doubles(vector).alias("q"))
    return points.select("key", _doubles(vector).alias("p")).crossJoin(asked).select("qid", "key", F.round(measure(F.col("q"), F.col("p")), 6).alias("score"))


#: Most questions whose vectors travel to the tasks at once.
BLOCK = 4096


def dense_top(questions: DataFrame, points: DataFrame, k: int = K_DENSE, vector: str = "embedding", block: int = BLOCK, measure: str = "cosine") -> DataFrame:
    """(qid, key, score, rank) of the k nearest points by cosine (or ``euclidean``, lower first), exact; ties go to the smaller key.

    The stated questions go to the tasks in blocks of bounded size; a task multiplies them with each batch of points and
    passes on k rows a question, so no row per pair is ever made. Null vectors and null keys are left out.
    """
    if measure not in ("cosine", "euclidean"):
        raise ValueError(f"measure {measure!r} is none of cosine, euclidean")
    asked = questions.where(F.col(vector).isNotNull() & F.col("qid").isNotNull()).select(F.col("qid").cast("long").alias("qid"), _doubles(vector).alias("v"))
    some = asked.limit(block + 1).collect()  # at most block + 1 questions
    rows = points.where(F.col("key").isNotNull() & F.col(vector).isNotNull()).select(F.col("key").cast("long").alias("key"), _doubles(vector).alias("v"))
    down = measure == "euclidean"
    if len(some) <= block:
        return best(rows.mapInArrow(_nearest_of(some, k, down), _SCORED), k, down)
    count = -(-asked.count() // block)
    parts = [asked.where(F.pmod(F.xxhash64("qid"), F.lit(count)) == n).collect() for n in range(count)]  # about block questions each, one after the other
    found = [rows.mapInArrow(_nearest_of(part, k, down), _SCORED) for part in parts if part]
    return best(functools.reduce(DataFrame.unionByName, found), k, down)


_SCORED = "qid bigint, key bigint, score double"


def _nearest_of(asked: list[Any], k: int, euclidean: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    qids = [r["qid"] for r in asked]
    vectors = [r["v"] for r in asked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        if not qids:
            return
        q = np.array(vectors, float)
        q_norm = np.sqrt((q * q).sum(1))
        held_keys, held = np.empty((len(qids), 0), np.int64), np.empty((len(qids), 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            p = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            if euclidean:
                scores = np.stack([np.sqrt(((p - v) ** 2).sum(1)) for v in q])
            else:
                size = q_norm[:, None] * np.sqrt((p * p).sum(1))[None, :]
                scores = np.divide(q @ p.T, size, out=np.zeros_like(size), where=size > 0)
            scores = np.concatenate([held, np.round(scores, 6)], 1)
            every = np.concatenate([held_keys, np.broadcast_to(keys, (len(qids), len(keys)))], 1)
            order = np.lexsort((every, scores if euclidean else -scores), axis=1)[:, :k]
            held, held_keys = np.take_along_axis(scores, order, 1), np.take_along_axis(every, order, 1)
        if held.size:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qids, held.shape[1]), pa.int64()), pa.array(held_keys.ravel(), pa.int64()), pa.array(held.ravel())], names=["qid", "key", "score"])

    return run


def nearest(questions: DataFrame, points: DataFrame, k: int = 5, vector: str = "embedding") -> DataFrame:
    """(qid, key, score, rank) by Euclidean distance, lower first."""
    return dense_top(questions, points, k, vector, measure="euclidean")


def fuse(dense_hits: DataFrame, lexical_hits: DataFrame) -> DataFrame:
    """(qid, key, score, in_dense, in_lexical): a dense hit keeps its score and gains half the lexical one; a lexical hit
    alone counts one and a half times."""
    d = dense_hits.select("qid", "key", F.col("score").alias("d"))
    x = lexical_hits.select("qid", "key", F.col("score").alias("x"))
    score = F.coalesce(F.col("d"), F.col("x")) + F.coalesce(F.col("x") * 0.5, F.lit(0.0))
    return d.join(x, ["qid", "key"], "full").select("qid", "key", score.alias("score"), F.col("d").isNotNull().alias("in_dense"), F.col("x").isNotNull().alias("in_lexical"))


def boost(question: Column, citations: Column, subject: Column, idea: Column) -> Column:
    """What a hit gains by its metadata: 0.3 for each cited article when its number or source stands in the question
    (sources of empty name always do), 0.1 for its subject, 0.2 when the idea holds a word of the question."""
    q = F.lower(question)
    one = lambda c: F.size(F.filter(F.coalesce(c["cited_articles"], F.array().cast("array<int>")), lambda a: F.contains(q, a.cast("string")) | F.contains(q, F.lower(F.coalesce(c["main_source"], F.lit(""))))))
    cited = F.aggregate(F.coalesce(citations, F.array()), F.lit(0), lambda s, c: s + one(c)) * 0.3
    about = F.when(F.contains(q, F.lower(subject)) & (subject != ""), 0.1).otherwise(0.0)
    words = F.when((idea != "") & F.exists(T.tokens(q), lambda w: F.contains(F.lower(idea), w)), 0.2).otherwise(0.0)
    return F.round(cited + about + words, 6)


def overlap_rerank(question: Column, text: Column, size: int = 500) -> Column:
    """The local reranker: share of the question's distinct words among the first ``size`` characters of a passage."""
    q = F.array_distinct(T.tokens(F.lower(question)))
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(q, T.tokens(F.lower(F.left(text, F.lit(size)))))), F.size(q)), F.lit(0.0)), 6)


def hybrid(questions: DataFrame, points: DataFrame, index: dict[str, DataFrame], top_n: int = 8, vector: str = "embedding", k_dense: int = K_DENSE, k_lex: int = K_LEX, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(qid, key, score, ..., rank): dense and lexical candidates fused, optionally rescored, best ``top_n`` a question."""
    fused = fuse(dense_top(questions, points, k_dense, vector), lexical_top(index, question_terms(questions, tokenizer=tokenizer_of(index)), k_lex))
    return best(rerank(fused) if rerank else fused, top_n)


def build_indexes(paragraphs: DataFrame, key: str, text: str, encode: Callable[[Column], Column] | None = None, tokenizer: str = "auto") -> dict[str, DataFrame]:
    """The lexical tables and ``points`` (key, embedding); without an encoder, hashed term counts are the vectors.

    The tokenizer ``auto`` is settled here by the corpus' size and kept in the index, so that questions are cut alike.
    """
    encode = encode or (lambda c: V.hashed(T.tokens(c, "normalized")))
    return lexical_index(paragraphs, key, text, tokenizer) | {"points": paragraphs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), encode(F.col(text)).alias("embedding"))}


def save_indexes(index: dict[str, DataFrame], path: str) -> None:
    for name, table in index.items():
        table.write.mode("overwrite").parquet(f"{path}/{name}")


def load_indexes(spark: Any, path: str, names: tuple[str, ...] = ("postings", "lengths", "corpus", "terms", "points")) -> dict[str, DataFrame]:
    """Missing tables raise when read."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}


def upsert(spark: Any, path: str, rows: DataFrame, key: str = "key") -> None:
    """Puts ``rows`` into the stored collection at ``path``: rows of a known ``key`` replace the old ones, others are added.

    A missing collection is created. Of several rows of one key in ``rows`` any one stays; rows without a key are left out.
    The new state is written beside the old one before it takes its place.
    """
    new = materialize(rows.where(F.col(key).isNotNull()).dropDuplicates([key]))
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        old = None
    if old is not None:
        kept = old.join(new.select(key), key, "left_anti").select(*new.columns)
        new = materialize(kept.unionByName(new))
    new.write.mode("overwrite").parquet(path)


#: What an asymmetric encoder expects before a question; fixed value.
QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


def embed(texts: Column, encode: Callable[[Column], Column] | None = None, query: bool = False) -> Column:
    """Vectors of texts, those of questions with the prefix; null stays null. Documents are stripped first."""
    encode = encode or (lambda c: V.hashed(T.tokens(c, "normalized")))
    ready = F.concat(F.lit(QUERY_PREFIX), texts) if query else T.strip(texts)
    return F.when(texts.isNotNull(), encode(ready))
