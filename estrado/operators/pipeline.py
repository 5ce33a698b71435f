"""Questions in, answers out: retrieval, grouping, context and generation for a batch of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estrado.functions import generate as G
from estrado.operators import answers, search


@dataclass(frozen=True)
class Config:
    """Settings of a pipeline; results asked for are capped at ``max_results``; an index of another ``tokenizer`` than stated is refused."""

    strategy: str = "enriched"
    top_n: int = 8
    max_results: int = answers.MAX_RESULTS
    k_dense: int = search.K_DENSE
    k_lex: int = search.K_LEX
    tokenizer: str | None = None
    rerank: bool = True
    snippet: int = answers.SNIPPET
    history: int = answers.HISTORY
    generator: str = "summary"


STRATEGIES = ("standard", "enriched", "conversational")


def hits(questions: DataFrame, paragraphs: DataFrame, index: dict[str, DataFrame], config: Config = Config()) -> DataFrame:
    """The best paragraphs of each question with their metadata; equal questions are searched for once.

    ``questions`` has (qid, question, embedding); ``paragraphs`` has (key, expediente, section, text, path, idea_central,
    materia_preliminar, articulos_citados). The enriched strategy raises fused scores by metadata; reranking replaces them.
    """
    if config.tokenizer not in (None, found := search.tokenizer_of(index)):
        raise ValueError(f"the index was built with the tokenizer {found!r}, not {config.tokenizer!r}")
    once = questions.groupBy("question").agg(F.min("qid").alias("qid"), F.min_by("embedding", "qid").alias("embedding"))
    top_n = min(config.top_n, config.max_results)
    meta = paragraphs.withColumnRenamed("text", "paragraph")

    def score(fused: DataFrame) -> DataFrame:
        if config.rerank:
            rows = fused.join(paragraphs.select("key", "text"), "key").join(once.select("qid", "question"), "qid")
            return rows.select("qid", "key", search.overlap_rerank(F.col("question"), F.col("text")).alias("score"))
        if config.strategy == "enriched":
            rows = fused.join(meta.select("key", "articulos_citados", "materia_preliminar", "idea_central"), "key").join(once.select("qid", "question"), "qid")
            gain = search.boost(F.col("question"), F.col("articulos_citados"), F.col("materia_preliminar"), F.col("idea_central"))
            return rows.select("qid", "key", (F.col("score") + gain).alias("score"))
        return fused

    found = search.hybrid(once, index["points"], index, top_n, k_dense=config.k_dense, k_lex=config.k_lex, rerank=score)
    same = questions.select(F.col("qid").alias("_q"), "question").join(once.select("qid", "question"), "question").select("_q", "qid")
    return found.join(same, "qid").drop("qid").withColumnRenamed("_q", "qid").join(meta, "key")


def answer(questions: DataFrame, paragraphs: DataFrame, index: dict[str, DataFrame], config: Config = Config(), turns: DataFrame | None = None) -> DataFrame:
    """(qid, question, context, answer). Questions without a hit get an empty context.

    ``turns`` (conv_id, turn, question, answer) with ``questions.conv_id``: the conversation so far, for that strategy.
    """
    if config.strategy not in STRATEGIES:
        raise ValueError(f"no strategy {config.strategy!r}; there are {', '.join(STRATEGIES)}")
    found = hits(questions, paragraphs, index, config)
    if config.strategy == "enriched":
        context = answers.context_grouped(answers.group_hits(found), config.snippet)
    elif config.strategy == "standard":
        context = answers.context_flat(found, config.snippet)
    else:
        context = answers.context_chat(found)
    rows = questions.join(context, "qid", "left").withColumn("context", F.coalesce("context", F.lit("")))
    prompt = F.concat(F.col("context"), F.lit("\n\nPregunta: "), F.col("question"))
    if config.strategy == "conversational":
        past = answers.history(turns, "conv_id", "turn", "question", "answer", config.history).withColumnRenamed("context", "_past") if turns is not None else None
        rows = rows.join(past, "conv_id", "left") if past is not None else rows.withColumn("_past", F.lit(None).cast("string"))
        prompt = F.concat(F.coalesce("_past", F.lit("No hay historial previo.")), F.lit("\n\n"), prompt)
    return rows.select("qid", "question", "context", G.generate(prompt, config.generator).alias("answer"))
