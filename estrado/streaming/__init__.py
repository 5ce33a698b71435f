"""Incremental forms of operators that keep state: an extension, the batch forms are the reference."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estrado.operators.evaluate import GAIN, START

_FILES = "file_id bigint, path string, organo string, lote int, recibido_at timestamp, payload string"


def index_new_files(spark: SparkSession, folder: str, add: Callable[[DataFrame, int], None], checkpoint: str) -> Any:
    """A query that hands every batch of newly delivered ruling files (Parquet) to ``add`` once."""
    files = spark.readStream.schema(_FILES).parquet(folder)
    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_counts(files: DataFrame, delay: str = "30 days", window: str = "1 day") -> DataFrame:
    """(organo, day, files): deliveries by court and day; files later than ``delay`` no longer count."""
    return files.withWatermark("recibido_at", delay).groupBy("organo", F.window("recibido_at", window).alias("w")).agg(F.count("*").alias("files")).select("organo", F.col("w.start").alias("day"), "files")


def last_turns(turns: DataFrame, n: int = 5) -> DataFrame:
    """(conv_id, turns): after each batch the last ``n`` turns of the conversations it touched. ``turns``: (conv_id, turn, text)."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for batch in batches:
            held += list(zip(batch["turn"].tolist(), batch["text"].tolist()))
        held = sorted(held)[-n:]
        state.update(([t for t, _ in held], [x for _, x in held]))
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [[x for _, x in held]]})

    return turns.withColumn("conv_id", F.col("conv_id").cast("string")).groupBy("conv_id").applyInPandasWithState(update, "conv_id string, turns array<string>", "turn array<bigint>, text array<string>", "update", "NoTimeout")


def elo(matches: DataFrame) -> DataFrame:
    """(league, player, rating): ratings after each batch. ``matches``: (league, match_no, player_a, player_b, result), batches in order."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        rating = dict(zip(*state.get)) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values("match_no", kind="stable")
        for m in rows.itertuples():
            a, b = rating.get(m.player_a, START), rating.get(m.player_b, START)
            won = 1 / (1 + 10 ** ((b - a) / 400))
            rating[m.player_b] = b + GAIN * (won - m.result)
            rating[m.player_a] = a + GAIN * (m.result - won)  # last, as in the batch form, for one who meets themselves
        names = sorted(rating)
        state.update((names, [rating[p] for p in names]))
        yield pd.DataFrame({"league": key[0], "player": names, "rating": [rating[p] for p in names]})

    return matches.groupBy("league").applyInPandasWithState(update, "league string, player string, rating double", "player array<string>, rating array<double>", "update", "NoTimeout")
