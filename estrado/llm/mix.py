"""Problem 9: mixing sources to target shares of all tokens, with capped repeats.

Token sums by source and hash bucket give, for each source, how often all its documents are used and the hash below
which they are used once more; only the bucket in which the budget ends is refined, so nothing is sorted and no
document moves. Whatever the hash threshold leaves open is less than one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estrado.plans.scratch import materialize

#: Ranks of a public byte-level BPE; the path, on the driver's machine, is a parameter of every function that needs it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenisation of that vocabulary; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bits of the hash that one histogram looks at, and all bits used.
STEP, BITS = 10, 60
#: Target sources that are planned, and sent to the tasks, at once; longer lists are planned in blocks.
SOURCES = 10_000


def source_label(column: Any) -> Any:
    """Labels typed in uneven case and spacing as one."""
    return F.lower(F.trim(F.regexp_replace(column, r"(?U)\s+", " ")))


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", into: str = "n_tokens") -> DataFrame:
    """``documents`` without ``text``, with its number of tokens; null and empty texts have 0. Spark ships the vocabulary to the executors."""
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rpartition("/")[2]
    kept = [c for c in documents.columns if c not in (text, into)]
    source = documents.select(*kept, F.col(text).alias("_text"))
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "_text"), f"`{into}` bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64

        import tiktoken
        from pyspark import SparkFiles

        with open(SparkFiles.get(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            n = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*kept, into])

    return source.mapInArrow(run, ddl)


def _sized(documents: DataFrame, vocabulary: str) -> DataFrame:
    rows = documents.where("doc_id is not null and source is not null").select("doc_id", source_label(F.col("source")).alias("source"), "text")
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit("mix"), "doc_id"), 64 - BITS)
    return materialize(count_tokens(rows, vocabulary).where("n_tokens > 0").withColumn("h", hashed))


def plan(sized: DataFrame, targets: DataFrame, total: int | None = None, block: int = SOURCES) -> DataFrame:
    """(source, target_share, max_repeats, held, rounds, below): for each target source the tokens held, how often all of
    them are used, and the hash below which once more.

    ``total``: tokens of the whole mixture; by default the most for which every source that holds anything keeps its
    share within its repeats. Shares of sources that hold nothing go to the others in proportion. Lists of more than
    ``block`` sources are planned block by block, so the driver never holds more.
    """
    aims = targets.where("source is not null and target_share > 0").groupBy(source_label(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(0)), F.lit(0)).alias("max_repeats"))
    tokens = sized.groupBy("source").agg(F.sum("n_tokens").alias("held"))
    rows = materialize(aims.join(tokens, "source", "left").fillna(0, ["held"]).withColumn("live", F.expr("held > 0 and max_repeats > 0")))
    whole = rows.where("live").agg(F.sum("target_share").alias("shares"), F.min(F.col("held") * F.col("max_repeats") / F.col("target_share")).alias("most")).first()
    shares = whole["shares"] or 1.0
    total = (whole["most"] or 0.0) * shares if total is None else total
    allowed = F.col("held") * F.col("max_repeats")
    wanted = F.when(F.col("live"), F.least(F.col("target_share") / shares * float(total), allowed.cast("double"))).otherwise(0.0)
    rows = rows.withColumn("wanted", wanted).withColumn("rounds", F.when(F.col("live"), F.floor(F.col("wanted") / F.col("held"))).otherwise(0).cast("int"))
    rows = rows.withColumn("rest", F.when(F.col("live") & (F.col("rounds") < F.col("max_repeats")), F.col("wanted") - F.col("rounds") * F.col("held")).otherwise(0.0))
    blocks = max(1, -(-rows.count() // block))
    kept = ["source", "target_share", "max_repeats", "held", "rounds"]
    out = None
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("source"), F.lit(blocks)) == k) if blocks > 1 else rows
        held = [r.asDict() | {"below": 0} for r in part.select(*kept, "rest").collect()]
        found = sized.sparkSession.createDataFrame([tuple(r[c] for c in (*kept, "below")) for r in _thresholds(sized, held)], "source string, target_share double, max_repeats int, held long, rounds int, below long")
        out = found if out is None else out.unionByName(found)
    return materialize(out) if blocks > 1 else out


def _thresholds(sized: DataFrame, rows: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """Fills ``below``: nested histograms of STEP bits, each of the boundary bucket of the one before."""
    open_ = {r["source"]: r for r in rows if r["rest"] > 0}
    for shift in range(BITS - STEP, -1, -STEP):
        if not open_:
            break
        spark = sized.sparkSession
        bounds = spark.createDataFrame([(s, r["below"], float(r["rest"])) for s, r in open_.items()], "source string, low long, rest double")  # at most a block of sources
        inside = sized.join(F.broadcast(bounds), "source").where(F.shiftrightunsigned("h", shift + STEP) == F.shiftrightunsigned("low", shift + STEP))
        buckets = inside.groupBy("source", "rest", F.shiftrightunsigned("h", shift).alias("bucket")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most 2**STEP rows
        ends = buckets.withColumn("upto", F.sum("n").over(run)).where("upto > rest")
        first = ends.groupBy("source").agg(F.min_by(F.struct("bucket", "n", "docs", "upto"), "bucket").alias("b"))
        found = {r["source"]: r["b"] for r in first.collect()}  # a row for each source
        for source in list(open_):
            r = open_[source]
            if source not in found:  # all of the bucket fits
                r["below"] = (((r["below"] >> (shift + STEP)) + 1) << (shift + STEP)) if shift + STEP < BITS else 1 << BITS
                del open_[source]
                continue
            b = found[source]
            r["below"] = b["bucket"] << shift
            r["rest"] -= b["upto"] - b["n"]
            if b["docs"] == 1 or shift == 0:
                if r["rest"] > b["n"] / 2:  # the document in which the budget ends counts if most of it fits
                    r["below"] += 1 << shift
                del open_[source]
    return rows


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, total: int | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, copies): the documents of the mixture and how often each is used.

    ``documents`` has (doc_id, source, text), ``targets`` (source, target_share, max_repeats). No document is used more
    than its source's max_repeats; documents of other or null sources, without id, or without tokens are left out;
    rows with an equal doc_id are used alike; empty tables give an empty mixture.
    """
    sized = _sized(documents, vocabulary)
    return _used(sized, plan(sized, targets, total))


def _used(sized: DataFrame, aims: DataFrame) -> DataFrame:
    few = aims.select("source", "rounds", "below")
    few = F.broadcast(few) if aims.limit(SOURCES + 1).count() <= SOURCES else few
    copies = F.col("rounds") + (F.col("h") < F.col("below")).cast("int")
    return sized.join(few, "source").select("doc_id", "source", "n_tokens", copies.alias("copies")).where("copies > 0")


def shares(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, total: int | None = None) -> DataFrame:
    """(source, held, max_repeats, target_share, used_tokens, used_documents, most_copies, actual_share) of the mixture."""
    sized = _sized(documents, vocabulary)
    aims = plan(sized, targets, total)
    used = materialize(_used(sized, aims).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"), F.count("*").alias("used_documents"), F.max("copies").alias("most_copies")))
    every = used.agg(F.sum("used_tokens").alias("every"))
    out = aims.select("source", "held", "max_repeats", "target_share").join(used, "source", "left").fillna(0, ["used_tokens", "used_documents", "most_copies"])
    return out.crossJoin(F.broadcast(every)).withColumn("actual_share", F.try_divide("used_tokens", "every")).drop("every")  # every: one row
