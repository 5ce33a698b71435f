"""Problem 8: passages of evaluation texts inside a corpus.

Every training shard (a bounded run of documents within a task) is turned into an FM-index over words: the
Burrows-Wheeler transform of its word sequence, held as a wavelet matrix for rank, and sampled suffix positions. All
phrases of ten words of the evaluation items are searched backwards at once; occurrences are located through the
samples and merged into removal spans by document and item.

Where the items' phrases fit into every task, index and search are one pass over the corpus. Words that no item holds
can't be part of an occurrence then: they share one symbol, which ends a run, and runs shorter than a phrase are left out.
More phrases are searched block by block in indexes that were built and written once, each with the alphabet of its own
shard, so the corpus is read once whatever the number of items.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estrado.llm.confusables import FULL_WIDTH, INVISIBLE, LOOKALIKE
from estrado.plans.scratch import materialize

PHRASE = 10
#: Most indexed words of a shard; every shard is searched for all phrases.
SHARD = 1_500_000
#: Most words of a shard whose index is written.
STORED = 200_000
#: Every so many positions of the text one suffix position is kept.
SAMPLE = 8
#: Most evaluation phrases, counted by characters from above, that travel to every task; more go in blocks of about so many.
PHRASES = 2_000_000

_LOOKS = str.maketrans({**{c: None for c in INVISIBLE}, **dict(zip(*FULL_WIDTH)), **LOOKALIKE})
_WORD = re.compile(r"[a-z0-9]+")
_ANY_WORD = re.compile(r"[^\W_]+")


def text_words(text: str) -> list[str]:
    """Runs of letters and digits without regard to case, accents and characters that only look different."""
    if not text.isascii():
        text = _plain(text)
        if not text.isascii():
            text = "".join(c for c in unicodedata.normalize("NFKD", text.translate(_LOOKS)) if not unicodedata.combining(c))
            text = text.translate(_LOOKS)
            if not text.isascii():
                return _ANY_WORD.findall(text.casefold())
    return _WORD.findall(text.lower())


def _plain(text: str) -> str:
    for accented, base in (("á", "a"), ("é", "e"), ("í", "i"), ("ó", "o"), ("ú", "u"), ("ñ", "n"), ("ü", "u"), ("Á", "A"), ("É", "E"), ("Í", "I"), ("Ó", "O"), ("Ú", "U"), ("Ñ", "N"), ("Ü", "U"), ("«", " "), ("»", " "), ("¿", " "), ("¡", " "), ("°", " ")):
        text = text.replace(accented, base)
    return text


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by doubling the compared length; a shorter suffix comes first."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    keys = text[order]
    rank[order] = np.concatenate(([0], np.cumsum(keys[1:] != keys[:-1]))) if n else rank
    step = 1
    while n and rank.max() < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        both = rank * (n + 1) + second
        order = np.argsort(both, kind="stable")
        keys = both[order]
        rank[order] = np.concatenate(([0], np.cumsum(keys[1:] != keys[:-1])))
        step *= 2
    return order


class WaveletMatrix:
    """A sequence of numbers below 2**bits with rank of any number up to any place, by vectors of questions."""

    def __init__(self, values: np.ndarray, size: int) -> None:
        self.bits = max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        start = np.zeros_like(at)
        for depth, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = (symbol >> (self.bits - 1 - depth)) & 1
            at = np.where(bit, zeros + ones[at], at - ones[at])
            start = np.where(bit, zeros + ones[start], start - ones[start])
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[at + 1] - ones[at]
            out = out << 1 | bit
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """Backward search and location over a text of symbols from 1 on; 0 is the end mark and added here."""

    def __init__(self, text: np.ndarray, size: int) -> None:
        text = np.append(text, 0)
        order = suffix_array(text)
        self.n = len(text)
        self.bwt = WaveletMatrix(text[order - 1], size)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=size))))
        kept = order % SAMPLE == 0
        self.kept = np.concatenate(([0], np.cumsum(kept)))
        self.sampled = order[kept]

    def state(self) -> tuple[Any, ...]:
        """What ``of`` needs, of plain types only, as workers need no installed package."""
        return self.n, self.bwt.bits, self.bwt.ones, self.bwt.zeros, self.before, self.kept, self.sampled

    @classmethod
    def of(cls, state: tuple[Any, ...]) -> FMIndex:
        index = cls.__new__(cls)
        index.bwt = WaveletMatrix.__new__(WaveletMatrix)
        index.n, index.bwt.bits, index.bwt.ones, index.bwt.zeros, index.before, index.kept, index.sampled = state
        return index

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each phrase (a row of symbols)."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            lo[live] = self.before[c] + self.bwt.rank(c, lo[live])
            hi[live] = self.before[c] + self.bwt.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
        hi[lo > hi] = lo[lo > hi]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The suffixes' places in the text: steps back to the next sampled suffix, then its place and the steps."""
        out, steps, live = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        at = rows.astype(np.int64).copy()
        while len(live):
            here = at[live]
            hit = self.kept[here + 1] > self.kept[here]
            out[live[hit]] = self.sampled[self.kept[here[hit]]] + steps
            live, here = live[~hit], here[~hit]
            c = self.bwt.access(here)
            at[live] = self.before[c] + self.bwt.rank(c, here)
            steps += 1
        return out


def phrases_of(items: list[tuple[int, str]], size: int = PHRASE) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """(word -> symbol from 2 on, distinct phrases, (phrase, item) pairs)."""
    symbols: dict[str, int] = {}
    seen: dict[tuple[int, ...], int] = {}
    owners: set[tuple[int, int]] = set()
    for item, text in items:
        ids = [symbols.setdefault(w, len(symbols) + 2) for w in text_words(text or "")]
        for k in range(len(ids) - size + 1):
            owners.add((seen.setdefault(tuple(ids[k : k + size]), len(seen)), item))
    return symbols, np.array(list(seen), np.int64).reshape(-1, size), np.array(sorted(owners), np.int64).reshape(-1, 2)


_SPANS = "doc_id bigint, item_id bigint, word_from int, word_to int"


def leaks(documents: DataFrame, items: DataFrame, size: int = PHRASE, block: int = PHRASES) -> DataFrame:
    """(doc_id, item_id, word_from, word_to): merged spans of words of a document that stand in an item.

    Spans hold at least ``size`` consecutive words of the item, word_to is exclusive. Null texts, null ids, empty texts
    and items of fewer words leak nothing; equal documents under other ids have their own spans, repeated rows the same
    spans once; texts of any length are read whole; other columns are ignored. ``block`` changes no result.
    """
    of = Window.partitionBy("doc_id", "item_id").orderBy("word_from", "word_to")
    before = F.max("word_to").over(of.rowsBetween(Window.unboundedPreceding, -1))
    hits = occurrences(documents, items, size, block).distinct().withColumn("_new", (F.coalesce(before, F.lit(-1)) < F.col("word_from")).cast("int"))
    hits = hits.withColumn("_span", F.sum("_new").over(of))
    return hits.groupBy("doc_id", "item_id", "_span").agg(F.min("word_from").alias("word_from"), F.max("word_to").alias("word_to")).drop("_span")


def occurrences(documents: DataFrame, items: DataFrame, size: int = PHRASE, block: int = PHRASES) -> DataFrame:
    """Spans as in ``leaks``, those of one shard and block merged only."""
    texts = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    asked = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = asked.agg(F.sum(F.length("text"))).first()[0] or 0  # characters are at least as many as phrases
    if total <= block:
        symbols, phrases, owners = phrases_of([tuple(r) for r in asked.collect()], size)
        return texts.mapInArrow(_searcher(symbols, phrases, owners, size), _SPANS)
    index = materialize(texts.mapInArrow(_indexer(size), "shard binary"))
    wanted = materialize(asked.mapInArrow(_phrases(size), "item_id bigint, phrase string").distinct())
    count = max(1, -(-wanted.count() // block))
    out = None
    for k in range(count):  # a stated set of phrases, in blocks of about ``block`` rows
        part = [tuple(r) for r in wanted.where(F.pmod(F.xxhash64("phrase"), F.lit(count)) == k).collect()]
        found = index.mapInArrow(_stored_searcher(part, size), _SPANS)
        out = found if out is None else out.unionByName(found)
    return out


def _phrases(size: int) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text_words(text)
                rows += [(item, " ".join(words[k : k + size])) for k in range(len(words) - size + 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string()))], names=["item_id", "phrase"])

    return run


def _indexer(size: int) -> Any:
    """FM-indexes of shards of at most STORED words, documents beyond it in overlapping parts, ready to be written."""

    def shard(docs: list[int], starts: list[int], runs: list[list[str]]) -> pa.RecordBatch:
        symbols: dict[str, int] = {}
        text = np.fromiter((s for run in runs for s in (*(symbols.setdefault(w, len(symbols) + 2) for w in run), 1)), np.int64)
        begin = np.concatenate(([0], np.cumsum([len(r) + 1 for r in runs])[:-1]))
        held = pickle.dumps((symbols, np.array(docs, np.int64), np.array(starts, np.int64), begin, FMIndex(text, len(symbols) + 2).state()))
        return pa.RecordBatch.from_arrays([pa.array([held], pa.binary())], names=["shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, starts, runs, held = [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = text_words(text.as_py())
                for at in range(0, len(words) - size + 1, STORED):
                    part = words[at : at + STORED + size - 1]
                    docs.append(doc)
                    starts.append(at)
                    runs.append(part)
                    held += len(part) + 1
                    if held >= STORED:
                        yield shard(docs, starts, runs)
                        docs, starts, runs, held = [], [], [], 0
        if runs:
            yield shard(docs, starts, runs)

    return run


def _stored_searcher(asked: list[tuple[int, str]], size: int) -> Any:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for item, phrase in asked:
            known.setdefault(phrase, []).append(item)
        for batch in batches:
            for held in batch.column(0):
                symbols, docs, starts, begin, state = pickle.loads(held.as_py())
                rows, owners = [], []
                for phrase, items in known.items():
                    ids = [symbols.get(w, 0) for w in phrase.split(" ")]
                    if all(ids):
                        owners += [(len(rows), item) for item in items]
                        rows.append(ids)
                if rows:
                    own = np.array(owners, np.int64)
                    found = _spans(FMIndex.of(state), np.array(rows, np.int64), own, np.searchsorted(own[:, 0], np.arange(len(rows) + 1)), docs, starts, begin, size)
                    if found is not None:
                        yield found

    return run


def _spans(index: FMIndex, phrases: np.ndarray, owners: np.ndarray, first: np.ndarray, docs: np.ndarray, starts: np.ndarray, begin: np.ndarray, size: int) -> pa.RecordBatch | None:
    """The merged spans of a shard's documents; run k of its text begins at begin[k] and at word starts[k] of docs[k]."""
    lo, hi = index.search(phrases)
    hit = np.nonzero(hi > lo)[0]
    if not len(hit):
        return None
    per = hi[hit] - lo[hit]
    rows = np.repeat(lo[hit] - np.concatenate(([0], np.cumsum(per)[:-1])), per) + np.arange(per.sum())
    phrase = np.repeat(hit, per)
    place = index.locate(rows)
    run = np.searchsorted(begin, place, "right") - 1
    word = starts[run] + place - begin[run]
    doc = docs[run]
    many = first[phrase + 1] - first[phrase]
    own = np.repeat(first[phrase] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    doc, word, item = np.repeat(doc, many), np.repeat(word, many), owners[own, 1]
    order = np.lexsort((word, item, doc))
    doc, word, item = doc[order], word[order], item[order]
    fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (word[1:] > word[:-1] + size)))
    last = np.append(np.nonzero(fresh)[0][1:] - 1, len(doc) - 1)
    return pa.RecordBatch.from_arrays([pa.array(doc[fresh]), pa.array(item[fresh]), pa.array(word[fresh], pa.int32()), pa.array(word[last] + size, pa.int32())], names=["doc_id", "item_id", "word_from", "word_to"])


def _searcher(symbols: dict[str, int], phrases: np.ndarray, owners: np.ndarray, size: int) -> Any:
    first = np.searchsorted(owners[:, 0], np.arange(len(phrases) + 1)) if len(owners) else None

    def search(docs: list[int], runs: list[list[int]], starts: list[int]) -> pa.RecordBatch | None:
        """Indexes the runs of one shard and gives the merged spans of its documents."""
        lengths = np.fromiter(map(len, runs), np.int64, len(runs)) + 1
        text = np.fromiter((s for run in runs for s in (*run, 1)), np.int64, int(lengths.sum()))
        begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        return _spans(FMIndex(text, len(symbols) + 2), phrases, owners, first, np.asarray(docs, np.int64), np.asarray(starts, np.int64), begin, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(phrases):
            return
        docs: list[int] = []
        runs: list[list[int]] = []
        starts: list[int] = []
        held = 0
        get = symbols.get
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = [get(w, 1) for w in text_words(text.as_py())]
                start = 0
                while start < len(ids):
                    try:
                        end = ids.index(1, start)
                    except ValueError:
                        end = len(ids)
                    if end - start >= size:
                        docs.append(doc)
                        runs.append(ids[start:end])
                        starts.append(start)
                        held += end - start + 1
                    start = end + 1
                if held >= SHARD:
                    found = search(docs, runs, starts)
                    if found is not None:
                        yield found
                    docs, runs, starts, held = [], [], [], 0
        if runs:
            found = search(docs, runs, starts)
            if found is not None:
                yield found

    return run


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """p8_found: every document that has ten consecutive words of an item, with the item; see ``leaks`` for nulls and the like."""
    return occurrences(documents, items).select("doc_id", "item_id").distinct()


def clean(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, passages, words): what leaked where, for removal or report."""
    return leaks(documents, items).groupBy("doc_id", "item_id").agg(F.count("*").alias("passages"), F.sum(F.col("word_to") - F.col("word_from")).alias("words"))
