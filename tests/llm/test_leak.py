import random

import numpy as np
import pytest

from estrado.llm import leak

WORDS = "acta bien caso dato este fuero grado hecho ibero juez".split()
DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def test_index_like_brute_force():
    r = np.random.default_rng(1)
    for n in (1, 2, 7, 60, 300):
        text = r.integers(1, 6, n)
        index = leak.FMIndex(text, 6)
        phrases = r.integers(1, 6, (30, 3))
        for p, lo, hi in zip(phrases, *index.search(phrases)):
            assert sorted(index.locate(np.arange(lo, hi)).tolist()) == [k for k in range(n - 2) if (text[k : k + 3] == p).all()]


def test_wavelet_rank_and_access():
    values = np.random.default_rng(2).integers(0, 13, 200)
    matrix = leak.WaveletMatrix(values, 13)
    for c in range(13):
        assert matrix.rank(np.full(201, c), np.arange(201)).tolist() == [int((values[:k] == c).sum()) for k in range(201)]
    assert matrix.access(np.arange(200)).tolist() == values.tolist()


def brute(docs, items, size=10):
    out = set()
    for i, t in items:
        w = leak.text_words(t or "")
        phrases = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}
        for d, text in docs:
            v = leak.text_words(text or "")
            if d is not None and any(tuple(v[k : k + size]) in phrases for k in range(len(v) - size + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize("shard", [30, 1_500_000])
def test_documents_like_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(leak, "SHARD", shard)
    r = random.Random(3)
    items = [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(5, 40)))) for i in range(8)]
    docs = []
    for d in range(60):
        words = [r.choice([*WORDS, "otra"]) for _ in range(30)]
        if d % 3 == 0:
            passage = items[d % 8][1].split()
            words[10:10] = passage[: r.randint(8, 14)]
        docs.append((d, " ".join(words)))
    docs += [(100, docs[0][1]), (0, docs[0][1]), (101, None), (None, items[0][1]), (102, "")]
    got = leak.found(spark.createDataFrame(docs, DOCS), spark.createDataFrame([*items, (50, None), (None, "x " * 20)], ITEMS).selectExpr("*", "1 as doc_id"))
    assert {tuple(r) for r in got.collect()} == brute(docs, items)
    assert {tuple(r) for r in leak.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block=60).select("doc_id", "item_id").distinct().collect()} == brute(docs, items)


@pytest.mark.parametrize("stored", [25, 200_000])
def test_written_indexes_give_the_same_spans(spark, monkeypatch, stored):
    monkeypatch.setattr(leak, "STORED", stored)
    r = random.Random(9)
    items = spark.createDataFrame([(i, " ".join(r.choice(WORDS[:3]) for _ in range(40))) for i in range(5)], ITEMS)
    docs = spark.createDataFrame([(d, " ".join(r.choice(WORDS[:3]) for _ in range(r.randint(0, 120)))) for d in range(30)] + [(3, "acta " * 30), (90, None)], DOCS)
    spans = lambda block: sorted(map(tuple, leak.leaks(docs, items, size=5, block=block).collect()))
    one = spans(leak.PHRASES)
    assert one and one == spans(100) == spans(7)


def test_spans_like_brute_force(spark):
    r = random.Random(12)
    items = [(i, " ".join(r.choice(WORDS[:4]) for _ in range(30))) for i in range(4)]
    docs = [(d, " ".join(r.choice(WORDS[:4]) for _ in range(60))) for d in range(25)]
    want = set()
    for d, text in docs:
        v = text.split()
        for i, item in items:
            w = item.split()
            phrases = {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
            at = [k for k in range(len(v) - 3) if tuple(v[k : k + 4]) in phrases]
            held = sorted({k + n for k in at for n in range(4)})
            for k in held:
                if k - 1 not in held:
                    end = k
                    while end in held:
                        end += 1
                    want.add((d, i, k, end))
    assert {tuple(x) for x in leak.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), size=4).collect()} == want


def test_words_ignore_case_accents_and_looks():
    text = "«" + chr(0xFF21) + "cion  ni" + chr(0x200B) + "ño», di" + chr(0x441) + "é y ÑU_2"
    assert leak.text_words(text) == ["acion", "nino", "dice", "y", "nu", "2"]


def test_spans_are_merged_and_exclusive(spark):
    item = " ".join(f"w{k}" for k in range(14))
    docs = spark.createDataFrame([(1, f"antes {item} después {' '.join(item.split()[:10])}")], DOCS)
    got = sorted(map(tuple, leak.leaks(docs, spark.createDataFrame([(5, item)], ITEMS)).collect()))
    assert got == [(1, 5, 1, 15), (1, 5, 16, 26)]
    assert [tuple(r) for r in leak.clean(docs, spark.createDataFrame([(5, item)], ITEMS)).collect()] == [(1, 5, 2, 24)]


def test_empty_short_and_long(spark):
    item = " ".join(f"w{k}" for k in range(12))
    items = spark.createDataFrame([(1, item)], ITEMS)
    assert leak.found(spark.createDataFrame([], DOCS), items).count() == 0
    assert leak.found(spark.createDataFrame([(1, item)], DOCS), items.limit(0)).count() == 0
    assert leak.found(spark.createDataFrame([(1, item)], DOCS), spark.createDataFrame([(1, "w1 w2")], ITEMS)).count() == 0
    assert leak.found(spark.createDataFrame([(1, "w1 " * 100_000 + item)], DOCS), items).count() == 1
