import itertools
import math
import random
from collections import Counter

import pytest

from estrado.llm import cooccur


def brute(rows, least):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    single = Counter(i for s in baskets.values() for i in s)
    pairs = Counter(p for s in baskets.values() for p in itertools.combinations(sorted(s), 2))
    return {(a, b): (n, single[a], single[b], len(baskets)) for (a, b), n in pairs.items() if n >= least}


@pytest.mark.parametrize("block", [2, 512])
def test_like_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cooccur, "BLOCK", block)
    r = random.Random(1)
    rows = [(r.choice([*range(30), None]), r.choice([*range(12), None])) for _ in range(500)]
    rows += rows[:50] + [(99, k) for k in range(12)]
    got = cooccur.cooccurrences(spark.createDataFrame(rows, "b int, i int").selectExpr("*", "1 as item_a", "2 as n", "3 as _b"), "b", "i", least=3)
    assert {(x.item_a, x.item_b): (x.n, x.n_a, x.n_b, x.n_baskets) for x in got.collect()} == brute(rows, 3)
    one = got.first()
    assert one.lift == pytest.approx(one.n * one.n_baskets / one.n_a / one.n_b) and one.pmi == pytest.approx(math.log2(one.lift))


def test_only_pairs_of_different_groups(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (1, "c", 2)], "b int, i string, g int")
    assert {(r.item_a, r.item_b) for r in cooccur.cooccurrences(df, "b", "i", "g").collect()} == {("a", "c"), ("b", "c")}


def test_found_and_empty(spark):
    reference = spark.createDataFrame([(1, "Ley 1"), (2, "Ley 2")], "source_id bigint, canonical_name string")
    rows = [(f"f{n}", s, [5]) for n in range(6) for s in ("Ley 1", "Ley 2")] + [(f"g{n}", "Ley 1", [9]) for n in range(30)] + [(None, "Ley 2", [9]), ("f1", "ley 1", [7]), ("f1", "Ley 1", None), ("f2", None, [1]), ("f1", "Ley 1", [5, 5, None])]
    df = spark.createDataFrame(rows, "id_fallo string, main_source string, cited_articles array<int>")
    assert [tuple(r) for r in cooccur.found(df, reference).collect()] == [(1, 5, 2, 5)]
    assert cooccur.found(df.limit(0), reference).count() == 0
