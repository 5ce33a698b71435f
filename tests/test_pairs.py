from itertools import combinations

from estrado.plans.pairs import pairs_within


def test_every_pair_of_a_class_once_whatever_the_blocks(spark):
    data = [("big", k) for k in range(60)] + [("two", 1), ("two", 5), ("one", 3)]
    want = sorted([("big", a, b) for a, b in combinations(range(60), 2)] + [("two", 1, 5)])
    df = spark.createDataFrame(data, "g string, k int")
    for block in (1000, 7, 1):
        assert sorted(tuple(r) for r in pairs_within(df, ["g"], "k", block).collect()) == want


def test_no_rows(spark):
    assert pairs_within(spark.createDataFrame([], "g string, k int"), ["g"], "k").count() == 0
