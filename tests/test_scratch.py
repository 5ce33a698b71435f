import os

import pytest

from estrado.plans import scratch


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Session:
    """What scratch_dir asks of a session."""

    def __init__(self, **conf):
        self.conf = Conf()
        self.sparkContext = self
        self._conf = Conf({k.replace("_", "."): v for k, v in conf.items()})

    def getConf(self):
        return self._conf


def test_the_shared_folder_is_the_sessions_and_required_off_local():
    assert scratch.scratch_dir(Session(spark_master="spark://host:7077", spark_checkpoint_dir="hdfs:///x/")) == "hdfs:///x"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(Session(spark_master="yarn"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.scratch_dir(Session(spark_master="local-cluster[3,2,3000]"))
    assert os.path.isdir(scratch.scratch_dir(Session(spark_master="local[4]")))


def test_written_tables_are_read_back_and_removed(spark):
    kept = dict(scratch._WRITTEN)
    scratch._WRITTEN.clear()
    out = scratch.materialize(spark.range(5).selectExpr("id", "id % 2 as part"), "part")
    folder = next(iter(scratch._WRITTEN.values()))[0]
    assert sorted(map(tuple, out.collect())) == [(n, n % 2) for n in range(5)] and os.path.isdir(folder)
    assert scratch.clean(spark) == 1 and not os.path.exists(folder)
    scratch._WRITTEN.update(kept)


def test_repeats_are_told_apart(spark):
    from estrado.plans.repeats import distinct_rows, split_repeats

    rows = [(1, "a"), (2, "b"), (2, "b"), (2, "c"), (None, "d"), (None, "d"), (3, None)]
    df = spark.createDataFrame(rows, "k int, v string")
    want = sorted(map(tuple, df.distinct().collect()), key=str)
    for most in (10, 0):
        assert sorted(map(tuple, distinct_rows(df, "k", most).collect()), key=str) == want
    once, more = split_repeats(df, "k")
    assert {r.k for r in once.collect()} == {1, 3} and more.count() == 5
    assert split_repeats(df.where("k = 1"), "k")[1] is None and split_repeats(df, "k", 1)[0] is None
    assert distinct_rows(df.limit(0), "k").count() == 0
