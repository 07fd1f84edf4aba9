import ctypes
import random

import pytest
from pyspark.sql import functions as F

from strandloom.llm import common
from strandloom.llm.graph import components


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_spread_join_is_a_join(spark, monkeypatch, how):
    """A key with most rows, keys without a match, null keys, and columns named like those used inside."""
    monkeypatch.setattr(common, "LEAST_HOT", 20)
    rnd = random.Random(1)
    rows = [(k, "hot" if k % 3 else rnd.choice(["a", "b", None, "none"])) for k in range(600)]
    left = spark.createDataFrame(rows, "id long, key string").withColumn("__salt", F.lit(1)).withColumn("__copies", F.lit(2))
    right = spark.createDataFrame([("hot", 400, 1), ("a", 50, 2), ("b", 50, 3), ("zzz", 0, 4)], "key string, n long, v int")
    assert sorted(common.hot_keys(right, "key", "n").values()) == [3, 3, 20]
    got = common.spread_join(left, right, "key", "n", F.col("id"), how)
    want = left.join(right, "key", how)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_hot_keys_are_few_whatever_the_size(spark):
    sizes = spark.range(100_000).select(F.col("id").alias("key"), (F.col("id") % 7 + 2000).alias("n"))
    assert common.hot_keys(sizes, "key", "n") == {}
    more = sizes.withColumn("n", F.when(F.col("key") < 300, 10_000_000).otherwise(F.col("n")))
    assert 0 < len(common.hot_keys(more, "key", "n")) <= 1 / common.HOT_SHARE


def test_written_tables_go(spark):
    import os

    table = common.cut(spark.range(3))
    path = table._cut_at.removeprefix("file:")
    assert table.count() == 3 and os.path.isdir(path)
    common.release(table)
    assert not os.path.exists(path)


def test_a_written_table_returns_the_native_memory_that_its_plan_freed(spark, monkeypatch):
    said, trim = [], common.trim_jvm
    monkeypatch.setattr(common, "trim_jvm", lambda session: said.append(trim(session)))
    common.release(common.cut(spark.range(3)))
    version = tuple(int(x) for x in spark._jvm.java.lang.System.getProperty("java.version").split("-")[0].split("."))
    known = hasattr(ctypes.CDLL(None), "malloc_trim") and version >= (17, 0, 9)
    assert len(said) == 1 and (not known or "Trim native heap" in said[0])


def test_a_jvm_that_cannot_trim_is_left_alone():
    assert common.trim_jvm(object()) is None


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://head:7077"

        class _jsc:
            @staticmethod
            def sc():
                class Inner:
                    @staticmethod
                    def getCheckpointDir():
                        class Empty:
                            isEmpty = staticmethod(lambda: True)

                        return Empty

                return Inner

        getConf = staticmethod(dict)

    class Session:
        sparkContext = Context
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session)


def test_components_with_a_centre_of_most_edges(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 10)
    rnd = random.Random(2)
    edges = [(5, k) for k in range(100, 400)] + [(k, k + 1) for k in range(1000, 1040)] + [(rnd.randrange(2000, 2060), rnd.randrange(2000, 2060)) for _ in range(50)] + [(7, 7)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = top(a), top(b)
            root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in root}
