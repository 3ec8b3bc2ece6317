"""Stage tables in buckets: nothing moves in a join of them, and every row comes back."""

import os
import tempfile
import threading

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from vitalis.operators.cohort import laid_wide_join, wide_join
from vitalis.plans import extraction as X
from vitalis.sources.bucketed import read_bucketed, table_name, write_bucketed


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="vitalis-test-")


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(df):
    return sorted(map(repr, df.collect()))


ROWS = [(1, 10, "a"), (2, 20, None), (3, 30, "c"), (None, 40, "d"), (5, None, "e")]


def test_layout_comes_back_whole_in_a_catalog_that_forgot_it(spark, folder):
    df = spark.createDataFrame(ROWS, "subject long, stay long, `odd name` string")
    path = os.path.join(folder, "t")
    assert _rows(write_bucketed(df, path, "subject", 4)) == _rows(df)
    spark.sql(f"DROP TABLE {table_name(path)}")
    again = read_bucketed(spark, path, "subject", 4)
    assert _rows(again) == _rows(df) and again.columns == df.columns
    assert _rows(write_bucketed(df.where("subject = 1"), path, "subject", 4)) == _rows(df.where("subject = 1"))
    empty = write_bucketed(df.where("false"), os.path.join(folder, "none"), "subject", 4)
    assert empty.count() == 0 and empty.columns == df.columns


def test_laid_wide_join_equals_the_plain_one_and_moves_nothing(spark, folder, no_broadcast):
    base = spark.createDataFrame(ROWS, "subject long, stay long, v string")
    by_stay = spark.createDataFrame([(10, 1.0), (40, 4.0), (99, 9.0), (None, 0.0)], "stay long, x double")
    by_subject = spark.createDataFrame([(1, 7), (5, 8), (None, 9)], "subject long, y int")
    clash = spark.createDataFrame([(3, "mine", 2)], "subject long, v string, z int")
    sides = [("s", by_stay, "stay"), ("p", by_subject, "subject"), ("q", clash, "subject")]
    out = laid_wide_join(base, sides, lambda name, df, key: write_bucketed(df, os.path.join(folder, name), key, 4))
    assert "Exchange" not in _plan(out)
    assert _plan(out).count("SortMergeJoin") == 2
    assert _rows(out) == _rows(wide_join(base, [(df, key) for _, df, key in sides]).select(out.columns))


def test_wide_table_joins_stage_tables_without_an_exchange(spark, no_broadcast):
    w = X.wide_table(spark, SF001)
    assert "Exchange" not in _plan(w)
    assert _plan(w).count("SortMergeJoin") == 3
    assert "Bucketed: true" in _plan(w)
    n = spark.read.parquet(f"{SF001}/orders.parquet").select("o_custkey").distinct().count()
    assert w.count() == n == w.select(F.countDistinct("subject_id")).first()[0]


def test_sides_are_laid_at_the_same_time(spark):
    base = spark.createDataFrame([(1, 10), (2, 20), (None, 30)], "k int, s int")
    sides = [("one", spark.createDataFrame([(10, "a")], "s int, x string"), "s"),
             ("two", spark.createDataFrame([(1, 0.5), (3, 1.5)], "k int, y double"), "k")]
    both = threading.Barrier(2)

    def lay(name, df, key):
        if not name.startswith("base_"):
            both.wait(20)          # breaks where one side waits for the other
        return df

    assert set(laid_wide_join(base, sides, lay).select("k", "s", "x", "y").collect()) == {(1, 10, "a", 0.5), (2, 20, None, None), (None, 30, None, None)}

    def fails(name, df, key):
        if name == "two":
            raise ValueError("no space")
        return df

    with pytest.raises(ValueError, match="no space"):
        laid_wide_join(base, sides, fails)
