"""The pruned event layout: what is read, and what is skipped."""

import os
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalis.sources.ingest import ingest_events, read_events

SCHEMA = T.StructType([T.StructField("stay", T.LongType()), T.StructField("item", T.StringType()), T.StructField("v", T.DoubleType())])
ROWS = [(i % 40 if i % 3 else 7, "abcd"[i % 4], float(i)) for i in range(2000)] + [(None, "a", 1.0), (3, None, 2.0)]


@pytest.fixture(scope="module")
def laid(spark):
    base = tempfile.mkdtemp(prefix="vitalis-test-")
    raw, out = os.path.join(base, "raw"), os.path.join(base, "out")
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.option("header", "true").option("compression", "gzip").csv(raw)
    return ingest_events(spark, raw, SCHEMA, out, "item", "stay", buckets=8, fmt="csv")


def test_ingest_keeps_every_row(spark, laid):
    back = read_events(spark, laid, SCHEMA, "item", "stay")
    assert back.columns == ["stay", "item", "v"]
    assert Counter(map(tuple, back.collect())) == Counter(ROWS)
    assert sorted(os.listdir(os.path.join(laid, "buckets=8")))[:2] == ["item=__HIVE_DEFAULT_PARTITION__", "item=a"]


def test_items_and_cohort_prune_folders(spark, laid):
    people = spark.createDataFrame([(i, i % 2) for i in range(40)], "stay int, kind int").repartition(2).checkpoint()
    cohort = people.where("kind = 1 and stay in (5, 7)")
    kept = read_events(spark, laid, SCHEMA, "item", "stay", ["a", "b"], cohort)
    assert Counter(map(tuple, kept.collect())) == Counter(r for r in ROWS if r[0] in (5, 7) and r[1] in ("a", "b"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert any("dynamicpruning" in line and "stay_bucket" in line for line in filters)
    assert all("item" in line.split("PartitionFilters")[1].split("PushedFilters")[0] for line in filters if "FileScan parquet" in line)


def test_folders_without_a_layout_are_refused(spark):
    empty = tempfile.mkdtemp(prefix="vitalis-test-")
    with pytest.raises(ValueError, match="0 layouts"):
        read_events(spark, empty, SCHEMA, "item", "stay")
