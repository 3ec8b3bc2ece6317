"""Large event extracts, read once into a layout that later scans can skip most of.

A gzip file cannot be split, so every scan of a ``.csv.gz`` extract is one task per file.  ``ingest_events`` makes that
pass once: it writes Parquet partitioned by item and by a hash bucket of the stay, rebalanced before the write so that
a hot item or stay fills several files rather than one task.  ``read_events`` then prunes items statically and buckets
dynamically, by the cohort it is joined to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import read_source

BUCKETS = 64
_BUCKET = "stay_bucket"


def _bucket(stay: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(stay), F.lit(buckets)).cast("int")


def ingest_events(spark: SparkSession, path: str, schema: T.StructType, out: str, item: str, stay: str, buckets: int = BUCKETS,
                  fmt: str | None = None) -> str:
    """Write the event file or files at ``path`` to ``out`` by ``item`` and bucket of ``stay``.  Null items and stays
    are kept.  The number of buckets is part of the layout (a constant partition), so readers need not be told."""
    events = read_source(spark, path, schema, fmt)
    laid = events.select("*", F.lit(buckets).alias("buckets"), _bucket(F.col(stay), buckets).alias(_BUCKET))
    laid.hint("rebalance", F.col(item), F.col(_BUCKET)).write.mode("overwrite").partitionBy("buckets", item, _BUCKET).parquet(out)
    return out


def _layout(spark: SparkSession, out: str) -> int:
    """The number of buckets at ``out``, from the folder's names."""
    root = spark._jvm.org.apache.hadoop.fs.Path(out)
    names = [f.getPath().getName() for f in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
    found = [int(n.split("=")[1]) for n in names if n.startswith("buckets=")]
    if len(found) != 1:
        raise ValueError(f"{out} holds {len(found)} layouts; expected one written by ingest_events")
    return found[0]


def read_events(spark: SparkSession, out: str, schema: T.StructType, item: str, stay: str, items: Sequence | None = None,
                cohort: DataFrame | None = None) -> DataFrame:
    """Events of ``items`` (all if not given) whose stay is in ``cohort`` (all if not given), with the columns of
    ``schema``.  Both prune whole folders before anything is read; the cohort does so at run time, where its side of
    the join is small enough to be broadcast."""
    buckets = _layout(spark, out)
    partitioned = T.StructType([*schema.fields, T.StructField("buckets", T.IntegerType()), T.StructField(_BUCKET, T.IntegerType())])
    events = spark.read.schema(partitioned).parquet(out)
    if items is not None:
        events = events.where(F.col(item).isin(list(items)))
    if cohort is not None:
        key = F.col(stay).cast(schema[stay].dataType)
        wanted = cohort.select(key.alias(stay)).select(stay, _bucket(F.col(stay), buckets).alias(_BUCKET))
        events = events.join(wanted, [stay, _BUCKET], "left_semi")
    return events.select(*[f.name for f in schema.fields])
