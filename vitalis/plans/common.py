"""Shared helpers for the bound plans: table loading, rounding, SQL builders."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from ..sources.bucketed import read_bucketed, write_bucketed

DIGITS = 6  # floating outputs are rounded so the oracle comparison is exact


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def source_version(spark: SparkSession, sf_dir: str) -> str:
    """A digest of the source folder's files (path, size, time): equal as long as none was changed."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(sf_dir)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath().toString()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.md5("\n".join(sorted(seen)).encode()).hexdigest()


def stage_folder(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, bool]:
    """Where a stage's output for this source lies in the session's checkpoint folder, and whether it was written whole."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stages/{source_version(spark, sf_dir)}/{name}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return path, done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def laid_stage(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], DataFrame], key: str) -> DataFrame:
    """A stage's output in buckets of ``key``, as many as the session has shuffle partitions: written once per state of
    the source, then read."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, done = stage_folder(spark, sf_dir, f"{name}.{key}.{buckets}")
    return read_bucketed(spark, path, key, buckets) if done else write_bucketed(make(), path, key, buckets)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round every floating column (double/float) to ``digits``."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def ts_text(c: str | F.Column) -> F.Column:
    """Timestamp as 'yyyy-MM-dd HH:mm:ss' text (same rendering in both engines)."""
    return F.date_format(F.col(c) if isinstance(c, str) else c, "yyyy-MM-dd HH:mm:ss")


def sql_round(expr: str, digits: int = DIGITS) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits})"


def sql_pivot(key: str, type_col: str, types: Sequence[str], stats: Sequence[str], src: str,
              count_stats: Sequence[str] = ("count",)) -> str:
    """Conditional-aggregation pivot of a long (key, type, stats...) relation."""
    cols = []
    for t in types:
        for s in stats:
            inner = f"max(CASE WHEN {type_col} = '{t}' THEN {s} END)"
            if s in count_stats:
                cols.append(f"CAST({inner} AS BIGINT) AS {t}_{s}")
            else:
                cols.append(f"{sql_round(inner)} AS {t}_{s}")
    return f"SELECT {key}, " + ", ".join(cols) + f" FROM {src} GROUP BY {key}"


SQL_STAT = {
    "mean": "avg({v})",
    "max": "max({v})",
    "min": "min({v})",
    "std": "stddev_samp({v})",
    "count": "count({v})",
}


def sql_stats(value: str, stats: Sequence[str]) -> str:
    return ", ".join(f"{SQL_STAT[s].format(v=value)} AS {s}" for s in stats)
