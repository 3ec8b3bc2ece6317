"""Tables laid out in buckets of their key, so that joins on it need no exchange.

A bucketed layout is known to Spark through the catalog only, so each folder gets a table of its own: ``write_bucketed``
makes it, and ``read_bucketed`` makes it again in a session whose catalog does not know it.  Both take the number of
buckets; it belongs to the layout, so callers keep it in the folder's name.  Rows of one key share a bucket: lay out
tables with one row per key, or few.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_name(path: str) -> str:
    return f"vitalis_{hashlib.md5(path.encode()).hexdigest()}"


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` to ``path`` in ``buckets`` buckets of ``key``, one file each, and read it back so.  Null keys share a
    bucket; an empty table keeps its schema."""
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table_name(path)}")
    (df.repartition(buckets, F.col(key)).write.format("parquet").mode("overwrite").option("path", path)
       .bucketBy(buckets, key).sortBy(key).saveAsTable(table_name(path)))
    return spark.table(table_name(path))


def read_bucketed(spark: SparkSession, path: str, key: str, buckets: int) -> DataFrame:
    """The table that ``write_bucketed`` laid out at ``path``, with its buckets."""
    name = table_name(path)
    if not spark.catalog.tableExists(name):
        schema = spark.read.parquet(path).schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)
