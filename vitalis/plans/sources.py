"""Source and sink plans (S1, S2, S4, S5) with oracle SQL.

Round trips write under the session's checkpoint folder (the shared folder
named by ``spark.checkpoint.dir`` on a cluster) and read back with declared
schemas; the result must equal the source table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import to_ts
from ..operators.features import keyword_flags
from ..session import ensure_checkpoint_dir
from ..sources.codes import LIFESTYLE_FLAGS
from ..sources.ingest import ingest_events, read_events
from ..sources.tables import CLINICAL_SCHEMAS, optional_source, read_source, safe_load, write_table
from . import extraction as X
from . import reporting as RP
from .common import rounded, table

CUSTOMER_SCHEMA = T.StructType([
    T.StructField("c_custkey", T.LongType()),
    T.StructField("c_name", T.StringType()),
    T.StructField("c_nationkey", T.IntegerType()),
    T.StructField("c_acctbal", T.DoubleType()),
    T.StructField("c_mktsegment", T.StringType()),
])
ATTRIBUTION_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("row_id", T.LongType()),
    T.StructField("feature", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("attribution", T.DoubleType()),
])


def scratch_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/tables/{name}-{uuid.uuid4().hex}"


def q_csv_round_trip(spark, sf):
    """S4 (CSV sink) + S1 (CSV source with a declared schema)."""
    path = scratch_path(spark, "customer_csv")
    write_table(table(spark, sf, "customer"), path, fmt="csv")
    return rounded(read_source(spark, path, CUSTOMER_SCHEMA, fmt="csv"))


def q_csv_by_name(spark, sf):
    """A CSV with reordered and extra columns, read by the declared names."""
    path = scratch_path(spark, "customer_shuffled_csv")
    c = table(spark, sf, "customer").select("c_mktsegment", F.lit("x").alias("extra"), "c_acctbal", "c_name",
                                            (F.col("c_custkey") + 1).alias("other_key"), "c_custkey", "c_nationkey")
    write_table(c, path, fmt="csv")
    return rounded(read_source(spark, path, CUSTOMER_SCHEMA, fmt="csv"))


def q_text_times(spark, sf):
    """Order dates written as text and parsed back."""
    text = table(spark, sf, "orders").select("o_orderkey", X.ts_text("o_orderdate").alias("t"))
    return text.select("o_orderkey", X.ts_text(to_ts("t", "yyyy-MM-dd HH:mm:ss")).alias("parsed"),
                       F.year(to_ts("t")).alias("year"))


def q_parquet_round_trip(spark, sf):
    """S4 (Parquet sink) + S7 (safe load) of the first-stay table."""
    path = scratch_path(spark, "first_stays")
    write_table(X.first_stays(spark, sf), path)
    back = safe_load(spark, path)
    assert back is not None
    return rounded(back.select("subject_id", "stay_id", X.ts_text("intime").alias("intime"),
                               "o_orderstatus", "o_orderpriority", "o_totalprice"))


def q_optional_source(spark, sf):
    """A missing optional source is an empty table of its schema, and the
    flags built from it fall back to 0 for every subject."""
    omr = optional_source(spark, scratch_path(spark, "missing_omr"), CLINICAL_SCHEMAS["omr"])
    subjects = X.first_stays(spark, sf).select("subject_id")
    return keyword_flags(omr, "subject_id", "result_name", "result_value", LIFESTYLE_FLAGS, entities=subjects)


def q_json_round_trip(spark, sf):
    """Attribution long table written as JSON and read back with its schema."""
    path = scratch_path(spark, "attributions_json")
    write_table(RP.attributions(spark, sf), path, fmt="json")
    return rounded(spark.read.schema(ATTRIBUTION_SCHEMA).json(path))


EVENT_FILE = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
                           T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
GZ_ITEMS = ["click", "view"]


def q_gz_ingest(spark, sf):
    """The events as gzipped CSV files, read once into the pruned layout; then two items of a cohort from it."""
    raw, out = scratch_path(spark, "events_gz"), scratch_path(spark, "events_laid")
    names = [f.name for f in EVENT_FILE.fields]
    table(spark, sf, "events").select(*names).write.mode("overwrite").option("header", "true").option("compression", "gzip").csv(raw)
    ingest_events(spark, raw, EVENT_FILE, out, "event_type", "user_id", buckets=16, fmt="csv")
    cohort = table(spark, sf, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id"))
    kept = read_events(spark, out, EVENT_FILE, "event_type", "user_id", GZ_ITEMS, cohort)
    return rounded(kept.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


QUERIES = {
    "s3_gz_ingest": q_gz_ingest,
    "s1_csv_by_name": q_csv_by_name,
    "p8_text_times": q_text_times,
    "s1_s4_csv_round_trip": q_csv_round_trip,
    "s4_s7_parquet_round_trip": q_parquet_round_trip,
    "s2_optional_source": q_optional_source,
    "s5_json_round_trip": q_json_round_trip,
}

SQL = {
    "s3_gz_ingest": f"""SELECT user_id, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events
        WHERE event_type IN ({', '.join(f"'{i}'" for i in GZ_ITEMS)}) AND user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)
        GROUP BY user_id, event_type""",
    "s1_csv_by_name": "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer",
    "p8_text_times": """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS parsed,
        CAST(year(o_orderdate) AS INTEGER) AS year FROM orders""",
    "s1_s4_csv_round_trip": "SELECT c_custkey, c_name, c_nationkey, round(c_acctbal, 6) AS c_acctbal, c_mktsegment FROM customer",
    "s4_s7_parquet_round_trip": X.SQL["w1_first_stay"],
    "s2_optional_source": f"""WITH {X.SQL_FIRST_STAYS}
        SELECT DISTINCT subject_id, 0 AS smoking_omr, 0 AS alcohol_omr FROM first_stays""",
    "s5_json_round_trip": RP.SQL["m18_linear_attributions"],
}

