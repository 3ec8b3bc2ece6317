"""Readers and sinks.

Every reader declares its schema: nothing is inferred, so a job that runs on
one extract runs on the next, and a missing optional source becomes an empty
table with the same columns rather than a missing one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Schemas of the clinical extract the engine was designed around.  Only the
# columns the operators read are declared; a file may hold others, in any order.
CLINICAL_SCHEMAS: dict[str, T.StructType] = {
    "patients": T.StructType([
        T.StructField("subject_id", T.LongType()),
        T.StructField("gender", T.StringType()),
        T.StructField("anchor_age", T.IntegerType()),
        T.StructField("dod", T.TimestampType()),
    ]),
    "admissions": T.StructType([
        T.StructField("hadm_id", T.LongType()),
        T.StructField("deathtime", T.TimestampType()),
        T.StructField("hospital_expire_flag", T.IntegerType()),
    ]),
    "icustays": T.StructType([
        T.StructField("subject_id", T.LongType()),
        T.StructField("hadm_id", T.LongType()),
        T.StructField("stay_id", T.LongType()),
        T.StructField("first_careunit", T.StringType()),
        T.StructField("intime", T.TimestampType()),
        T.StructField("outtime", T.TimestampType()),
        T.StructField("los", T.DoubleType()),
    ]),
    "diagnoses_icd": T.StructType([
        T.StructField("subject_id", T.LongType()),
        T.StructField("hadm_id", T.LongType()),
        T.StructField("icd_code", T.StringType()),
    ]),
    "omr": T.StructType([
        T.StructField("subject_id", T.LongType()),
        T.StructField("chartdate", T.DateType()),
        T.StructField("result_name", T.StringType()),
        T.StructField("result_value", T.StringType()),
    ]),
    "chartevents": T.StructType([
        T.StructField("stay_id", T.LongType()),
        T.StructField("itemid", T.IntegerType()),
        T.StructField("charttime", T.TimestampType()),
        T.StructField("valuenum", T.DoubleType()),
    ]),
    "labevents": T.StructType([
        T.StructField("hadm_id", T.LongType()),
        T.StructField("itemid", T.IntegerType()),
        T.StructField("charttime", T.TimestampType()),
        T.StructField("valuenum", T.DoubleType()),
    ]),
}


def _hadoop_path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def read_source(spark: SparkSession, path: str, schema: T.StructType | None = None,
                fmt: str | None = None) -> DataFrame:
    """Read a table with a declared schema.

    CSV is read with a header and ``''`` as null (what the original extract
    used); Parquet keeps its own footer schema unless one is given.  CSV
    columns are bound by name: a file may hold other columns, in any order,
    and a declared column that it lacks is an error.
    """
    fmt = fmt or ("csv" if path.endswith((".csv", ".csv.gz")) else "parquet")
    if fmt == "csv":
        return _read_csv(spark, path, schema)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(path)


def _read_csv(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    """A CSV table with the declared columns, found by the header's names.

    Spark binds a user schema by position, so it is given one in file order
    (undeclared columns as text); ``enforceSchema=false`` makes it check every
    file's header against that order.  Only the declared columns are parsed."""
    options = {"header": "true", "nullValue": "", "mode": "FAILFAST"}
    header = spark.read.options(**options).csv(path).columns     # reads the first line only
    if schema is None:
        return spark.read.options(**options).csv(path)
    declared = {f.name.lower(): f for f in schema.fields}
    missing = sorted(set(declared) - {h.lower() for h in header})
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    in_file = T.StructType([T.StructField(h, declared[h.lower()].dataType if h.lower() in declared else T.StringType())
                            for h in header])
    df = spark.read.schema(in_file).options(**options, enforceSchema="false").csv(path)
    return df.select(*[df[f"`{f.name}`"].alias(f.name) for f in schema.fields])


def optional_source(spark: SparkSession, path: str | None, schema: T.StructType,
                    fmt: str | None = None) -> DataFrame:
    """Like ``read_source``, but a missing path gives an empty table of ``schema``."""
    if path and _hadoop_path_exists(spark, path):
        return read_source(spark, path, schema, fmt)
    return spark.createDataFrame([], schema)


def safe_load(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """``None`` when a stage output is missing or unreadable; the caller skips."""
    try:
        if not _hadoop_path_exists(spark, path):
            return None
        df = spark.read.format(fmt).load(path)
        df.schema  # resolve now so an unreadable footer fails here
        return df
    except Exception:  # noqa: BLE001 - any read failure means "not available"
        return None


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Iterable[str] = (),
                mode: str = "overwrite") -> None:
    """Write one stage output.  Parquet by default; CSV keeps a header."""
    w = df.write.mode(mode)
    cols = list(partition_by)
    if cols:
        w = w.partitionBy(*cols)
    if fmt == "csv":
        w.option("header", "true").csv(path)
    else:
        w.format(fmt).save(path)


def save_model(model, path: str) -> str:
    """Persist an MLlib model (overwrite)."""
    model.write().overwrite().save(path)
    return path


def load_model(cls, path: str):
    """Load a model saved by ``save_model``; ``cls`` is the model class."""
    return cls.load(path)
