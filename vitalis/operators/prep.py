"""Feature preparation (F1-F7): encoders, scaling, feature roles, class weights.

Encoders are tables (column, value, code) joined back, so the same fitted
encoding applies to train, validation and test and can be inspected or saved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import category_text
from .ranking import range_ranked

ID_COLUMNS = ("subject_id", "hadm_id", "stay_id")


def categorical_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """string-typed columns."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def feature_columns(df: DataFrame, target: str, drop: Sequence[str] = ID_COLUMNS) -> list[str]:
    """every column except ids and the target (and helper columns)."""
    skip = set(drop) | {target, "split", "variant", "weight", "shuffle_key"}
    return [c for c in df.columns if c not in skip]


def fit_label_codes(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F1 fit: per column, the distinct train values (as text, null -> 'nan') with
    code = lexicographic rank.  One (column, value, code) table for all columns, ranked by a range-partitioned
    sort: a column may have as many values as rows."""
    if not cols:
        return train.sparkSession.createDataFrame([], "column string, value string, code int, freq bigint")
    # one scan for all columns, combined map-side before the shuffle
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), category_text(c).alias("value")) for c in cols]))
    d = train.select(cells.alias("_x")).select("_x.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("freq"))
    return range_ranked(d, ["column"], ["value"], "code").select("column", "value", F.col("code").cast("int").alias("code"), "freq")


def apply_label_codes(df: DataFrame, codes: DataFrame, cols: Sequence[str], unseen: str = "minus_one") -> DataFrame:
    """F1/F2 apply: replace each categorical column by its code.

    ``unseen='minus_one'`` (F1) gives -1 to values not seen in train;
    ``unseen='mode'`` (F2) gives them the code of the most frequent train value."""
    out = df
    for c in cols:
        cc = codes.where(F.col("column") == c)
        m = cc.select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
        out = out.withColumn(f"_v_{c}", category_text(c)).join(m, on=f"_v_{c}", how="left")
        if unseen == "mode":
            mode = cc.orderBy(F.desc("freq"), "value").select(F.col("code").alias(f"_m_{c}")).limit(1)
            out = out.crossJoin(F.broadcast(mode))
            fill = F.col(f"_m_{c}")
        else:
            fill = F.lit(-1)
        out = out.withColumn(c, F.coalesce(F.col(f"_c_{c}"), fill).cast("int")).drop(f"_v_{c}", f"_c_{c}", f"_m_{c}")
    return out.select(*df.columns)


def decode_label_codes(df: DataFrame, codes: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F3 inverse: round, clip to [0, n-1] and map codes back to values."""
    out = df
    for c in cols:
        cc = codes.where(F.col("column") == c)
        n = cc.agg(F.max("code").alias(f"_n_{c}"))
        m = cc.select(F.col("code").alias(f"_k_{c}"), F.col("value").alias(f"_d_{c}"))
        out = (out.crossJoin(F.broadcast(n))
                  .withColumn(f"_k_{c}", F.least(F.greatest(F.round(F.col(c)).cast("int"), F.lit(0)), F.col(f"_n_{c}")))
                  .join(m, on=f"_k_{c}", how="left")
                  .withColumn(c, F.col(f"_d_{c}")).drop(f"_k_{c}", f"_d_{c}", f"_n_{c}"))
    return out.select(*df.columns)


def fit_scaler(train: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """F4 fit: mean and *population* std per column (one-row collect)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m|{c}"), F.stddev_pop(c).alias(f"s|{c}")]
    row = train.agg(*aggs).first()
    return {c: (row[f"m|{c}"] or 0.0, row[f"s|{c}"] or 0.0) for c in cols}


def apply_scaler(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    """F4 apply: z-score; a constant column (std 0) becomes x - mean."""
    def z(c):
        m, s = stats[c]
        return ((F.col(c) - F.lit(m)) / F.lit(s if s else 1.0)).alias(c)
    return df.select(*[z(c) if c in stats else F.col(c) for c in df.columns])


def class_weights(df: DataFrame, target: str, weight_col: str = "weight") -> DataFrame:
    """'balanced' weights n / (k * n_class) as a column (k = number of classes)."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = counts.crossJoin(tot).select(target, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(weight_col))
    return df.join(F.broadcast(w), on=target, how="left")
