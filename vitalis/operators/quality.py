"""Data quality: filters, range rules, class and missing-value profiles,
sparse-column removal and imputation (P4-P6, A7-A12, D1, D2).

Profiles are one aggregation pass each (all columns at once) followed by an
unpivot, so their cost is one scan regardless of the number of columns.  The
only driver round trips are one-row results (ratios, means) that decide a
schema or a constant.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nan_to_null, safe_ratio, sql_ident

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def _unpivot(row: DataFrame, names: Sequence[str], name_col: str, value_col: str,
             value_type: str = "double") -> DataFrame:
    """One wide row of values per name -> (name, value) rows (``stack``)."""
    if not names:
        return row.sparkSession.createDataFrame([], f"{name_col} string, {value_col} {value_type}")
    args = ", ".join(f"'{n}', CAST({sql_ident(n)} AS {value_type})" for n in names)
    return row.selectExpr(f"stack({len(names)}, {args}) AS ({name_col}, {value_col})")


def nans_to_nulls(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    """Map NaN to null on floating columns (input hygiene for range rules)."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    todo = floats if cols is None else floats & set(cols)
    return df.select(*[nan_to_null(c).alias(c) if c in todo else F.col(c) for c in df.columns])


def min_value_filter(df: DataFrame, col: str, min_value: float, optional: bool = True) -> DataFrame:
    """Keep rows with ``col >= min_value``.  A missing column is skipped
    when ``optional`` (the original silently skips it), else an error."""
    if col not in df.columns:
        if optional:
            return df
        raise ValueError(f"column {col!r} is required for the filter")
    return df.where(F.col(col) >= min_value)


def _violation(col: str, lo, hi):
    conds = []
    if lo is not None:
        conds.append(F.col(col) < F.lit(lo))
    if hi is not None:
        conds.append(F.col(col) > F.lit(hi))
    if not conds:
        return F.lit(False)
    return F.coalesce(reduce(lambda a, b: a | b, conds), F.lit(False))


def applicable_rules(df: DataFrame, rules: Sequence[tuple[str, float | None, float | None]]):
    """Rules whose column exists; the rest never fire (reported by ``unmatched_rules``)."""
    return [r for r in rules if r[0] in df.columns]


def unmatched_rules(df: DataFrame, rules) -> list[str]:
    return [r[0] for r in rules if r[0] not in df.columns]


def any_violation(df: DataFrame, rules):
    rs = applicable_rules(df, rules)
    if not rs:
        return F.lit(False)
    return reduce(lambda a, b: a | b, [_violation(c, lo, hi) for c, lo, hi in rs])


def range_filter(df: DataFrame, rules) -> DataFrame:
    """P5: drop a row when any rule fires (``x < min`` or ``x > max``, strict).
    Null passes; rules on absent columns are ignored."""
    return df.where(~any_violation(df, rules))


def range_report(df: DataFrame, rules) -> DataFrame:
    """Violations per (column, side) in one pass, plus the distinct rows removed
    (``column = '*'``, side ``'any'``)."""
    rs = applicable_rules(df, rules)
    aggs, names = [], []
    for c, lo, hi in rs:
        for side, bound in (("min", lo), ("max", hi)):
            if bound is None:
                continue
            cond = _violation(c, lo if side == "min" else None, hi if side == "max" else None)
            name = f"{c}|{side}|{float(bound)!r}"
            aggs.append(F.count_if(cond).alias(name))
            names.append(name)
    aggs.append(F.count_if(any_violation(df, rules)).alias("*|any|nan"))
    names.append("*|any|nan")
    row = df.agg(*aggs)
    long = _unpivot(row, names, "key", "violations", "bigint")
    parts = F.split("key", r"\|")
    return long.select(parts[0].alias("column"), parts[1].alias("side"),
                       F.when(parts[2] != "nan", parts[2].cast("double")).alias("bound"), "violations")


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Count and share per class (share of all rows)."""
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(
        target, "n", safe_ratio("n", "total").alias("share"))


def cohort_summary(df: DataFrame, target: str, positive=1) -> DataFrame:
    """N, positives, positive rate and imbalance n0/n1 in one row."""
    pos = F.count_if(F.col(target) == positive)
    neg = F.count_if(F.col(target) != positive)
    return df.agg(F.count(F.lit(1)).alias("n"), pos.alias("positives"),
                  safe_ratio(pos, F.count(F.lit(1))).alias("rate"),
                  F.try_divide(neg.cast("double"), pos.cast("double")).alias("imbalance"))


def missing_ratios(df: DataFrame, cols: Sequence[str] | None = None, only_missing: bool = False,
                   top: int | None = None) -> DataFrame:
    """Fraction of nulls per column, one pass, sorted descending (name breaks ties)."""
    cols = list(cols) if cols is not None else df.columns
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols])
    long = _unpivot(row, cols, "column", "missing_ratio")
    if only_missing:
        long = long.where(F.col("missing_ratio") > 0)
    long = long.orderBy(F.desc("missing_ratio"), "column")
    return long.limit(top) if top else long


def missing_thresholds(ratios: DataFrame) -> DataFrame:
    """Number of columns with >= 10 %, < 10 % and < 50 % missing."""
    r = F.col("missing_ratio")
    return ratios.agg(F.count_if(r >= 0.1).alias("n_ge_10pct"), F.count_if(r < 0.1).alias("n_lt_10pct"),
                      F.count_if(r < 0.5).alias("n_lt_50pct"))


def flag_prevalence(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """A10: count and percentage of rows with each flag = 1."""
    total = F.count(F.lit(1))
    aggs = [F.count_if(F.col(f) == 1).alias(f) for f in flags] + [total.alias("_total")]
    row = df.agg(*aggs)
    long = _unpivot(row.drop("_total"), list(flags), "flag", "n", "bigint")
    return long.crossJoin(row.select("_total")).select(
        "flag", "n", (safe_ratio("n", "_total") * 100.0).alias("pct"))


def null_row_count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows having at least one null among ``cols``."""
    cols = list(cols) if cols is not None else df.columns
    anynull = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    return df.agg(F.count_if(anynull).alias("rows_with_null"), F.count(F.lit(1)).alias("rows"))


def sparse_columns(df: DataFrame, threshold: float = 0.5, keep: Sequence[str] = ()) -> list[str]:
    """Columns whose null ratio is ``>= threshold`` (one-row driver collect)."""
    cols = [c for c in df.columns if c not in keep]
    if not cols:
        return []
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is not None and row[c] >= threshold]


def drop_sparse(df: DataFrame, threshold: float = 0.5, keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns with null ratio ``>= threshold``, then rows with any null."""
    dropped = sparse_columns(df, threshold, keep)
    return df.drop(*dropped).dropna(how="any")


def fit_means(train: DataFrame, cols: Sequence[str] | None = None) -> dict[str, float]:
    """D2 fit: train means of the numeric columns that have nulls in train."""
    cols = [f.name for f in train.schema.fields
            if isinstance(f.dataType, NUMERIC) and (cols is None or f.name in cols)]
    if not cols:
        return {}
    aggs = []
    for c in cols:
        aggs += [F.count_if(F.col(c).isNull()).alias(f"n|{c}"), F.avg(c).alias(f"m|{c}")]
    row = train.agg(*aggs).first()
    return {c: row[f"m|{c}"] for c in cols if row[f"n|{c}"] > 0 and row[f"m|{c}"] is not None}


def impute(df: DataFrame, means: dict[str, float]) -> DataFrame:
    """D2 apply: fill nulls with the train means (same constants for val/test)."""
    return df.select(*[F.coalesce(F.col(c), F.lit(means[c])).cast(df.schema[c].dataType).alias(c)
                       if c in means and isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType))
                       else (F.coalesce(F.col(c).cast("double"), F.lit(means[c])).alias(c) if c in means
                             else F.col(c))
                       for c in df.columns])
