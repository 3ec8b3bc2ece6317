"""Feature aggregation: windowed statistics, pivots, flags, first measures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import contains_any_ci, matches_ci, prefix_any, to_number

STAT_FUNCS = {
    "mean": F.avg,
    "max": F.max,
    "min": F.min,
    "std": F.stddev_samp,   # sample std: one reading -> null
    "count": F.count,
}


def window_stats(events: DataFrame, keys: Sequence[str], value_col: str,
                 stats: Sequence[str] = ("mean", "max", "min", "std", "count")) -> DataFrame:
    """A1/A2: per key group, statistics over the non-null values.

    A group whose values are all null produces no row (and so no columns after
    the pivot), as in the original.  One hash aggregate with map-side partial
    aggregation: a hot group is pre-reduced in every task.
    """
    valid = events.where(F.col(value_col).isNotNull())
    aggs = [STAT_FUNCS[s](value_col).alias(s) for s in stats]
    out = valid.groupBy(*keys).agg(*aggs)
    if "count" in stats:
        out = out.withColumn("count", F.col("count").cast("bigint"))
    return out


def pivot_stats(long: DataFrame, key: str, type_col: str, types: Sequence[str],
                stats: Sequence[str] = ("mean", "max", "min", "std", "count")) -> DataFrame:
    """A3: long (key, type, stats...) -> wide ``{type}_{stat}`` columns.

    Pivot values are explicit, so the output schema is fixed (absent types are
    null columns) and Spark does not run a distinct job to discover them.  The
    input is already one row per (key, type), so the pivot aggregates little.
    """
    aggs = [F.first(s).alias(s) for s in stats]
    wide = long.groupBy(key).pivot(type_col, list(types)).agg(*aggs)
    if len(stats) == 1:  # Spark names single-aggregate pivot columns by value only
        wide = wide.select(key, *[F.col(t).alias(f"{t}_{stats[0]}") for t in types])
    cols = [f"{t}_{s}" for t in types for s in stats]
    return wide.select(key, *cols)


def measure_features(events: DataFrame, key: str, type_col: str, value_col: str, types: Sequence[str],
                     stats: Sequence[str] = ("mean", "max", "min", "std", "count")) -> DataFrame:
    """A1 + A3: windowed events -> one wide row per key."""
    long = window_stats(events.where(F.col(type_col).isin(list(types))), [key, type_col], value_col, stats)
    return pivot_stats(long, key, type_col, types, stats)


def any_flags(codes: DataFrame, entity: str, code_col: str, flags: Mapping[str, Sequence[str]],
              entities: DataFrame | None = None, normalise_dots: bool = False) -> DataFrame:
    """A4: per entity, flag = 1 when any of its codes starts with a listed prefix.

    All flags come from one aggregation pass (``max`` of a prefix test per
    flag), not one join per flag.  With ``entities`` every listed entity gets a
    row and entities without codes get 0.
    """
    aggs = [F.max(prefix_any(code_col, p, normalise_dots).cast("int")).alias(name) for name, p in flags.items()]
    per = codes.groupBy(entity).agg(*aggs)
    if entities is None:
        return per
    return _default_zero(per, entity, list(flags), entities)


def _default_zero(per: DataFrame, entity: str, flags: Sequence[str], entities: DataFrame) -> DataFrame:
    base = entities.select(entity).distinct()
    out = base.join(per, on=entity, how="left")
    return out.select(entity, *[F.coalesce(F.col(n), F.lit(0)).cast("int").alias(n) for n in flags])


def flagged_only(flags_df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Rows of a per-code flag table with at least one flag set."""
    return flags_df.where(F.greatest(*[F.col(n) for n in flags]) == 1) if len(flags) > 1 else \
        flags_df.where(F.col(flags[0]) == 1)


def rollup_flags(df: DataFrame, entity: str, flags: Sequence[str], entities: DataFrame | None = None) -> DataFrame:
    """Lift 0/1 flags to a coarser entity (``max`` per entity, combined
    map-side), e.g. part -> order -> customer; listed entities without rows get 0."""
    per = df.groupBy(entity).agg(*[F.max(n).cast("int").alias(n) for n in flags])
    return per if entities is None else _default_zero(per, entity, flags, entities)


def keyword_flags(rows: DataFrame, entity: str, name_col: str, value_col: str,
                  flags: Mapping[str, tuple[Sequence[str], str]], entities: DataFrame | None = None) -> DataFrame:
    """A5: flag = 1 when some row's name contains a keyword (case-insensitive)
    and its lower-cased value matches the flag's regex; default 0."""
    aggs = []
    for name, (keywords, pattern) in flags.items():
        hit = contains_any_ci(name_col, keywords) & matches_ci(value_col, pattern)
        aggs.append(F.max(hit.cast("int")).alias(name))
    per = rows.groupBy(entity).agg(*aggs)
    if entities is None:
        return per.select(entity, *[F.coalesce(F.col(n), F.lit(0)).cast("int").alias(n) for n in flags])
    base = entities.select(entity).distinct()
    out = base.join(per, on=entity, how="left")
    return out.select(entity, *[F.coalesce(F.col(n), F.lit(0)).cast("int").alias(n) for n in flags])


def first_measure(rows: DataFrame, entity: str, name_col: str, value_col: str, order_cols: Sequence[str],
                  names: Sequence[str], numeric: bool = True) -> DataFrame:
    """Per (entity, name) the earliest non-null value, pivoted to one column per name.

    The value is chosen before numeric coercion (text that is not a number
    becomes null afterwards, as in the original).  ``min_by`` with a null
    ordering for null values skips them; it aggregates map-side.
    """
    ordering = F.struct(*[F.col(c) for c in order_cols])
    picked = (rows.where(F.col(name_col).isin(list(names)))
                  .groupBy(entity, name_col)
                  .agg(F.min_by(F.col(value_col), F.when(F.col(value_col).isNotNull(), ordering)).alias("v")))
    wide = picked.groupBy(entity).pivot(name_col, list(names)).agg(F.first("v"))
    cols = [to_number(F.col(n)).alias(n) if numeric else F.col(n) for n in names]
    return wide.select(entity, *cols)


def anthropometrics(measures: DataFrame, entity: str, aliases: Mapping[str, Sequence[str]],
                    inch_to_cm: float, lb_to_kg: float, mode: str = "row",
                    present: Sequence[str] | None = None) -> DataFrame:
    """Height (cm), weight (kg) and BMI from first measures.

    ``mode='row'`` takes, per row, the first alias that has a value.
    ``mode='table'`` keeps the original's rule: the first alias *present in the
    table* wins for every row; ``present`` lists the names that occur (the
    caller computes it once).  BMI prefers a recorded BMI and is otherwise
    computed from height and weight when both exist.
    """
    def pick(names: Sequence[str]):
        if not names:
            return F.lit(None).cast("double")
        if mode == "row":
            return F.coalesce(*[F.col(n) for n in names])
        for n in names:
            if present is None or n in present:
                return F.col(n)
        return F.lit(None).cast("double")

    height = pick(aliases["height"]) * inch_to_cm
    weight = pick(aliases["weight"]) * lb_to_kg
    recorded = pick(aliases["bmi"])
    out = measures.select(entity, height.alias("height_cm"), weight.alias("weight_kg"), recorded.alias("_bmi"))
    computed = F.try_divide(F.col("weight_kg"), (F.col("height_cm") / 100.0) * (F.col("height_cm") / 100.0))
    if mode == "table" and present is not None and any(n in present for n in aliases["bmi"]):
        bmi_col = F.col("_bmi")
    else:
        bmi_col = F.coalesce(F.col("_bmi"), computed)
    return out.select(entity, "height_cm", "weight_kg", bmi_col.alias("bmi"))
