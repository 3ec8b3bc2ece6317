"""Cohort building: first record per entity, horizon labels, joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import elapsed_hours, horizon_flag


def first_per_key(df: DataFrame, key: str, order_cols: Sequence[str], tiebreak: Sequence[str] = (),
                  compat: bool = False) -> DataFrame:
    """The earliest row per ``key`` by ``order_cols`` then ``tiebreak``.

    Written as one hash aggregation, ``min(struct(order, tiebreak, row))``,
    instead of a window: the aggregate combines map-side, so a key holding a
    third of all rows is reduced in every task before the shuffle and no task
    ever sorts a whole group.

    ``compat=True`` mimics pandas ``groupby.first()``: each column takes its
    first *non-null* value, which may come from a later row.
    """
    order = list(order_cols) + [c for c in tiebreak if c not in order_cols]
    payload = [c for c in df.columns if c != key]
    if not compat:
        # each column once: those that order the rows first, then the rest
        first = [c for c in order if c != key]
        held = first + [c for c in payload if c not in first]
        best = df.groupBy(key).agg(F.min(F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(held)])).alias("_best"))
        return best.select(key, *[F.col(f"_best._{held.index(c)}").alias(c) for c in payload])
    ordering = F.struct(*[F.col(c) for c in order])
    aggs = []
    for c in payload:
        if c in order:
            aggs.append(F.min_by(F.col(c), ordering).alias(c))
        else:
            aggs.append(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), ordering)).alias(c))
    return df.groupBy(key).agg(*aggs).select(key, *payload)


def horizon_labels(stays: DataFrame, origin: str, event_cols: Sequence[str], hours: float = 48.0,
                   label: str = "label", not_before: bool = False, keep_limit: str | None = None) -> DataFrame:
    """P10: ``label`` = 1 when any event time falls at or before ``origin + hours``."""
    out = stays.withColumn(label, horizon_flag(origin, hours, event_cols, not_before))
    if keep_limit:
        out = out.withColumn(keep_limit, F.col(origin) + F.expr(f"make_dt_interval(0, 0, 0, {hours * 3600.0})"))
    return out


def attach(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "left") -> DataFrame:
    """Many-to-one enrichment.  AQE turns it into a broadcast join when the
    measured right side is small; otherwise it stays a sort-merge join."""
    return left.join(right, on=on, how=how)


def in_cohort(events: DataFrame, cohort: DataFrame, key: str, cohort_key: str | None = None) -> DataFrame:
    """Keep events whose ``key`` belongs to the cohort (left-semi join)."""
    ids = cohort.select(F.col(cohort_key or key).alias(key)).where(F.col(key).isNotNull())
    return events.join(ids, on=key, how="left_semi")


def window_join(events: DataFrame, anchors: DataFrame, key: str, time_col: str, origin_col: str,
                lo_hours: float = 0.0, hi_hours: float = 24.0, hours_col: str = "hours") -> DataFrame:
    """Events joined to their anchor by ``key``, kept when
    ``lo_hours <= (time - origin) <= hi_hours`` (both ends inclusive).

    The key equality drives the join (hash/sort-merge or, when AQE measures the
    anchor side small, broadcast); the hour range is a residual predicate.
    Skewed keys are split by AQE's skew-join handling.
    """
    a = anchors.select(F.col(key), F.col(origin_col).alias("_origin"), *[
        c for c in anchors.columns if c not in (key, origin_col)])
    j = events.join(a, on=key, how="inner").withColumn(hours_col, elapsed_hours(time_col, "_origin"))
    j = j.where((F.col(hours_col) >= lo_hours) & (F.col(hours_col) <= hi_hours))
    return j.withColumnRenamed("_origin", origin_col)


def lookup(df: DataFrame, dictionary: DataFrame, key: str, fixed_size: bool = True,
           dict_key: str | None = None) -> DataFrame:
    """Map ``key`` through a dictionary table; unmapped rows are dropped.

    ``fixed_size=True`` is for code tables whose size is set by code, not data:
    they are broadcast.  Data-derived dictionaries are left to AQE, which
    broadcasts only after measuring them.
    """
    d = dictionary if dict_key is None else dictionary.withColumnRenamed(dict_key, key)
    if fixed_size:
        d = F.broadcast(d)
    return df.join(d, on=key, how="inner")


def wide_join(base: DataFrame, sides: Sequence[tuple[DataFrame | None, str]]) -> DataFrame:
    """Chain of left joins on unique keys; ``None``/skipped sides are ignored.

    Pass sides grouped by key (all subject-keyed sides, then all stay-keyed
    ones) so the base is re-partitioned once per key, not once per side.
    """
    out = base
    for side, key in sides:
        if side is None:
            continue
        dup = [c for c in side.columns if c != key and c in out.columns]
        if dup:
            side = side.drop(*dup)
        out = out.join(side, on=key, how="left")
    return out


def laid_wide_join(base: DataFrame, sides: Sequence[tuple[str, DataFrame, str]], lay: Callable[[str, DataFrame, str], DataFrame]) -> DataFrame:
    """J2 over stage tables.  ``sides`` are (name, table, key); ``lay(name, table, key)`` stores a table in buckets of its
    key.  Every side is laid out once and the base once per key, so no join of the chain moves a row; a lost executor
    costs the reading of its buckets."""
    with ThreadPoolExecutor(max_workers=max(1, len(sides))) as pool:
        # the sides do not depend on each other or on the base: their jobs share the cluster
        laid = [pool.submit(lay, name, side, key) for name, side, key in sides]
        out, by = base, None
        for (name, _, key), side in zip(sides, laid):
            if key != by:
                out, by = lay(f"base_{name}", out, key), key
            out = wide_join(out, [(side.result(), key)])
    return out
