"""Scalar column expressions.

All are built from ``pyspark.sql.functions`` so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = Column | str


def _c(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: ColumnLike) -> Column:
    """NaN -> null.  Range rules compare with ``<``/``>``; in Spark NaN is larger
    than every number, so NaN must be missing (as in pandas) before they run."""
    return F.nanvl(_c(c), F.lit(None).cast("double"))


def to_number(c: ColumnLike) -> Column:
    """Non-numeric text -> null (``try_cast``; a plain cast throws under ANSI)."""
    return _c(c).cast("string").try_cast("double")


def number(df: DataFrame, name: str) -> Column:
    """P7 for a column of ``df``: numeric columns as they are, text through ``to_number``."""
    return F.col(name).cast("double") if isinstance(df.schema[name].dataType, T.NumericType) else to_number(name)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null equals null; keys come from the left side."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(r, cond, how).drop(*[f"_r_{k}" for k in keys])


def to_ts(c: ColumnLike, fmt: str | None = None) -> Column:
    """Text -> timestamp."""
    return F.to_timestamp(_c(c), fmt) if fmt else F.to_timestamp(_c(c))


def epoch_micros(c: ColumnLike) -> Column:
    """Microseconds since the epoch for a timestamp, timestamp_ntz or date column."""
    return F.unix_micros(_c(c).cast("timestamp"))


def elapsed_micros(t: ColumnLike, origin: ColumnLike) -> Column:
    """Wall-clock microseconds from ``origin`` to ``t``.  ``timestamp_diff``
    counts local date-time, like the naive datetimes of the original (and the
    oracle): an hour lost or gained at a DST change in the session time zone
    does not shift windows."""
    return F.timestamp_diff("MICROSECOND", _c(origin), _c(t))


def elapsed_hours(t: ColumnLike, origin: ColumnLike) -> Column:
    """(t - origin) in fractional hours."""
    return elapsed_micros(t, origin) / F.lit(3.6e9)


def horizon_flag(origin: ColumnLike, hours: float, events: Sequence[ColumnLike],
                 not_before: bool = False) -> Column:
    """P10: 1 when any non-null event time is ``<= origin + hours`` (inclusive).

    The original has no lower bound, so an event before the origin counts;
    ``not_before=True`` adds ``event >= origin``.  All-null -> 0.
    """
    limit = F.lit(int(round(hours * 3.6e9)))
    conds = []
    for e in events:
        d = elapsed_micros(e, origin)
        cond = d <= limit
        if not_before:
            cond = cond & (d >= 0)
        conds.append(F.coalesce(cond, F.lit(False)))
    return reduce(lambda a, b: a | b, conds).cast("int")


def prefix_any(c: ColumnLike, prefixes: Iterable[str], normalise_dots: bool = False) -> Column:
    """``str(code).startswith(any prefix)``; null -> false.

    Prefixes are de-duplicated (set semantics).  ``normalise_dots`` strips dots
    on both sides, so ``'E78.5'`` also matches a stored ``'E785'``.
    """
    code = _c(c).cast("string")
    ps = list(dict.fromkeys(prefixes))
    if normalise_dots:
        code = F.regexp_replace(code, r"\.", "")
        ps = list(dict.fromkeys(p.replace(".", "") for p in ps))
    if not ps:
        return F.lit(False)
    return F.coalesce(reduce(lambda a, b: a | b, [code.startswith(p) for p in ps]), F.lit(False))


def contains_any_ci(c: ColumnLike, keywords: Iterable[str]) -> Column:
    """Case-insensitive substring test against any keyword; null -> false."""
    low = F.lower(_c(c))
    kws = list(dict.fromkeys(k.lower() for k in keywords))
    return F.coalesce(reduce(lambda a, b: a | b, [low.contains(k) for k in kws]), F.lit(False))


def matches_ci(c: ColumnLike, pattern: str) -> Column:
    """lower(value) contains a match of ``pattern`` (regex find); null -> false."""
    return F.coalesce(F.lower(_c(c)).rlike(pattern), F.lit(False))


def indicator(c: ColumnLike, value) -> Column:
    """1 when ``c == value``; anything else, null included, -> 0."""
    return F.coalesce(_c(c) == F.lit(value), F.lit(False)).cast("int")


def one_hot_name(category: str, prefix: str = "icu_") -> str:
    """P15 naming: text before '(' trimmed, spaces -> '_', lower-cased, prefixed."""
    return prefix + category.split("(")[0].strip().replace(" ", "_").lower()


def one_hot(c: ColumnLike, categories: Sequence[str], prefix: str = "icu_") -> list[Column]:
    """One indicator column per listed category."""
    return [indicator(c, v).alias(one_hot_name(v, prefix)) for v in categories]


def either_flag(*flags: ColumnLike) -> Column:
    """1 when any given flag is 1 (null counts as 0)."""
    return reduce(lambda a, b: a | b, [F.coalesce(_c(f) == 1, F.lit(False)) for f in flags]).cast("int")


def category_text(c: ColumnLike) -> Column:
    """String form of a category; null becomes the text 'nan' as in the original."""
    return F.coalesce(_c(c).cast("string"), F.lit("nan"))


def shorten(c: ColumnLike, n: int, suffix: str = "...") -> Column:
    """P20: first ``n`` characters plus ``suffix`` when longer than ``n``."""
    col = _c(c)
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit(suffix))).otherwise(col)


def bmi(weight_kg: ColumnLike, height_cm: ColumnLike) -> Column:
    """Kg / (cm/100)^2, null unless both are present (and height non-zero)."""
    h = _c(height_cm) / 100.0
    return F.try_divide(_c(weight_kg), h * h)


def safe_ratio(num: ColumnLike, den: ColumnLike, default: float | None = 0.0) -> Column:
    """num/den with a zero or null denominator -> ``default``."""
    r = F.try_divide(_c(num).cast("double"), _c(den).cast("double"))
    return r if default is None else F.coalesce(r, F.lit(default))


def sql_ident(name: str) -> str:
    """Backquote a column name for Spark SQL expressions."""
    return "`" + name.replace("`", "``") + "`"


def safe_name(text: str) -> str:
    """Lower-case identifier made of [a-z0-9_] from free text."""
    return re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_")
