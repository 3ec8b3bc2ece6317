"""Quality plans on the wide table (P4-P6, A7-A12, D1) with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as Q
from . import extraction as X
from .common import rounded, sql_round, table

# Stand-in range rules for the wide table (column, min, max); 'age' is absent
# on purpose: rules on missing columns never fire.
WIDE_RULES = [
    ("age", 0, None),
    ("o_totalprice", 0, None),
    ("c_acctbal", 0, None),
    ("bmi", 0, 60),
    ("height_cm", 0, None),
    ("click_mean", 0.1, None),
    ("view_max", None, 300),
    ("ECONOMY_mean", 0, 100000),
]
MIN_FILTER = ("o_totalprice", 50000.0)
SPARSE_THRESHOLD = 0.5


def clean_input(spark: SparkSession, sf: str) -> DataFrame:
    return Q.nans_to_nulls(X.wide_table(spark, sf))


def q_min_filter(spark, sf):
    w = Q.min_value_filter(clean_input(spark, sf), *MIN_FILTER)
    return w.select("subject_id", "stay_id", "label")


def q_range_filter(spark, sf):
    return Q.range_filter(clean_input(spark, sf), WIDE_RULES).select("subject_id", "stay_id", "label")


def q_range_report(spark, sf):
    return rounded(Q.range_report(clean_input(spark, sf), WIDE_RULES))


def q_class_distribution(spark, sf):
    return rounded(Q.class_distribution(table(spark, sf, "labels"), "toxic"))


def q_cohort_summary(spark, sf):
    return rounded(Q.cohort_summary(clean_input(spark, sf), "label"))


def q_missing_ratio(spark, sf):
    return rounded(Q.missing_ratios(clean_input(spark, sf), only_missing=True, top=30))


def q_missing_thresholds(spark, sf):
    return Q.missing_thresholds(Q.missing_ratios(clean_input(spark, sf)))


def q_flag_prevalence(spark, sf):
    return rounded(Q.flag_prevalence(clean_input(spark, sf), X.WIDE_FLAGS))


def q_null_rows(spark, sf):
    return Q.null_row_count(clean_input(spark, sf))


def q_sparse_columns(spark, sf):
    r = Q.missing_ratios(clean_input(spark, sf))
    return rounded(r.withColumn("dropped", (F.col("missing_ratio") >= SPARSE_THRESHOLD).cast("int")))


def q_complete_rows(spark, sf):
    return Q.drop_sparse(clean_input(spark, sf), SPARSE_THRESHOLD).select("subject_id")


QUERIES = {
    "p4_min_filter": q_min_filter,
    "p5_range_filter": q_range_filter,
    "p6_range_report": q_range_report,
    "a7_class_distribution": q_class_distribution,
    "a11_cohort_summary": q_cohort_summary,
    "a8_missing_ratio": q_missing_ratio,
    "a9_missing_thresholds": q_missing_thresholds,
    "a10_flag_prevalence": q_flag_prevalence,
    "a12_null_rows": q_null_rows,
    "d1_sparse_columns": q_sparse_columns,
    "d1_complete_rows": q_complete_rows,
}

# ---------------------------------------------------------------------------
# oracle SQL
# ---------------------------------------------------------------------------

WIDE_SQL = f"wide AS ({X.SQL['j2_wide_table']})"


def _viol(c, lo, hi):
    parts = []
    if lo is not None:
        parts.append(f"{c} < {float(lo)!r}")
    if hi is not None:
        parts.append(f"{c} > {float(hi)!r}")
    return "coalesce(" + " OR ".join(parts) + ", false)"


_RULES = [r for r in WIDE_RULES if r[0] in X.WIDE_COLUMNS]
_ANY = " OR ".join(_viol(*r) for r in _RULES)


def _report_sql() -> str:
    sel = []
    for c, lo, hi in _RULES:
        if lo is not None:
            sel.append(f"SELECT '{c}' AS \"column\", 'min' AS side, {float(lo)!r} AS bound, "
                       f"count_if({_viol(c, lo, None)}) AS violations FROM wide")
        if hi is not None:
            sel.append(f"SELECT '{c}' AS \"column\", 'max' AS side, {float(hi)!r} AS bound, "
                       f"count_if({_viol(c, None, hi)}) AS violations FROM wide")
    sel.append(f"SELECT '*' AS \"column\", 'any' AS side, NULL::DOUBLE AS bound, count_if({_ANY}) AS violations FROM wide")
    return f"WITH {WIDE_SQL} " + " UNION ALL ".join(sel)


_RATIO_ROW = "ratio_row AS (SELECT " + ", ".join(
    f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) AS {c}" for c in X.WIDE_COLUMNS) + " FROM wide)"
_RATIOS = f"{_RATIO_ROW}, ratios AS (UNPIVOT ratio_row ON COLUMNS(*) INTO NAME \"column\" VALUE missing_ratio)"

SQL = {
    "p4_min_filter": f"WITH {WIDE_SQL} SELECT subject_id, stay_id, label FROM wide WHERE {MIN_FILTER[0]} >= {MIN_FILTER[1]}",
    "p5_range_filter": f"WITH {WIDE_SQL} SELECT subject_id, stay_id, label FROM wide WHERE NOT ({_ANY})",
    "p6_range_report": _report_sql(),
    "a7_class_distribution": """SELECT toxic, count(*) AS n, round(count(*) / (SELECT count(*) FROM labels)::DOUBLE, 6) AS share
                                FROM labels GROUP BY toxic""",
    "a11_cohort_summary": f"""WITH {WIDE_SQL} SELECT count(*) AS n, count_if(label = 1) AS positives,
        {sql_round('count_if(label = 1) / count(*)')} AS rate,
        {sql_round('CASE WHEN count_if(label = 1) = 0 THEN NULL ELSE count_if(label <> 1) / count_if(label = 1) END')} AS imbalance
        FROM wide""",
    "a8_missing_ratio": f"""WITH {WIDE_SQL}, {_RATIOS}
        SELECT "column", {sql_round('missing_ratio')} AS missing_ratio FROM ratios WHERE missing_ratio > 0
        ORDER BY missing_ratio DESC, "column" LIMIT 30""",
    "a9_missing_thresholds": f"""WITH {WIDE_SQL}, {_RATIOS}
        SELECT count_if(missing_ratio >= 0.1) AS n_ge_10pct, count_if(missing_ratio < 0.1) AS n_lt_10pct,
               count_if(missing_ratio < 0.5) AS n_lt_50pct FROM ratios""",
    "a10_flag_prevalence": f"WITH {WIDE_SQL} " + " UNION ALL ".join(
        f"SELECT '{f}' AS flag, count_if({f} = 1) AS n, {sql_round(f'100.0 * count_if({f} = 1) / count(*)')} AS pct FROM wide"
        for f in X.WIDE_FLAGS),
    "a12_null_rows": f"""WITH {WIDE_SQL} SELECT count_if({' OR '.join(f'{c} IS NULL' for c in X.WIDE_COLUMNS)}) AS rows_with_null,
        count(*) AS rows FROM wide""",
    "d1_sparse_columns": f"""WITH {WIDE_SQL}, {_RATIOS}
        SELECT "column", {sql_round('missing_ratio')} AS missing_ratio,
               CAST(missing_ratio >= {SPARSE_THRESHOLD} AS INTEGER) AS dropped FROM ratios""",
    "d1_complete_rows": f"""WITH {WIDE_SQL}, {_RATIO_ROW}
        SELECT w.subject_id FROM wide w CROSS JOIN ratio_row r
        WHERE {' AND '.join(f'(w.{c} IS NOT NULL OR r.{c} >= {SPARSE_THRESHOLD})' for c in X.WIDE_COLUMNS)}""",
}
