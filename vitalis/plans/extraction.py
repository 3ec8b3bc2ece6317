"""Extraction plans bound to the driver's tables.

Roles: ``orders`` are stays (customer = subject, order = stay, order date =
admission time); ``events`` are chart events per user (first event = origin);
``lineitem`` joined to ``orders`` are lab-style events keyed by stay; part
names are diagnosis codes; ``conversations`` rows are keyword records.

Each ``q_*`` returns a DataFrame; ``SQL`` holds the DuckDB oracle twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import either_flag, indicator, one_hot, one_hot_name
from ..operators.cohort import attach, first_per_key, horizon_labels, in_cohort, laid_wide_join, lookup, window_join
from ..operators.features import (anthropometrics, any_flags, first_measure, flagged_only, keyword_flags,
                                  measure_features, rollup_flags, window_stats)
from ..sources.codes import INCH_TO_CM, LAB_STATS, LB_TO_KG, VITAL_STATS
from .common import laid_stage, rounded, sql_pivot, sql_round, sql_stats, table, ts_text

# ---------------------------------------------------------------------------
# Stand-in bindings (our choice of roles on the driver's tables)
# ---------------------------------------------------------------------------
EVENT_TYPES = ["click", "view", "purchase", "signup", "error"]
EVENT_WINDOW_HOURS = (0.0, 24.0)
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
LINE_WINDOW_HOURS = (0.0, 24.0 * 365)  # order dates are day-grained: a one-year window
LABEL_HOURS = 48.0
PART_FLAGS = {
    "red_part": ["red"],
    "temp_part": ["hot", "cold"],
    "small_ring": ["small ring"],
    "large_part": ["large"],
    "gear_part": ["blue gear", "old gear", "new gear"],
}
CONVERSATION_FLAGS = {
    "assistant_en": (["assist"], " the | and "),
    "user_de": (["USER"], " der | die | und "),
    "system_fr": (["sys"], " le | la | des "),
}
MEASURE_ALIASES = {"height": ["view", "click"], "weight": ["purchase", "signup"], "bmi": ["bmi"]}
SEGMENTS = ["BUILDING", "AUTOMOBILE", "HOUSEHOLD", "FURNITURE"]
COHORT_ITEMS = ["F"]


# ---------------------------------------------------------------------------
# building blocks
# ---------------------------------------------------------------------------

def first_stays(spark: SparkSession, sf: str) -> DataFrame:
    """W1 on orders: the earliest order per customer, order key breaks ties."""
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("stay_id"),
        F.col("o_orderdate").alias("intime"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    return first_per_key(orders, "subject_id", ["intime"], ["stay_id"])


def event_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("origin"))


def event_features(spark: SparkSession, sf: str) -> DataFrame:
    """J4 + A1 + A3 on events: first-day statistics per user and type, wide."""
    ev = table(spark, sf, "events").select("user_id", "ts", "event_type", "value")
    win = window_join(ev, event_anchors(spark, sf), "user_id", "ts", "origin", *EVENT_WINDOW_HOURS)
    return measure_features(win, "user_id", "event_type", "value", EVENT_TYPES, VITAL_STATS)


def line_features(spark: SparkSession, sf: str, stays: DataFrame | None = None) -> DataFrame:
    """J4 + J5 + A2 + A3: lineitems of each first stay within the window, typed by part."""
    stays = stays if stays is not None else first_stays(spark, sf)
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("stay_id"), "l_partkey", "l_shipdate", "l_extendedprice")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("item_type"))
    win = window_join(li, stays.select("stay_id", "intime"), "stay_id", "l_shipdate", "intime", *LINE_WINDOW_HOURS)
    typed = lookup(win, part, "l_partkey", fixed_size=False)
    return measure_features(typed, "stay_id", "item_type", "l_extendedprice", PART_TYPES, LAB_STATS)


def outcome_times(spark: SparkSession, sf: str):
    """Stand-in death times: per customer the last finished order ('dod'),
    per stay the first returned shipment ('deathtime')."""
    orders = table(spark, sf, "orders")
    dod = (orders.where(F.col("o_orderstatus") == "F").groupBy(F.col("o_custkey").alias("subject_id"))
                 .agg(F.max("o_orderdate").alias("dod")))
    li = table(spark, sf, "lineitem")
    death = (li.where(F.col("l_returnflag") == "R").groupBy(F.col("l_orderkey").alias("stay_id"))
               .agg(F.min("l_shipdate").alias("deathtime")))
    return dod, death


def labelled_stays(spark: SparkSession, sf: str, stays: DataFrame | None = None) -> DataFrame:
    """J1 + P10: first stays with the 48 h outcome label."""
    dod, death = outcome_times(spark, sf)
    stays = stays if stays is not None else first_stays(spark, sf)
    s = attach(attach(stays, dod, "subject_id"), death, "stay_id")
    return horizon_labels(s, "intime", ["dod", "deathtime"], LABEL_HOURS, "label")


def code_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(subject, code) rows: customer -> orders -> lineitem -> part name."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("subject_id"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("code"))
    return li.join(p, "l_partkey").join(o, "l_orderkey").select("subject_id", "code")


def part_flags(spark: SparkSession, sf: str, stays: DataFrame | None = None) -> DataFrame:
    """A4 evaluated where it is cheapest: prefix tests once per part (the code
    dictionary), only flagged parts joined to lineitem, flags rolled up per
    order (map-side) before the order -> customer join, then per customer.
    Same result as ``any_flags(code_rows(...))``, with the large lineitem x
    orders shuffle reduced to one row per flagged order."""
    stays = stays if stays is not None else first_stays(spark, sf)
    names = list(PART_FLAGS)
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
    per_part = flagged_only(any_flags(part, "l_partkey", "p_name", PART_FLAGS), names)
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    per_order = rollup_flags(li.join(per_part, "l_partkey"), "l_orderkey", names)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("subject_id"))
    return rollup_flags(per_order.join(o, "l_orderkey"), "subject_id", names, entities=stays)


def event_measures(spark: SparkSession, sf: str) -> DataFrame:
    """A6 + P7 rows: (user, type, JSON 'k' as text), earliest first."""
    ev = table(spark, sf, "events").select(
        "user_id", "event_type", "ts", "event_id", F.get_json_object("props", "$.k").alias("k"))
    names = sorted({n for v in MEASURE_ALIASES.values() for n in v})
    return first_measure(ev, "user_id", "event_type", "k", ["ts", "event_id"], names)


# ---------------------------------------------------------------------------
# registered queries
# ---------------------------------------------------------------------------

def q_event_window_wide(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(event_features(spark, sf))


def q_first_stay(spark: SparkSession, sf: str) -> DataFrame:
    s = first_stays(spark, sf)
    return rounded(s.select("subject_id", "stay_id", ts_text("intime").alias("intime"),
                            "o_orderstatus", "o_orderpriority", "o_totalprice"))


def q_first_stay_compat(spark: SparkSession, sf: str) -> DataFrame:
    """W1 compat: with urgent priorities blanked, each column's first non-null value."""
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("stay_id"),
        F.col("o_orderdate").alias("intime"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_orderpriority")).alias("priority"))
    s = first_per_key(orders, "subject_id", ["intime"], ["stay_id"], compat=True)
    return s.select("subject_id", "stay_id", ts_text("intime").alias("intime"), "priority")


def q_horizon_label(spark: SparkSession, sf: str) -> DataFrame:
    s = labelled_stays(spark, sf)
    return s.select("subject_id", "stay_id", ts_text("dod").alias("dod"),
                    ts_text("deathtime").alias("deathtime"), "label")


def q_line_window_wide(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(line_features(spark, sf))


def q_line_window_long(spark: SparkSession, sf: str) -> DataFrame:
    """J4 + J5 + A2 in long form (stay, type, five statistics)."""
    stays = first_stays(spark, sf)
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("stay_id"), "l_partkey", "l_shipdate", "l_extendedprice")
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("item_type"))
    win = window_join(li, stays.select("stay_id", "intime"), "stay_id", "l_shipdate", "intime", *LINE_WINDOW_HOURS)
    typed = lookup(win, part, "l_partkey", fixed_size=False)
    return rounded(window_stats(typed, ["stay_id", "item_type"], "l_extendedprice", LAB_STATS))


def q_code_flags(spark: SparkSession, sf: str) -> DataFrame:
    return part_flags(spark, sf)


def q_cohort_events(spark: SparkSession, sf: str) -> DataFrame:
    """S3 + J3 + P3: item-filtered lineitem scan (pushed ``IN`` filter) kept to
    the cohort's stays by a left-semi join, counted per stay and item."""
    stays = first_stays(spark, sf)
    li = (table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("stay_id"), "l_linestatus")
          .where(F.col("l_linestatus").isin(COHORT_ITEMS)))
    kept = in_cohort(li, stays, "stay_id")
    return kept.groupBy("stay_id", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


def q_code_flags_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A4 on (subject, code) fact rows, the shape of a diagnoses table."""
    return any_flags(code_rows(spark, sf), "subject_id", "code", PART_FLAGS, entities=first_stays(spark, sf))


def q_keyword_flags(spark: SparkSession, sf: str) -> DataFrame:
    conv = table(spark, sf, "conversations")
    return keyword_flags(conv, "conv_id", "role", "text", CONVERSATION_FLAGS)


def q_first_measure(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(event_measures(spark, sf))


def q_anthropometrics(spark: SparkSession, sf: str) -> DataFrame:
    m = event_measures(spark, sf)
    return rounded(anthropometrics(m, "user_id", MEASURE_ALIASES, INCH_TO_CM, LB_TO_KG, mode="row"))


def wide_table(spark: SparkSession, sf: str) -> DataFrame:
    """One row per subject: label, indicators, flags, measures, both windows.

    The cohort and every side are stage tables in buckets of their key: made once per state of the source and joined
    without an exchange.  The stay-keyed side comes first, then the base is laid out by subject."""
    def lay(name, df, key):
        return laid_stage(spark, sf, f"wide_{name}", lambda: df, key)

    cohort = lay("cohort", first_stays(spark, sf), "subject_id")
    stays = labelled_stays(spark, sf, cohort)
    cust = table(spark, sf, "customer").select(F.col("c_custkey").alias("subject_id"), "c_mktsegment", "c_acctbal")
    base = attach(stays, cust, "subject_id").select(
        "subject_id", "stay_id", "o_orderstatus", "o_orderpriority", "o_totalprice", "c_mktsegment",
        "c_acctbal", "label")
    flags = part_flags(spark, sf, cohort)
    anthro = anthropometrics(event_measures(spark, sf), "user_id", MEASURE_ALIASES, INCH_TO_CM, LB_TO_KG) \
        .withColumnRenamed("user_id", "subject_id")
    ev = event_features(spark, sf).withColumnRenamed("user_id", "subject_id")
    line = line_features(spark, sf, cohort)
    w = laid_wide_join(base, [("line", line, "stay_id"), ("flags", flags, "subject_id"), ("measures", anthro, "subject_id"),
                              ("events", ev, "subject_id")], lay)
    return w.select(
        "*",
        indicator("o_orderstatus", "F").alias("status_f"),
        *one_hot("c_mktsegment", SEGMENTS, prefix="seg_"),
        either_flag("red_part", "temp_part").alias("red_or_temp"),
    )


def q_wide_table(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(wide_table(spark, sf))


QUERIES = {
    "a3_event_window_wide": q_event_window_wide,
    "w1_first_stay": q_first_stay,
    "w1_first_stay_compat": q_first_stay_compat,
    "p10_horizon_label": q_horizon_label,
    "a2_line_window_long": q_line_window_long,
    "a3_line_window_wide": q_line_window_wide,
    "a4_code_flags": q_code_flags,
    "a4_code_flags_rows": q_code_flags_rows,
    "j3_cohort_events": q_cohort_events,
    "a5_keyword_flags": q_keyword_flags,
    "a6_first_measure": q_first_measure,
    "p12_anthropometrics": q_anthropometrics,
    "j2_wide_table": q_wide_table,
}

# ---------------------------------------------------------------------------
# DuckDB oracle SQL
# ---------------------------------------------------------------------------


def _hours(t: str, o: str) -> str:
    return f"((epoch_us({t}) - epoch_us({o})) / 3600000000.0)"


SQL_FIRST_STAYS = """
first_stays AS (
  SELECT o_custkey AS subject_id, o_orderkey AS stay_id, o_orderdate AS intime,
         o_orderstatus, o_orderpriority, o_totalprice
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
  WHERE rn = 1
)"""

SQL_EVENT_LONG = f"""
anchors AS (
  SELECT user_id, ts AS origin FROM (
    SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
  WHERE rn = 1
),
ev_win AS (
  SELECT e.user_id, e.event_type, e.value FROM events e JOIN anchors a USING (user_id)
  WHERE {_hours('e.ts', 'a.origin')} BETWEEN {EVENT_WINDOW_HOURS[0]} AND {EVENT_WINDOW_HOURS[1]}
),
ev_long AS (
  SELECT user_id, event_type, {sql_stats('value', VITAL_STATS)}
  FROM ev_win WHERE value IS NOT NULL AND event_type IN ({', '.join(repr(t) for t in EVENT_TYPES)})
  GROUP BY user_id, event_type
),
ev_wide AS ({sql_pivot('user_id', 'event_type', EVENT_TYPES, VITAL_STATS, 'ev_long')})"""

SQL_LINE_LONG = f"""
line_win AS (
  SELECT l.l_orderkey AS stay_id, p.p_type AS item_type, l.l_extendedprice
  FROM lineitem l JOIN first_stays s ON l.l_orderkey = s.stay_id
  JOIN part p ON p.p_partkey = l.l_partkey
  WHERE {_hours('l.l_shipdate', 's.intime')} BETWEEN {LINE_WINDOW_HOURS[0]} AND {LINE_WINDOW_HOURS[1]}
),
line_long AS (
  SELECT stay_id, item_type, {sql_stats('l_extendedprice', LAB_STATS)}
  FROM line_win WHERE l_extendedprice IS NOT NULL AND item_type IN ({', '.join(repr(t) for t in PART_TYPES)})
  GROUP BY stay_id, item_type
),
line_wide AS ({sql_pivot('stay_id', 'item_type', PART_TYPES, LAB_STATS, 'line_long')})"""

SQL_LABELS = """
dod AS (SELECT o_custkey AS subject_id, max(o_orderdate) AS dod FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
death AS (SELECT l_orderkey AS stay_id, min(l_shipdate) AS deathtime FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
labelled AS (
  SELECT s.*, d.dod, x.deathtime,
    CAST((coalesce(d.dod <= s.intime + INTERVAL 48 HOUR, false)
       OR coalesce(x.deathtime <= s.intime + INTERVAL 48 HOUR, false)) AS INTEGER) AS label
  FROM first_stays s LEFT JOIN dod d USING (subject_id) LEFT JOIN death x USING (stay_id)
)"""


def _sql_prefix(col: str, prefixes) -> str:
    ps = list(dict.fromkeys(prefixes))
    return "(" + " OR ".join(f"starts_with({col}, '{p}')" for p in ps) + ")"


SQL_FLAGS = f"""
codes AS (
  SELECT o.o_custkey AS subject_id, p.p_name AS code
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN orders o ON o.o_orderkey = l.l_orderkey
),
flag_rows AS (
  SELECT subject_id, {', '.join(f'max(CAST(coalesce({_sql_prefix("code", ps)}, false) AS INTEGER)) AS {n}' for n, ps in PART_FLAGS.items())}
  FROM codes GROUP BY subject_id
),
flags AS (
  SELECT s.subject_id, {', '.join(f'CAST(coalesce(f.{n}, 0) AS INTEGER) AS {n}' for n in PART_FLAGS)}
  FROM (SELECT DISTINCT subject_id FROM first_stays) s LEFT JOIN flag_rows f USING (subject_id)
)"""

_MEASURE_NAMES = sorted({n for v in MEASURE_ALIASES.values() for n in v})

SQL_MEASURES = f"""
measure_rows AS (
  SELECT user_id, event_type, first(k ORDER BY ts, event_id) FILTER (WHERE k IS NOT NULL) AS v
  FROM (SELECT user_id, event_type, ts, event_id, json_extract_string(props, '$.k') AS k FROM events
        WHERE event_type IN ({', '.join(repr(n) for n in _MEASURE_NAMES)}))
  GROUP BY user_id, event_type
),
measures AS (
  SELECT user_id, {', '.join(f"TRY_CAST(max(CASE WHEN event_type = '{n}' THEN v END) AS DOUBLE) AS {n}" for n in _MEASURE_NAMES)}
  FROM measure_rows GROUP BY user_id
),
anthro AS (
  SELECT user_id, h AS height_cm, w AS weight_kg,
         CASE WHEN h IS NULL OR w IS NULL OR h = 0 THEN NULL ELSE w / ((h / 100.0) * (h / 100.0)) END AS bmi
  FROM (SELECT user_id, coalesce({', '.join(MEASURE_ALIASES['height'])}) * {INCH_TO_CM} AS h,
               coalesce({', '.join(MEASURE_ALIASES['weight'])}) * {LB_TO_KG} AS w FROM measures)
)"""


def _kw_sql(keywords, pattern) -> str:
    kws = list(dict.fromkeys(k.lower() for k in keywords))
    name = "(" + " OR ".join(f"contains(lower(role), '{k}')" for k in kws) + ")"
    return f"coalesce({name} AND regexp_matches(lower(text), '{pattern}'), false)"


def _ts_sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def _round_cols(cols) -> str:
    return ", ".join(f"{sql_round(c)} AS {c}" for c in cols)


_WIDE_EV_COLS = [f"{t}_{s}" for t in EVENT_TYPES for s in VITAL_STATS]
_WIDE_LINE_COLS = [f"{t}_{s}" for t in PART_TYPES for s in LAB_STATS]


def _wide_col(c: str) -> str:
    return c if c.endswith("_count") else f"{sql_round(c)} AS {c}"


SQL = {
    "a3_event_window_wide": f"WITH {SQL_EVENT_LONG} SELECT * FROM ev_wide",
    "w1_first_stay": f"""WITH {SQL_FIRST_STAYS}
        SELECT subject_id, stay_id, {_ts_sql('intime')} AS intime, o_orderstatus, o_orderpriority,
               {sql_round('o_totalprice')} AS o_totalprice FROM first_stays""",
    "w1_first_stay_compat": """
        SELECT o_custkey AS subject_id,
               first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS stay_id,
               strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS intime,
               first(pr ORDER BY o_orderdate, o_orderkey) FILTER (WHERE pr IS NOT NULL) AS priority
        FROM (SELECT *, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_orderpriority END AS pr FROM orders)
        GROUP BY o_custkey""",
    "p10_horizon_label": f"""WITH {SQL_FIRST_STAYS}, {SQL_LABELS}
        SELECT subject_id, stay_id, {_ts_sql('dod')} AS dod, {_ts_sql('deathtime')} AS deathtime, label
        FROM labelled""",
    "a2_line_window_long": f"""WITH {SQL_FIRST_STAYS}, {SQL_LINE_LONG}
        SELECT stay_id, item_type, {sql_round('mean')} AS mean, {sql_round('std')} AS std,
               {sql_round('max')} AS max, {sql_round('min')} AS min, CAST(count AS BIGINT) AS count
        FROM line_long""",
    "a3_line_window_wide": f"WITH {SQL_FIRST_STAYS}, {SQL_LINE_LONG} SELECT * FROM line_wide",
    "a4_code_flags": f"WITH {SQL_FIRST_STAYS}, {SQL_FLAGS} SELECT * FROM flags",
    "a4_code_flags_rows": f"WITH {SQL_FIRST_STAYS}, {SQL_FLAGS} SELECT * FROM flags",
    "j3_cohort_events": f"""WITH {SQL_FIRST_STAYS}
        SELECT l_orderkey AS stay_id, l_linestatus, count(*) AS n FROM lineitem
        WHERE l_linestatus IN ({', '.join(repr(i) for i in COHORT_ITEMS)})
          AND l_orderkey IN (SELECT stay_id FROM first_stays) GROUP BY ALL""",
    "a5_keyword_flags": "SELECT conv_id, " + ", ".join(
        f"max(CAST({_kw_sql(k, p)} AS INTEGER)) AS {n}" for n, (k, p) in CONVERSATION_FLAGS.items())
        + " FROM conversations GROUP BY conv_id",
    "a6_first_measure": f"WITH {SQL_MEASURES} SELECT user_id, {_round_cols(_MEASURE_NAMES)} FROM measures",
    "p12_anthropometrics": f"WITH {SQL_MEASURES} SELECT user_id, {_round_cols(['height_cm', 'weight_kg', 'bmi'])} FROM anthro",
    "j2_wide_table": f"""WITH {SQL_FIRST_STAYS}, {SQL_LABELS}, {SQL_FLAGS}, {SQL_MEASURES}, {SQL_EVENT_LONG},
        {SQL_LINE_LONG}
        SELECT b.subject_id, b.stay_id, b.o_orderstatus, b.o_orderpriority, {sql_round('b.o_totalprice')} AS o_totalprice,
               c.c_mktsegment, {sql_round('c.c_acctbal')} AS c_acctbal, b.label,
               {', '.join(f'f.{n}' for n in PART_FLAGS)},
               {sql_round('a.height_cm')} AS height_cm, {sql_round('a.weight_kg')} AS weight_kg, {sql_round('a.bmi')} AS bmi,
               {', '.join(f'e.{c}' for c in _WIDE_EV_COLS)},
               {', '.join(f'l.{c}' for c in _WIDE_LINE_COLS)},
               CAST(coalesce(b.o_orderstatus = 'F', false) AS INTEGER) AS status_f,
               {', '.join(f"CAST(coalesce(c.c_mktsegment = '{s}', false) AS INTEGER) AS {one_hot_name(s, 'seg_')}" for s in SEGMENTS)},
               CAST(coalesce(f.red_part = 1, false) OR coalesce(f.temp_part = 1, false) AS INTEGER) AS red_or_temp
        FROM labelled b LEFT JOIN (SELECT c_custkey AS subject_id, c_mktsegment, c_acctbal FROM customer) c USING (subject_id)
        LEFT JOIN flags f USING (subject_id)
        LEFT JOIN (SELECT user_id AS subject_id, * EXCLUDE (user_id) FROM anthro) a USING (subject_id)
        LEFT JOIN (SELECT user_id AS subject_id, * EXCLUDE (user_id) FROM ev_wide) e USING (subject_id)
        LEFT JOIN line_wide l USING (stay_id)""",
}

WIDE_COLUMNS = (["subject_id", "stay_id", "o_orderstatus", "o_orderpriority", "o_totalprice", "c_mktsegment",
                 "c_acctbal", "label"] + list(PART_FLAGS) + ["height_cm", "weight_kg", "bmi"]
                + _WIDE_EV_COLS + _WIDE_LINE_COLS + ["status_f"] + [one_hot_name(s, "seg_") for s in SEGMENTS]
                + ["red_or_temp"])
WIDE_FLAGS = list(PART_FLAGS) + ["status_f", "red_or_temp"] + [one_hot_name(s, "seg_") for s in SEGMENTS]
WIDE_NUMERIC = [c for c in WIDE_COLUMNS if c not in ("o_orderstatus", "o_orderpriority", "c_mktsegment")]
