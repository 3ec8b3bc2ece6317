"""Metric and feature-preparation plans (M8-M11, F1, F2, F4, F7) with oracle SQL.

Predictions for the SQL-checked metrics are deterministic scores derived from
the tables (document length for the toxic label, discount and tax for the
return flag), so the oracle can recompute them; model predictions use the same
operators (see ``modelling``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import prep as P
from ..operators import sampling as S
from .common import rounded, sql_round, table
from .splitting import FRACTIONS, SEED, sql_split

DOC_THRESHOLD = 7.0
LINE_THRESHOLD = 0.5
CATEGORICAL = ["lang", "source"]
SCALE_COLS = ["n_chars", "quality"]


def doc_preds(spark: SparkSession, sf: str) -> DataFrame:
    lab = table(spark, sf, "labels").select("doc_id", "toxic")
    doc = table(spark, sf, "documents").select("doc_id", "n_chars")
    j = lab.join(doc, "doc_id", "left")
    score = F.round(F.log(F.col("n_chars").cast("double") + 1.0), 1)
    return j.select("doc_id", F.col("toxic").alias("label"), score.alias("score"),
                    (score >= DOC_THRESHOLD).cast("int").alias("prediction"))


def line_preds(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    score = F.col("l_discount") * 10.0 + F.col("l_tax")
    return li.select((F.col("l_returnflag") == "R").cast("int").alias("label"), score.alias("score"),
                     (score >= LINE_THRESHOLD).cast("int").alias("prediction"))


def q_confusion(spark, sf):
    return M.confusion(doc_preds(spark, sf))


def q_rates(spark, sf):
    return rounded(M.rates(M.confusion(doc_preds(spark, sf))))


def q_ranking(spark, sf):
    return rounded(M.ranking_metrics(doc_preds(spark, sf)))


def q_evaluate_lines(spark, sf):
    return rounded(M.evaluate(line_preds(spark, sf)))


def doc_split(spark, sf) -> DataFrame:
    lab = table(spark, sf, "labels").select("doc_id", "toxic", "quality")
    doc = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return S.stratified_split(lab.join(doc, "doc_id", "left"), "doc_id", "toxic", FRACTIONS, seed=SEED)


def _encoded(spark, sf, unseen):
    d = doc_split(spark, sf)
    codes = P.fit_label_codes(d.where(F.col("split") == "train"), CATEGORICAL)
    return P.apply_label_codes(d, codes, CATEGORICAL, unseen=unseen).select("doc_id", "split", *CATEGORICAL)


def q_label_encoding(spark, sf):
    return _encoded(spark, sf, "minus_one")


def q_mode_encoding(spark, sf):
    return _encoded(spark, sf, "mode")


def q_standardise(spark, sf):
    d = doc_split(spark, sf)
    stats = P.fit_scaler(d.where(F.col("split") == "train"), SCALE_COLS)
    return rounded(P.apply_scaler(d, stats).select("doc_id", "split", *SCALE_COLS))


def q_class_weights(spark, sf):
    return rounded(P.class_weights(table(spark, sf, "labels").select("doc_id", "toxic"), "toxic"))


def q_decode(spark, sf):
    """codes moved off the integers, as synthetic rows have them, and codes beyond the range, back to values."""
    doc = table(spark, sf, "documents").select("doc_id", *CATEGORICAL)
    codes = P.fit_label_codes(doc, CATEGORICAL)
    coded = P.apply_label_codes(doc, codes, CATEGORICAL)
    near = P.decode_label_codes(coded.select("doc_id", *[(F.col(c) + 0.3).alias(c) for c in CATEGORICAL]), codes, CATEGORICAL)
    far = P.decode_label_codes(coded.select("doc_id", *[(F.col(c) * 0.0 + s).alias(c) for c, s in zip(CATEGORICAL, (1000.0, -7.4))]), codes, CATEGORICAL)
    return near.join(far.select("doc_id", *[F.col(c).alias(f"{c}_clipped") for c in CATEGORICAL]), "doc_id")


def q_categorical(spark, sf):
    """the text columns discovered in a table, names with a value for every row included, with
    the number of values that encoding them takes."""
    cust = table(spark, sf, "customer")
    cols = P.categorical_columns(cust)
    codes = P.fit_label_codes(cust, cols)
    return codes.groupBy("column").agg(F.count(F.lit(1)).alias("n_values"), F.max("code").alias("last_code"))


QUERIES = {
    "f3_decode": q_decode,
    "f6_categorical": q_categorical,
    "m8_confusion": q_confusion,
    "m9_rates": q_rates,
    "m10_m11_ranking": q_ranking,
    "m8_m11_evaluate_lines": q_evaluate_lines,
    "f1_label_encoding": q_label_encoding,
    "f2_mode_encoding": q_mode_encoding,
    "f4_standardise": q_standardise,
    "f7_class_weights": q_class_weights,
}

# ---------------------------------------------------------------------------
# oracle SQL
# ---------------------------------------------------------------------------

DOC_PREDS = f"""(SELECT l.doc_id, l.toxic AS label, round(ln(CAST(d.n_chars AS DOUBLE) + 1.0), 1) AS score,
        CAST(round(ln(CAST(d.n_chars AS DOUBLE) + 1.0), 1) >= {DOC_THRESHOLD} AS INTEGER) AS prediction
    FROM labels l LEFT JOIN documents d USING (doc_id))"""
LINE_PREDS = f"""(SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, l_discount * 10.0 + l_tax AS score,
        CAST(l_discount * 10.0 + l_tax >= {LINE_THRESHOLD} AS INTEGER) AS prediction FROM lineitem)"""


def sql_confusion(src: str) -> str:
    return f"""SELECT count_if(label = 1 AND prediction = 1) AS tp, count_if(label <> 1 AND prediction <> 1) AS tn,
        count_if(label <> 1 AND prediction = 1) AS fp, count_if(label = 1 AND prediction <> 1) AS fn FROM {src}"""


def _r(num, den):
    return f"CASE WHEN ({den}) = 0 THEN 0.0 ELSE ({num}) / CAST(({den}) AS DOUBLE) END"


RATES = f"""{_r('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {_r('tp', 'tp + fp')} AS precision,
    {_r('tp', 'tp + fn')} AS recall, {_r('2 * tp', '2 * tp + fp + fn')} AS f1_score, {_r('tn', 'tn + fp')} AS specificity"""


def sql_ranking(src: str) -> str:
    return f"""(SELECT CASE WHEN P * N = 0 THEN 0.0 ELSE auc_num / (P * N) END AS roc_auc,
               CASE WHEN P * N = 0 THEN 0.0 ELSE ap_num / P END AS pr_auc
        FROM (SELECT sum(pos)::DOUBLE AS P, sum(neg)::DOUBLE AS N, sum(neg * (pa + pos / 2.0)) AS auc_num,
                     sum(CASE WHEN pos > 0 THEN pos * (pa + pos) / (pa + pos + na + neg) ELSE 0 END) AS ap_num
              FROM (SELECT *, coalesce(sum(pos) OVER w, 0)::DOUBLE AS pa, coalesce(sum(neg) OVER w, 0)::DOUBLE AS na
                    FROM (SELECT score, count_if(label = 1) AS pos, count_if(label <> 1) AS neg FROM {src}
                          WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY score)
                    WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))))"""


def _round_all(cols):
    return ", ".join(f"{sql_round(c)} AS {c}" for c in cols)


DOC_SPLIT = sql_split("""(SELECT l.doc_id, l.toxic, l.quality, d.lang, d.source, d.n_chars
                          FROM labels l LEFT JOIN documents d USING (doc_id))""", "doc_id", "toxic")


def _sql_encoding(mode: bool) -> str:
    parts = [f"s AS (SELECT * FROM {DOC_SPLIT})"]
    sel = []
    for c in CATEGORICAL:
        parts.append(f"""codes_{c} AS (SELECT value, freq, row_number() OVER (ORDER BY value) - 1 AS code FROM (
            SELECT coalesce(CAST({c} AS VARCHAR), 'nan') AS value, count(*) AS freq FROM s WHERE split = 'train' GROUP BY 1))""")
        fill = f"(SELECT code FROM codes_{c} ORDER BY freq DESC, value LIMIT 1)" if mode else "-1"
        sel.append(f"CAST(coalesce((SELECT code FROM codes_{c} k WHERE k.value = coalesce(CAST(s.{c} AS VARCHAR), 'nan')), {fill}) AS INTEGER) AS {c}")
    return f"WITH {', '.join(parts)} SELECT doc_id, split, {', '.join(sel)} FROM s"


def _sql_standardise() -> str:
    st = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in SCALE_COLS)
    sel = ", ".join(
        f"{sql_round(f'(s.{c} - t.m_{c}) / CASE WHEN coalesce(t.s_{c}, 0) = 0 THEN 1.0 ELSE t.s_{c} END')} AS {c}"
        for c in SCALE_COLS)
    return f"""WITH s AS (SELECT * FROM {DOC_SPLIT}), t AS (SELECT {st} FROM s WHERE split = 'train')
        SELECT s.doc_id, s.split, {sel} FROM s CROSS JOIN t"""


SQL = {
    "f3_decode": """SELECT doc_id, coalesce(lang, 'nan') AS lang, coalesce(source, 'nan') AS source, l AS lang_clipped, f AS source_clipped
        FROM documents CROSS JOIN (SELECT max(coalesce(lang, 'nan')) AS l, min(coalesce(source, 'nan')) AS f FROM documents)""",
    "f6_categorical": """SELECT d.column_name AS "column", v.n AS n_values, CAST(v.n - 1 AS INTEGER) AS last_code
        FROM (DESCRIBE customer) d LEFT JOIN (SELECT 'c_name' AS c, count(DISTINCT coalesce(c_name, 'nan')) AS n FROM customer
        UNION ALL SELECT 'c_mktsegment', count(DISTINCT coalesce(c_mktsegment, 'nan')) FROM customer) v ON v.c = d.column_name WHERE d.column_type = 'VARCHAR'""",
    "m8_confusion": sql_confusion(DOC_PREDS),
    "m9_rates": f"SELECT tp, tn, fp, fn, {_round_all(['accuracy', 'precision', 'recall', 'f1_score', 'specificity'])} "
                f"FROM (SELECT *, {RATES} FROM ({sql_confusion(DOC_PREDS)}))",
    "m10_m11_ranking": f"SELECT {_round_all(['roc_auc', 'pr_auc'])} FROM {sql_ranking(DOC_PREDS)}",
    "m8_m11_evaluate_lines": f"""SELECT tp, tn, fp, fn,
        {_round_all(['accuracy', 'precision', 'recall', 'f1_score', 'specificity', 'roc_auc', 'pr_auc'])}
        FROM (SELECT *, {RATES} FROM ({sql_confusion(LINE_PREDS)})) CROSS JOIN {sql_ranking(LINE_PREDS)}""",
    "f1_label_encoding": _sql_encoding(False),
    "f2_mode_encoding": _sql_encoding(True),
    "f4_standardise": _sql_standardise(),
    "f7_class_weights": f"""SELECT doc_id, toxic, {sql_round('n_all / (k * n_c)')} AS weight FROM labels
        JOIN (SELECT toxic, count(*)::DOUBLE AS n_c FROM labels GROUP BY toxic) USING (toxic)
        CROSS JOIN (SELECT count(*)::DOUBLE AS n_all, count(DISTINCT toxic)::DOUBLE AS k FROM labels)""",
}
