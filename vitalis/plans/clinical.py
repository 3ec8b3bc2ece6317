"""The clinical pipeline on its own schema: extract -> clean -> split ->
resample -> model -> explain, built from the operators and the fixed code
tables in ``sources.codes``.

Inputs follow ``sources.tables.CLINICAL_SCHEMAS`` (patients, admissions,
icustays, diagnoses_icd, optional omr, chartevents, labevents).  The driver's
test tables have a different schema, so this module is exercised by
``tests/test_clinical.py`` on a small clinical-shaped fixture; the registered
queries run the same operators on the stand-in bindings.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import either_flag, indicator, number, one_hot
from ..operators import explain as EX
from ..operators import models as MD
from ..operators import prep as P
from ..operators import quality as Q
from ..operators import sampling as S
from ..operators import search as SR
from ..operators.cohort import attach, first_per_key, horizon_labels, in_cohort, lookup, wide_join, window_join
from ..operators.features import anthropometrics, any_flags, first_measure, keyword_flags, measure_features
from ..operators.smote import smote_union
from ..sources import codes as K
from ..session import ensure_checkpoint_dir
from ..sources.tables import CLINICAL_SCHEMAS, optional_source, read_source, write_table

ID_COLS = ["subject_id", "hadm_id", "stay_id"]
TARGET = "mortality_48h"
HOSP = ["patients", "admissions", "diagnoses_icd", "omr", "labevents"]
ICU = ["icustays", "chartevents"]


def load(spark: SparkSession, base: str, fmt: str = "csv", paths: Mapping[str, str] | None = None) -> dict:
    """Read every source with its declared schema (``base/hosp``,
    ``base/icu`` layout unless ``paths`` says otherwise); OMR is optional."""
    out = {}
    for name, schema in CLINICAL_SCHEMAS.items():
        sub = "hosp" if name in HOSP else "icu"
        path = (paths or {}).get(name, os.path.join(base, sub, f"{name}.{fmt}"))
        if name == "omr":
            out[name] = optional_source(spark, path, schema, fmt)
        else:
            out[name] = read_source(spark, path, schema, fmt)
    return out


def extract(t: Mapping[str, DataFrame], window_hours: float = 24.0, horizon_hours: float = 48.0,
            compat: bool = False, normalise_dots: bool = False, alias_mode: str = "table",
            not_before: bool = False, comorbidity_scope: str = "subject", convert_units: bool = False) -> DataFrame:
    """One row per subject (first ICU stay) with label, flags, measures and
    first-day vital / lab statistics.

    Defaults reproduce the original but for ``compat``: the original takes each
    column's first non-null value of a subject's stays (``compat=True``), the
    default takes the first stay's own row.  The options are its documented quirks:
    ``not_before`` ignores deaths before admission, ``comorbidity_scope=
    'index_admission'`` uses only the index admission's diagnoses (the original
    uses all of the subject's), ``convert_units`` converts Fahrenheit items
    before temperatures are averaged."""
    spark = t["icustays"].sparkSession
    stays = first_per_key(t["icustays"].select("subject_id", "hadm_id", "stay_id", "first_careunit", "intime",
                                              "outtime"), "subject_id", ["intime"], ["stay_id"], compat=compat)
    pat = t["patients"].select("subject_id", "gender", "anchor_age", "dod")
    adm = t["admissions"].select("hadm_id", "deathtime")
    labelled = horizon_labels(attach(attach(stays, pat, "subject_id"), adm, "hadm_id"),
                              "intime", ["dod", "deathtime"], horizon_hours, TARGET, not_before=not_before)

    if comorbidity_scope == "index_admission":
        diag = t["diagnoses_icd"].join(stays.select("subject_id", "hadm_id"), ["subject_id", "hadm_id"], "left_semi")
    else:
        diag = in_cohort(t["diagnoses_icd"], stays, "subject_id")
    diag = diag.select("subject_id", "icd_code")
    comorbid = any_flags(diag, "subject_id", "icd_code", K.ICD_FLAGS, entities=stays, normalise_dots=normalise_dots)

    omr = in_cohort(t["omr"], stays, "subject_id")
    lifestyle = keyword_flags(omr, "subject_id", "result_name", "result_value", K.LIFESTYLE_FLAGS, entities=stays)
    names = [n for v in K.ANTHROPOMETRIC_ALIASES.values() for n in v]
    measures = first_measure(omr, "subject_id", "result_name", "result_value", ["chartdate", "result_value"], names)
    present = None
    if alias_mode == "table":  # which alias names occur at all: at most len(names) rows
        present = [r[0] for r in omr.where(F.col("result_name").isin(names)).select("result_name").distinct().collect()]
    anthro = anthropometrics(measures, "subject_id", K.ANTHROPOMETRIC_ALIASES, K.INCH_TO_CM, K.LB_TO_KG,
                             alias_mode, present)

    vital_items = K.item_table(spark, K.VITAL_ITEMS, "itemid")
    all_vital_ids = [i for v in K.VITAL_ITEMS.values() for i in v]
    ce = (t["chartevents"].where(F.col("itemid").isin(all_vital_ids))          # pushed to the scan
          .select("stay_id", F.col("itemid").cast("long").alias("itemid"), "charttime",
                  number(t["chartevents"], "valuenum").alias("valuenum")))
    if convert_units:
        conv = spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in K.CHART_CONVERSIONS.items()],
                                     "itemid long, _scale double, _offset double")
        ce = (ce.join(F.broadcast(conv), "itemid", "left")   # fixed-size code table
                .withColumn("valuenum", F.col("valuenum") * F.coalesce("_scale", F.lit(1.0))
                            + F.coalesce("_offset", F.lit(0.0))).drop("_scale", "_offset"))
    ce = window_join(ce, stays.select("stay_id", "intime"), "stay_id", "charttime", "intime", 0.0, window_hours)
    vitals = measure_features(lookup(ce, vital_items, "itemid"), "stay_id", "item_type", "valuenum",
                              list(K.VITAL_ITEMS), K.VITAL_STATS)

    lab_items = K.item_table(spark, K.LAB_ITEMS, "itemid")
    all_lab_ids = [i for v in K.LAB_ITEMS.values() for i in v]
    le = (t["labevents"].where(F.col("itemid").isin(all_lab_ids) & F.col("hadm_id").isNotNull())
          .select("hadm_id", F.col("itemid").cast("long").alias("itemid"), "charttime",
                  number(t["labevents"], "valuenum").alias("valuenum")))
    le = window_join(le, stays.select("hadm_id", "stay_id", "intime"), "hadm_id", "charttime", "intime",
                     0.0, window_hours)
    labs = measure_features(lookup(le, lab_items, "itemid"), "stay_id", "item_type", "valuenum",
                            list(K.LAB_ITEMS), K.LAB_STATS)

    base = labelled.select("subject_id", "hadm_id", "stay_id", "gender", "anchor_age", "first_careunit", TARGET)
    wide = wide_join(base, [(comorbid, "subject_id"), (lifestyle, "subject_id"), (anthro, "subject_id"),
                            (vitals, "stay_id"), (labs, "stay_id")])
    return wide.select(
        "*",
        indicator("gender", "M").alias("gender_male"),
        *one_hot("first_careunit", K.MAJOR_CARE_UNITS, prefix="icu_"),
        either_flag("smoking_icd", "smoking_omr").alias("smoking"),
        either_flag("alcohol_icd", "alcohol_omr").alias("alcohol"),
    )


def clean(df: DataFrame, rules=K.RANGE_RULES, threshold: float = 0.5) -> DataFrame:
    """Stay-length filter (skipped without ``los``), range rules, drop the 7-day
    label, then sparse columns and incomplete rows."""
    df = Q.min_value_filter(df, "los", 1.0, optional=True)
    df = Q.range_filter(Q.nans_to_nulls(df), rules)
    df = df.drop("mortality_7d")
    return Q.drop_sparse(df, threshold, keep=[*ID_COLS, TARGET])


def split(df: DataFrame, seed: int = 42) -> DataFrame:
    return S.stratified_split(df, "subject_id", TARGET, (0.6, 0.2, 0.2), seed=seed)


def encode(parts: DataFrame) -> tuple[DataFrame, list[str], list[str]]:
    """F1 + D2: train-fitted label codes (unseen -> -1) and train-mean imputation."""
    cats = P.categorical_columns(parts, exclude=["split"])
    codes = P.fit_label_codes(parts.where(F.col("split") == "train"), cats)
    enc = P.apply_label_codes(parts, codes, cats)
    enc = Q.impute(enc, Q.fit_means(enc.where(F.col("split") == "train")))
    return enc, P.feature_columns(enc, TARGET), cats


def variants(enc: DataFrame, feats: list[str], cats: list[str], seed: int = 42) -> dict[str, DataFrame]:
    """Original, SMOTE and down-sampled train parts, each materialised once."""
    train = enc.where(F.col("split") == "train")
    out = {"original": train,
           "smote": smote_union(train, "subject_id", TARGET, feats, categorical=cats, seed=seed).drop("synthetic"),
           "downsampling": S.downsample(train, "subject_id", TARGET, seed=seed, shuffle_col=None)}
    return {k: v.checkpoint(eager=True) for k, v in out.items()}


TREES = ("Random_Forest", "Extra_Trees", "XGBoost", "LightGBM")


def run(spark: SparkSession, base: str, out_dir: str, fmt: str = "csv", models=MD.MODEL_NAMES,
        tune: Sequence[str] = MD.BOOSTED, n_trials: int | None = None) -> DataFrame:
    """The whole pipeline, writing every stage (S4) and returning the leaderboard.

    extract -> clean -> split -> variants -> fits -> tuning of the ``tune`` families on every variant with
    their test metrics (``n_trials``: the original's number if not given; no families: no tuning) ->
    attributions and importance of the best tree model, reloaded from its saved files, over all test rows."""
    ensure_checkpoint_dir(spark)
    t = load(spark, base, fmt)
    final = extract(t)
    write_table(final, os.path.join(out_dir, "final_dataset"))
    cleaned = clean(final).checkpoint(eager=True)
    write_table(cleaned, os.path.join(out_dir, "cleaned"))
    parts = split(cleaned)
    write_table(parts, os.path.join(out_dir, "split"), partition_by=["split"])
    enc, feats, cats = encode(parts)
    enc = enc.checkpoint(eager=True)
    val, test = enc.where(F.col("split") == "val"), enc.where(F.col("split") == "test")
    train = variants(enc, feats, cats)
    board = MD.run_grid(train, val, feats, TARGET, models, out_dir=os.path.join(out_dir, "models"))
    write_table(board, os.path.join(out_dir, "leaderboard"))
    if tune:
        write_table(SR.tuning_matrix(train, val, test, feats, TARGET, tune, n_trials), os.path.join(out_dir, "tuning"))
    best = board.where(F.col("model_name").isin(*TREES) & F.col("roc_auc").isNotNull()).orderBy(
        F.desc("roc_auc"), "resampling_method", "model_name").first()
    if best:
        explain(spark, best["model_path"], test, os.path.join(out_dir, "explain"))
    return board


def explain(spark: SparkSession, model_path: str, rows: DataFrame, out_dir: str) -> DataFrame:
    """M17 + A18 + S5: a saved tree model's attributions of ``rows`` as JSON, with what they add up from, and its
    features by importance."""
    fitted = MD.Fitted.load(spark, model_path)
    attr, expected = EX.tree_attributions(rows, "subject_id", fitted.features, fitted.model, fitted.name, fitted.cuts)
    write_table(attr, os.path.join(out_dir, "attributions"), fmt="json")
    info = [(fitted.name, float(expected), len(fitted.features), model_path)]
    write_table(spark.createDataFrame(info, "model_name string, expected_value double, feature_count int, model_path string"),
                os.path.join(out_dir, "model_info"), fmt="json")
    imp = EX.importance(spark.read.schema(EX.LONG_SCHEMA).json(os.path.join(out_dir, "attributions")), top=None)
    write_table(imp, os.path.join(out_dir, "importance"))
    return imp
