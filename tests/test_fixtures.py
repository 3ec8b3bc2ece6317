"""Hand-computed edge rows (FIXTURES.md §4)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from vitalis.functions.columns import horizon_flag, prefix_any
from vitalis.operators import cohort as C
from vitalis.operators import features as FE
from vitalis.operators import metrics as M
from vitalis.operators import prep as P
from vitalis.operators import quality as Q
from vitalis.operators import report as R
from vitalis.operators import sampling as S
from vitalis.sources.codes import INCH_TO_CM, LB_TO_KG, LIFESTYLE_FLAGS

T0 = dt.datetime(2024, 1, 1, 0, 0, 0)


def test_first_row_default_and_compat(spark):
    df = spark.createDataFrame([(1, 10, T0, None), (1, 11, T0 + dt.timedelta(hours=1), "A")],
                               "subject long, stay long, t timestamp, unit string")
    d = C.first_per_key(df, "subject", ["t"], ["stay"]).first()
    c = C.first_per_key(df, "subject", ["t"], ["stay"], compat=True).first()
    assert d["stay"] == 10 and d["unit"] is None
    assert c["stay"] == 10 and c["unit"] == "A"


def test_first_row_tie_breaks_on_id(spark):
    df = spark.createDataFrame([(1, 7, T0), (1, 5, T0)], "subject long, stay long, t timestamp")
    assert C.first_per_key(df, "subject", ["t"], ["stay"]).first()["stay"] == 5


@pytest.mark.parametrize("offset,not_before,expected", [
    (dt.timedelta(hours=48), False, 1),
    (dt.timedelta(hours=48, seconds=1), False, 0),
    (dt.timedelta(hours=-5), False, 1),
    (dt.timedelta(hours=-5), True, 0),
    (None, False, 0),
])
def test_horizon_label(spark, offset, not_before, expected):
    ev = None if offset is None else T0 + offset
    df = spark.createDataFrame([(T0, ev, None)], "origin timestamp, a timestamp, b timestamp")
    got = df.select(horizon_flag("origin", 48, ["a", "b"], not_before).alias("y")).first()["y"]
    assert got == expected


def test_window_join_edges(spark):
    ev = spark.createDataFrame([(1, T0 + dt.timedelta(hours=h)) for h in (-0.01, 0, 24, 24.01)],
                               "k long, t timestamp")
    an = spark.createDataFrame([(1, T0)], "k long, origin timestamp")
    hours = sorted(r["hours"] for r in C.window_join(ev, an, "k", "t", "origin", 0, 24).collect())
    assert hours == [0.0, 24.0]


def test_window_stats(spark):
    df = spark.createDataFrame([(1, "x", 2.0), (1, "x", 4.0), (1, "x", None), (2, "x", 5.0)],
                               "k long, t string, v double")
    rows = {r["k"]: r for r in FE.window_stats(df, ["k", "t"], "v").collect()}
    assert rows[1]["mean"] == 3 and rows[1]["max"] == 4 and rows[1]["min"] == 2
    assert round(rows[1]["std"], 6) == 1.414214 and rows[1]["count"] == 2
    assert rows[2]["std"] is None and rows[2]["count"] == 1


def test_prefix_flag_dots(spark):
    df = spark.createDataFrame([("E785",), (None,)], "code string")
    lit, norm = df.select(prefix_any("code", ["E78.5"]).alias("a"),
                          prefix_any("code", ["E78.5"], normalise_dots=True).alias("b")).collect()[0]
    assert (lit, norm) == (False, True)
    assert df.select(prefix_any("code", ["E78.5"]).alias("a")).collect()[1]["a"] is False


def test_any_flags_default_zero(spark):
    codes = spark.createDataFrame([(1, "E11.9")], "s long, code string")
    ents = spark.createDataFrame([(1,), (2,)], "s long")
    got = {r["s"]: r["diabetes"] for r in FE.any_flags(codes, "s", "code", {"diabetes": ["E11"]}, ents).collect()}
    assert got == {1: 1, 2: 0}


def test_keyword_flag(spark):
    rows = spark.createDataFrame([(1, "SMOKING status", "Former")], "s long, name string, value string")
    got = FE.keyword_flags(rows, "s", "name", "value", LIFESTYLE_FLAGS).first()
    assert got["smoking_omr"] == 1 and got["alcohol_omr"] == 0


def test_bmi(spark):
    m = spark.createDataFrame([(1, 70.0, 154.0)], "s long, h double, w double")
    r = FE.anthropometrics(m, "s", {"height": ["h"], "weight": ["w"], "bmi": []}, INCH_TO_CM, LB_TO_KG).first()
    assert round(r["height_cm"], 6) == 177.8
    assert round(r["weight_kg"], 6) == 69.853168
    assert round(r["bmi"], 6) == 22.096454


def test_range_filter_nan_and_null(spark):
    df = spark.createDataFrame([(1, 100.0), (2, 100.1), (3, None), (4, float("nan"))], "id long, spo2_mean double")
    kept = Q.range_filter(Q.nans_to_nulls(df), [("spo2_mean", 0, 100)]).select("id").collect()
    assert sorted(r["id"] for r in kept) == [1, 3, 4]


def test_sparse_column_at_threshold_is_dropped(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, 1.0, 1.0)], "id long, half double, full double")
    assert Q.sparse_columns(df, 0.5) == ["half"]
    assert Q.drop_sparse(df, 0.5).columns == ["id", "full"]


def test_stratified_split_counts(spark):
    df = spark.createDataFrame([(i, 1 if i < 10 else 0) for i in range(100)], "id long, y int")
    s = S.stratified_split(df, "id", "y")
    got = {(r["y"], r["split"]): r["count"] for r in s.groupBy("y", "split").count().collect()}
    assert got == {(1, "train"): 6, (1, "val"): 2, (1, "test"): 2,
                   (0, "train"): 54, (0, "val"): 18, (0, "test"): 18}
    # disjoint and exhaustive; invariant under repartitioning
    assert s.select("id").distinct().count() == 100
    again = S.stratified_split(df.repartition(7), "id", "y")
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, again.collect()))


def test_downsample_balanced_subset(spark):
    df = spark.createDataFrame([(i, 1 if i < 10 else 0) for i in range(100)], "id long, y int")
    d = S.downsample(df, "id", "y")
    got = {r["y"]: r["count"] for r in d.groupBy("y").count().collect()}
    assert got == {0: 10, 1: 10}
    assert d.select("id").distinct().count() == 20


def test_label_encoding_unseen(spark):
    train = spark.createDataFrame([("b",), ("a",)], "c string")
    test = spark.createDataFrame([("a",), ("zz",)], "c string")
    codes = P.fit_label_codes(train, ["c"])
    assert sorted(r["c"] for r in P.apply_label_codes(train, codes, ["c"]).collect()) == [0, 1]
    assert [r["c"] for r in P.apply_label_codes(test, codes, ["c"]).orderBy("c").collect()] == [-1, 0]


def test_metrics_no_predicted_positives(spark):
    p = spark.createDataFrame([(1, 0, 0.2), (0, 0, 0.1)], "label int, prediction int, score double")
    r = M.evaluate_dict(p)
    assert r["precision"] == 0 and r["f1_score"] == 0


def test_auc_ap_fixture(spark):
    p = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "label int, score double")
    r = M.ranking_metrics(p).first()
    assert r["roc_auc"] == pytest.approx(0.75)
    assert r["pr_auc"] == pytest.approx(0.833333, abs=1e-6)


def test_auc_one_class(spark):
    p = spark.createDataFrame([(1, 0.1), (1, 0.4)], "label int, score double")
    r = M.ranking_metrics(p).first()
    assert r["roc_auc"] == 0 and r["pr_auc"] == 0


def test_auc_matches_brute_force_with_ties(spark):
    import random
    rnd = random.Random(3)
    rows = [(rnd.randint(0, 1), float(rnd.randint(0, 20))) for _ in range(400)]
    p = spark.createDataFrame(rows, "label int, score double")
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    mw = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg) / (len(pos) * len(neg))
    assert M.ranking_metrics(p, n_buckets=5).first()["roc_auc"] == pytest.approx(mw, abs=1e-12)


def test_population_vs_sample_std(spark):
    attr = spark.createDataFrame([("m", 1, "f", 0.0, 1.0), ("m", 2, "f", 0.0, 3.0)],
                                 "model_name string, row_id long, feature string, value double, attribution double")
    r = R.attribution_summary(attr).first()
    assert r["std"] == pytest.approx(1.0)
    s = FE.window_stats(attr, ["feature"], "attribution").first()
    assert round(s["std"], 6) == 1.414214


def test_category_counts_feature_once(spark):
    imp = spark.createDataFrame([("m", "sbp_mean_max", 2.0), ("m", "age", 4.0)],
                                "model_name string, feature string, importance double")
    kw = spark.createDataFrame([("vitals", "sbp_"), ("vitals", "_max"), ("other", "zzz")], "category string, keyword string")
    got = {r["category"]: (r["importance"], r["n_features"]) for r in R.category_importance(imp, kw).collect()}
    assert got == {"vitals": (2.0, 1), "other": (0.0, 0)}


def test_minmax_normalise_constant_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double")
    got = {(r["g"], r["v"]): r["norm_value"] for r in R.minmax_normalise(df, "g", "v").collect()}
    assert got == {("a", 1.0): 0.0, ("a", 3.0): 1.0, ("b", 5.0): 0.0}
    assert not math.isnan(got[("b", 5.0)])


def test_hours_ignore_session_dst(spark):
    """Windows and horizons count wall-clock hours, whatever the session zone."""
    from vitalis.functions.columns import elapsed_hours
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        df = spark.sql("SELECT timestamp_ntz'2024-03-09 12:00:00' AS o, timestamp_ntz'2024-03-11 12:00:00' AS e")
        r = df.select(elapsed_hours("e", "o").alias("h"), horizon_flag("o", 48, ["e"]).alias("y")).first()
        assert (r["h"], r["y"]) == (48.0, 1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
