"""Model-side operators on a tiny table: grid, search, early stopping, tuning, save/load, decoding."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from vitalis.functions.columns import to_ts
from vitalis.operators import features as FE
from vitalis.operators import metrics as M
from vitalis.operators import models as MD
from vitalis.operators import prep as P
from vitalis.operators import sampling as S
from vitalis.operators import search as SR
from vitalis.operators.smote import smote_union
from vitalis.sources.tables import load_model, safe_load, save_model


@pytest.fixture(scope="module")
def tiny(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(160):
        a, b = rng.normal(size=2)
        y = int(a + rng.normal(scale=0.5) > 0.8)
        rows.append((i, float(a), float(b), int(rng.integers(0, 3)), y, ["train", "val", "test"][i % 3]))
    return spark.createDataFrame(rows, "id long, a double, b double, c int, label int, split string")


def test_grid_and_error_rows(spark, tiny):
    tr, val = tiny.where("split = 'train'"), tiny.where("split = 'val'")
    board = MD.run_grid({"original": tr}, val, ["a", "b", "c"], "label",
                        models=["Logistic_Regression", "No_Such_Model"], parallel=2).collect()
    by = {r["model_name"]: r for r in board}
    assert by["Logistic_Regression"]["error"] is None and by["Logistic_Regression"]["roc_auc"] > 0.6
    assert by["No_Such_Model"]["roc_auc"] is None and "unknown model" in by["No_Such_Model"]["error"]


def test_search_and_tuning_matrix(spark, tiny):
    tr, val, te = (tiny.where(f"split = '{s}'") for s in ("train", "val", "test"))
    trials = SR.search("Logistic_Regression", tr, val, ["a", "b", "c"], "label", n_trials=3)
    assert trials.count() == 3 and trials.where("error IS NULL").count() == 3
    best = SR.best_trial(trials)
    assert best["val_roc_auc"] == max(r["val_roc_auc"] for r in trials.collect())
    m = SR.tuning_matrix({"original": tr}, val, te, ["a", "b", "c"], "label",
                         models=["Logistic_Regression"], n_trials=2).first()
    assert m["base_model"] == "Logistic_Regression" and m["resampling_method"] == "original"
    assert m["error"] is None and m["n_trials"] == 2


def test_early_stopping_fit(spark, tiny):
    tr, val = tiny.where("split = 'train'"), tiny.where("split = 'val'")
    params = {"n_estimators": 5, "max_depth": 3, "learning_rate": 0.1, "subsample": 1.0,
              "colsample_bytree": 1.0, "reg_alpha": 0.0, "reg_lambda": 0.0, "num_leaves": 10}
    f = SR.fit_trial("LightGBM", tr, val, ["a", "b", "c"], "label", params, tr.count())
    assert 1 <= f.model.getNumTrees <= 5
    # the rounds kept are those of the fit on train alone, cut at the best validation loss
    full = MD.fit("LightGBM", tr, ["a", "b", "c"], "label", SR.to_mllib("LightGBM", params, float(tr.count())))
    assert f.model.getNumTrees == SR.best_round(full.round_losses(val))


def test_best_round_waits_with_patience():
    assert SR.best_round([3.0, 2.0, 2.5, 2.4, 1.0], patience=3) == 5
    assert SR.best_round([3.0, 2.0, 2.5, 2.4, 2.3, 1.0], patience=3) == 2
    assert SR.best_round([1.0]) == 1


def test_missing_classes_and_scores_are_errors(spark, tiny):
    holes = tiny.withColumn("label", F.when(F.col("id") % 9 != 0, F.col("label")))
    with pytest.raises(ValueError, match="18 rows"):
        S.downsample(holes, "id", "label")
    parts = S.stratified_split(holes.withColumn("id", F.when(F.col("id") % 5 != 0, F.col("id"))).drop("split"), "id", "label")
    assert parts.count() == 160
    scores = tiny.select("label", F.when(F.col("id") > 1, F.col("a")).otherwise(F.lit(float("nan"))).alias("score"), F.lit(1).alias("prediction"))
    with pytest.raises(ValueError, match="2 rows"):
        M.evaluate(scores).collect()


def test_explain_stage_from_saved_files(spark, tiny):
    from vitalis.plans import clinical as CL

    out = tempfile.mkdtemp(prefix="vitalis-test-")
    f = MD.fit("Random_Forest", tiny.where("split = 'train'"), ["a", "b", "c"], "label", params={"numTrees": 5, "maxDepth": 4})
    rows = tiny.where("split = 'test'").withColumnRenamed("id", "subject_id")
    imp = CL.explain(spark, f.save(spark, os.path.join(out, "rf")), rows, os.path.join(out, "explain"))
    assert {r["feature"] for r in imp.collect()} == {"a", "b", "c"}
    info = spark.read.json(os.path.join(out, "explain", "model_info")).first()
    sums = spark.read.json(os.path.join(out, "explain", "attributions")).groupBy("row_id").agg((F.sum("attribution") + info["expected_value"]).alias("s"))
    both = f.transform(rows).join(sums, F.col("subject_id") == F.col("row_id"))
    assert both.count() == rows.count() and both.where(F.abs(F.col("s") - F.col("score")) > 1e-6).count() == 0


def test_saved_pipeline_scores_alike(spark, tiny):
    f = MD.fit("SVC", tiny.where("split = 'train'"), ["a", "b", "c"], "label", params={"maxIter": 20})
    g = MD.Fitted.load(spark, f.save(spark, os.path.join(tempfile.mkdtemp(prefix="vitalis-test-"), "svc")))
    a, b = ([r["score"] for r in m.transform(tiny).orderBy("id").collect()] for m in (f, g))
    assert a == pytest.approx(b)


def test_model_save_load_and_safe_load(spark, tiny):
    f = MD.fit("Logistic_Regression", tiny.where("split = 'train'"), ["a", "b", "c"], "label")
    path = os.path.join(tempfile.mkdtemp(prefix="vitalis-test-"), "lr")
    save_model(f.model, path)
    m = load_model(LogisticRegressionModel, path)
    assert list(m.coefficients) == list(f.model.coefficients)
    assert safe_load(spark, path + "-missing") is None


def test_decode_round_trip(spark):
    df = spark.createDataFrame([("x",), ("y",), ("z",)], "c string")
    codes = P.fit_label_codes(df, ["c"])
    coded = spark.createDataFrame([(0.4,), (1.6,), (7.0,), (-2.0,)], "c double")
    got = sorted(r["c"] for r in P.decode_label_codes(coded, codes, ["c"]).collect())
    # 0.4 -> 0 (x), 1.6 -> 2 (z), 7.0 clipped -> 2 (z), -2.0 clipped -> 0 (x)
    assert got == ["x", "x", "z", "z"]


def test_smote_points_lie_on_segments(spark):
    rows = [(i, float(i % 7), float(i % 5), 1 if i < 12 else 0) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    out = smote_union(df, "id", "y", ["a", "b"], k=3)
    counts = {(r["y"], r["synthetic"]): r["count"] for r in out.groupBy("y", "synthetic").count().collect()}
    assert counts == {(0, 0): 48, (1, 0): 12, (1, 1): 36}
    mins = [(r["a"], r["b"]) for r in df.where("y = 1").collect()]
    lo_a, hi_a = min(p[0] for p in mins), max(p[0] for p in mins)
    for r in out.where("synthetic = 1").collect():
        assert lo_a - 1e-9 <= r["a"] <= hi_a + 1e-9


def test_table_mode_alias_and_timestamp_parse(spark):
    m = spark.createDataFrame([(1, None, 60.0, 150.0), (2, 70.0, 65.0, 160.0)], "s long, h1 double, h2 double, w double")
    aliases = {"height": ["h1", "h2"], "weight": ["w"], "bmi": []}
    table_mode = {r["s"]: r["height_cm"] for r in FE.anthropometrics(m, "s", aliases, 2.54, 0.45, "table", ["h1", "h2"]).collect()}
    row_mode = {r["s"]: r["height_cm"] for r in FE.anthropometrics(m, "s", aliases, 2.54, 0.45, "row").collect()}
    assert table_mode[1] is None and row_mode[1] == pytest.approx(60 * 2.54)
    t = spark.createDataFrame([("2024-01-02 03:04:05",)], "t string").select(to_ts("t").alias("t")).first()["t"]
    assert (t.year, t.hour, t.second) == (2024, 3, 5)


def test_svc_rbf_features_and_linear_kernel(spark, tiny):
    tr, val = tiny.where("split = 'train'"), tiny.where("split = 'val'")
    rbf = MD.fit("SVC", tr, ["a", "b", "c"], "label", params={"maxIter": 20})
    lin = MD.fit("SVC", tr, ["a", "b", "c"], "label", params={"kernel": "linear", "gamma": "auto", "maxIter": 20})
    assert rbf.rff is not None and rbf.rff[0].shape == (MD.RFF_COMPONENTS, 3)
    assert lin.rff is None
    for f in (rbf, lin):
        r = MD.evaluate_model(f, val)
        assert 0.0 <= r["roc_auc"] <= 1.0
    # the feature map approximates the RBF kernel
    w, b = MD.rff_spec(2, 0.5, 4000, seed=1)
    x, y = np.array([0.3, -0.2]), np.array([-0.1, 0.4])
    zx = np.sqrt(2 / 4000) * np.cos(w @ x + b)
    zy = np.sqrt(2 / 4000) * np.cos(w @ y + b)
    assert abs(zx @ zy - np.exp(-0.5 * ((x - y) ** 2).sum())) < 0.05


def test_feature_map_is_reckoned_by_the_batch(spark):
    spec = MD.rff_spec(2, 0.5, 7, seed=1)
    df = spark.createDataFrame([(0, 0.3, -2), (1, -0.1, 4), (2, None, 1), (3, float("nan"), 1)], "id int, a double, b int")
    mapped = df.select("id", MD.rff_array(["a", "b"], spec).alias("z"))
    z = {r["id"]: r["z"] for r in mapped.collect()}
    for i, x in ((0, (0.3, -2.0)), (1, (-0.1, 4.0))):
        assert z[i] == pytest.approx(np.sqrt(2 / 7) * np.cos(spec[0] @ np.array(x) + spec[1]), abs=1e-12)
    assert z[2] == [None] * 7 and np.isnan(z[3]).all()
    assert df.where("id > 5").select(MD.rff_array(["a", "b"], spec).alias("z")).collect() == []
    assert "lambda" not in mapped._jdf.queryExecution().toString()      # no interpreted sum per row and component


def test_long_fits_start_first(spark, tiny, monkeypatch):
    started, real = [], MD.fit
    monkeypatch.setattr(MD, "fit", lambda name, *a, **k: started.append(name) or real("Logistic_Regression", *a, **k))
    tr, val = tiny.where("split = 'train'"), tiny.where("split = 'val'")
    board = MD.run_grid({"one": tr, "two": tr}, val, ["a", "b", "c"], "label", models=["Logistic_Regression", "SVC", "XGBoost"], parallel=1)
    assert started == ["XGBoost", "XGBoost", "SVC", "SVC", "Logistic_Regression", "Logistic_Regression"]
    assert board.count() == 6 and board.where("error is not null").count() == 0
