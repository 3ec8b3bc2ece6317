"""Fits in pools with a time limit, searches that resume, cut ensembles, models saved with their preparation."""

import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from vitalis.operators import explain as E
from vitalis.operators import models as MD
from vitalis.operators import prep as P
from vitalis.operators import quality as Q
from vitalis.operators import search as SR

from .test_models import tiny  # noqa: F401 - fixture


def _slow(spark):
    """Hours of work in short tasks."""
    return spark.range(0, 10 ** 12, 1, 50_000).select(F.sum(F.col("id") * 3 % 7)).collect()


def test_a_fit_past_its_limit_is_cancelled(spark, tiny, monkeypatch):  # noqa: F811
    real = MD.fit
    monkeypatch.setattr(MD, "fit", lambda name, *a, **k: _slow(spark) if name == "SVC" else real(name, *a, **k))
    tr, val = tiny.where("split = 'train'"), tiny.where("split = 'val'")
    start = time.monotonic()
    board = MD.run_grid({"original": tr, "again": tr}, val, ["a", "b", "c"], "label", models=["SVC", "Logistic_Regression"], parallel=4, limit=25)
    by = {(r["resampling_method"], r["model_name"]): r for r in board.collect()}
    assert time.monotonic() - start < 120
    for v in ("original", "again"):
        assert "TimeoutError: stopped after 25 s" in by[v, "SVC"]["error"] and by[v, "SVC"]["roc_auc"] is None
        assert by[v, "Logistic_Regression"]["error"] is None and by[v, "Logistic_Regression"]["roc_auc"] > 0.6
    assert spark.range(5).count() == 5       # nothing of the tags is left on this thread


def test_in_pool_passes_results_and_errors(spark):
    assert MD.in_pool(spark, "p", None, lambda: spark.range(3).count()) == 3
    with pytest.raises(ZeroDivisionError):
        MD.in_pool(spark, "p", 60, lambda: 1 / 0)
    with pytest.raises(TimeoutError, match="stopped after 1 s"):
        MD.in_pool(spark, "p", 1, lambda: _slow(spark))


def test_search_resumes_where_it_stopped(spark, tiny, monkeypatch):  # noqa: F811
    tr, val = tiny.where("split = 'train'"), tiny.where("split = 'val'")
    store = os.path.join(tempfile.mkdtemp(prefix="vitalis-test-"), "trials")
    fitted, real = [], SR.fit_trial

    def broken(model, train, val, features, label, params, n_rows):
        if len(fitted) == 4:
            raise KeyboardInterrupt
        fitted.append(params["C"])
        return real(model, train, val, features, label, params, n_rows)

    monkeypatch.setattr(SR, "fit_trial", broken)
    args = ("Logistic_Regression", tr, val, ["a", "b", "c"], "label")
    with pytest.raises(KeyboardInterrupt):
        SR.search(*args, n_trials=6, parallel=2, store=store)
    assert SR.stored_trials(spark, store, "Logistic_Regression|42").count() == 4
    fitted.clear()
    monkeypatch.setattr(SR, "fit_trial", lambda *a: fitted.append(a[5]["C"]) or real(*a))
    found = {r["trial"]: r for r in SR.search(*args, n_trials=6, parallel=2, store=store).collect()}
    assert len(fitted) == 2 and sorted(found) == list(range(6))
    monkeypatch.undo()
    whole = {r["trial"]: r for r in SR.search(*args, n_trials=6).collect()}
    for t, r in whole.items():
        assert found[t]["params"] == r["params"] and found[t]["val_roc_auc"] == pytest.approx(r["val_roc_auc"])
    other = SR.search("Logistic_Regression", tr, val, ["a", "b", "c"], "label", n_trials=1, store=store, study="other")
    assert [r["study"] for r in other.collect()] == ["other"]


def test_failed_trials_are_rows(spark, tiny, monkeypatch):  # noqa: F811
    def fails(*a):
        raise ValueError("no fit")
    monkeypatch.setattr(SR, "fit_trial", fails)
    tr = tiny.where("split = 'train'")
    rows = SR.search("Logistic_Regression", tr, tr, ["a"], "label", n_trials=3).collect()
    assert [r["error"] for r in rows] == ["ValueError: no fit"] * 3 and all(r["val_roc_auc"] is None for r in rows)


def test_cut_ensemble_is_the_shorter_fit(spark, tiny):  # noqa: F811
    tr, val = tiny.where("split = 'train'"), tiny.where("split = 'val'")
    full = MD.fit("LightGBM", tr, ["a", "b", "c"], "label", {"maxIter": 6, "maxDepth": 3})
    short = MD.fit("LightGBM", tr, ["a", "b", "c"], "label", {"maxIter": 2, "maxDepth": 3})
    cut = full.first_trees(2)
    assert cut.model.getNumTrees == 2 and full.first_trees(9) is full
    a, b = ([r["score"] for r in m.transform(val).orderBy("id").collect()] for m in (cut, short))
    assert a == pytest.approx(b)
    again = MD.Fitted.load(spark, cut.save(spark, os.path.join(tempfile.mkdtemp(prefix="vitalis-test-"), "gbt")))
    assert [r["score"] for r in again.transform(val).orderBy("id").collect()] == pytest.approx(a)


def test_model_saved_with_preparation_scores_raw_rows(spark, tiny):  # noqa: F811
    raw = tiny.withColumn("c", F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit(None).cast("string")), F.col("c") + 1)) \
              .withColumn("a", F.when(F.col("id") % 7 != 0, F.col("a")))
    train = raw.where("split = 'train'")
    codes = P.fit_label_codes(train, ["c"])
    means = Q.fit_means(train, ["a", "b"])
    ready = Q.impute(P.apply_label_codes(raw, codes, ["c"]), means)
    f = MD.fit("Logistic_Regression", ready.where("split = 'train'"), ["a", "b", "c"], "label")
    with pytest.raises(ValueError, match="without its label codes"):
        f.transform_raw(raw)
    g = MD.Fitted.load(spark, f.with_preparation(codes, means).save(spark, os.path.join(tempfile.mkdtemp(prefix="vitalis-test-"), "lr")))
    want = [r["score"] for r in f.transform(ready).orderBy("id").collect()]
    assert [r["score"] for r in g.transform_raw(raw).orderBy("id").collect()] == pytest.approx(want)
    unseen = raw.where("id = 3").withColumn("c", F.lit("never seen"))
    coded = Q.impute(unseen.withColumn("c", F.lit(-1)), means)
    assert g.transform_raw(unseen).first()["score"] == pytest.approx(f.transform(coded).first()["score"])


def test_extra_trees_split_at_random_cuts(spark, tiny):  # noqa: F811
    feats = ["a", "b", "c"]
    f = MD.fit("Extra_Trees", tiny.where("split = 'train'"), feats, "label", {"numTrees": 8, "maxDepth": 5})
    ends = tiny.where("split = 'train'").agg(F.min("a"), F.max("a")).first()
    assert len(f.cuts["a"]) == MD.RANDOM_CUTS and len(set(f.cuts["a"])) > 20 and all(ends[0] <= p <= ends[1] for p in f.cuts["a"])
    trees = [r.asDict() for r in E.tree_rows(E.forest_table(spark, f.model, [f.cuts[c] for c in feats])).orderBy("tree").collect()]
    rows = f.transform(tiny).orderBy("id").collect()

    def vote(tree, x):
        j = 0
        while tree["left"][j] >= 0:
            k = tree["feature"][j]
            assert tree["threshold"][j] in f.cuts[feats[k]]
            j = tree["left"][j] if x[k] <= tree["threshold"][j] else tree["right"][j]
        return tree["value"][j]

    for r in rows:
        assert r["score"] == pytest.approx(sum(vote(t, [r[c] for c in feats]) for t in trees) / len(trees))
    assert MD.evaluate_model(f, tiny.where("split = 'val'"))["roc_auc"] > 0.6
    again = MD.Fitted.load(spark, f.save(spark, os.path.join(tempfile.mkdtemp(prefix="vitalis-test-"), "et")))
    assert [r["score"] for r in again.transform(tiny).orderBy("id").collect()] == pytest.approx([r["score"] for r in rows])
    attr, expected = E.tree_attributions(tiny.where("id < 10"), "id", feats, f.model, "et", f.cuts)
    sums = {r["row_id"]: r["s"] for r in attr.groupBy("row_id").agg(F.sum("attribution").alias("s")).collect()}
    assert all(sums[r["id"]] + expected == pytest.approx(r["score"]) for r in rows[:10])
