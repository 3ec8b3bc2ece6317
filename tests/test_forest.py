"""Forests grown in tables: parts grown apart equal the whole, scores of slices equal those of held trees, and the rules
of MLlib (purity, depth, instances, bags) hold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalis.operators import forest as FO
from vitalis.operators import models as MD
from vitalis.operators.explain import tree_attributions


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(600):
        a, b = rng.normal(size=2)
        c = int(rng.integers(0, 3))
        data.append((i, None if i % 50 == 0 else float(a), float(b), c, int(a * b + 0.3 * c + rng.normal(scale=0.4) > 0.4)))
    return spark.createDataFrame(data, "id long, a double, b double, c int, label int").repartition(3, "id").checkpoint()


FEATS = ["a", "b", "c"]


def _nodes(forest):
    return sorted(map(tuple, forest.spark.read.parquet(forest.path).select("tree", "id", "left", "right", "feature", "threshold", "w0", "w1", "raw").collect()))


def _paths(forest):
    """Every node by its path from the root: numbering inside a tree may differ."""
    out = {}
    by = {(n[0], n[1]): n for n in _nodes(forest)}
    for t in range(forest.getNumTrees):
        stack = [(0, 1)]
        while stack:
            i, heap = stack.pop()
            n = by.pop((t, i))
            out[t, heap] = (n[4], n[5], n[6], n[7], n[8])
            if n[2] >= 0:
                stack += [(n[2], 2 * heap), (n[3], 2 * heap + 1)]
    assert not by       # ids are 0 .. n-1 and every node hangs in its tree
    return out


@pytest.mark.parametrize("cuts", [None, {f: [float(v) for v in np.linspace(-2, 2, 32)] for f in FEATS}])
def test_parts_grown_apart_equal_the_whole(spark, rows, cuts):
    params = {"numTrees": 6, "maxDepth": 30, "bootstrap": cuts is None}
    whole = FO.fit_forest(rows, FEATS, "label", None, params, cuts)
    parts = FO.fit_forest(rows, FEATS, "label", None, params, cuts, local_rows=40)
    assert _paths(whole) == _paths(parts) and len(_paths(whole)) > 6 * 40
    a = whole.transform(rows).select("id", F.col("score").alias("a"), F.col("prediction").alias("p"))
    b = parts.transform(rows, held=50).select("id", F.col("score").alias("b"), F.col("prediction").alias("q"))
    both = a.join(b, "id")
    assert both.count() == 600 and both.where("abs(a - b) > 1e-9 or p <> q").count() == 0


def test_open_trees_learn_their_rows_and_keep_the_rules(spark, rows):
    f = FO.fit_forest(rows, FEATS, "label", None, {"numTrees": 1, "bootstrap": False, "maxDepth": 30, "maxBins": 200, "featureSubsetStrategy": "all"})
    scored = f.transform(rows)
    assert scored.where((F.col("score") > 0.5) == (F.col("label") == 1)).count() >= 590
    g = FO.fit_forest(rows, FEATS, "label", None, {"numTrees": 4, "maxDepth": 3, "minInstancesPerNode": 25})
    nodes = _nodes(g)
    assert min(n[8] for n in nodes if n[2] < 0) >= 25 and max(h.bit_length() for _, h in _paths(g)) <= 4
    roots = {n[0]: n[8] for n in nodes if n[1] == 0}
    assert len(set(roots.values())) > 1 and all(450 < v < 750 for v in roots.values())      # bags differ
    counts = FO.bag_counts(0, 200_000, 1, {"subsamplingRate": 1.0, "bootstrap": True, "seed": 1})
    assert counts.mean() == pytest.approx(1.0, abs=0.01) and counts.var() == pytest.approx(1.0, abs=0.02)


def test_rare_values_are_split_and_one_class_is_a_leaf(spark, rows):
    rare = rows.withColumn("flag", (F.col("id") < 5).cast("int")).withColumn("label", F.col("flag"))
    f = FO.fit_forest(rare, ["flag"], "label", None, {"numTrees": 1, "bootstrap": False})
    assert f.transform(rare).where("score <> label").count() == 0
    one = FO.fit_forest(rows.where("label = 1"), FEATS, "label", None, {"numTrees": 2}, local_rows=10)
    assert one.totalNumNodes == 2 and one.transform(rows).where("score <> 1.0").count() == 0
    with pytest.raises(ValueError, match="no parameters"):
        FO.fit_forest(rows, FEATS, params={"nTrees": 2})


@pytest.mark.parametrize("name", ["Random_Forest", "Extra_Trees"])
def test_families_save_score_and_explain(spark, rows, name, tmp_path):
    known = rows.na.drop()
    f = MD.fit(name, known, FEATS, "label", {"numTrees": 10, "maxDepth": 8})
    again = MD.Fitted.load(spark, f.save(spark, str(tmp_path / "m")))
    a = {r["id"]: r["score"] for r in f.transform(known).collect()}
    assert a == {r["id"]: r["score"] for r in again.transform(known).collect()}
    assert MD.evaluate_model(f, known)["roc_auc"] > 0.8
    attr, expected = tree_attributions(known, "id", FEATS, again.model, name, again.cuts)
    for r in attr.groupBy("row_id").agg(F.sum("attribution").alias("s")).collect():
        assert r["s"] + expected == pytest.approx(a[r["row_id"]], abs=1e-6)
