"""TreeSHAP: additivity against MLlib's own outputs and equality with brute-force Shapley."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vitalis.operators import explain as E
from vitalis.operators import forest as FO


def _extend(m, pz, po, pi):
    m = [list(e) for e in m]
    length = len(m)
    m.append([pi, pz, po, 1.0 if length == 0 else 0.0])
    for i in range(length - 1, -1, -1):
        m[i + 1][3] += po * m[i][3] * (i + 1) / (length + 1)
        m[i][3] = pz * m[i][3] * (length - i) / (length + 1)
    return m


def _unwind(m, i):
    m = [list(e) for e in m]
    last = len(m) - 1
    n = m[last][3]
    for j in range(last - 1, -1, -1):
        if m[i][2] != 0:
            t = m[j][3]
            m[j][3] = n * (last + 1) / ((j + 1) * m[i][2])
            n = t - m[j][3] * m[i][1] * (last - j) / (last + 1)
        else:
            m[j][3] = m[j][3] * (last + 1) / (m[i][1] * (last - j))
    for j in range(i, last):
        m[j][0], m[j][1], m[j][2] = m[j + 1][0], m[j + 1][1], m[j + 1][2]
    m.pop()
    return m


def tree_shap_row(x: np.ndarray, tree: dict, phi: np.ndarray) -> None:
    """Add one tree's exact path-dependent SHAP values for row ``x`` to ``phi``."""
    left, right, feat, thr, val, cover = (tree[k] for k in ("left", "right", "feature", "threshold", "value", "cover"))

    def recurse(j, m, pz, po, pi):
        m = _extend(m, pz, po, pi)
        if left[j] < 0:
            for i in range(1, len(m)):
                w = sum(e[3] for e in _unwind(m, i))
                phi[m[i][0]] += w * (m[i][2] - m[i][1]) * val[j]
            return
        d = feat[j]
        xv = x[d]
        hot, cold = (left[j], right[j]) if (not np.isnan(xv) and xv <= thr[j]) else (right[j], left[j])
        iz = io = 1.0
        k = next((k for k in range(1, len(m)) if m[k][0] == d), None)
        if k is not None:
            iz, io = m[k][1], m[k][2]
            m = _unwind(m, k)
        cj = cover[j] if cover[j] > 0 else 1.0
        recurse(hot, m, iz * cover[hot] / cj, io, d)
        recurse(cold, m, iz * cover[cold] / cj, 0.0, d)

    recurse(0, [], 1.0, 1.0, -1)


def _data(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):
        a, b, c = rng.normal(size=3)
        y = int(a + 0.5 * b * c + rng.normal(scale=0.3) > 0)
        rows.append((i, float(a), float(b), float(c), y))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, label int")


def _cond_expect(x, tree, subset):
    left, right, feat, thr, val, cover = (tree[k] for k in ("left", "right", "feature", "threshold", "value", "cover"))

    def go(j):
        if left[j] < 0:
            return val[j]
        if feat[j] in subset:
            return go(left[j] if x[feat[j]] <= thr[j] else right[j])
        return (cover[left[j]] * go(left[j]) + cover[right[j]] * go(right[j])) / cover[j]
    return go(0)


def _brute(x, tree, n):
    phi = np.zeros(n)
    for i in range(n):
        others = [k for k in range(n) if k != i]
        for r in range(len(others) + 1):
            for s in itertools.combinations(others, r):
                w = math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n)
                phi[i] += w * (_cond_expect(x, tree, set(s) | {i}) - _cond_expect(x, tree, set(s)))
    return phi


@pytest.mark.parametrize("kind", ["rf", "gbt"])
def test_tree_shap_additive_and_exact(spark, kind):
    df = _data(spark)
    feats = ["a", "b", "c"]
    vec = VectorAssembler(inputCols=feats, outputCol="features").transform(df)
    if kind == "rf":
        model = RandomForestClassifier(numTrees=5, maxDepth=4, seed=1).fit(vec)
        out = vector_to_array("probability")[1]
    else:
        model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(vec)
        out = vector_to_array("rawPrediction")[1]
    sample = df.where(F.col("id") < 20)
    attr, expected = E.tree_attributions(sample, "id", feats, model, "m")
    sums = {r["row_id"]: r["s"] for r in attr.groupBy("row_id").agg(F.sum("attribution").alias("s")).collect()}
    truth = {r["id"]: r["o"] for r in model.transform(VectorAssembler(inputCols=feats, outputCol="features")
                                                      .transform(sample)).select("id", out.alias("o")).collect()}
    assert len(sums) == 20
    for k, v in truth.items():
        assert abs(expected + sums[k] - v) < 1e-6
    # exact Shapley values of the first tree by brute force; batch == per-row
    trees = [r.asDict() for r in E.tree_rows(E.forest_table(spark, model)).orderBy("tree").collect()]
    xs = np.array([[r["a"], r["b"], r["c"]] for r in sample.collect()])
    for t in trees:
        batch = E.tree_shap_batch(xs, t)
        for i, x in enumerate(xs):
            one = np.zeros(3)
            tree_shap_row(x, t, one)
            assert np.allclose(batch[i], one, atol=1e-10)
    for r in sample.limit(5).collect():
        x = np.array([r["a"], r["b"], r["c"]])
        phi = np.zeros(3)
        tree_shap_row(x, trees[0], phi)
        assert np.allclose(phi, _brute(x, trees[0], 3), atol=1e-9)
    # many slices and blocks give what one gives, and the states what the long table gives
    rows, again = E.explained_rows(sample.unionByName(sample.where("id < 3")), "id", feats, model, slice_nodes=10, block_rows=3)
    assert abs(again - expected) < 1e-12
    want = {(r["row_id"], f): v for r in attr.groupBy("row_id").pivot("feature", feats).agg(F.first("attribution")).collect()
            for f, v in zip(feats, (r["a"], r["b"], r["c"]))}
    got = rows.collect()
    assert len(got) == 23
    for r in got:
        for f, v in zip(feats, r["phi"]):
            assert abs(want[r["row_id"], f] - v) < 1e-9
    states = E.attribution_states(rows, feats, "m")
    assert "Generate" not in _plan(rows.agg(F.sum(F.col("phi")[0]))) and states.count() == 3
    imp = {r["feature"]: r["importance"] for r in E.importance_of(states).collect()}
    for i, f in enumerate(feats):
        assert abs(imp[f] - np.mean([abs(r["phi"][i]) for r in got])) < 1e-9


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().split("Exchange")[0].split("FlatMapCoGroups")[0]


def _random_tree(rng, d, depth):
    """A tree of given depth whose features repeat on its paths; covers add up."""
    tree = {k: [] for k in ("left", "right", "feature", "threshold", "value", "cover")}

    def grow(cover, left_depth):
        j = len(tree["left"])
        for k, v in (("left", -1), ("right", -1), ("feature", -1), ("threshold", 0.0), ("value", float(rng.normal())), ("cover", cover)):
            tree[k].append(v)
        if left_depth and cover >= 2 and rng.random() < 0.9:
            part = float(rng.integers(1, int(cover)))
            tree["feature"][j], tree["threshold"][j] = int(rng.integers(d)), float(rng.normal())
            tree["left"][j] = grow(part, left_depth - 1)
            tree["right"][j] = grow(cover - part, left_depth - 1)
        return j
    grow(500.0, depth)
    return {k: np.array(v) for k, v in tree.items()}


@pytest.mark.parametrize("seed", range(8))
def test_tree_shap_with_repeated_features_and_missing_values(seed):
    rng = np.random.default_rng(seed)
    d = int(rng.integers(1, 6))
    tree = _random_tree(rng, d, int(rng.integers(0, 9)))
    xs = rng.normal(size=(12, d))
    xs[rng.random(xs.shape) < 0.1] = np.nan
    batch = E.tree_shap_batch(xs, tree)
    for i, x in enumerate(xs):
        one = np.zeros(d)
        tree_shap_row(x, tree, one)
        assert np.allclose(batch[i], one, atol=1e-9)


def test_tree_shap_cost_does_not_follow_the_number_of_paths():
    """A deep tree takes a walk over its edges, in little memory."""
    rng = np.random.default_rng(1)
    tree = _random_tree(rng, 12, 24)
    xs = rng.normal(size=(50, 12))
    for x, phi in zip(xs[:3], E.tree_shap_batch(xs, tree)[:3]):
        out = np.zeros(12)
        tree_shap_row(x, tree, out)
        assert np.allclose(phi, out, atol=1e-8)


def test_one_product_and_one_lookup_for_each_branch(monkeypatch):
    """Leaves of value 0 cost nothing and no factor is divided by row: a chain of splits whose leaves are 0 but for the last."""
    n_splits, n = 12, 64
    tree = {c: [] for c in ("left", "right", "feature", "threshold", "value", "cover")}
    for k in range(n_splits):           # node 2k splits on feature k, its left child 2k + 1 is a leaf
        for node in ((2 * k + 1, 2 * k + 2, k, 0.0, 0.5, float(n_splits - k + 1)), (-1, -1, -1, 0.0, 0.0, 1.0)):
            for c, v in zip(tree, node):
                tree[c].append(v)
    for c, v in zip(tree, (-1, -1, -1, 0.0, 1.0, 1.0)):
        tree[c].append(v)
    lookups, take = [], np.take
    monkeypatch.setattr(E.np, "take", lambda *a, **k: lookups.append(1) or take(*a, **k))
    x = np.random.default_rng(0).standard_normal((n, n_splits))
    phi = E.tree_shap_batch(x, tree)
    assert len(lookups) == n_splits     # one for each split, none for its leaf of value 0
    follows = (x > 0).all(axis=1)
    assert np.allclose(phi.sum(axis=1), follows - 1.0 / (n_splits + 1))


def _chain(d, rng):
    """A tree whose longest path splits on each of ``d`` features once, then on the first one again."""
    n = 2 * (d + 1) + 1
    t = {"left": [-1] * n, "right": [-1] * n, "feature": [-1] * n, "threshold": [0.0] * n, "value": rng.random(n).tolist(), "cover": [0.0] * n}
    at, cover = 0, 4096.0
    for k in range(d + 1):
        t["left"][at], t["right"][at], t["feature"][at], t["threshold"][at], t["cover"][at] = 2 * k + 1, 2 * k + 2, k % d, -0.5 if k == d else 0.0, cover
        t["cover"][2 * k + 2] = cover * 0.3
        at, cover = 2 * k + 1, cover * 0.7
    t["cover"][at] = cover
    return t


@pytest.mark.parametrize("d", [4, 9, 22])
def test_states_of_a_path_are_reckoned_once_whatever_the_batch(d):
    """All states of short paths, those that occur of longer ones: a row's values do not depend on the rows beside it, and add up."""
    rng = np.random.default_rng(d)
    tree, x = _chain(d, rng), np.random.default_rng(1).normal(size=(3000, d)) - 1.5
    phi = E.tree_shap_batch(x, tree)
    assert np.allclose(phi[:5], np.vstack([E.tree_shap_batch(x[i:i + 1], tree) for i in range(5)]), atol=1e-12)
    left, cover, value = (np.array(tree[c]) for c in ("left", "cover", "value"))
    expected = (cover * value)[left < 0].sum() / cover[0]
    assert np.allclose(phi.sum(axis=1) + expected, FO._descend(x, tree), atol=1e-9)
    z = [0.7, 0.2, 0.9]
    assert np.allclose(E.leaf_table(z, 2.0), E.leaf_table(z, 2.0, np.arange(8)))
    assert np.isclose(E.leaf_table(z, 2.0)[:, 7].sum(), 2.0 * (1 - np.prod(z)))


def test_few_rows_are_explained_by_all_cores(spark):
    """One block of rows: its trees are dealt over the tasks, so that no leaf is reckoned for every few rows anew."""
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 5), int(i % 3 == 0)) for i in range(200)], "id long, a double, b double, label int")
    model = FO.fit_forest(rows, ["a", "b"], params={"numTrees": 12, "maxDepth": 4})
    explained, expected = E.explained_rows(rows, "id", ["a", "b"], model)
    plan = explained._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "sum" in plan      # the slices' values are added up by row
    got = {r["row_id"]: sum(r["phi"]) + expected for r in explained.collect()}
    scores = {r["id"]: r["score"] for r in model.transform(rows).collect()}
    assert len(got) == 200 and all(abs(got[i] - scores[i]) < 1e-9 for i in scores)
