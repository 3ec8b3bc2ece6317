"""Prediction explanations as long attribution tables.

Output schema of every explainer:
    model_name, row_id, feature, value, attribution
plus a per-model expected value, so that for each row
    expected + sum(attribution) = model output.

* ``linear_attributions`` (M18): coef * (x - centre); pure column arithmetic.
* ``tree_attributions`` (M17): exact path-dependent TreeSHAP for MLlib random
  forests and gradient-boosted trees.  The fitted forest stays a distributed
  table of trees, dealt into slices of bounded size; a task explains a block of
  rows for a slice of trees, and the slices' values are added up by row.
* ``attribution_states``: per-feature sums of explained rows, from which means,
  spreads and importance follow without the long table (A18, A22).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LONG_SCHEMA = "model_name string, row_id bigint, feature string, value double, attribution double"
SLICE_NODES = 200_000   # nodes of the trees that a task holds at once (a larger tree is a slice of its own)
BLOCK_ROWS = 32_768     # rows that a task explains at once


def to_long(df: DataFrame, id_col: str, features: Sequence[str], value_col: str = "value") -> DataFrame:
    """Wide rows -> (row_id, feature, value)."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias(value_col))
                                for f in features])).alias("_cell")
    return df.select(F.col(id_col).cast("bigint").alias("row_id"), cells).select("row_id", "_cell.*")


def linear_attributions(df: DataFrame, id_col: str, coefs: DataFrame, features: Sequence[str]) -> DataFrame:
    """attribution = coef * (value - centre) per (model, row, feature).

    ``coefs`` has (model_name, feature, coef, centre); its size is models x
    features (schema-sized), so it is broadcast."""
    long = to_long(df, id_col, sorted(features))
    j = long.join(F.broadcast(coefs), "feature")
    return j.select("model_name", "row_id", "feature", "value",
                    (F.col("coef") * (F.col("value") - F.col("centre"))).alias("attribution"))


def linear_coefficients(fitted, train: DataFrame, model_name: str) -> DataFrame:
    """Coefficient table of a fitted MLlib linear model, centred on the train means."""
    spark = train.sparkSession
    feats = fitted.features
    means = train.agg(*[F.avg(c).alias(c) for c in feats]).first()
    coef = list(fitted.model.coefficients.toArray())
    rows = [(model_name, f, float(c), float(means[f] or 0.0)) for f, c in zip(feats, coef)]
    return spark.createDataFrame(rows, "model_name string, feature string, coef double, centre double")


def importance(attr: DataFrame, top: int | None = 20) -> DataFrame:
    """Mean |attribution| per (model, feature), descending, top-k per model."""
    imp = attr.groupBy("model_name", "feature").agg(F.avg(F.abs("attribution")).alias("importance"))
    if top is None:
        return imp
    from pyspark.sql import Window
    w = Window.partitionBy("model_name").orderBy(F.desc("importance"), "feature")
    return imp.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


# ---------------------------------------------------------------------------
# TreeSHAP
# ---------------------------------------------------------------------------

def forest_table(spark: SparkSession, model, cuts: Sequence[Sequence[float]] | None = None) -> DataFrame:
    """The nodes of a fitted MLlib tree ensemble: tree, scale, id, left, right, feature, threshold, value, cover.

    A ``forest.Forest`` is such a table already.  For an MLlib forest on indicators of cut points ``cuts`` holds the points of
    each feature: its splits are then told as splits of the features themselves.

    The model is saved under the session's checkpoint folder and its node table read back; nothing of it but the
    trees' weights passes through the driver.  ``scale`` is what a tree's output counts for: its weight for boosted
    trees (margin), 1 / trees for a forest (mean of the leaves' shares of class 1)."""
    from ..session import ensure_checkpoint_dir
    from .forest import Forest
    if isinstance(model, Forest):       # a table already, told in the features themselves
        return model.table()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    if "treeID" not in nodes.columns:  # single decision tree
        nodes = nodes.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
    n = nodes.select(F.col("treeID").cast("int").alias("tree"), "nodeData.*")
    stats, total = F.col("impurityStats"), F.aggregate("impurityStats", F.lit(0.0), lambda a, v: a + v)
    if "GBT" in type(model).__name__:
        weights = [float(w) for w in model.treeWeights]
        cover, value = F.coalesce(F.get(stats, F.lit(0)), F.col("rawCount").cast("double")), F.col("prediction")
    else:
        weights = [1.0 / k for k in [getattr(model, "getNumTrees", 1)] for _ in range(k)]
        cover = F.when(total > 0, total).otherwise(F.col("rawCount").cast("double"))
        value = F.when(total > 0, F.coalesce(F.get(stats, F.lit(1)), F.lit(0.0)) / total).otherwise(0.0)
    scales = spark.createDataFrame(list(enumerate(weights)), "tree int, scale double")
    feature, threshold = F.col("split.featureIndex"), F.coalesce(F.get("split.leftCategoriesOrThreshold", F.lit(0)), F.lit(0.0))
    if cuts is not None:
        points = F.array(*[F.lit(float(c)) for f in cuts for c in f])
        threshold = F.when(feature >= 0, F.get(points, feature)).otherwise(0.0)
        feature = F.when(feature >= 0, F.floor(feature / len(cuts[0])).cast("int")).otherwise(feature)
    return n.select("tree", "id", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
                    feature.alias("feature"), threshold.alias("threshold"),
                    value.alias("value"), cover.alias("cover")).join(F.broadcast(scales), "tree")


_ARRAYS = ("left", "right", "feature", "threshold", "value", "cover")


def tree_rows(nodes: DataFrame) -> DataFrame:
    """One row per tree: its scale and its nodes as arrays in the order of their ids (0 .. n-1)."""
    by_id = F.array_sort(F.collect_list(F.struct("id", *_ARRAYS)))
    packed = nodes.groupBy("tree").agg(F.first("scale").alias("scale"), by_id.alias("nodes"))
    return packed.select("tree", "scale", *[F.col(f"nodes.{c}").alias(c) for c in _ARRAYS])


def expected_value(nodes: DataFrame) -> float:
    """The ensemble's output with no feature known: the leaves' values weighted by their share of the root's cover."""
    leaf, root = F.col("left") < 0, F.col("id") == 0
    per_tree = nodes.groupBy("tree").agg(
        (F.first("scale") * F.sum(F.when(leaf, F.col("cover") * F.col("value"))) / F.max(F.when(root, F.col("cover")))).alias("e"))
    return float(per_tree.agg(F.sum("e")).first()[0] or 0.0)


@lru_cache(maxsize=None)
def _quadrature(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre points and weights on [0, 1] that integrate polynomials of degree m - 1."""
    points, weights = np.polynomial.legendre.leggauss(max(1, math.ceil(m / 2)))
    return (points + 1) / 2, weights / 2


def leaf_table(z: Sequence[float], value: float, states: np.ndarray | None = None) -> np.ndarray:
    """What a leaf adds to each of its path's m features, (m x states): bit i of a state says whether a row follows all
    branches on feature i, whose cover ratios have the product z[i].  All 2^m states, or the given ones."""
    m = len(z)
    t, w = _quadrature(m)
    s = 1 - t
    on = [zi * s + t for zi in z]
    product = np.full((len(t), 1 if states is None else len(states)), value)
    for i in range(m):
        off = (z[i] * s)[:, None]
        if states is None:
            product = np.concatenate((product * off, product * on[i][:, None]), axis=1)
        else:
            product *= np.where((states >> np.array(i, states.dtype)) & np.array(1, states.dtype) != 0, on[i][:, None], off)
    # on the branch (1 - z) w / factor, off it (0 - z) w / (z s)
    got = np.stack([(1 - z[i]) * w / on[i] for i in range(m)] + [-w / s]) @ product
    if states is None:
        for i in range(m):
            halves = got[i].reshape(-1, 2, 1 << i)      # bit i is 0, is 1
            halves[:, 0] = got[m].reshape(-1, 2, 1 << i)[:, 0]
        return got[:m]
    return np.stack([np.where((states >> np.array(i, states.dtype)) & np.array(1, states.dtype) != 0, got[i], got[m]) for i in range(m)])


def tree_shap_batch(x: np.ndarray, tree: dict) -> np.ndarray:
    """Path-dependent TreeSHAP of one tree for a batch of rows (n x d).

    With z the product of a feature's cover ratios on a path and o whether the row follows all its branches, the
    Shapley weight of a set of k of m features is the integral of t^k (1-t)^(m-1-k), so a leaf adds to feature i

        value * (o_i - z_i) * integral over [0, 1] of  prod_{j != i} (z_j (1 - t) + o_j t) dt,

    a polynomial that Gauss-Legendre quadrature with half as many points as features integrates exactly.  A row has
    no other part in it than its m bits o: a walk down the tree carries these as one number for each row, a leaf
    reckons what it adds for each value of them (``leaf_table``), and rows look it up.  So an edge costs a few steps on
    small integers, a leaf one look-up for each feature of its path; leaves of value 0 and what lies above them only cost nothing.
    Where a path has more states than a batch has rows, only those that occur are reckoned."""
    n, d = x.shape
    phi = np.zeros((d, n))
    columns = np.ascontiguousarray(x.T)
    left, right, feature, threshold, value, cover = (np.asarray(tree[c]).tolist() for c in _ARRAYS)
    live, height, stack = [False] * len(left), 0, [(0, 0)]
    order = []
    while stack:                        # children come after their parents
        j, depth = stack.pop()
        order.append(j)
        height = max(height, depth)
        if left[j] >= 0:
            stack += [(left[j], depth + 1), (right[j], depth + 1)]
    for j in reversed(order):
        live[j] = live[left[j]] or live[right[j]] if left[j] >= 0 else bool(value[j])
    bits = min(height, d)
    if bits > 64:
        raise ValueError(f"paths of {bits} features")
    kind = np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64
    part = np.empty(n)

    def add(code: np.ndarray, features: list[int], z: list[float], v: float) -> None:
        m = len(z)
        if 2 << m <= n or m < 6:
            table, at = leaf_table(z, v), code.astype(np.intp)
        elif m <= 20:
            at = code.astype(np.intp)
            seat = np.zeros(1 << m, np.intp)
            seat[at] = 1
            states = np.flatnonzero(seat)
            seat[states] = np.arange(len(states))
            table, at = leaf_table(z, v, states), seat[at]
        else:
            states, at = np.unique(code, return_inverse=True)
            table = leaf_table(z, v, states)
        for i, f in enumerate(features):
            np.take(table[i], at, out=part, mode="clip")
            phi[f] += part

    def walk(j: int, code: np.ndarray, features: list[int], z: list[float]) -> None:
        f = feature[j]
        known = columns[f] <= threshold[j]      # a missing value goes right
        at = features.index(f) if f in features else -1
        for child, go in ((left[j], known), (right[j], ~known)):
            if not live[child]:
                continue
            share = cover[child] / cover[j] if cover[j] > 0 else 0.0
            if at < 0:
                below = code | (go.astype(kind) << kind(len(z)))
                named, ratios = [*features, f], [*z, share]
            else:               # split again: the bit goes where this branch is left
                below = code & ~((~go).astype(kind) << kind(at))
                named, ratios = features, [*z[:at], z[at] * share, *z[at + 1:]]
            if left[child] < 0:
                add(below, named, ratios, value[child])
            else:
                walk(child, below, named, ratios)

    if left[0] >= 0 and live[0]:
        walk(0, np.zeros(n, kind), [], [])
    return phi.T


def _explain_block(rows: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
    """What the given trees add to the attributions of the given rows."""
    if rows.empty or trees.empty:
        none = np.empty(0, np.int64)
        return pd.DataFrame({"_row": none, "_rid": none, "x": none.astype(object), "phi": none.astype(object)})
    x = np.stack(rows["x"].to_numpy())
    phi = np.zeros_like(x)
    for r in trees.to_dict("records"):
        for lo in range(0, len(x), BLOCK_ROWS):
            phi[lo:lo + BLOCK_ROWS] += r["scale"] * tree_shap_batch(x[lo:lo + BLOCK_ROWS], r)
    return pd.DataFrame({"_row": rows["_row"].to_numpy(), "_rid": rows["_rid"].to_numpy(), "x": list(x), "phi": list(phi)})


def explained_rows(df: DataFrame, id_col: str, features: Sequence[str], fitted_model, slice_nodes: int = SLICE_NODES,
                   block_rows: int = BLOCK_ROWS, cuts: dict[str, Sequence[float]] | None = None) -> tuple[DataFrame, float]:
    """Attributions of every row as arrays in the order of ``features``: (row_id, x, phi), and the expected value.
    ``cuts`` are the random cut points of extra trees (``Fitted.cuts``).

    Rows are dealt into blocks by a hash of their place in a checkpointed table, so equal or repeated ids do not
    meet in one; trees into slices of about ``slice_nodes`` nodes, fewer where there are too few blocks for all cores, as a
    tree's leaves are reckoned once for each block.  Blocks and slices are cogrouped: what is shuffled
    is each row once per slice and each tree once per block."""
    from ..session import ensure_checkpoint_dir
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    feats = list(features)
    nan = F.lit(float("nan"))
    rows = df.select(F.col(id_col).cast("bigint").alias("_rid"),
                     F.array(*[F.coalesce(F.col(f).cast("double"), nan) for f in feats]).alias("x")).checkpoint(eager=True)
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    nodes = forest_table(spark, fitted_model, [cuts[f] for f in feats] if cuts else None).checkpoint(eager=True)
    expected = expected_value(nodes)
    n_rows, tasks = rows.count(), 2 * spark.sparkContext.defaultParallelism
    n_blocks = max(1, math.ceil(n_rows / block_rows))
    slice_nodes = max(1, min(slice_nodes, math.ceil(nodes.count() / math.ceil(tasks / n_blocks))))
    # one row for each tree: a window over a parameter's number of rows
    before = Window.orderBy("tree").rowsBetween(Window.unboundedPreceding, -1)
    sizes = nodes.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    slices = sizes.select("tree", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / slice_nodes).cast("int").alias("slice"))
    slices = slices.select("tree", (F.dense_rank().over(Window.orderBy("slice")) - 1).alias("slice")).checkpoint(eager=True)
    n_slices = int(slices.agg(F.max("slice")).first()[0]) + 1
    n_blocks = max(n_blocks, math.ceil(tasks / n_slices))
    keys = ["_block", "_slice"]
    every_slice = F.explode(F.sequence(F.lit(0), F.lit(n_slices - 1))).alias("_slice")
    every_block = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("_block")
    a = rows.select("*", F.pmod(F.xxhash64("_row"), F.lit(n_blocks)).cast("int").alias("_block"), every_slice)
    b = tree_rows(nodes).join(slices.withColumnRenamed("slice", "_slice"), "tree").select("*", every_block)
    n_tasks = 3 * n_blocks * n_slices      # more partitions than groups, so that few share one
    part = (a.repartition(n_tasks, *keys).groupBy(*keys).cogroup(b.repartition(n_tasks, *keys).groupBy(*keys))
             .applyInPandas(_explain_block, "_row bigint, _rid bigint, x array<double>, phi array<double>"))
    if n_slices > 1:
        whole = F.array(*[F.sum(F.col("phi")[i]) for i in range(len(feats))])
        part = part.groupBy("_row").agg(F.first("_rid").alias("_rid"), F.first("x").alias("x"), whole.alias("phi"))
    known = F.transform("x", lambda v: F.when(~F.isnan(v), v))
    return part.select(F.col("_rid").alias("row_id"), known.alias("x"), "phi"), expected


def tree_attributions(df: DataFrame, id_col: str, features: Sequence[str], fitted_model,
                      model_name: str, cuts: dict[str, Sequence[float]] | None = None) -> tuple[DataFrame, float]:
    """Exact TreeSHAP per (row, feature) for an MLlib RF/GBT model.

    Returns (long attribution table, expected value).  For GBT the explained
    output is the margin ``rawPrediction[1]``; for RF it is P(y=1)."""
    rows, expected = explained_rows(df, id_col, features, fitted_model, cuts=cuts)
    names = F.array(*[F.lit(f) for f in features])
    cell = F.explode(F.arrays_zip(names.alias("feature"), F.col("x").alias("value"), F.col("phi").alias("attribution"))).alias("_c")
    return rows.select(F.lit(model_name).alias("model_name"), "row_id", cell).select("model_name", "row_id", "_c.*"), expected


def attribution_states(rows: DataFrame, features: Sequence[str], model_name: str, array: str = "phi") -> DataFrame:
    """A18/A22 without the long table: one row per feature with what the attributions of all rows add up to:
    (model_name, feature, n, total, total_abs, total_sq, least, most).  States of several tables merge by adding
    (least and most: by minimum and maximum)."""
    feats = list(features)
    v = [F.col(array)[i] for i in range(len(feats))]
    state = [F.struct(F.lit(f).alias("feature"), F.count(c).alias("n"), F.sum(c).alias("total"), F.sum(F.abs(c)).alias("total_abs"),
                      F.sum(c * c).alias("total_sq"), F.min(c).alias("least"), F.max(c).alias("most")) for f, c in zip(feats, v)]
    return rows.agg(F.array(*state).alias("_s")).select(F.explode("_s").alias("_s")).select(F.lit(model_name).alias("model_name"), "_s.*")


def importance_of(states: DataFrame, top: int | None = 20) -> DataFrame:
    """A18 from states: mean |attribution| per (model, feature), descending, top-k per model."""
    imp = states.select("model_name", "feature", F.try_divide("total_abs", "n").alias("importance"))
    if top is None:
        return imp
    w = Window.partitionBy("model_name").orderBy(F.desc("importance"), "feature")
    return imp.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
