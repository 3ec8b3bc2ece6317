"""Model training and scoring on MLlib.

Six model families, each an MLlib estimator (fits are distributed); the
experiment grid is a small driver loop that submits the fits (concurrently,
from a thread pool) and gathers one metrics row per fit into a DataFrame.

Mapping to the original families (documented, not faked):
  Logistic_Regression -> LogisticRegression(maxIter=1000, balanced weights)
  SVC                 -> LinearSVC on train-standardised features mapped by
                         random Fourier features (an RBF-kernel approximation,
                         gamma 'scale' by default; kernel='linear' skips the
                         map), probability by Platt scaling (logistic fit on
                         the margin).  MLlib has no exact kernel SVM.  The mapped
                         fit is svc.fit_svc: MLlib's, without keeping the map.
  Random_Forest       -> forest.fit_forest(numTrees=100, balanced weights): MLlib's rules, grown in tables
  XGBoost             -> GBTClassifier(maxIter=100, maxDepth=6, stepSize=0.3), unweighted
  LightGBM            -> GBTClassifier(maxIter=100, maxDepth=5, stepSize=0.1), balanced weights
  Extra_Trees         -> forest.fit_forest(numTrees=100, bootstrap=False,
                         featureSubsetStrategy='sqrt') on pairs of a feature and a random
                         cut point: every feature has RANDOM_CUTS of them, drawn
                         uniformly over its train range, and a node sees a random
                         few of all (feature, cut) pairs, each with its one
                         threshold, and takes the best.
"""

from __future__ import annotations

import json
import math
import os
import threading
import traceback
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa

from pyspark import StorageLevel
from pyspark.ml.common import _py2java
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LinearSVC, LinearSVCModel,
                                       LogisticRegression, LogisticRegressionModel)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import metrics as M
from . import prep as P
from . import quality as Q
from .forest import Forest, fit_forest
from .svc import fit_svc

MODEL_NAMES = ["Logistic_Regression", "SVC", "Random_Forest", "XGBoost", "LightGBM", "Extra_Trees"]
BOOSTED = ["XGBoost", "LightGBM"]
WEIGHTED = {"Logistic_Regression", "SVC", "Random_Forest", "LightGBM", "Extra_Trees"}
SEED = 42
LONGEST_FIRST = ["XGBoost", "LightGBM", "SVC"]      # hundreds of jobs in a row each: a grid starts them before the others
MAX_DEPTH = 30      # the deepest trees MLlib grows; the original leaves depth open

LEADERBOARD_SCHEMA = T.StructType([
    T.StructField("resampling_method", T.StringType()),
    T.StructField("model_name", T.StringType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1_score", T.DoubleType()),
    T.StructField("specificity", T.DoubleType()),
    T.StructField("roc_auc", T.DoubleType()),
    T.StructField("pr_auc", T.DoubleType()),
    T.StructField("feature_count", T.IntegerType()),
    T.StructField("train_samples", T.LongType()),
    T.StructField("model_path", T.StringType()),
    T.StructField("error", T.StringType()),
])


FOREST_PARAMS = {"Random_Forest": {"numTrees": 100, "maxDepth": MAX_DEPTH, "seed": SEED},
                 "Extra_Trees": {"numTrees": 100, "bootstrap": False, "maxDepth": MAX_DEPTH, "featureSubsetStrategy": "sqrt", "seed": SEED}}


def estimator(name: str, params: dict | None = None, weight_col: str | None = None,
              label: str = "label", features: str = "features"):
    """A fresh MLlib estimator for a model family, with ``params`` overriding defaults."""
    p = dict(params or {})
    common = {"labelCol": label, "featuresCol": features}
    if weight_col:
        common["weightCol"] = weight_col
    if name == "Logistic_Regression":
        kw = {"maxIter": 1000, **p}
        return LogisticRegression(**common, **kw)
    if name == "SVC":
        return LinearSVC(**common, **{"maxIter": 100, **p})
    if name == "XGBoost":
        return GBTClassifier(**common, **{"maxIter": 100, "maxDepth": 6, "stepSize": 0.3, "seed": SEED, **p})
    if name == "LightGBM":
        return GBTClassifier(**common, **{"maxIter": 100, "maxDepth": 5, "stepSize": 0.1, "seed": SEED, **p})
    raise ValueError(f"unknown model {name!r}")


RANDOM_CUTS = 32        # cut points of a feature


def cut_table(train: DataFrame, features: Sequence[str], n_cuts: int = RANDOM_CUTS, seed: int = SEED) -> DataFrame:
    """M5: (feature, cut, point): ``n_cuts`` points of each feature, uniform over its train range.

    The draws are ``md5(feature|cut|seed)``, so they are the same on any cluster.  Features x cuts rows."""
    ends = train.agg(*[f(F.col(c).cast("double")).alias(f"{n}|{c}") for c in features for n, f in (("lo", F.min), ("hi", F.max))])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"lo|{c}").alias("lo"), F.col(f"hi|{c}").alias("hi")) for c in features])
    drawn = ends.select(F.explode(cells).alias("_e")).select("_e.*", F.explode(F.sequence(F.lit(0), F.lit(n_cuts - 1))).alias("cut"))
    digest = F.md5(F.concat_ws("|", "feature", F.col("cut").cast("string"), F.lit(str(seed))))
    u = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16 ** 13)
    return drawn.select("feature", "cut", (F.col("lo") + u * (F.col("hi") - F.col("lo"))).alias("point"))


MODEL_CLASSES = {"Logistic_Regression": LogisticRegressionModel, "SVC": LinearSVCModel,
                 "Random_Forest": Forest, "Extra_Trees": Forest,
                 "XGBoost": GBTClassificationModel, "LightGBM": GBTClassificationModel}
RFF_COMPONENTS = 100
SVC_KERNEL_PARAMS = ("kernel", "gamma", "n_components")


def rff_spec(n_features: int, gamma: float, n_components: int = RFF_COMPONENTS, seed: int = SEED):
    """Random Fourier features for the RBF kernel exp(-gamma |x - y|^2):
    z(x) = sqrt(2/D) cos(W x + b), W ~ N(0, 2 gamma), b ~ U(0, 2 pi).
    The (D x d) matrix is sized by the schema, not the data."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2.0 * gamma), size=(n_components, n_features))
    b = rng.uniform(0.0, 2.0 * math.pi, size=n_components)
    return w, b


def rff_array(features: Sequence[str], spec):
    """The feature map as one array column, reckoned for an Arrow batch at a time; a row with a null has nulls."""
    w, b = np.asarray(spec[0], float), np.asarray(spec[1], float)
    scale = math.sqrt(2.0 / len(b))

    @F.arrow_udf("array<double>")
    def mapped(cols: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in cols:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch], axis=1)
            missing = np.any([c.is_null().to_numpy(zero_copy_only=False) for c in batch], axis=0)
            z = scale * np.cos(x @ w.T + b)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(b))
            yield pa.ListArray.from_arrays(ends, pa.array(z.ravel(), mask=np.repeat(missing, len(b)) if missing.any() else None))

    return mapped(*[F.col(f).cast("double") for f in features])


def resolve_gamma(gamma, scaled_train: DataFrame, features: Sequence[str]) -> float:
    """'scale' = 1 / (d * var(X)) over all feature values, 'auto' = 1 / d, else the number."""
    d = len(features)
    if gamma == "auto":
        return 1.0 / d
    if gamma == "scale":
        cells = F.explode(F.array(*[F.col(f).cast("double") for f in features]))
        var = scaled_train.select(cells.alias("v")).agg(F.var_pop("v")).first()[0] or 0.0
        return 1.0 / (d * var) if var > 0 else 1.0
    return float(gamma)


def in_pool(spark: SparkSession, name: str, limit: float | None, work: Callable):
    """``work()`` with its Spark jobs in the scheduler pool ``name`` and under a tag of their own.

    With the session's FAIR scheduler (``session.DEFAULT_CONF``) the pools of concurrent fits share the cluster
    instead of queueing.  After ``limit`` seconds the tagged jobs are cancelled, and so are those that follow them,
    until ``work`` gives up: a TimeoutError.  Call it from the thread that submits the jobs."""
    sc, tag = spark.sparkContext, f"fit-{uuid.uuid4().hex}"
    done, late = threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(limit):
            late.set()
            while not done.is_set():
                sc.cancelJobsWithTag(tag)
                done.wait(0.2)

    sc.setLocalProperty("spark.scheduler.pool", name)
    sc.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True) if limit is not None else None
    if watcher:
        watcher.start()
    try:
        return work()
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"stopped after {limit} s") from e
        raise
    finally:
        done.set()
        sc.removeJobTag(tag)
        sc.setLocalProperty("spark.scheduler.pool", None)


class Fitted:
    """A fitted model family with everything needed to score new rows: prepared ones (``transform``) or, with the
    label codes and means of the train rows (``with_preparation``), raw ones (``transform_raw``)."""

    def __init__(self, name, model, features, scaler=None, platt=None, label="label", rff=None, codes=None, means=None, cuts=None):
        self.name, self.model, self.features = name, model, list(features)
        self.scaler, self.platt, self.label, self.rff = scaler, platt, label, rff
        self.codes, self.means, self.cuts = codes, means, cuts

    def with_preparation(self, codes: DataFrame, means: dict[str, float]) -> Fitted:
        """The same model with the train rows' label code table (F1) and imputation means."""
        return Fitted(self.name, self.model, self.features, self.scaler, self.platt, self.label, self.rff, codes, dict(means), self.cuts)

    def transform_raw(self, df: DataFrame) -> DataFrame:
        """M7 on rows with text categories and nulls: encode (unseen: -1), impute, score."""
        if self.codes is None:
            raise ValueError("this model was kept without its label codes and means")
        cats = [f.name for f in df.schema.fields if f.name in self.features and isinstance(f.dataType, T.StringType)]
        return self.transform(Q.impute(P.apply_label_codes(df, self.codes, cats), self.means or {}))

    def save(self, spark: SparkSession, path: str) -> str:
        """The model and all it needs to score: scaler, Platt numbers, feature map, feature list, and the label
        codes and means if it has them."""
        if isinstance(self.model, Forest):
            self.model.save(f"{path}/model")
        else:
            self.model.write().overwrite().save(f"{path}/model")
        if self.codes is not None:
            self.codes.write.mode("overwrite").parquet(f"{path}/codes")
        rff = [np.asarray(a).tolist() for a in self.rff] if self.rff is not None else None
        meta = json.dumps({"name": self.name, "features": self.features, "scaler": self.scaler, "platt": self.platt,
                           "label": self.label, "rff": rff, "codes": self.codes is not None, "means": self.means, "cuts": self.cuts})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        return path

    @staticmethod
    def load(spark: SparkSession, path: str) -> Fitted:
        m = json.loads(spark.read.text(f"{path}/meta").first()[0])
        model = MODEL_CLASSES[m["name"]].load(f"{path}/model")
        scaler = {k: tuple(v) for k, v in m["scaler"].items()} if m["scaler"] else None
        rff = tuple(np.array(a) for a in m["rff"]) if m["rff"] else None
        codes = spark.read.parquet(f"{path}/codes") if m.get("codes") else None
        return Fitted(m["name"], model, m["features"], scaler, tuple(m["platt"]) if m["platt"] else None, m["label"], rff, codes, m.get("means"), m.get("cuts"))

    def first_trees(self, n: int) -> Fitted:
        """A boosted ensemble cut to its first ``n`` rounds."""
        if n >= self.model.getNumTrees:
            return self
        java, jvm = self.model._java_obj, SparkSession.getActiveSession()._jvm
        gateway = SparkSession.getActiveSession().sparkContext._gateway
        trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
        weights = gateway.new_array(jvm.double, n)
        for i, (tree, weight) in enumerate(zip(java.trees()[:n], java.treeWeights()[:n])):
            trees[i], weights[i] = tree, weight
        cut = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), trees, weights))
        cut._resetUid(self.model.uid)
        cut = self.model._copyValues(cut)
        return Fitted(self.name, cut, self.features, self.scaler, self.platt, self.label, self.rff, self.codes, self.means)

    def _vectors(self, df: DataFrame) -> DataFrame:
        if self.scaler:
            df = P.apply_scaler(df, self.scaler)
        if self.rff is not None:
            return df.withColumn("features", array_to_vector(rff_array(self.features, self.rff)))
        return VectorAssembler(inputCols=self.features, outputCol="features", handleInvalid="keep").transform(df)

    def round_losses(self, df: DataFrame) -> list[float]:
        """Loss on ``df`` (every row counting alike) after each boosting round."""
        rows = self._vectors(df).select(F.col(self.label).cast("double").alias(self.label), "features",
                                        F.lit(1.0).alias("weight"))
        return list(self.model.evaluateEachIteration(rows))

    def transform(self, df: DataFrame) -> DataFrame:
        """M7: adds ``prediction`` and ``score`` (P(y=1); the margin when no probability)."""
        if isinstance(self.model, Forest):
            return self.model.transform(df)
        out = self.model.transform(self._vectors(df))
        if "probability" in out.columns and self.platt is None:
            return out.withColumn("score", vector_to_array("probability")[1])
        out = out.withColumn("margin", vector_to_array("rawPrediction")[1])
        if self.platt is not None:
            a, b = self.platt
            return out.withColumn("score", 1.0 / (1.0 + F.exp(-(F.lit(a) * F.col("margin") + F.lit(b)))))
        return out.withColumn("score", F.col("margin"))


def _linear_svc(spark: SparkSession, coefficients: np.ndarray, intercept: float) -> LinearSVCModel:
    vector = _py2java(spark.sparkContext, Vectors.dense(coefficients))
    return LinearSVCModel(spark._jvm.org.apache.spark.ml.classification.LinearSVCModel(f"svc-{uuid.uuid4().hex}", vector, float(intercept)))


def fit(name: str, train: DataFrame, features: Sequence[str], label: str = "label",
        params: dict | None = None, weighted: bool | None = None) -> Fitted:
    """Fit one family.  Class weights (F7) are used where the original used them."""
    weighted = (name in WEIGHTED) if weighted is None else weighted
    params = dict(params or {})
    kernel = {k: params.pop(k) for k in SVC_KERNEL_PARAMS if k in params}
    df = train
    if weighted:
        df = P.class_weights(df, label, "weight")
    scaler = P.fit_scaler(df, features) if name == "SVC" else None
    if scaler:
        df = P.apply_scaler(df, scaler)
    rff = None
    if name == "SVC" and kernel.get("kernel", "rbf") == "rbf":
        # the original's default SVC is RBF with gamma='scale'
        gamma = resolve_gamma(kernel.get("gamma", "scale"), df, features)
        rff = rff_spec(len(features), gamma, int(kernel.get("n_components", RFF_COMPONENTS)))
    cuts = None
    if name == "Extra_Trees":
        cuts = {f: [0.0] * RANDOM_CUTS for f in features}
        for r in cut_table(df, features).collect():                     # features x cuts rows
            cuts[r["feature"]][r["cut"]] = 0.0 if r["point"] is None else r["point"]
    if name in FOREST_PARAMS:
        forest = fit_forest(df, features, label, "weight" if weighted else None, {**FOREST_PARAMS[name], **params}, cuts)
        return Fitted(name, forest, features, label=label, cuts=cuts)
    fitted_cols = Fitted(name, None, features, None, None, label, rff)
    vec = fitted_cols._vectors(df)
    if rff is not None:
        model = _linear_svc(df.sparkSession, *fit_svc(df, features, rff, label, "weight" if weighted else None, params))
    else:
        model = estimator(name, params, "weight" if weighted else None, label).fit(vec)
    platt = None
    if name == "SVC":
        # the fit reads its rows more than once: the margins are reckoned once
        margins = model.transform(vec).select(vector_to_array("rawPrediction")[1].alias("m"), label).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            m = VectorAssembler(inputCols=["m"], outputCol="mv").transform(margins)
            lr = LogisticRegression(featuresCol="mv", labelCol=label, maxIter=100).fit(m)
        finally:
            margins.unpersist()
        platt = (float(lr.coefficients[0]), float(lr.intercept))
    return Fitted(name, model, features, scaler, platt, label, rff)


def evaluate_model(fitted: Fitted, df: DataFrame, label: str = "label") -> dict:
    preds = fitted.transform(df).select(F.col(label).alias("label"), "prediction", "score")
    return M.evaluate_dict(preds)


def _board_metrics(scored: list[DataFrame]) -> dict:
    """Metrics of every (variant, model) from one pass over all their predictions.
    A model with null or NaN scores gets none.  One row per fit reaches the driver."""
    if not scored:
        return {}
    both = scored[0]
    for s in scored[1:]:
        both = both.unionByName(s)
    both = both.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        bad = both.where(F.col("score").isNull() | F.isnan("score")).select("variant", "model").distinct()
        good = both.join(F.broadcast(bad), ["variant", "model"], "left_anti")
        return {(r["variant"], r["model"]): r.asDict() for r in M.grouped_evaluate(good, ["variant", "model"]).collect()}
    finally:
        both.unpersist()


def run_grid(variants: dict[str, DataFrame], evaluation: DataFrame, features: Sequence[str], label: str = "label",
             models: Sequence[str] = MODEL_NAMES, out_dir: str | None = None, parallel: int = 4,
             limit: float | None = None) -> DataFrame:
    """M6 + M12: every (variant, model) fitted and scored; failures, and fits that take more than ``limit`` seconds,
    become rows with the error text.  Each fit has a scheduler pool of its own, the longest start first.  Returns the
    leaderboard sorted by ROC-AUC."""
    spark = evaluation.sparkSession
    jobs = [(v, m) for v in variants for m in models]
    jobs.sort(key=lambda j: LONGEST_FIRST.index(j[1]) if j[1] in LONGEST_FIRST else len(LONGEST_FIRST))

    def one(job):
        v, m = job
        path = os.path.join(out_dir, v, m) if out_dir else None

        def work():
            f = fit(m, variants[v], features, label)
            if path:
                f.save(spark, path)
            return f.transform(evaluation).select(
                F.lit(v).alias("variant"), F.lit(m).alias("model"), F.col(label).alias("label"), "prediction", "score")

        try:
            return in_pool(spark, f"{v}-{m}", limit, work), path, None
        except Exception as e:  # noqa: BLE001 - a failed fit is a result row
            return None, path, f"{type(e).__name__}: {e}"[:500] + ("" if os.environ.get("VITALIS_QUIET") else
                                                                    "\n" + traceback.format_exc()[-500:])

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as ex:
        fits = dict(zip(jobs, ex.map(one, jobs)))
    sizes = {v: tr.count() for v, tr in variants.items()}
    metrics = _board_metrics([s for s, _, _ in fits.values() if s is not None])
    names = ["accuracy", "precision", "recall", "f1_score", "specificity", "roc_auc", "pr_auc"]
    rows = []
    for (v, m), (scored, path, error) in fits.items():
        r = metrics.get((v, m), {})
        if scored is not None and not r:
            error = "null or NaN scores"
        rows.append((v, m, *[r.get(k) for k in names], len(features), sizes[v] if error is None else None, path, error))
    board = spark.createDataFrame(rows, LEADERBOARD_SCHEMA)
    return board.orderBy(F.desc_nulls_last("roc_auc"), "resampling_method", "model_name")
