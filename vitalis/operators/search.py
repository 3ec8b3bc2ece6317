"""Hyper-parameter search.

The trials are a *table*: trial t draws every parameter from
``md5(t|param|seed)``, so the same seed gives the same trials on any cluster.
Each trial is an MLlib fit scored by validation ROC-AUC; the trial results
form a DataFrame and the best trial is ``max_by``.  The sequential
model-based sampler of the original (TPE) is not rebuilt: it is a
single-machine optimiser, and seeded independent draws keep every trial
reproducible and parallel.

Parameters without an MLlib counterpart (reg_alpha, reg_lambda, num_leaves,
min_samples_split) are drawn and recorded but do not change the fit; the SVC
kernel and gamma select the random-Fourier RBF map (see ``models``); the
mapping is in ``to_mllib``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import models as MD

# The search spaces and trial counts of the original study.
BOOSTED_SPACE = [
    ("n_estimators", "int", 100, 500),
    ("max_depth", "int", 3, 8),
    ("learning_rate", "log", 0.01, 0.3),
    ("subsample", "float", 0.6, 1.0),
    ("colsample_bytree", "float", 0.6, 1.0),
    ("reg_alpha", "log", 1e-8, 10.0),
    ("reg_lambda", "log", 1e-8, 10.0),
]
FOREST_SPACE = [
    ("n_estimators", "int", 50, 200),
    ("max_depth", "int", 5, 20),
    ("min_samples_split", "int", 2, 10),
    ("min_samples_leaf", "int", 1, 5),
    ("max_features", "cat", ["sqrt", "log2"]),
]
SPACES = {
    "XGBoost": BOOSTED_SPACE,
    "LightGBM": BOOSTED_SPACE + [("num_leaves", "int", 10, 100)],
    "Random_Forest": FOREST_SPACE,
    "Extra_Trees": FOREST_SPACE,
    "SVC": [("C", "log", 0.1, 10.0), ("gamma", "cat", ["scale", "auto"]), ("kernel", "cat", ["rbf", "linear"])],
    "Logistic_Regression": [("C", "log", 0.1, 10.0), ("penalty", "cat", ["l1", "l2"])],
}
N_TRIALS = {"XGBoost": 50, "LightGBM": 50, "Random_Forest": 30, "Extra_Trees": 30, "SVC": 30,
            "Logistic_Regression": 30}
EARLY_STOPPING = {"LightGBM"}  # validated on the validation rows


def _unit(trial: F.Column, name: str, seed: int) -> F.Column:
    """Uniform [0, 1) from md5(trial|name|seed)."""
    h = F.conv(F.substring(F.md5(F.concat(trial.cast("string"), F.lit(f"|{name}|{seed}"))), 1, 13), 16, 10)
    return h.cast("double") / F.lit(float(16 ** 13))


def trial_table(spark: SparkSession, model: str, n_trials: int | None = None, seed: int = 42, space: Sequence | None = None) -> DataFrame:
    """M13 trial table: one row per trial, one column per parameter of ``space`` (the family's own if not given)."""
    n = n_trials or N_TRIALS[model]
    t = F.col("id")
    cols = [t.cast("int").alias("trial")]
    for spec in space or SPACES[model]:
        name, kind = spec[0], spec[1]
        u = _unit(t, name, seed)
        if kind == "int":
            lo, hi = spec[2], spec[3]
            v = (F.lit(lo) + F.floor(u * (hi - lo + 1))).cast("int")
        elif kind == "float":
            lo, hi = spec[2], spec[3]
            v = F.lit(lo) + u * (hi - lo)
        elif kind == "log":
            lo, hi = spec[2], spec[3]
            v = F.exp(F.lit(math.log(lo)) + u * (math.log(hi) - math.log(lo)))
        else:
            choices = spec[2]
            idx = F.floor(u * len(choices)).cast("int")
            v = F.element_at(F.array(*[F.lit(c) for c in choices]), idx + 1)
        cols.append(v.alias(name))
    return spark.range(n).select(*cols)


def to_mllib(model: str, params: dict, weight_sum: float | None = None) -> dict:
    """Map a drawn parameter set to MLlib estimator parameters."""
    p = {}
    if model in ("XGBoost", "LightGBM"):
        p["maxIter"] = int(params["n_estimators"])
        p["maxDepth"] = int(params["max_depth"])
        p["stepSize"] = float(params["learning_rate"])
        p["subsamplingRate"] = float(params["subsample"])
        p["featureSubsetStrategy"] = repr(round(float(params["colsample_bytree"]), 6))
    elif model in ("Random_Forest", "Extra_Trees"):
        p["numTrees"] = int(params["n_estimators"])
        p["maxDepth"] = int(params["max_depth"])
        p["minInstancesPerNode"] = int(params["min_samples_leaf"])
        p["featureSubsetStrategy"] = str(params["max_features"])
    elif model in ("SVC", "Logistic_Regression"):
        n = weight_sum or 1.0
        p["regParam"] = 1.0 / (float(params["C"]) * n)
        if model == "Logistic_Regression":
            p["elasticNetParam"] = 1.0 if params["penalty"] == "l1" else 0.0
        else:  # consumed by models.fit: random-Fourier RBF map or linear
            p["kernel"] = params["kernel"]
            p["gamma"] = params["gamma"]
    return p


def long_trials(trials: DataFrame, model: str) -> DataFrame:
    """A trial table as rows (model_name, trial, param, number, choice)."""
    cells = [F.struct(F.lit(c).alias("param"), (F.col(c) if d != "string" else F.lit(None)).cast("double").alias("number"),
                      (F.col(c) if d == "string" else F.lit(None)).cast("string").alias("choice")) for c, d in trials.dtypes if c != "trial"]
    return trials.select(F.lit(model).alias("model_name"), "trial", F.explode(F.array(*cells)).alias("_c")).select("model_name", "trial", "_c.*")


TRIAL_SCHEMA = T.StructType([
    T.StructField("study", T.StringType()),
    T.StructField("trial", T.IntegerType()),
    T.StructField("params", T.StringType()),
    T.StructField("val_roc_auc", T.DoubleType()),
    T.StructField("error", T.StringType()),
])


def stored_trials(spark: SparkSession, store: str, study: str) -> DataFrame:
    """The finished trials of a study; none if nothing was stored yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], TRIAL_SCHEMA)
    # a trial that was stored twice counts once
    return spark.read.schema(TRIAL_SCHEMA).parquet(store).where(F.col("study") == study).dropDuplicates(["trial"])


def search(model: str, train: DataFrame, val: DataFrame, features: Sequence[str], label: str = "label",
           n_trials: int | None = None, seed: int = 42, parallel: int = 4, store: str | None = None, study: str | None = None,
           space: Sequence | None = None, limit: float | None = None) -> DataFrame:
    """Run every trial and return the trials table.

    Trials run in batches of ``parallel`` concurrent fits, each in a scheduler pool of its own and stopped after
    ``limit`` seconds; the fits of a batch are scored together, in one pass over their predictions, and appended to
    the Parquet table ``store``.  A search that was broken off starts again with the trials not yet stored under
    ``study`` (model and seed, if not given), so at most one batch is fitted twice."""
    spark = train.sparkSession
    study = study or f"{model}|{seed}"
    trials = [r.asDict() for r in trial_table(spark, model, n_trials, seed, space).orderBy("trial").collect()]  # n_trials rows
    have = {r["trial"] for r in stored_trials(spark, store, study).select("trial").collect()} if store else set()
    trials_left = [t for t in trials if t["trial"] not in have]
    n_rows = train.count() if trials_left else 0

    def one(tr):
        params = {k: v for k, v in tr.items() if k != "trial"}

        def work():
            f = fit_trial(model, train, val, features, label, params, n_rows)
            return f.transform(val).select(F.lit(str(tr["trial"])).alias("variant"), F.lit(model).alias("model"),
                                           F.col(label).alias("label"), "prediction", "score")
        try:
            return MD.in_pool(spark, f"{study}-{tr['trial']}", limit, work), None
        except Exception as e:  # noqa: BLE001 - a failed trial is recorded, as in a study
            return None, f"{type(e).__name__}: {e}"[:300]

    rows = []
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as ex:
        for lo in range(0, len(trials_left), max(1, parallel)):
            batch = trials_left[lo:lo + max(1, parallel)]
            fits = list(ex.map(one, batch))
            metrics = MD._board_metrics([s for s, _ in fits if s is not None])
            done = []
            for tr, (scored, error) in zip(batch, fits):
                auc = metrics.get((str(tr["trial"]), model), {}).get("roc_auc")
                if scored is not None and auc is None:
                    error = "null or NaN scores"
                params = json.dumps({k: v for k, v in tr.items() if k != "trial"}, sort_keys=True)
                done.append((study, tr["trial"], params, None if auc is None else float(auc), error))
            if store:
                spark.createDataFrame(done, TRIAL_SCHEMA).coalesce(1).write.mode("append").parquet(store)
            rows += done
    if store:
        return stored_trials(spark, store, study).where(F.col("trial") < len(trials))
    return spark.createDataFrame(rows, TRIAL_SCHEMA)


PATIENCE = 50       # rounds without a better validation loss before boosting stops, as in the original


def best_round(losses: Sequence[float], patience: int = PATIENCE) -> int:
    """Number of rounds to keep: the best one seen before ``patience`` rounds brought no better."""
    best = 0
    for i, loss in enumerate(losses):
        if loss < losses[best]:
            best = i
        elif i - best >= patience:
            break
    return best + 1


def fit_trial(model, train, val, features, label, params, n_rows):
    """One trial's fit.  M14: an early-stopping family is grown in full on train, its validation loss after
    each round read from ``evaluateEachIteration``, and cut at the round patience stops at.  Validation rows choose
    the round and teach nothing."""
    p = to_mllib(model, params, float(n_rows))
    full = MD.fit(model, train, features, label, p)
    if model not in EARLY_STOPPING:
        return full
    return full.first_trees(best_round(full.round_losses(val)))


def best_trial(trials: DataFrame) -> dict:
    """Best trial by validation AUC (trial number breaks ties)."""
    row = (trials.where(F.col("val_roc_auc").isNotNull())
                 .agg(F.max_by(F.struct("trial", "params", "val_roc_auc"),
                               F.struct("val_roc_auc", -F.col("trial"))).alias("b"))).first()
    return row["b"].asDict() if row and row["b"] else {}


TUNING_SCHEMA = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("base_model", T.StringType()),
    T.StructField("resampling_method", T.StringType()),
    T.StructField("n_trials", T.IntegerType()),
    T.StructField("best_params", T.StringType()),
    T.StructField("val_roc_auc", T.DoubleType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1_score", T.DoubleType()),
    T.StructField("specificity", T.DoubleType()),
    T.StructField("roc_auc", T.DoubleType()),
    T.StructField("pr_auc", T.DoubleType()),
    T.StructField("error", T.StringType()),
])


def tuning_matrix(variants: dict[str, DataFrame], val: DataFrame, test: DataFrame, features: Sequence[str],
                  label: str = "label", models: Sequence[str] = MD.BOOSTED, n_trials: int | None = None,
                  seed: int = 42, store: str | None = None, spaces: dict[str, Sequence] | None = None, parallel: int = 4,
                  limit: float | None = None) -> DataFrame:
    """M15 + M16: search each (model, variant), refit the best on train and
    evaluate it on test.  Both the search score and the test metrics are kept,
    so before/after comparisons use one split.  ``store``, ``parallel`` and ``limit`` as in ``search``; ``spaces``
    replaces the search space of the families it names."""
    spark = val.sparkSession
    rows = []
    for v, tr in variants.items():
        for m in models:
            try:
                trials = search(m, tr, val, features, label, n_trials, seed, parallel, store, f"{m}|{v}|{seed}", (spaces or {}).get(m), limit)
                b = best_trial(trials)
                f = fit_trial(m, tr, val, features, label, json.loads(b["params"]), tr.count())
                r = MD.evaluate_model(f, test, label)
                rows.append((f"{m}_{v}", m, v, trials.count(), b["params"], b["val_roc_auc"], r["accuracy"],
                             r["precision"], r["recall"], r["f1_score"], r["specificity"], r["roc_auc"],
                             r["pr_auc"], None))
            except Exception as e:  # noqa: BLE001
                rows.append((f"{m}_{v}", m, v, None, None, None, None, None, None, None, None, None, None,
                             f"{type(e).__name__}: {e}"[:300]))
    return spark.createDataFrame(rows, TUNING_SCHEMA).orderBy(F.desc_nulls_last("roc_auc"), "model_name")
