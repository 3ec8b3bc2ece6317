"""Classification metrics as aggregations.

ROC-AUC and average precision need, for every distinct score, the number of
positives and negatives scored above it.  Instead of a global ``Window.orderBy``
(which Spark runs in a single partition) the distinct scores are cut into
``n_buckets`` score ranges from approximate quantiles; running sums are taken
inside each range and shifted by the (tiny) table of range totals.  The cut
points only affect the work split, never the result: the metrics are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import null_safe_join

# score ranges: each range is one window partition, so 1024 keeps a range small
# even with billions of distinct scores; the offset table has <= 1024 rows.
N_BUCKETS = 1024


def confusion(preds: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """M8: TP, TN, FP, FN in one pass."""
    y, p = F.col(label) == 1, F.col(pred) == 1
    return preds.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & ~p).alias("tn"),
                     F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))


def _ratio(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def rates(conf: DataFrame) -> DataFrame:
    """M9: accuracy, precision, recall, F1, specificity; a zero denominator gives 0."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    precision = _ratio(tp, tp + fp)
    recall = _ratio(tp, tp + fn)
    return conf.select(
        "*",
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
        _ratio(tn, tn + fp).alias("specificity"),
    )


def score_counts(preds: DataFrame, label: str = "label", pred: str | None = "prediction", score: str = "score",
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """The one pass over the predictions: positives and negatives per
    (group, score, predicted class).  Every metric is derived from this table,
    which is much smaller than the data (ties and classes collapse) and is
    persisted (recomputable from lineage) because several metrics read it."""
    g = list(group_cols)
    keys = [*g, F.col(score).cast("double").alias("score")]
    if pred:
        keys.append(F.col(pred).cast("int").alias("prediction"))
    counts = (preds.groupBy(*keys)
                   .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")))
    return counts.persist(StorageLevel.MEMORY_AND_DISK)


def score_table(preds: DataFrame, label: str = "label", score: str = "score", n_buckets: int = N_BUCKETS,
                group_cols: Sequence[str] = (), counts: DataFrame | None = None) -> DataFrame:
    """One row per (group, distinct score): pos, neg, and pos_above / neg_above
    (counts at strictly higher scores within the group)."""
    g = list(group_cols)
    c = counts if counts is not None else score_counts(preds, label, None, score, g)
    bad = c.where(F.col("score").isNull() | F.isnan("score")).agg(F.sum(F.col("pos") + F.col("neg"))).first()[0]
    if bad:
        raise ValueError(f"{bad} rows have a null or NaN score; a ranking over the others would not be theirs")
    per = (c.groupBy(*g, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))
    qs = per.approxQuantile("score", [i / n_buckets for i in range(1, n_buckets)], 1.0 / (4 * n_buckets)) \
        if n_buckets > 1 else []
    splits = [float("-inf")] + sorted(set(qs)) + [float("inf")]
    b = Bucketizer(splits=splits, inputCol="score", outputCol="_b").transform(per)
    higher_in_bucket = (Window.partitionBy(*g, "_b").orderBy(F.desc("score"))
                              .rowsBetween(Window.unboundedPreceding, -1))
    local = b.select("*", F.coalesce(F.sum("pos").over(higher_in_bucket), F.lit(0)).alias("_lp"),
                     F.coalesce(F.sum("neg").over(higher_in_bucket), F.lit(0)).alias("_ln"))
    totals = b.groupBy(*g, "_b").agg(F.sum("pos").alias("_tp"), F.sum("neg").alias("_tn"))
    # at most (groups x n_buckets) rows: windows over it are cheap
    higher_buckets = Window.partitionBy(*g).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*g, "_b", F.coalesce(F.sum("_tp").over(higher_buckets), F.lit(0)).alias("_op"),
                            F.coalesce(F.sum("_tn").over(higher_buckets), F.lit(0)).alias("_on"))
    return (null_safe_join(local, offsets, [*g, "_b"])
                 .select(*g, "score", "pos", "neg", (F.col("_lp") + F.col("_op")).alias("pos_above"),
                         (F.col("_ln") + F.col("_on")).alias("neg_above")))


def ranking_metrics(preds: DataFrame, label: str = "label", score: str = "score", n_buckets: int = N_BUCKETS,
                    group_cols: Sequence[str] = (), counts: DataFrame | None = None) -> DataFrame:
    """M10 + M11: tie-aware ROC-AUC (Mann-Whitney) and step-wise average precision,
    per group.  Both are 0 when only one class is present."""
    g = list(group_cols)
    t = score_table(preds, label, score, n_buckets, g, counts)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    pa, na = F.col("pos_above").cast("double"), F.col("neg_above").cast("double")
    aggs = [F.sum(pos).alias("P"), F.sum(neg).alias("N"),
            F.sum(neg * (pa + pos / 2.0)).alias("_auc_num"),
            F.sum(F.when(F.col("pos") > 0, pos * (pa + pos) / (pa + pos + na + neg)).otherwise(0.0)).alias("_ap_num")]
    agg = t.groupBy(*g).agg(*aggs) if g else t.agg(*aggs)
    one_class = F.coalesce(F.col("P"), F.lit(0.0)) * F.coalesce(F.col("N"), F.lit(0.0)) == 0
    return agg.select(
        *g,
        F.when(one_class, 0.0).otherwise(F.col("_auc_num") / (F.col("P") * F.col("N"))).alias("roc_auc"),
        F.when(one_class, 0.0).otherwise(F.col("_ap_num") / F.col("P")).alias("pr_auc"))


def _confusion_from_counts(counts: DataFrame, g: Sequence[str]) -> DataFrame:
    p = F.col("prediction") == 1
    aggs = [F.sum(F.when(p, F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(~p, F.col("neg")).otherwise(0)).alias("tn"),
            F.sum(F.when(p, F.col("neg")).otherwise(0)).alias("fp"),
            F.sum(F.when(~p, F.col("pos")).otherwise(0)).alias("fn")]
    conf = counts.groupBy(*g).agg(*aggs) if g else counts.agg(*aggs)
    return conf.select(*g, *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("tp", "tn", "fp", "fn")])


def grouped_evaluate(preds: DataFrame, group_cols: Sequence[str], label: str = "label", pred: str = "prediction",
                     score: str = "score", n_buckets: int = N_BUCKETS) -> DataFrame:
    """All metrics per group (one row per group): a leaderboard from one pass
    over the predictions."""
    g = list(group_cols)
    counts = score_counts(preds, label, pred, score, g)
    return null_safe_join(rates(_confusion_from_counts(counts, g)),
                          ranking_metrics(preds, label, score, n_buckets, g, counts), g, "left")


def evaluate(preds: DataFrame, label: str = "label", pred: str = "prediction", score: str = "score",
             n_buckets: int = N_BUCKETS) -> DataFrame:
    """All seven metrics plus the confusion counts in one row, from one pass."""
    counts = score_counts(preds, label, pred, score)
    return rates(_confusion_from_counts(counts, [])).crossJoin(
        ranking_metrics(preds, label, score, n_buckets, (), counts))


def evaluate_dict(preds: DataFrame, label: str = "label", pred: str = "prediction", score: str = "score",
                  n_buckets: int = N_BUCKETS) -> dict:
    """``evaluate`` collected to a dict (one row); the cached count table is
    released afterwards."""
    counts = score_counts(preds, label, pred, score)
    try:
        row = rates(_confusion_from_counts(counts, [])).crossJoin(
            ranking_metrics(preds, label, score, n_buckets, (), counts)).first()
        return row.asDict()
    finally:
        counts.unpersist()
