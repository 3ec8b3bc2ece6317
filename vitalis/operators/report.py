"""Report tables behind the figures.

Rendering is out of scope; every panel's numbers are a DataFrame here.
Top-k results use ``orderBy().limit()`` (per-task top-k then a merge) or a
per-group ``row_number``; the limit is the feature in each case.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import shorten


def histogram(df: DataFrame, col: str, bins: int, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Equal-width histogram, one row for every bin, empty ones included;
    the last bin is closed on the right and values outside the bounds count
    nowhere.  Bounds default to the column's min/max (one-row collect)."""
    if lo is None or hi is None:
        r = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi")).first()
        lo = r["lo"] if lo is None else lo
        hi = r["hi"] if hi is None else hi
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_lo double, bin_hi double, n bigint")
    width = (float(hi) - float(lo)) / bins if hi != lo else 1.0
    b = F.least(F.floor((F.col(col).cast("double") - F.lit(float(lo))) / F.lit(width)).cast("int"), F.lit(bins - 1))
    inside = df.where(F.col(col).isNotNull() & F.col(col).cast("double").between(float(lo), float(hi)))
    counts = inside.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    counts = (df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(counts), "bin", "left")
                .withColumn("n", F.coalesce("n", F.lit(0).cast("bigint"))))     # at most ``bins`` rows on either side
    return counts.select("bin", (F.lit(float(lo)) + F.col("bin") * width).alias("bin_lo"),
                         (F.lit(float(lo)) + (F.col("bin") + 1) * width).alias("bin_hi"), "n")


def value_counts(df: DataFrame, col: str, top: int | None = None) -> DataFrame:
    """Rows per value, most frequent first (value breaks ties)."""
    c = df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)
    return c.limit(top) if top else c


def grouped_mean(df: DataFrame, by: str | Sequence[str], metric: str, alias: str | None = None) -> DataFrame:
    """Mean of a metric per group."""
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(F.avg(metric).alias(alias or f"mean_{metric}"))


def impact(raw: DataFrame, clean: DataFrame, target: str, positive=1) -> DataFrame:
    """Raw vs clean: counts, removed, removal rate, positive rates and
    imbalance before/after and their change (two 1-row aggregates joined)."""
    def summary(df, sfx):
        pos = F.count_if(F.col(target) == positive)
        n = F.count(F.lit(1))
        return df.agg(n.alias(f"n_{sfx}"), pos.alias(f"pos_{sfx}"),
                      F.try_divide(pos.cast("double"), n).alias(f"rate_{sfx}"),
                      F.try_divide((n - pos).cast("double"), pos).alias(f"imbalance_{sfx}"))
    j = summary(raw, "raw").crossJoin(summary(clean, "clean"))
    return j.select("*", (F.col("n_raw") - F.col("n_clean")).alias("removed"),
                    F.try_divide((F.col("n_raw") - F.col("n_clean")).cast("double"), F.col("n_raw")).alias("removal_rate"),
                    (F.col("rate_clean") - F.col("rate_raw")).alias("rate_change"),
                    (F.col("imbalance_clean") - F.col("imbalance_raw")).alias("imbalance_change"))


PARTS = "split"      # a stage of this name stands for the parts of its split column


def stage_ledger(stages: Mapping[str, DataFrame], target: str, positive=1, baseline: str | None = None,
                 parts: Sequence[str] = ("train", "val", "test")) -> DataFrame:
    """One row per pipeline stage: size, positives, rate, and the change in
    size versus ``baseline`` (e.g. each train variant against the original).
    The ``parts`` of a split table are counted in one pass (the stage ``PARTS``)."""
    out, order = None, 0
    for name, df in stages.items():
        sums = [F.count(F.lit(1)).alias("n"), F.count_if(F.col(target) == positive).alias("positives")]
        if name == PARTS:
            counts = df.groupBy(F.col(PARTS).alias("stage")).agg(*sums)
            every = df.sparkSession.createDataFrame([(order + i, p) for i, p in enumerate(parts)], "stage_order int, stage string")
            rows = every.join(counts, "stage", "left").select("stage_order", "stage", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "positives")])
            order += len(parts)
        else:
            rows = df.agg(F.lit(order).alias("stage_order"), F.lit(name).alias("stage"), *sums)
            order += 1
        out = rows if out is None else out.unionByName(rows)
    out = out.withColumn("rate", F.try_divide(F.col("positives").cast("double"), F.col("n")))
    if baseline:
        base = out.where(F.col("stage") == baseline).select(F.col("n").alias("_base_n"))
        out = out.crossJoin(base).withColumn(
            "change_pct", F.try_divide((F.col("n") - F.col("_base_n")).cast("double") * 100.0, F.col("_base_n"))
        ).drop("_base_n")
    return out


def top_k(df: DataFrame, metric: str, k: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """W2 + W3: sort by metric descending (ties broken by ``tiebreak``) and keep k."""
    return df.orderBy(F.desc_nulls_last(metric), *tiebreak).limit(k)


def arg_max(df: DataFrame, metric: str, tiebreak: Sequence[str]) -> DataFrame:
    """The single best row (ties broken by ``tiebreak`` ascending); a top-1."""
    return df.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), *tiebreak).limit(1)


def best_set(df: DataFrame, metrics: Sequence[str], tiebreak: Sequence[str]) -> DataFrame:
    """The best row of each metric, a row that is best in several once."""
    out = None
    for m in metrics:
        one = arg_max(df, m, tiebreak)
        out = one if out is None else out.unionByName(one)
    return out.dropDuplicates(list(tiebreak))


def best_per_group(df: DataFrame, group: str | Sequence[str], metric: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Best row per group (``row_number`` over the group by metric desc)."""
    g = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*g).orderBy(F.desc_nulls_last(metric), *tiebreak)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def shortlist(df: DataFrame, models: Sequence[str], variants: Sequence[str], metric: str,
              model_col: str = "base_model", variant_col: str = "resampling_method") -> DataFrame:
    """Rows of the listed models and variants, best first."""
    return (df.where(F.col(model_col).isin(list(models)) & F.col(variant_col).isin(list(variants)))
              .orderBy(F.desc_nulls_last(metric), model_col, variant_col))


def compare_boards(before: DataFrame, after: DataFrame, keys: Sequence[str], metric: str) -> DataFrame:
    """Join two leaderboards on (model, variant) and take the metric change."""
    b = before.select(*keys, F.col(metric).alias(f"{metric}_before"))
    a = after.select(*keys, F.col(metric).alias(f"{metric}_after"))
    return b.join(a, list(keys), "full").withColumn(
        f"{metric}_change", F.col(f"{metric}_after") - F.col(f"{metric}_before"))


def cross_model_importance(imp: DataFrame, top: int = 15) -> DataFrame:
    """Mean importance per feature over models, top-k."""
    return (imp.groupBy("feature").agg(F.avg("importance").alias("mean_importance"),
                                       F.count(F.lit(1)).alias("n_models"))
               .orderBy(F.desc("mean_importance"), "feature").limit(top))


def category_importance(imp: DataFrame, keywords: DataFrame) -> DataFrame:
    """A feature belongs to a category when any of its keywords is a
    substring of the lower-cased name (a feature may be in several categories,
    but counts once per category).  Category score = mean over its features of
    the feature's mean importance across models; 0 when it has none.

    ``keywords`` (category, keyword) is a fixed code table: broadcast."""
    per_feature = imp.groupBy("feature").agg(F.avg("importance").alias("fi"))
    hits = (per_feature.join(F.broadcast(keywords), F.lower(F.col("feature")).contains(F.col("keyword")))
                       .select("category", "feature", "fi").distinct())
    score = hits.groupBy("category").agg(F.avg("fi").alias("importance"), F.count(F.lit(1)).alias("n_features"))
    cats = keywords.select("category").distinct()
    return cats.join(score, "category", "left").select(
        "category", F.coalesce("importance", F.lit(0.0)).alias("importance"),
        F.coalesce("n_features", F.lit(0)).cast("bigint").alias("n_features"))


def common_features(imp: DataFrame, per_model: int = 5, min_models: int = 2, max_features: int = 10,
                    name_len: int = 20) -> DataFrame:
    """Features in the top ``per_model`` of at least ``min_models`` models
    (at most ``max_features``), as a long model x feature table with 0 for a
    model where the feature is not in its top list."""
    w = Window.partitionBy("model_name").orderBy(F.desc("importance"), "feature")
    top = imp.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_model).drop("_r")
    common = (top.groupBy("feature").agg(F.count(F.lit(1)).alias("n_models"))
                 .where(F.col("n_models") >= min_models)
                 .orderBy(F.desc("n_models"), "feature").limit(max_features))
    models = top.select("model_name").distinct()
    grid = models.crossJoin(common.select("feature"))  # models x (<= max_features) cells
    return (grid.join(top.select("model_name", "feature", "importance"), ["model_name", "feature"], "left")
                .select("model_name", "feature", shorten("feature", name_len).alias("label"),
                        F.coalesce("importance", F.lit(0.0)).alias("importance")))


def attribution_summary(attr: DataFrame) -> DataFrame:
    """Mean |x|, population std, min and max of the attributions per (model, feature)."""
    a = F.col("attribution")
    return attr.groupBy("model_name", "feature").agg(
        F.avg(F.abs(a)).alias("mean_abs"), F.stddev_pop(a).alias("std"), F.min(a).alias("min"), F.max(a).alias("max"))


def minmax_normalise(df: DataFrame, group: str, value: str, out: str = "norm_value") -> DataFrame:
    """(x - min) / (max - min) per group; 0 for a constant group.
    Min/max come from an aggregation (combined map-side) joined back, so a
    large group is never gathered into one task."""
    mm = df.groupBy(group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    j = df.join(mm, group, "left")
    norm = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return j.withColumn(out, F.coalesce(norm, F.lit(0.0)).cast("double")).drop("_lo", "_hi")


def beeswarm_points(attr: DataFrame, imp: DataFrame, top: int = 15) -> DataFrame:
    """Points of the top features (by importance): attribution, raw value
    and the value normalised per feature for colouring."""
    w = Window.partitionBy("model_name").orderBy(F.desc("importance"), "feature")
    keep = imp.withColumn("feature_rank", F.row_number().over(w).cast("bigint")).where(F.col("feature_rank") <= top) \
              .select("model_name", "feature", "feature_rank")
    pts = attr.join(F.broadcast(keep), ["model_name", "feature"])
    return minmax_normalise(pts, "feature", "value")
