"""Deterministic ranking, stratified splitting and resampling.

Randomness comes from ``md5(id|seed)`` (a 60-bit integer), never from
``rand()``/``sample()``/``randomSplit()``: results then depend on the data and
the seed only, not on partitioning or retries, and a lost executor recomputes
exactly the same rows.

Splits and samples are order statistics: a row's part depends only on whether
its rank in hash order lies below a few cuts of its class.  The hash space is
divided into ``2**bits`` equal buckets; a (class, bucket) count table, combined
map-side, names the one bucket that each cut falls into.  All other rows are
decided by their bucket alone and never move; only the rows of those buckets
are ranked, by a range-partitioned sort that no repeated id can fill a task of.

``ranked`` gives every row its rank, by the same buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import null_safe_join
from .ranking import range_ranked

HASH_BITS = 60
# 2**20 hash buckets: at 1e11 rows about 1e5 rows per (class, bucket) window,
# while the (class, bucket) offset table stays <= 1M rows per class.
RANK_BITS = 20


def hash_key(id_col: str | Column, seed: int = 42) -> Column:
    """60-bit non-negative integer from ``md5(cast(id as string) || '|' || seed)``."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    digest = F.md5(F.concat(F.coalesce(c.cast("string"), F.lit("null")), F.lit(f"|{seed}")))   # a null id hashes as text
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def ranked(df: DataFrame, group_cols: Sequence[str], hash_col: str, tiebreak: Sequence[str],
           rank_col: str = "rank", size_col: str | None = "group_size", bits: int = RANK_BITS) -> DataFrame:
    """Add the exact 0-based rank of each row inside ``group_cols`` ordered by
    (``hash_col``, ``tiebreak``), and optionally the group size.

    ``hash_col`` must be uniform on [0, 2**60) and never null (see ``hash_key``).
    A null group is a group of its own: no row is lost."""
    groups = list(group_cols)
    bucket = F.shiftright(F.col(hash_col), HASH_BITS - bits)
    with_b = df.withColumn("_bucket", bucket)
    counts = with_b.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "_bucket",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                            F.sum("_n").over(Window.partitionBy(*groups)).alias("_size"))
    local = Window.partitionBy(*groups, "_bucket").orderBy(hash_col, *tiebreak)
    out = (null_safe_join(with_b.withColumn("_local", F.row_number().over(local) - 1), offsets, [*groups, "_bucket"])
                 .withColumn(rank_col, (F.col("_offset") + F.col("_local")).cast("bigint")))
    if size_col:
        out = out.withColumnRenamed("_size", size_col)
    else:
        out = out.drop("_size")
    return out.drop("_bucket", "_local", "_offset")


def part_sizes(n: Column, fractions: Sequence[float]) -> list[Column]:
    """Cumulative cut points of ``n`` rows for the leading fractions (rounded half up)."""
    cuts, acc = [], F.lit(0).cast("bigint")
    for f in fractions[:-1]:
        acc = acc + F.floor(n * F.lit(float(f)) + F.lit(0.5)).cast("bigint")
        cuts.append(acc)
    return cuts


MAX_CLASSES = 10_000


def cut_parts(df: DataFrame, target: str, hash_col: str, tiebreak: Sequence[str], cuts: Sequence[Column],
              part_col: str = "_cut", bits: int = RANK_BITS) -> DataFrame:
    """Add ``part_col``: how many of the ascending ``cuts`` of its class a row's rank reaches.

    The rank is that in the order (``hash_col``, ``tiebreak``) inside ``target`` (a null class is a class of its
    own); rows equal in all of it are ordered by a hash of the whole row.  ``cuts`` are expressions of ``_size``, the
    rows of a class.  At most ``MAX_CLASSES`` classes; what reaches the driver is a number for each class and cut."""
    spark = df.sparkSession
    m = len(cuts)
    with_b = df.withColumn("_bucket", F.shiftright(F.col(hash_col), HASH_BITS - bits))
    counts = with_b.groupBy(target, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    one_class = Window.partitionBy(target)          # at most 2**bits rows
    before = one_class.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(target, "_bucket", "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                            F.sum("_n").over(one_class).alias("_size"))
    hit = [(c >= F.col("_offset")) & (c < F.col("_offset") + F.col("_n")) for c in cuts]
    per_class = offsets.groupBy(target).agg(*[e for i, (c, h) in enumerate(zip(cuts, hit)) for e in (
        F.max(F.when(h, F.col("_bucket"))).alias(f"_b{i}"), F.max(F.when(h, c - F.col("_offset"))).alias(f"_r{i}"))])
    rows = per_class.limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{target!r} has more than {MAX_CLASSES} values; it is no class column")
    # a cut at a class's end lies in no bucket: every row is below it
    table = spark.createDataFrame([tuple(r) for r in rows], per_class.schema).fillna(
        {f"_b{i}": 1 << bits for i in range(m)} | {f"_r{i}": 0 for i in range(m)})
    known = null_safe_join(with_b, F.broadcast(table), [target])
    in_cut = F.lit(False)
    for i in range(m):
        in_cut = in_cut | (F.col("_bucket") == F.col(f"_b{i}"))
    passed = [(F.col("_bucket") > F.col(f"_b{i}")).cast("int") for i in range(m)]
    reached = [(F.col("_bucket") == F.col(f"_b{i}")).cast("int") * (F.col("_in_bucket") >= F.col(f"_r{i}")).cast("int") for i in range(m)]
    clear = known.where(~in_cut).withColumn(part_col, sum(passed, F.lit(0)))
    order = [hash_col, *dict.fromkeys(t for t in tiebreak), "_whole"]
    near = range_ranked(known.where(in_cut).withColumn("_whole", F.xxhash64(*df.columns)), [target, "_bucket"], order, "_in_bucket")
    near = near.withColumn(part_col, sum([p + q for p, q in zip(passed, reached)], F.lit(0)))
    keep = [*df.columns, part_col]
    return clear.select(*keep).unionByName(near.select(*keep))


def stratified_split(df: DataFrame, id_col: str, target: str, fractions: Sequence[float] = (0.6, 0.2, 0.2),
                     names: Sequence[str] = ("train", "val", "test"), seed: int = 42,
                     split_col: str = "split", bits: int = RANK_BITS, tiebreak: Sequence[str] = ()) -> DataFrame:
    """D3: per class, the first ``round(f1*n)`` rows in hash order go to the first
    part, the next ``round(f2*n)`` to the second, the rest to the last.

    Class shares are preserved to within one row per class, and the split is
    the same on every run and every cluster layout.  When ``id_col`` is not
    unique, ``tiebreak`` columns order rows sharing an id."""
    h = df.withColumn("_h", hash_key(id_col, seed))
    r = cut_parts(h, target, "_h", [id_col, *tiebreak], part_sizes(F.col("_size"), fractions), "_cut", bits)
    label = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_cut") + 1)
    return r.withColumn(split_col, label).drop("_h", "_cut")


def split_profile(df: DataFrame, target: str, split_col: str = "split", positive=1) -> DataFrame:
    """Size, share, positives and positive rate per part, one pass."""
    per = df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"),
                                    F.count_if(F.col(target) == positive).alias("positives"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return per.crossJoin(F.broadcast(total)).select(
        split_col, "n", F.try_divide(F.col("n").cast("double"), F.col("_total")).alias("share"), "positives",
        F.try_divide(F.col("positives").cast("double"), F.col("n")).alias("rate"))


def split_conservation(source: DataFrame, parts: DataFrame, id_col: str, split_col: str = "split") -> DataFrame:
    """Total of the parts equals the input, and no id is in two parts."""
    per_id = parts.groupBy(id_col).agg(F.countDistinct(split_col).alias("_k"))
    a = per_id.agg(F.count_if(F.col("_k") > 1).alias("ids_in_several_parts"))
    b = parts.agg(F.count(F.lit(1)).alias("rows_in_parts"))
    c = source.agg(F.count(F.lit(1)).alias("rows_in_source"))
    return a.crossJoin(b).crossJoin(c).withColumn(
        "conserved", (F.col("rows_in_parts") == F.col("rows_in_source")) & (F.col("ids_in_several_parts") == 0))


def class_counts(df: DataFrame, target: str) -> dict:
    """Rows per class.  Raises above ``MAX_CLASSES`` classes (a continuous target),
    so what reaches the driver is bounded."""
    rows = df.groupBy(target).count().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{target!r} has more than {MAX_CLASSES} values; it is no class column")
    return {r[0]: r[1] for r in rows}


def downsample(df: DataFrame, id_col: str, target: str, seed: int = 42, bits: int = RANK_BITS,
               shuffle_col: str | None = "shuffle_key") -> DataFrame:
    """Every class is cut to the size of the smallest class, drawing without
    replacement in hash order; the largest class is found, not assumed.

    ``shuffle_col`` carries the seeded order the original used to shuffle rows
    (DataFrame rows have no order of their own).  Rows without a class are an
    error: they belong to no class and must not set the target size."""
    counts = class_counts(df, target)
    if None in counts:
        raise ValueError(f"{counts[None]} rows have no {target!r}; drop or label them before down-sampling")
    if not counts:
        return df
    n_min = min(counts.values())
    h = df.withColumn("_h", hash_key(id_col, seed))
    out = cut_parts(h, target, "_h", [id_col], [F.lit(n_min).cast("bigint")], "_cut", bits).where("_cut = 0").drop("_h", "_cut")
    if shuffle_col:
        out = out.withColumn(shuffle_col, hash_key(id_col, seed + 1))
    return out


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows drawn without replacement in hash order (top-n per task,
    then a merge of the task tops: ``TakeOrderedAndProject``)."""
    return df.withColumn("_h", hash_key(id_col, seed)).orderBy("_h", id_col).limit(n).drop("_h")


def variants(train_variants: dict[str, DataFrame], variant_col: str = "variant") -> DataFrame:
    """Stack train variants (original, down-sampled, SMOTE ...) with a label column.
    Columns are aligned by name; a column missing in one variant becomes null."""
    out = None
    for name, df in train_variants.items():
        d = df.withColumn(variant_col, F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
