"""Exact ranks in an order, without a window over a group (D3, D6, D7, F1, F2 support).

Rows are range-partitioned and sorted by (groups, order), so a group of any size is spread over as many tasks as it
needs; a row's rank is its place in its task's part of the group plus the sizes of the parts before.  The sorted
table is checkpointed first, so that a recomputed task cannot deal the rows differently.  Rows equal in all of these
columns are interchangeable; they are parted by their place in the input, so that not even one repeated row has to
fit one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import null_safe_join
from ..session import ensure_checkpoint_dir

_PLACE = (1 << 33) - 1      # the part of monotonically_increasing_id that counts inside a partition


def range_ranked(df: DataFrame, groups: Sequence[str], order: Sequence[str], rank_col: str = "rank") -> DataFrame:
    """Add the 0-based rank of each row inside ``groups`` (null is a group of its own), ordered by ``order``
    (ascending, nulls first)."""
    ensure_checkpoint_dir(df.sparkSession)
    keys = [*groups, *order, "_seat"]
    s = (df.withColumn("_seat", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
           .withColumn("_part", F.spark_partition_id())
           .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_PLACE)))
           .drop("_seat").checkpoint(eager=True))
    parts = s.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = parts.select(*groups, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    out = null_safe_join(s, shift, [*groups, "_part"])
    return out.withColumn(rank_col, (F.col("_at") + F.col("_shift")).cast("bigint")).drop("_part", "_at", "_shift")
