"""Operator 13: centroid clustering of integer vectors with Ptolemaic pivot bounds.

For points x, c, p, q of a Euclidean space Ptolemy's inequality gives

    d(x, c) >= |d(x, p) d(c, q) - d(x, q) d(c, p)| / d(p, q).

The pivots are the starting centroids; each forms a fixed pair with the one farthest from it.  Every vector keeps
its distances to the pivots in the scratch table, so a round needs only the centroids' own distances to them.  A
centroid is skipped when its bound, made smaller by more than all rounding can add, exceeds the best squared
distance so far; the rest are computed in 64-bit integers, those with the least bound first.  Rounding can thus
cost time but never a result.

Vectors stay where they are: each task sums its own vectors for each centroid, and only those sums meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LARGEST = 1 << 27       # of a component: 4 * LARGEST**2 * dims fits 64 bits up to 64 dims
SLACK = 2.0 ** -46      # relative; a bound takes about ten roundings of 2**-53 each


def squares(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows from one vector."""
    d = points - centre
    return np.einsum("ij,ij->i", d, d)


def pivot_pairs(pivots: np.ndarray) -> list[tuple[int, int, float]]:
    """Each pivot with the one farthest from it and their distance; equal pivots form no pair."""
    out = []
    for i, p in enumerate(pivots):
        d = squares(pivots, p)
        j = int(np.argmax(d))
        if d[j]:
            out.append((i, j, float(np.sqrt(d[j]))))
    return out


def nearest(points: np.ndarray, near: np.ndarray, centres: np.ndarray, pivots: np.ndarray,
            pairs: list[tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each point the nearest centre (ties: the smaller number), its squared distance, and how many were computed.

    ``near`` holds the points' distances to ``pivots``.
    """
    n, k = len(points), len(centres)
    to_pivot = np.sqrt(np.array([squares(centres, p) for p in pivots], dtype=np.float64))      # pivot x centre
    lower = np.zeros((n, k))
    for i, j, apart in pairs:
        a, b = near[:, i, None] * to_pivot[j], near[:, j, None] * to_pivot[i]
        np.maximum(lower, (np.abs(a - b) - SLACK * (a + b)) / apart, out=lower)
    lower *= lower * (1 - SLACK)
    order = np.argsort(lower, axis=1, kind="stable")
    best, who, checked = np.full(n, np.iinfo(np.int64).max), np.full(n, k), np.zeros(n, dtype=np.int64)
    rows = np.arange(n)
    for s in range(k):
        c = order[:, s]
        at = np.flatnonzero(lower[rows, c] <= best.astype(np.float64))
        if not len(at):
            break
        found = c[at]
        d = points[at] - centres[found]
        d = np.einsum("ij,ij->i", d, d)
        checked[at] += 1
        better = (d < best[at]) | ((d == best[at]) & (found < who[at]))
        best[at[better]], who[at[better]] = d[better], found[better]
    return who, best, checked


def _integers(column: pa.ListArray, dims: int, scale: int) -> np.ndarray:
    """Rows of ``dims`` finite numbers as integers floor(scale * x)."""
    x = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims))
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"a component times {scale} is beyond {LARGEST}; squared distances would not fit 64 bits")
    return x.astype(np.int64)


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1,
            key: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """One row per vector: ``key``, cluster, distance (squared, of the integer vectors), checked (centroids whose
    distance was computed, of ``k``), cluster_inertia, inertia, centroid (final, array of integers).

    Kept are vectors of exactly ``dims`` (64 at most) components, none null or non-finite; others are left out, as
    are further columns.  The ``k`` kept rows with the smallest hex sha256 of ``seed:key`` start as centroids (ties:
    the smaller vector; null keys last; fewer rows, fewer centroids).  Repeated rows count each; an empty table gives
    an empty result.  A component beyond ``LARGEST`` / ``scale`` raises, as its distances would not fit 64 bits.
    """
    if dims > 64:
        raise ValueError("squared distances are exact for 64 components at most")
    spark = df.sparkSession
    scratch = common.Scratch(spark)
    x = F.col(vec).cast("array<double>")
    sound = (F.size(x) == dims) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = df.select(F.col(key).alias("_key"), x.alias("_x")).where(F.coalesce(sound, F.lit(False)))
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_key").cast("string")), 256).asc_nulls_last(), "_x").limit(k)
    start = [r["_x"] for r in first.select("_x").collect()]                                 # k rows
    centres = _integers(pa.array(start, pa.list_(pa.float64())), dims, scale)
    pivots, pairs = centres, pivot_pairs(centres)
    key_field = kept.schema["_key"]

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = _integers(b.column(1), dims, scale)
            near = np.sqrt(np.array([squares(points, p) for p in pivots], dtype=np.float64)).T
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p.tobytes() for p in points.astype("<i4")], pa.binary()),
                                              pa.array([d.tobytes() for d in near.astype("<f8")], pa.binary())], names=["_key", "point", "near"])

    table = scratch.keep(kept.mapInArrow(prepare, T.StructType([key_field, T.StructField("point", T.BinaryType()), T.StructField("near", T.BinaryType())])))

    def assigned(b: pa.RecordBatch, centres: np.ndarray) -> tuple[np.ndarray, ...]:
        points = _matrix(b.column("point"), "<i4", dims).astype(np.int64)
        return points, *nearest(points, _matrix(b.column("near"), "<f8", len(pivots)), centres, pivots, pairs)

    def sums(centres: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((len(centres), dims), dtype=np.int64), np.zeros(len(centres), dtype=np.int64)
            for b in batches:
                points, who, _, _ = assigned(b, centres)
                np.add.at(total, who, points)
                count += np.bincount(who, minlength=len(centres))
            used = np.flatnonzero(count)
            if len(used):
                yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))],
                                                 names=["cluster", "n", "total"])

        parts = table.mapInArrow(run, "cluster int, n long, total array<long>")
        cells = parts.select("cluster", "n", F.posexplode("total").alias("pos", "part"))
        return cells.groupBy("cluster", "pos").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))

    for _ in range(rounds if len(centres) else 0):
        moved = centres.copy()
        for r in sums(centres).collect():                                                   # k * dims rows
            moved[r["cluster"], r["pos"]] = int(r["total"]) // r["n"]
        centres = moved

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, who, best, checked = assigned(b, centres)
            yield pa.RecordBatch.from_arrays([b.column("_key"), pa.array(who, pa.int32()), pa.array(best), pa.array(checked, pa.int32())],
                                             names=["_key", "cluster", "distance", "checked"])

    ends = T.StructType([key_field, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("checked", T.IntegerType())])
    done = scratch.keep(table.mapInArrow(last, ends))
    scratch.drop(table)
    by_cluster = {r["cluster"]: int(r["s"]) for r in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    facts = spark.createDataFrame([(c, s, sum(by_cluster.values()), centres[c].tolist()) for c, s in sorted(by_cluster.items())],
                                  "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return done.join(F.broadcast(facts), "cluster").select(F.col("_key").alias(key), "cluster", "distance", "checked", "cluster_inertia", "inertia", "centroid")
