"""Operator 10: near-duplicate vectors by collision-counting projections.

Unit vectors are projected on many random directions.  Two vectors of cosine ``cosine`` are at most
r = sqrt(2 - 2 cosine) apart, so their projections on one direction differ by about r / sqrt(d):
they collide in the query-centred window |p - q| <= WINDOW * r / sqrt(d) with a known chance.

* Candidates: each of ``tables`` tables takes ``width`` of the projections, sorts each in cells and deals
  vectors of one label by their cells.  ``width`` follows from the size of the largest label so that a table's
  groups of unrelated vectors stay small; ``tables`` from the recall wanted at the threshold itself.
* In a group, collisions of a pair are counted over ``COUNTED`` directions.  Pairs that reach the
  recall-calibrated count are verified by their cosine in double precision.
* A pair may meet in several tables; it is counted in the first one where its cells agree.

Equal vectors are one vector with a number of copies.  A group larger than ``CHUNK`` is cut in chunks
of rows, and each pair of chunks is a task's work of bounded size.  Groups return their vectors' link
counts and a spanning forest of their links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

COUNTED = 24         # directions on which collisions are counted
WINDOW = 2.6         # half-width of a window, in standard deviations of a linked pair's difference
CELL = 4.0           # width of a cell, in the same unit
RECALL = 0.9995      # for a pair exactly at the threshold
GROUP = 4            # unrelated vectors wanted in a group
CHUNK = 1024


def calibrated(window: float, counted: int, recall: float) -> int:
    """The largest count of window collisions that a pair at the threshold reaches with chance ``recall`` or more."""
    p = erf(window / sqrt(2))
    tail, term = 0.0, p ** counted
    for k in range(counted, -1, -1):
        tail += term
        if tail >= recall:
            return k
        term *= k / (counted - k + 1) * (1 - p) / p
    return 0


def layout(n: int, r: float, recall: float = RECALL) -> tuple[int, int]:
    """(width, tables) for labels of up to n vectors."""
    # chance of one cell for a pair at the threshold (difference N(0, 1) units against CELL), and for unrelated vectors
    phi = (1 - exp(-CELL * CELL / 2)) * 2 / (CELL * sqrt(2 * pi))
    near = erf(CELL / sqrt(2)) - phi
    far = min(0.9, CELL * r / (2 * sqrt(pi)))
    width = max(1, ceil(log(max(2.0, n / GROUP)) / -log(far)))
    return width, max(2, ceil(log(1 - recall) / log(1 - near ** width)))


def prepared(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(key, label, vec): vec holds the vector's components as packed floats, null where it links with nothing."""
    kind = _kind(df, vector)

    def valid(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for v in batch.column(2).to_pylist():
            x = None
            if v and None not in v:
                a = np.array(v, dtype=kind)
                x = a.tobytes() if np.isfinite(a).all() and a.any() else None
            out.append(x)
        return [pa.array(out, pa.binary())]

    rows = df.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("v"))
    return common.add_columns(rows, [T.StructField("vec", T.BinaryType())], valid).select("key", "label", F.when(F.col("label").isNotNull(), F.col("vec")).alias("vec"))


def _kind(df: DataFrame, vector: str) -> str:
    return "<f4" if isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "<f8"


def _units(vecs: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision from packed components."""
    x = np.stack([np.frombuffer(v, kind) for v in vecs]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)      # lest squares overflow or vanish
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


_DIRECTIONS: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}


def _directions(d: int, n: int, r: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n directions, scaled so that a pair r apart differs by about 1, and random shifts of their cells."""
    key = (d, n, r, seed)
    if key not in _DIRECTIONS:
        rng = np.random.Generator(np.random.PCG64([seed, d]))
        a = rng.standard_normal((d, n))
        _DIRECTIONS[key] = a * (sqrt(d) / r / np.linalg.norm(a, axis=0)), rng.random(n) * CELL
    return _DIRECTIONS[key]


def _cells(x: np.ndarray, width: int, tables: int, r: float, seed: int) -> np.ndarray:
    """Each vector's cell number in each table."""
    a, shift = _directions(x.shape[1], max(COUNTED, width * tables), r, seed)
    n = width * tables
    # one vector at a time: the same vector gives the same cells wherever it is computed
    p = np.stack([v @ a for v in x])[:, :n]
    cell = np.floor((p + shift[:n]) / CELL).astype(np.int64).view(np.uint64).reshape(len(x), tables, width)
    out = np.full((len(x), tables), np.uint64(0x9E3779B97F4A7C15)) * (np.arange(tables, dtype=np.uint64) + np.uint64(1))
    for k in range(width):
        out = (out ^ cell[:, :, k]) * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(29)
    return out


def _linked(x: np.ndarray, y: np.ndarray, table: int, least: int, cosine: float, same: bool, width: int, tables: int, r: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs between two chunks (or in one) whose first common cell is in ``table``."""
    a = _directions(x.shape[1], max(COUNTED, width * tables), r, seed)[0][:, :COUNTED]
    p = x @ a
    q = p if same else y @ a
    hits = np.zeros((len(p), len(q)), dtype=np.uint8)
    for m in range(p.shape[1]):
        hits += np.abs(p[:, m, None] - q[None, :, m]) <= WINDOW
    if same:
        hits = np.triu(hits, 1)
    i, j = np.nonzero(hits >= max(1, least))
    ok = np.zeros(len(i), dtype=bool)
    for at in range(0, len(i), 50_000):
        part = slice(at, at + 50_000)
        ok[part] = np.einsum("ij,ij->i", x[i[part]], y[j[part]]) >= cosine
    i, j = i[ok], j[ok]
    if table and len(i):
        u, v = np.unique(i), np.unique(j)
        ku, kv = _cells(x[u], width, tables, r, seed), _cells(y[v], width, tables, r, seed)
        iu, jv = np.searchsorted(u, i), np.searchsorted(v, j)
        new = np.ones(len(i), dtype=bool)
        for t in range(table):
            new &= ku[iu, t] != kv[jv, t]
        i, j = i[new], j[new]
    return i, j


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the same components as all pairs."""
    root = list(range(n))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    out = []
    # one edge at a time only for pairs of rows whose components differ so far
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
            if len(out) == n - 1:
                break
    return out


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98, seed: int = 10) -> DataFrame:
    """(key, n_links, component_id, kept) for every row.

    n_links counts the other rows of the same label within the cosine; component_id is the smallest key reachable
    by links; kept marks the row whose key that is.  Rows with a null label, or a vector that is null, empty, zero or has a
    null or non-finite component, link with nothing.  Vectors of different lengths do not link.  Repeated rows
    are copies that link; rows with a null key take part and get their component's smallest key, if any.
    """
    scratch = common.Scratch(df.sparkSession)
    rows = scratch.keep(prepared(df, key, vector, label))
    valid = rows.where("vec is not null")
    # equal vectors of a label: one representative
    reps = scratch.keep(valid.groupBy("label", "vec").agg(F.min("key").alias("k"), F.count("*").alias("copies")).withColumn("id", F.monotonically_increasing_id()))
    size = reps.groupBy("label", F.octet_length("vec").alias("b")).count().agg(F.max("count").alias("n"), F.max("b").alias("b")).first()
    alone = rows.where("vec is null").select(F.col("key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"), F.lit(True).alias("kept"))
    if not size["n"]:
        return alone
    r = sqrt(2 - 2 * cosine)
    kind = _kind(df, vector)
    width, tables = layout(size["n"], r)
    least = calibrated(WINDOW, COUNTED, RECALL)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vecs = b.column(0).to_pylist(), b.column(2).to_pylist()
            for lo in range(0, len(ids), 2000):
                part = vecs[lo:lo + 2000]
                keys: list[np.ndarray] = [np.empty(0)] * len(part)
                for n in sorted({len(v) for v in part}):
                    own = [i for i, v in enumerate(part) if len(v) == n]
                    for i, g in zip(own, _cells(_units([part[i] for i in own], kind), width, tables, r, seed), strict=True):
                        keys[i] = g
                m = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[lo:lo + m], tables)), b.column(1).take(pa.array(np.repeat(np.arange(lo, lo + m), tables))), pa.array(np.tile(np.arange(tables, dtype=np.int32), m)),
                     pa.array(np.concatenate(keys).view(np.int64))], names=["id", "label", "t", "cell"])

    label_type = reps.schema["label"].dataType.simpleString()
    cells = scratch.keep(reps.select("id", "label", "vec").mapInArrow(dealt, f"id long, label {label_type}, t int, cell long"))
    groups = cells.groupBy("label", "t", "cell").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    placed = cells.join(groups, ["label", "t", "cell"]).withColumn("c", F.pmod(F.xxhash64("id"), chunks).cast("int")).withColumn("of", chunks)
    # a row goes to every pair of chunks that has its own; a group within CHUNK has one pair
    placed = placed.select("id", "t", "cell", "label", "c", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("o"))
    placed = placed.select("id", "t", F.xxhash64("label", "t", "cell").alias("g"), "cell", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"), "c")
    work = placed.join(reps.select("id", "vec", "copies", "label"), "id").repartition("g", "lo", "hi").sortWithinPartitions("t", "g", "lo", "hi", "id")
    work = work.select("t", "g", "lo", "hi", "c", "id", "copies", "vec")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(group: tuple, members: list) -> tuple[list, list, list, list]:
            t, _, lo, hi = group
            by_size: dict[int, list] = {}
            for m in members:
                by_size.setdefault(len(m[3]), []).append(m)
            ids, links, ea, eb = [], [], [], []
            for own in by_size.values():
                if len(own) < 2:
                    continue
                x = _units([m[3] for m in own], kind)
                c = np.array([m[0] for m in own])
                if lo == hi:
                    i, j = _linked(x, x, t, least, cosine, True, width, tables, r, seed)
                else:
                    a, b = np.flatnonzero(c == lo), np.flatnonzero(c == hi)
                    i, j = _linked(x[a], x[b], t, least, cosine, False, width, tables, r, seed)
                    i, j = a[i], b[j]
                if len(i):
                    copies = np.array([m[2] for m in own], dtype=np.int64)
                    n = np.bincount(i, copies[j], len(own)) + np.bincount(j, copies[i], len(own))
                    at = np.flatnonzero(n)
                    ids += [own[k][1] for k in at.tolist()]
                    links += n[at].astype(np.int64).tolist()
                    for a_, b_ in _forest(len(own), i, j):
                        ea.append(own[a_][1])
                        eb.append(own[b_][1])
            return ids, links, ea, eb

        held: tuple | None = None
        members: list = []
        names = ["id", "links", "a", "b"]

        def batch_of(got: list) -> pa.RecordBatch:
            ids, links, ea, eb = got
            none = [None]
            return pa.RecordBatch.from_arrays([pa.array(ids + none * len(ea), pa.int64()), pa.array(links + none * len(ea), pa.int64()),
                                               pa.array(none * len(ids) + ea, pa.int64()), pa.array(none * len(ids) + eb, pa.int64())], names=names)

        out: list[list] = [[], [], [], []]
        for b in batches:
            for row in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if row[:4] != held:
                    if held is not None and len(members) > 1:
                        for o, g in zip(out, pairs(held, members), strict=True):
                            o += g
                        if len(out[0]) + len(out[2]) > 20_000:
                            yield batch_of(out)
                            out = [[], [], [], []]
                    held, members = row[:4], []
                members.append(row[4:])
        if held is not None and len(members) > 1:
            for o, g in zip(out, pairs(held, members), strict=True):
                o += g
        yield batch_of(out)

    found = scratch.keep(work.mapInArrow(count, "id long, links long, a long, b long"))
    links = found.where("id is not null").groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.where("a is not null").select("a", "b"), scratch)
    member = reps.join(links, "id", "left").join(joined, reps["id"] == joined["node"], "left").select(
        "label", "vec", "k", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("c"))
    least_key = member.groupBy("c").agg(F.min("k").alias("component_id"))
    classes = scratch.keep(member.join(least_key, "c").select("label", "vec", (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), "component_id"))
    out = valid.join(classes, ["label", "vec"]).select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))
    return out.unionByName(alone)
