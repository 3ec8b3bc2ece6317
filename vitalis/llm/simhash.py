"""Operator 7: SimHash near-duplicates by a generalised pigeonhole search.

A fingerprint bit is 1 if it is set in over half of the XXH64 values (seed 42) of the text's word
shingles.  Two fingerprints that differ in at most ``tau`` of 64 bits are linked; documents
reachable by links form a component.

Search, over distinct fingerprints only:
* Bits that go together (by absolute correlation over all fingerprints) are put in one part.
* With thresholds T_i over m parts, sum(T_i + 1) = tau + 1, a pair within tau differs by at
  most T_i in some part i; T_i = -1 leaves the part out.  A dynamic programme over the parts
  picks the thresholds of least estimated cost (probes and candidate pairs); the number of
  parts is picked by the same cost.
* A fingerprint is indexed by its value in each part, and probes all values within T_i of its own.
  Candidates are verified by their bit distance.
* An index value shared by more than ``most`` fingerprints is not paired up.  Its members are linked
  through common neighbours instead: each emits every value within ceil(tau/2) bits of itself and
  of each probing neighbour's, and members that meet at a value are at most tau apart for even tau.
  Every pair within tau meets so, hence no link is lost, and rows grow with members, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def simhash(text: str, words: int) -> int:
    """The 64-bit fingerprint of one text; 0 for a text without words."""
    import xxhash

    raw = text.encode().translate(_LOWER).split()   # splits at 0x20 and 0x09-0x0D only
    if not raw:
        return 0
    h = xxhash.xxh64_intdigest
    if len(raw) <= words:
        return h(b" ".join(raw), 42)
    joined = b" ".join(raw)
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(raw) - words + 1].tolist()
    values = np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, ends[words - 1:].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(values), 1 << 16):
        part = values[at:at + (1 << 16)].astype(">u8").view(np.uint8)
        ones += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(values)).tobytes(), "big")


def fingerprint(df: DataFrame, text: str = "text", words: int = 3, out: str = "simhash", whole: bool = True) -> DataFrame:
    """Add ``out``, the fingerprint as a signed 64-bit integer; null, empty and wordless texts have 0.

    With ``whole`` false the text itself is left out of the result.
    """
    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        got = np.array([simhash(t, words) for t in common.texts(batch, text)], dtype=np.uint64)
        return [pa.array(got.view(np.int64), pa.int64())]

    return common.add_columns(df, [T.StructField(out, T.LongType())], fn, text, () if whole else (text,))


def _bits(values: np.ndarray) -> np.ndarray:
    """One column for each bit, bit 0 the lowest."""
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 matrix of how many have both bits, over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((64, 64)), 0
        for b in batches:
            x = _bits(b.column(0).to_numpy().view(np.uint64)).astype(np.float32)
            for at in range(0, len(x), 1 << 16):
                part = x[at:at + (1 << 16)]
                total += part.T @ part
                n += len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(65)), pa.array([*total.astype(np.int64).tolist(), [n]], pa.list_(pa.int64()))], names=["i", "c"])

    rows = prints.select("f").mapInArrow(run, "i long, c array<long>").select("i", F.posexplode("c")).groupBy("i", "pos").agg(F.sum("col").alias("n")).collect()
    both, n = np.zeros((64, 64)), 0     # 64 * 64 + 1 rows
    for r in rows:
        if r["i"] == 64:
            n = r["n"]
        else:
            both[r["i"], r["pos"]] = r["n"]
    return n, both


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Greedy parts of nearly equal width: start with the bit pair that goes together most, add the bit closest to the part."""
    p = np.diag(both) / max(1, n)
    cov = both / max(1, n) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    close = np.abs(cov / np.outer(sd, sd))
    free, out = list(range(64)), []
    for k in range(parts):
        width = 64 // parts + (k < 64 % parts)
        sub = close[np.ix_(free, free)] - np.eye(len(free)) * 9
        group = [free[int(np.argmax(sub)) // len(free)]]
        while len(group) < width:
            rest = [b for b in free if b not in group]
            group.append(rest[int(np.argmax(close[np.ix_(rest, group)].mean(axis=1)))])
        free = [b for b in free if b not in group]
        out.append(sorted(group))
    return out


def allocate(cost: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds T_i (from the keys of cost[i]) that sum to ``total`` at least cost, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (v, chosen) in best.items():
            for t, x in c.items():
                if s + t not in step or v + x < step[s + t][0]:
                    step[s + t] = (v + x, [*chosen, t])
        best = step
    return best[total]


def signed(x: int) -> int:
    """A 64-bit pattern as the signed integer that Spark holds."""
    return x - (1 << 64) if x >> 63 else x


def part_value(col: str, bits: list[int]):
    """The bits of one part, packed to an integer, as a column expression of shifts and masks."""
    out = None
    for to, b in enumerate(bits):
        one = F.shiftleft(F.shiftrightunsigned(F.col(col), b).bitwiseAND(F.lit(1).cast("long")), to)
        out = one if out is None else out.bitwiseOR(one)
    return out


def _flipped(value: Column, mask: Column) -> Column:
    return value.bitwiseXOR(mask)


def plan_search(prints: DataFrame, tau: int, part_counts: tuple[int, ...] = (2, 3, 4)) -> list[tuple[list[int], int]]:
    """Parts of bits with their thresholds, from statistics of all fingerprints."""
    n, both = bit_statistics(prints)
    if not n:
        return [(list(range(64))[k::tau + 1], 0) for k in range(tau + 1)]
    p = np.diag(both) / n
    differ = 2 * p * (1 - p)
    layouts = {m: grouped_bits(n, both, m) for m in part_counts}
    wide = prints.select(*[part_value("f", bits).alias(f"p{m}_{i}") for m, groups in layouts.items() for i, bits in enumerate(groups)])
    # pairs that agree in a part, exactly, from the part's value counts
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.col(c).alias("value")) for c in wide.columns])).alias("x")).select("x.*")
    agree = {r["part"]: float(r["pairs"]) for r in long.groupBy("part", "value").count().groupBy("part").agg(
        F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    best = None
    for m, groups in layouts.items():
        cost = []
        for i, bits in enumerate(groups):
            dist = np.array([1.0])
            for b in bits:      # distribution of the number of differing bits, were they independent
                dist = np.convolve(dist, [1 - differ[b], differ[b]])
            c = {-1: 0.0}
            for t in range(tau + 1):
                probes = sum(comb(len(bits), k) for k in range(t + 1))
                c[t] = n * (probes + 1) + agree[f"p{m}_{i}"] + n * n / 2 * float(dist[1:t + 1].sum())
            cost.append(c)
        got = allocate(cost, tau - m + 1)
        if best is None or got[0] < best[0]:
            best = (*got, groups)
    return [(bits, t) for bits, t in zip(best[2], best[1], strict=True) if t >= 0]


def links(prints: DataFrame, tau: int, scratch: common.Scratch, most: int = 64,
          plan: list[tuple[list[int], int]] | None = None) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``f`` that connect all pairs within ``tau`` bits (2 here, or any even number).

    Edges of small index values are the verified pairs themselves; in crowded values, edges lead to the
    smallest fingerprint of a common neighbourhood, all of whose members are within ``tau`` of each other.
    """
    if tau % 2:
        raise ValueError("common neighbourhoods need an even tau")
    plan = plan or plan_search(prints, tau)
    index = None
    probe = None
    for i, (bits, t) in enumerate(plan):
        value = part_value("f", bits)
        flips = [signed(sum(1 << b for b in c)) for k in range(t + 1) for c in combinations(range(len(bits)), k)]
        own = prints.select(F.lit(i).alias("part"), value.alias("value"), "f")
        index = own if index is None else index.unionByName(own)
        more = prints.select(F.lit(i).alias("part"), F.explode(F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), partial(_flipped, value))).alias("value"), "f")
        probe = more if probe is None else probe.unionByName(more)
    counts = probe.groupBy("part", "value").agg(F.count("*").alias("n"))
    crowded = scratch.keep(counts.where(F.col("n") > most).select("part", "value"))
    calm = index.join(crowded, ["part", "value"], "left_anti").withColumnRenamed("f", "a")
    asks = probe.join(crowded, ["part", "value"], "left_anti").withColumnRenamed("f", "b")
    near = calm.join(asks, ["part", "value"]).where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau).select("a", "b")
    back = calm.join(asks, ["part", "value"]).where("a > b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau).select(F.col("b").alias("a"), F.col("a").alias("b"))
    if any(t for _, t in plan):
        near = near.unionByName(back)
    # all members of crowded values, by common neighbourhood
    half = tau // 2
    masks = [signed(sum(1 << b for b in c)) for k in range(half + 1) for c in combinations(range(64), k)]
    inside = probe.join(crowded, ["part", "value"], "left_semi").select("f").distinct()
    balls = inside.select("f", F.explode(F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: F.col("f").bitwiseXOR(m))).alias("z"))
    hubs = balls.groupBy("z").agg(F.min("f").alias("b"), F.count("*").alias("n")).where("n > 1").select("z", "b")
    hot = balls.join(hubs, "z").where("f != b").select(F.col("f").alias("a"), "b")
    return near.unionByName(hot).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, tau: int = 2,
                    scratch: common.Scratch | None = None) -> DataFrame:
    """Each row's (key, fingerprint, component_id): the smallest key reachable by links, its own included.

    Wordless, empty and null texts share the zero fingerprint and are linked like any other.  Rows with a
    null key keep their place and may get a null component when nothing else is in it.  Repeated rows and
    keys each give a row.
    """
    scratch = scratch or common.Scratch(df.sparkSession)
    docs = scratch.keep(fingerprint(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", words, "f", whole=False))
    # smallest key of each fingerprint; the partial sums before the shuffle take the heat off common ones
    prints = scratch.keep(docs.groupBy("f").agg(F.min("key").alias("k")))
    edges = links(prints.select("f"), tau, scratch)
    joined = components(edges, scratch)
    member = prints.join(joined, prints["f"] == joined["node"], "left").select("f", "k", F.coalesce("component", "f").alias("c"))
    least = member.groupBy("c").agg(F.min("k").alias("component_id"))
    classes = scratch.keep(member.join(least, "c").select("f", "component_id"))
    return docs.join(classes, "f").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")
