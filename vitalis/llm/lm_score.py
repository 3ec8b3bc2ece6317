"""Operator 8: language-model scores from a log-frequency Bloom filter.

Training tokens and token pairs are counted over all training documents.  A count c is
quantised to 1 + floor(log2 c), and the filter holds, for every gram, the keys (gram, 1) to
(gram, level).  A worker reads a count back by probing (gram, 1), (gram, 2), ... until one is
absent: it never reads too low, and too high with the filter's error rate.  The restored
count r is the middle of its level.  A document's score is
    sum over tokens of log10 p(w | h),   p(w | h) = (r(h w) + MU p(w)) / (S(h) + MU),
    p(w) = (r(w) + 0.1) / (R + 0.1 (V + 1)),
h the token before (the end token before the first), S(h) the sum of r(h w) over all w, R that of r(w): the sums are of
the quantised counts themselves, so both are probabilities, over the V words and one unknown, but for the filter's error.
S(h) depends on h alone, and a document's contexts are its tokens (the end token leads instead of closing), so the sum
of log10 (S(h) + MU) is taken token by token, with the exact counts of the base score.

The filter is built in buckets by gram hash (48 bits; two grams share a hash far more seldom than
the filter errs), each bucket by the task that holds its counts, and broadcast in slices of at most ``SLICE``
bytes.  It grows with the number of distinct pairs, and its total is checked against ``MOST_BYTES``
before anything is broadcast: above it the operator raises, it drops nothing.

The base score needs exact counts.  Tokens with at least N / ``HEAVY`` occurrences are at most
HEAVY many (their counts sum to N), so their counts and S are broadcast as sorted 64-bit hashes; all other
tokens are joined by token, and none of those is common.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

END = b" "                  # no word holds a blank
HEAVY = 4_000_000
HELD_GRAMS = 1_500_000      # a task holds so many counts before it sends them on
HELD_TOKENS = 200_000
MU = 4.0
BITS = 8                    # filter bits for each key
HASHES = 4
SLICE = 96 << 20
MOST_BYTES = 2 << 30
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_GRAM = np.uint64(16)       # a gram's hash keeps the upper 48 bits
_NO_CONTEXT = 0             # stands where a single token's context would


def tokens(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words of a text; the end token is not among them."""
    return text.encode().translate(_LOWER).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * _K1
    x = x ^ (x >> np.uint64(29))
    x = x * _K2
    return x ^ (x >> np.uint64(32))


def pair_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(h * _K2 + w + _K1) >> _GRAM


def token_hash(w: np.ndarray) -> np.ndarray:
    return mix(w) >> _GRAM


class Ids(dict):
    """word -> small number, with the words' hashes, for one batch or worker."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = n = len(self)
        self.hashes.append(xxhash.xxh64_intdigest(word, 42))     # as Spark's xxhash64
        return n


def _numbered(docs: list[list[bytes]], ids: Ids) -> tuple[np.ndarray, np.ndarray]:
    """All documents' tokens as numbers, the end token closing each, and where each document ends."""
    get = ids.__getitem__
    flat: list[int] = []
    ends = []
    end = get(END)
    for d in docs:
        flat.extend(map(get, d))
        flat.append(end)
        ends.append(len(flat))
    return np.array(flat, dtype=np.int64), np.array(ends, dtype=np.int64)


def packed(grams: np.ndarray) -> bytes:
    """Sorted distinct hashes as the first one and 32-bit gaps, or plainly if a gap is longer."""
    gaps = np.diff(grams)
    if len(gaps) and int(gaps.max()) >> 32:
        return b"\1" + grams.astype("<u8").tobytes()
    return b"\0" + grams[:1].astype("<u8").tobytes() + gaps.astype("<u4").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if raw[:1] == b"\1":
        return np.frombuffer(raw, "<u8", offset=1)
    first, gaps = np.frombuffer(raw, "<u8", 1, 1), np.frombuffer(raw, "<u4", offset=9)
    return np.cumsum(np.concatenate([first, gaps.astype(np.uint64)]), dtype=np.uint64)


def summed(grams: list[np.ndarray], counts: list[np.ndarray], contexts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order with the sums of their counts and their contexts."""
    g = np.concatenate(grams)
    order = np.argsort(g)
    g = g[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    return g[first], np.add.reduceat(np.concatenate(counts)[order], first), np.concatenate(contexts)[order[first]]


def context_hash(h: np.ndarray) -> np.ndarray:
    """The upper 48 bits of a token's hash, never the mark of a single token."""
    return np.maximum(h >> _GRAM, np.uint64(1))


def levels(c: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(c)).astype(np.int64)


def restored(level: np.ndarray) -> np.ndarray:
    """The middle of 2**(level-1) .. 2**level - 1; 0 for level 0."""
    return np.where(level > 0, 1.5 * np.exp2(np.maximum(level, 1) - 1.0) - 0.5, 0.0)


def six_bytes(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six_bytes(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def gram_counts(train: DataFrame, buckets: int) -> DataFrame:
    """(bucket, grams, counts, contexts): packed sorted hashes of tokens and pairs with their counts, as each task saw
    them, and the hash of each pair's first token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            g, c, ctx = summed(*map(list, zip(*held, strict=True)))
            held.clear()
            cut = np.searchsorted(g, -(-(np.arange(buckets + 1, dtype=np.int64) << 48) // buckets).astype(np.uint64)).tolist()
            names = ["bucket", "grams", "counts", "contexts"]
            for lo in range(0, buckets, 64):
                mine = [b for b in range(lo, min(buckets, lo + 64)) if cut[b + 1] > cut[b]]
                yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int32()), pa.array([packed(g[cut[b]:cut[b + 1]]) for b in mine], pa.binary()),
                                                  pa.array([np.minimum(c[cut[b]:cut[b + 1]], 2**32 - 1).astype("<u4").tobytes() for b in mine], pa.binary()),
                                                  pa.array([six_bytes(ctx[cut[b]:cut[b + 1]]) for b in mine], pa.binary())], names=names)

        for b in batches:
            for part in common.slices(b, "t", 4_000_000):
                ids = Ids()
                flat, _ = _numbered([tokens(t) for t in common.texts(part, "t")], ids)
                hashes = np.array(ids.hashes, dtype=np.uint64)
                one = np.bincount(flat, minlength=len(hashes))
                before = np.concatenate([[ids[END]], flat[:-1]])
                pair, n = np.unique(before * len(hashes) + flat, return_counts=True)
                h, w = np.divmod(pair, len(hashes))
                some = one > 0
                held.append(summed([token_hash(hashes[some]), pair_hash(hashes[h], hashes[w])], [one[some], n],
                                   [np.full(int(some.sum()), _NO_CONTEXT, dtype=np.uint64), context_hash(hashes[h])]))
                size += len(held[-1][0])
                if size > HELD_GRAMS:
                    yield from out()
                    size = 0
        yield from out()

    return train.select(F.col("text").alias("t")).mapInArrow(run, "bucket int, grams binary, counts binary, contexts binary")


def places(grams: np.ndarray, level: int, n_bits: np.ndarray | int) -> Iterator[np.ndarray]:
    """The HASHES bit places of (gram, level), all in one of the 512-bit blocks of a filter of n_bits."""
    x = mix(grams + np.full(1, level, dtype=np.uint64) * _K1)
    blocks = np.asarray(n_bits, dtype=np.uint64) >> np.uint64(9)
    block = ((x >> np.uint64(32)) * blocks >> np.uint64(32)) << np.uint64(9)
    y = mix(x + _K2)
    for k in range(HASHES):
        yield block | (y >> np.uint64(9 * k) & np.uint64(511))


def build_filter(counts: DataFrame, key_bits: int = BITS) -> DataFrame:
    """(bucket, n_keys, bits, contexts, sums): one Bloom filter for each bucket, with all its grams' levels, and for each
    context the sum of its restored counts in this bucket.  A context's pairs lie in all buckets, so none is hot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = [None, [], [], []]

        def out() -> Iterator[pa.RecordBatch]:
            if state[0] is None:
                return
            g, c, ctx = summed(*state[1:])
            level = levels(c)
            n_bits = (int(level.sum()) * key_bits + 511) // 512 * 512
            bits = np.zeros(n_bits, dtype=bool)
            for k in range(1, int(level.max()) + 1):
                for at in places(g[level >= k], k, n_bits):
                    bits[at] = True
            own, at = np.unique(ctx, return_inverse=True)
            sums = np.bincount(at, weights=restored(level))
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
            yield pa.RecordBatch.from_arrays([pa.array([state[0]], pa.int32()), pa.array([int(level.sum())], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()),
                                              whole(own.astype(np.int64)), whole(sums)], names=["bucket", "n_keys", "bits", "contexts", "sums"])

        for b in batches:
            for k, g, c, ctx in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if k != state[0]:
                    yield from out()
                    state[:] = [k, [], [], []]
                state[1].append(unpacked(g))
                state[2].append(np.frombuffer(c, "<u4").astype(np.int64))
                state[3].append(from_six_bytes(ctx))
        yield from out()

    return counts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        run, "bucket int, n_keys long, bits binary, contexts array<long>, sums array<double>")


class Filter:
    """The broadcast filter on a worker: counts of gram hashes, slice by slice."""

    def __init__(self, parts: list, buckets: int):
        self.parts, self.buckets = parts, buckets      # parts: (first bucket, last bucket + 1, broadcast)

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """The restored count of each gram, 0 if its first probe fails."""
        bucket = (grams * np.uint64(self.buckets) >> np.uint64(48)).astype(np.int64)
        level = np.zeros(len(grams), dtype=np.int64)
        for lo, hi, part in self.parts:
            mine = np.flatnonzero((bucket >= lo) & (bucket < hi))
            if not len(mine):
                continue
            offset, n_bits, raw = part.value
            bits = np.frombuffer(raw, np.uint8)
            mine = mine[n_bits[bucket[mine] - lo] > 0]
            k = 1
            while len(mine):
                b = bucket[mine] - lo
                start, n = offset[b], n_bits[b]
                there = np.ones(len(mine), dtype=bool)
                for at in places(grams[mine], k, n):
                    p = start + at.astype(np.int64)
                    there &= (bits[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
                mine = mine[there]
                level[mine] = k
                k += 1
        return restored(level)


def token_counts(train: DataFrame) -> DataFrame:
    """(token, c) over all training documents; the end token is counted once for each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(got.keys()), pa.binary()), pa.array(list(got.values()), pa.int64())], names=["token", "c"])
            got.clear()
            return b

        for b in batches:
            for t in common.texts(b, "t"):
                got.update(tokens(t))
                got[END] += 1
                if len(got) > HELD_TOKENS:
                    yield out()
        yield out()

    return train.select(F.col("text").alias("t")).mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def score(df: DataFrame, train: str, key: str = "doc_id", text: str = "text", key_bits: int = BITS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``df``.

    ``train`` names a boolean column: rows to learn from; ``key_bits`` is the filter's size per key.  A null or empty text is one end token.  Repeated rows and
    null keys are rows like others.  Without training rows, N and V are 0 and every token has the same share.
    """
    spark = df.sparkSession
    scratch = common.Scratch(spark)
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), (~F.col(train)).alias("held_out"), F.col(text).alias("text"))
    learned = df.where(F.col(train)).select(F.col(text).alias("text"))

    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    built = scratch.keep(build_filter(gram_counts(learned, buckets), key_bits))
    sums = built.select(F.explode(F.arrays_zip("contexts", "sums")).alias("x")).groupBy(F.col("x.contexts").alias("context")).agg(F.sum("x.sums").alias("s"))
    context = F.greatest(F.shiftrightunsigned(F.xxhash64("token"), 16), F.lit(1))
    counts = scratch.keep(token_counts(learned).withColumn("context", context).join(sums.where(F.col("context") != _NO_CONTEXT), "context", "left").drop("context"))
    all_single = built.select(F.sum(F.aggregate(F.arrays_zip("contexts", "sums"), F.lit(0.0), lambda a, x: a + F.when(x["contexts"] == _NO_CONTEXT, x["sums"]).otherwise(0.0)))).first()[0] or 0.0
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    heavy = counts.where(F.col("c") * HEAVY >= n).select(F.xxhash64("token").alias("h"), "c", F.coalesce("s", F.lit(0.0)).alias("s")).sort("h").toPandas()     # at most HEAVY rows
    table = spark.sparkContext.broadcast((heavy["h"].to_numpy(np.int64), heavy["c"].to_numpy(np.int64), heavy["s"].to_numpy(np.float64)))
    del heavy

    sizes = sorted((r["bucket"], r["n"]) for r in built.select("bucket", F.octet_length("bits").alias("n")).collect())     # one row for each bucket
    if sum(x for _, x in sizes) > MOST_BYTES:
        raise ValueError(f"the filter takes {sum(x for _, x in sizes)} bytes, more than MOST_BYTES; lower key_bits")
    groups: list[list[tuple[int, int]]] = []
    for b, size in sizes:
        if not groups or sum(x for _, x in groups[-1]) + size > SLICE:
            groups.append([])
        groups[-1].append((b, size))
    parts = []
    for i, group in enumerate(groups):
        lo = group[0][0] if i else 0
        hi = groups[i + 1][0][0] if i + 1 < len(groups) else buckets
        n_bytes = np.zeros(hi - lo, dtype=np.int64)
        for b, size in group:
            n_bytes[b - lo] = size
        offset = np.cumsum(n_bytes) - n_bytes
        raw = bytearray(int(n_bytes.sum()))
        for r in built.where(F.col("bucket").between(lo, hi - 1)).select("bucket", "bits").toLocalIterator():
            at = int(offset[r["bucket"] - lo])
            raw[at:at + len(r["bits"])] = r["bits"]
        parts.append((lo, hi, spark.sparkContext.broadcast((offset * 8, n_bytes * 8, bytes(raw)))))
        del raw
    room, restored_room = n + 0.1 * (v + 1), all_single + 0.1 * (v + 1)
    kind = rows.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Filter(parts, buckets)
        known, times_known, sums_known = table.value
        for batch in batches:
            for b in common.slices(batch, "text", 4_000_000):
                ids = Ids()
                flat, ends = _numbered([tokens(t) for t in common.texts(b, "text")], ids)
                hashes = np.array(ids.hashes, dtype=np.uint64)
                starts = np.concatenate([[0], ends[:-1]])
                before = np.concatenate([[ids[END]], flat[:-1]])
                single = look.counts(token_hash(hashes))
                together = look.counts(pair_hash(hashes[before], hashes[flat]))
                model = np.add.reduceat(np.log10(together + MU * (single[flat] + 0.1) / restored_room), starts)
                # exact shares: heavy tokens here, the others by a join on their distinct tokens
                signed = hashes.view(np.int64)
                at = np.minimum(np.searchsorted(known, signed), max(0, len(known) - 1))
                exact = np.where(known[at] == signed, times_known[at], -1) if len(known) else np.full(len(signed), -1)
                share = np.where(exact >= 0, np.log10((np.maximum(exact, 0) + 0.1) / room), 0.0)
                base = np.add.reduceat(share[flat], starts)
                sums_of = np.where(exact >= 0, np.log10(sums_known[at] + MU), 0.0) if len(known) else np.zeros(len(signed))
                model -= np.add.reduceat(sums_of[flat], starts)
                n_heavy = np.add.reduceat((exact > 0)[flat].astype(np.int64), starts)
                doc, light = np.repeat(np.arange(len(ends)), ends - starts), (exact < 0)[flat]
                own, times = np.unique(doc[light] * len(ids) + flat[light], return_counts=True)
                cut = pa.array(np.searchsorted(own, np.arange(len(ends) + 1) * len(ids)).astype(np.int32))
                rest = pa.ListArray.from_arrays(cut, pa.array(list(ids), pa.binary()).take(pa.array(own % len(ids))))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(2), pa.array(ends - starts), pa.array(n_heavy), pa.array(base), pa.array(model),
                     rest, pa.ListArray.from_arrays(cut, pa.array(times.astype(np.int64)))],
                    names=["row", "key", "held_out", "n_tokens", "n_heavy", "base", "score", "rest", "times"])

    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("key", kind), T.StructField("held_out", T.BooleanType()),
                           T.StructField("n_tokens", T.LongType()), T.StructField("n_heavy", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType()),
                           T.StructField("rest", T.ArrayType(T.BinaryType())), T.StructField("times", T.ArrayType(T.LongType()))])
    scored = scratch.keep(rows.mapInArrow(run, schema))
    rare = scored.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row", F.col("x.rest").alias("token"), F.col("x.times").alias("times"))
    light = counts.where(F.col("c") * HEAVY < n)
    found = rare.join(light, "token", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_light"),
        F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(room))).alias("light"),
        F.sum(F.col("times") * F.log10(F.coalesce("s", F.lit(0.0)) + MU)).alias("light_sums"))
    out = scored.select("row", "key", "held_out", "n_tokens", "n_heavy", "base", "score").join(found, "row", "left")
    return out.select(F.col("key").alias(key), "held_out", "n_tokens", (F.col("n_heavy") + F.coalesce("n_light", F.lit(0))).alias("n_known"),
                      F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("light", F.lit(0.0))).alias("base_score"),
                      F.least(F.lit(0.0), F.col("score") - F.coalesce("light_sums", F.lit(0.0))).alias("score"))
