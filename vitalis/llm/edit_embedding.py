"""Operator 2: document fingerprints by randomised edit embedding.

Every text walks over its characters under random bits that all texts share: step j repeats the
current character and moves on when bit R(j, character) is 1.  Two texts that differ by few
edits soon walk in step again, so their walks differ in few positions: edit distance becomes
Hamming distance.  A character read at step j is left at j + wait(j, character), which a
table holds, so the walk costs one look-up for each character.

The fingerprint samples the walk: every step up to 64, then 32 random steps of each octave, each
kept as one of 64 symbols (a hash of the character).  A sample stands for as many steps as its
stratum has, and ``likeness`` is the weighted share of samples that agree, up to the longer walk.
Sample places come from a rule, so texts of any length have theirs.

Near pairs: bands of sampled symbols bring together texts that agree on all symbols of a band,
and ``near_pairs`` verifies candidates by likeness.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
PERIOD = 4096          # steps after which the shared bits repeat
OCTAVE = 32            # samples in each octave of steps
FIRST = 64             # all steps before this one are samples
FEW = 64               # fewer texts than this walk one by one

_BITS = np.random.Generator(np.random.PCG64(20)).integers(0, 2, (PERIOD, 256), dtype=np.uint8)


def _waits() -> np.ndarray:
    """wait[j, c]: steps for which character class c, read at step j, is repeated."""
    wait = np.ones((PERIOD, 256), dtype=np.uint8)
    open_ = _BITS == 0
    for d in range(1, 40):
        wait[open_] += 1
        open_ &= np.roll(_BITS, -d, axis=0) == 0
    return wait


WAIT = _waits()
_FLAT = WAIT.ravel()
_ROWS = [bytes(r) for r in WAIT]
_ALPHABET = np.frombuffer(SYMBOLS.encode(), np.uint8)
_SYMBOL = _ALPHABET[(np.arange(256, dtype=np.uint32) * np.uint32(2654435761) >> np.uint32(20)) & 63]


def _places(octaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled steps in order, and the steps each stands for, up to FIRST * 2**octaves."""
    at, weight = [np.arange(FIRST)], [np.ones(FIRST)]
    for k in range(octaves):
        width = (FIRST << k) // OCTAVE
        draw = np.random.Generator(np.random.PCG64([21, k])).integers(0, width, OCTAVE)
        at.append((FIRST << k) + width * np.arange(OCTAVE) + draw)
        weight.append(np.full(OCTAVE, float(width)))
    return np.concatenate(at), np.concatenate(weight)


_AT, _WEIGHT = _places(34)


def _classes(text: str) -> np.ndarray:
    cp = np.frombuffer(text.encode("utf-32-le"), "<u4")
    return np.where(cp < 256, cp, (cp * np.uint32(2654435761) >> np.uint32(13)) & 255).astype(np.uint8)


def fingerprints(docs: list[str]) -> list[str]:
    """Fingerprints of many texts; they walk together, longest first, and the last few alone."""
    n = np.array([len(t) for t in docs], dtype=np.int64)
    flat = _classes("".join(docs))
    start = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
    order = np.argsort(-n, kind="stable")
    lens, off = n[order], start[order]
    steps = np.zeros(len(flat) + 1, dtype=np.int64)    # the step at which each character is first read
    j = np.zeros(len(docs), dtype=np.int64)
    active = int(np.searchsorted(-lens, 0))            # texts of length > i
    i = 0
    while active >= FEW:
        at = off[:active] + i
        now = j[:active]
        steps[at] = now
        now += _FLAT[((now & (PERIOD - 1)) << 8) | flat[at]]
        i += 1
        while active and lens[active - 1] <= i:
            active -= 1
    for k in range(active):
        a, b, step = int(off[k]) + i, int(off[k] + lens[k]), int(j[k])
        seen = []
        add, rows, mask = seen.append, _ROWS, PERIOD - 1
        for c in flat[a:b].tobytes():
            add(step)
            step += rows[step & mask][c]
        steps[a:b] = seen
        j[k] = step
    end = np.empty(len(docs), dtype=np.int64)
    end[order] = j
    out = []
    for a, m, last in zip(start.tolist(), n.tolist(), end.tolist(), strict=True):
        if not m:
            out.append("")
            continue
        places = _AT[: np.searchsorted(_AT, last)]
        at = np.searchsorted(steps[a:a + m], places, side="right") - 1
        out.append(_SYMBOL[flat[a:a + m][at]].tobytes().decode())
    return out


def alike(a: str, b: str) -> float:
    """Weighted share of agreeing samples, up to the longer fingerprint; two empty ones are alike."""
    most, least = max(len(a), len(b)), min(len(a), len(b))
    if not most:
        return 1.0
    same = np.frombuffer(a[:least].encode(), np.uint8) == np.frombuffer(b[:least].encode(), np.uint8)
    return float(_WEIGHT[:least][same].sum() / _WEIGHT[:most].sum())


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Add ``out``, the fingerprint of ``text``: equal texts have equal ones, a null or empty text has the empty one."""
    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(fingerprints(common.texts(batch, text)), pa.string())]

    return common.add_columns(df, [T.StructField(out, T.StringType())], fn, text)


def likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add ``out``, the likeness (0 to 1) of two fingerprint columns; a null counts as the empty one."""
    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([alike(x, y) for x, y in zip(common.texts(batch, a), common.texts(batch, b), strict=True)], pa.float64())]

    return common.add_columns(df, [T.StructField(out, T.DoubleType())], fn)


def compare_next(df: DataFrame, edit: Callable[[str, str], str], key: str = "doc_id", text: str = "text",
                 blocks_per_partition: int = 4) -> DataFrame:
    """Compare each text with an edited one, made by ``edit(text, next text)``, and with the next row's text.

    The next row follows in descending ``key`` order (after the last, the first).  Returns key, n_chars, fingerprint,
    edited, edited_fingerprint, near_edited and near_next (likeness of the fingerprints).  Rows are dealt to
    blocks between quantiles of the key and the first row of each block also goes to the block before, so one
    shuffle suffices and no task sees the whole order.  A null key comes last; equal keys are ordered by text;
    a null text counts as empty; a single row is its own next one.
    """
    spark = df.sparkSession
    low = -(1 << 63)
    rows = df.select(F.coalesce(F.col(key), F.lit(low)).alias("_k"), F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = fingerprint(rows, "_text", "_print")
    n = max(2, blocks_per_partition * int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = df.select(F.coalesce(F.col(key), F.lit(low)).alias("_k"))
    bounds = sorted(set(keys.approxQuantile("_k", [i / n for i in range(1, n)], 0.25 / n)))
    cut = Bucketizer(splits=[-float("inf"), *bounds, float("inf")], inputCol="_d", outputCol="_b")

    def blocked(d: DataFrame) -> DataFrame:
        if not bounds:
            return d.withColumn("_block", F.lit(0))
        return cut.transform(d.withColumn("_d", F.col("_k").cast("double"))).withColumn("_block", F.col("_b").cast("int")).drop("_b", "_d")

    # one row for each block: at most n
    firsts = sorted((r["_block"], r["m"]) for r in blocked(keys).groupBy("_block").agg(F.max("_k").alias("m")).collect())
    to = [(m, firsts[(i + 1) % len(firsts)][0]) for i, (_, m) in enumerate(firsts)]
    ghosts = spark.createDataFrame(to, "_k long, _to int")
    dealt = blocked(rows).join(F.broadcast(ghosts), "_k", "left").withColumn("_at", F.explode(F.when(
        F.col("_to").isNull(), F.array(F.struct(F.col("_block").alias("block"), F.lit(False).alias("ghost")))).otherwise(
        F.array(F.struct(F.col("_block").alias("block"), F.lit(False).alias("ghost")), F.struct(F.col("_to").alias("block"), F.lit(True).alias("ghost"))))))
    dealt = dealt.select(F.col("_at.block").alias("_block"), F.col("_at.ghost").alias("_ghost"), "_k", "_key", "_text", "_print")
    ordered = dealt.repartition("_block").sortWithinPartitions("_block", "_ghost", F.desc("_k"), "_text")
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("_key", kind), T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType()), T.StructField("edited", T.StringType()),
                           T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None     # the row whose next one is still to come
        for batch in batches:
            for part in common.slices(batch, "_text"):
                block, ghost, _, _, body, own = (c.to_pylist() for c in part.columns)
                pairs = []
                for row in zip(block, ghost, part.column(3), body, own, strict=True):
                    if held is not None and held[0] == row[0]:
                        pairs.append((held, row))
                        held = None
                    if not row[1]:
                        held = row
                edited = [edit(a[3], b[3]) for a, b in pairs]
                prints = fingerprints(edited)
                yield pa.RecordBatch.from_arrays([
                    pa.array([a[2].as_py() for a, _ in pairs], part.column(3).type), pa.array([len(a[3]) for a, _ in pairs], pa.int64()), pa.array([a[4] for a, _ in pairs], pa.string()),
                    pa.array(edited, pa.string()), pa.array(prints, pa.string()), pa.array([alike(a[4], p) for (a, _), p in zip(pairs, prints, strict=True)], pa.float64()),
                    pa.array([alike(a[4], b[4]) for a, b in pairs], pa.float64())], names=schema.names)

    return ordered.mapInArrow(run, schema).withColumnRenamed("_key", key)


def _bands(n: int, bands: int, width: int) -> list[tuple[int, np.ndarray]]:
    """For a fingerprint of n samples: (octave, sampled places) of each band, by weight, within its octave and the one below."""
    out = []
    for level in {max(0, (n - FIRST) // OCTAVE), max(0, (n - FIRST) // OCTAVE - 1)}:
        m = min(n, FIRST + OCTAVE * level)
        p = _WEIGHT[:m] / _WEIGHT[:m].sum()
        draw = np.random.Generator(np.random.PCG64([22, level, m]))
        out += [(level * bands + b, draw.choice(m, width, p=p)) for b in range(bands)]
    return out


def near_pairs(df: DataFrame, key: str = "doc_id", fp: str = "fingerprint", threshold: float = 0.8,
               bands: int = 24, width: int = 6) -> DataFrame:
    """Pairs (a, b, likeness) of distinct fingerprints alike by ``threshold`` or more; a, b are the smallest keys that have them.

    Texts meet where all symbols of a band agree.  Each member of a band's group is verified against
    the group's smallest key and against its neighbour in key order, so a group of any size gives rows in
    proportion to its members.  Empty fingerprints and null keys form no pairs.
    """
    reps = df.where(F.length(fp) > 0).groupBy(F.col(fp).alias("fp")).agg(F.min(key).alias("k")).where("k is not null")
    cache: dict[int, list] = {}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band, value, keys, prints = [], [], [], []
            for f, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(f) not in cache:
                    cache[len(f)] = _bands(len(f), bands, width)
                raw = np.frombuffer(f.encode(), np.uint8)
                for b, places in cache[len(f)]:
                    band.append(b)
                    value.append(raw[places].tobytes().decode())
                    keys.append(k)
                    prints.append(f)
            yield pa.RecordBatch.from_arrays([pa.array(band, pa.int32()), pa.array(value), pa.array(keys, pa.int64()), pa.array(prints)], names=["band", "value", "k", "fp"])

    rows = reps.mapInArrow(cut, "band int, value string, k long, fp string")
    first = rows.groupBy("band", "value").agg(F.min(F.struct("k", "fp")).alias("m"), F.count("*").alias("n")).where("n > 1").select("band", "value", F.col("m.k").alias("a"), F.col("m.fp").alias("fa"))
    star = rows.join(first, ["band", "value"]).where("a < k").select("a", "fa", F.col("k").alias("b"), F.col("fp").alias("fb"))
    w = Window.partitionBy("band", "value").orderBy("k")
    chain = rows.withColumns({"a": F.lag("k").over(w), "fa": F.lag("fp").over(w)}).where("a is not null").select("a", "fa", F.col("k").alias("b"), F.col("fp").alias("fb"))
    pairs = star.unionByName(chain).dropDuplicates(["a", "b"])
    return likeness(pairs, "fa", "fb", "likeness").where(F.col("likeness") >= threshold).select("a", "b", "likeness")
