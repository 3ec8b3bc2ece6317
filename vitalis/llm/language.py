"""Operator 9: language identification by prediction by partial matching.

For each language a byte context tree of order 2 holds how often a byte followed each context.  Under
these frozen counts a byte s after context c costs -log2 of
    n(c, s) / (n(c) + d(c))                         if s was seen after c (d: distinct bytes seen there)
    d(c) / (n(c) + d(c)) * P(s | shorter context)   otherwise (the escape)
down to the uniform distribution below order 0; a context never seen costs nothing to leave.  The
cost depends on the last bytes only, so the tree is laid out as one table of code lengths and a
text's exact code length is a sum of look-ups.  The shortest code wins.

Bytes are folded first: A-Z to a-z, white space to blank, digits to one symbol, other ASCII to one;
bytes of other characters stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

ENTRIES = 2_000_000  # counts that a task holds before it merges them or sends them on
SIZE = 157           # symbols after folding
EVIDENCE = 40.0      # bytes' worth of evidence that a score counts at most
_LETTER = regex.compile(r"\p{L}")


def _folding() -> bytes:
    fold = np.full(256, 28, dtype=np.uint8)                      # other ASCII
    fold[[9, 10, 11, 12, 13, 32]] = 0
    fold[48:58] = 27
    fold[97:123] = fold[65:91] = np.arange(1, 27)
    fold[128:] = np.arange(29, SIZE)
    return fold.tobytes()


_FOLD = _folding()


def _flat(docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all texts, two blanks before each, and where each text's own bytes begin and end."""
    raw = [t.encode().translate(_FOLD) for t in docs]
    flat = np.frombuffer(b"".join(b"\0\0" + r for r in raw), np.uint8)
    ends = np.cumsum([len(r) + 2 for r in raw])
    return flat, np.stack([np.concatenate([[0], ends[:-1]]) + 2, ends], axis=1)


def _codes(flat: np.ndarray, size: int) -> np.ndarray:
    """For each byte from the third on, the number of its context and itself."""
    x = flat.astype(np.int32)
    return (x[:-2] * size + x[1:-1]) * size + x[2:]


def learn(df: DataFrame, lang: str = "lang", text: str = "text") -> dict:
    """Code-length tables of all languages; rows with a null text or language teach nothing.

    Every row with both teaches, so a language is known however rare it is; equal texts count as often as they
    occur.  At most SIZE**3 counts for each language reach the driver.
    """
    known = df.select(F.col(lang).cast("string").alias("l"), F.col(text).alias("t")).where("l is not null and t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}      # per language: distinct codes and their counts

        def merge() -> int:
            for name, parts in held.items():
                if len(parts) > 1:
                    code, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                    parts[:] = [(code, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64))]
            return sum(len(parts[0][0]) for parts in held.values())

        def out() -> Iterator[pa.RecordBatch]:
            for name, [(code, n)] in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(code), pa.string()), pa.array(code.astype(np.int32)), pa.array(n)], names=["l", "code", "n"])
            held.clear()

        room = 0
        for b in batches:
            for part_ in common.slices(b, "t"):
                langs, docs = part_.column(0).to_pylist(), part_.column(1).to_pylist()
                of: dict[str, list[str]] = {}
                for name, d in zip(langs, docs, strict=True):
                    of.setdefault(name, []).append(d)
                for name, own in of.items():
                    flat, at = _flat(own)
                    inside = np.ones(len(flat) - 2, dtype=bool)
                    starts = at[1:, 0] - 2
                    inside[starts - 1] = inside[starts - 2] = False       # the blanks before the next text
                    codes = _codes(flat, SIZE)[inside]
                    if len(codes) > SIZE ** 3 // 16:
                        c = np.bincount(codes, minlength=SIZE ** 3)
                        code, n = np.flatnonzero(c), c[c > 0]
                    else:
                        code, n = np.unique(codes, return_counts=True)
                    held.setdefault(name, []).append((code.astype(np.int32), n.astype(np.int64)))
                    room += len(code)
                    if room > ENTRIES:
                        room = merge()
                        if room > ENTRIES // 2:
                            yield from out()
                            room = 0
        merge()
        yield from out()

    counts = known.mapInArrow(run, "l string, code int, n long").groupBy("l", "code").agg(F.sum("n").alias("n")).toPandas()
    if counts.empty:
        return {"langs": [], "symbols": np.zeros(SIZE, np.uint8), "size": 1, "bits": []}
    code = counts["code"].to_numpy()
    used = np.unique(np.concatenate([code // SIZE ** 2, code // SIZE % SIZE, code % SIZE, [0]]))
    symbols = np.full(SIZE, len(used), dtype=np.uint8)                    # unseen symbols share one
    symbols[used] = np.arange(len(used))
    size = len(used) + 1
    langs, bits = sorted(counts["l"].unique()), []
    for name in langs:
        own = counts[counts["l"] == name]
        c, n = own["code"].to_numpy(), own["n"].to_numpy().astype(np.float64)
        tree = np.zeros((size, size, size))
        tree[symbols[c // SIZE ** 2], symbols[c // SIZE % SIZE], symbols[c % SIZE]] = n
        p = np.full(size, 1.0 / size)
        for level in (tree.sum(axis=(0, 1)), tree.sum(axis=0), tree):     # orders 0, 1, 2
            total, kinds = level.sum(axis=-1, keepdims=True), (level > 0).sum(axis=-1, keepdims=True)
            room = np.maximum(total + kinds, 1)
            p = np.where(level > 0, level / room, np.where(total > 0, kinds / room, 1.0) * p)
        bits.append(-np.log2(p).astype(np.float32).ravel())
    return {"langs": langs, "symbols": symbols, "size": size, "bits": bits}


def code_lengths(docs: list[str], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each text under each language, and the texts' bytes."""
    flat, at = _flat(docs)
    codes = _codes(model["symbols"][flat], model["size"])
    n = at[:, 1] - at[:, 0]
    out = np.zeros((len(docs), len(model["langs"])))
    some = n > 0
    cuts = np.stack([at[some, 0] - 2, at[some, 1] - 2], axis=1).ravel()
    for k, table in enumerate(model["bits"]):
        if len(cuts):
            cost = np.append(table[codes], np.float32(0)).astype(np.float64)
            out[some, k] = np.add.reduceat(cost, cuts)[::2]
    return out, n


def identify(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """Add lang_pred and score (0 to 1).

    ``und`` with score 0 for a null text, a text without a letter, or when no language was learned.
    The score is the winner's share of 2**-bits, with bits scaled to at most EVIDENCE bytes; ties take the first
    language in order.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)     # at most SIZE**3 floats for each language

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        m = shared.value
        docs = common.texts(batch, text)
        if not m["langs"]:
            return [pa.array(["und"] * len(docs), pa.string()), pa.array([0.0] * len(docs), pa.float64())]
        bits, n = code_lengths(docs, m)
        best = bits.argmin(axis=1).tolist()
        gap = (bits - bits.min(axis=1, keepdims=True)) * (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
        share = 1.0 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)
        letters = np.array([_LETTER.search(t) is not None for t in docs])
        names = [m["langs"][b] if x else "und" for b, x in zip(best, letters.tolist(), strict=True)]
        return [pa.array(names, pa.string()), pa.array(np.where(letters, share, 0.0), pa.float64())]

    return common.add_columns(df, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], fn, text)
