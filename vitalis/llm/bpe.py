"""Operator 1: byte-level BPE encoding and decoding as a monoid tree reduction.

A text is cut in halves until a leaf is short, leaves are encoded by tiktoken, and neighbours
are joined.  A join re-encodes a window that grows around the cut until it reaches a *sync
point* on either side.  A sync point is a position whose character is a blank or line feed and
whose previous character is no white space: no match of the splitting pattern crosses it (white
space occurs only at the start of a match or in a run of its own) and no match before or after
depends on what lies beyond it.  Tokens outside the window are therefore those of the whole
text.  Without sync points the window reaches the whole text, which is then encoded as one.
Decoding concatenates up the same tree.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import common

_SYNC = re.compile(r"(?<=\S)[ \n]")
LEAF = 1 << 14
_CODECS: dict[tuple[str, str, int], "Codec"] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encoder and decoder for a rank table; ``leaf`` is the longest text encoded without a cut."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        import tiktoken

        self.enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values(), default=0) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        self.leaf = max(1, leaf)

    def encode(self, text: str) -> np.ndarray:
        return self._encode(text, 0, len(text))

    def _leaf(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        return self.enc.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)

    def _encode(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self.leaf:
            return self._leaf(text[lo:hi])
        mid = (lo + hi) // 2
        left, right = self._encode(text, lo, mid), self._encode(text, mid, hi)
        return self._join(text, lo, mid, hi, left, right)

    def _join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        a = b = None
        grow = 16
        while a is None or b is None:
            grow *= 2
            if a is None:
                # the look-behind must not see what lies before this half
                found = [m.start() for m in _SYNC.finditer(text, max(lo, mid - grow), mid)]
                found = [p for p in found if p > lo]
                a = found[-1] if found else (lo if mid - grow <= lo else None)
            if b is None:
                m = _SYNC.search(text, mid, min(hi, mid + grow))
                b = m.start() if m else (hi if mid + grow >= hi else None)
        keep = self._tokens(left[::-1], len(text[a:mid].encode()))
        drop = self._tokens(right, len(text[mid:b].encode()))
        return np.concatenate([left[: len(left) - keep], self._leaf(text[a:b]), right[drop:]])

    def _tokens(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many leading tokens of ``ids`` make up ``n_bytes``."""
        if not n_bytes:
            return 0
        n = min(len(ids), n_bytes)
        return int(np.searchsorted(np.cumsum(self.size[ids[:n]]), n_bytes)) + 1

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return self.enc.decode_bytes(ids.tolist())
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def codec(path: str, pattern: str, leaf: int = LEAF) -> Codec:
    """One codec for each worker process and vocabulary."""
    key = (path, pattern, leaf)
    if key not in _CODECS:
        _CODECS[key] = Codec(load_ranks(path), pattern, leaf)
    return _CODECS[key]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", leaf: int = LEAF, out: str = "ids") -> DataFrame:
    """Add ``out``: the token ids of ``text`` as packed little-endian unsigned 32-bit integers.

    Null and empty texts give an empty value; equal texts equal values; every length is encoded whole.
    ``path`` is a rank file that each worker can read.
    """
    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        c = codec(path, pattern, leaf)
        return [pa.array([c.encode(t).astype("<u4", copy=False).tobytes() for t in common.texts(batch, text)], pa.binary())]

    return common.add_columns(df, [T.StructField(out, T.BinaryType())], fn, text)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", leaf: int = LEAF, out: str = "decoded") -> DataFrame:
    """Add ``out``: the bytes that the packed ids stand for; null ids give an empty value."""
    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        c = codec(path, pattern, leaf)
        col = batch.column(batch.schema.get_field_index(ids))
        return [pa.array([c.decode(np.frombuffer(x or b"", "<u4")) for x in col.to_pylist()], pa.binary())]

    return common.add_columns(df, [T.StructField(out, T.BinaryType())], fn)
