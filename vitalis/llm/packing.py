"""Operator 3: sum-of-squares online packing of token sequences into windows.

Each task packs the documents of its partition as they come.  Whole windows of a long document
are sequences of their own; the rest, of ``s`` tokens, goes to the fill level ``h`` (0: a new
window) that makes the sum over levels of N(level)^2 least, where N counts partially filled
windows and full windows count for nothing.  N is the level array; ties take the fullest level.
As cuts are free, windows are closed by the same rule: the tokens of the emptiest open window go to the
level that makes the sum least once the window there has taken what it has room for, and what is left
goes to the next level so chosen.  Each such placement closes a window or empties one, which happens
whenever more than ``MOST_OPEN`` are open, so that open windows are bounded whatever the documents'
lengths, and at the partition's end until one is left.  Only that last window, less than one for each
partition, is laid out without the rule, in sequences of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe, common

MOST_OPEN = 1024      # windows a task holds open: 8 MB of ids at 2048 tokens each

_CODECS: dict[tuple[str, str], object] = {}

FIELDS = [("start", T.LongType()), ("length", T.LongType()), ("doc_tokens", T.LongType()),
          ("sequence_id", T.LongType()), ("offset", T.LongType()), ("sequence_tokens", T.LongType()),
          ("ids", T.BinaryType())]


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins byte-level vocabularies use: printable Latin-1 stands for itself, the rest for 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class JsonCodec:
    """Ids of a byte-level BPE ``tokenizer.json``; no special tokens are put around a text.

    When merge k makes the token whose id is k places after the alphabet, merging by rank and
    merging by id order are the same thing, and the rank codec (much faster) gives the ids of
    the ``tokenizers`` library.  Any other file is encoded by that library itself.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], _byte_alphabet()
        added = spec.get("added_tokens", [])
        special = {t["content"] for t in added}
        vocab = {t: i for t, i in model["vocab"].items() if t not in special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        first = len(vocab) - len(merges)
        pre = spec.get("pre_tokenizer") or {}
        self.ranked = (model["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel"
                       and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not model.get("ignore_merges")
                       and not model.get("dropout")
                       and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")) and all(vocab.get(a + b) == first + k for k, (a, b) in enumerate(merges))
                       and sum(i < first for i in vocab.values()) == first == 256)
        if self.ranked:
            self.codec = bpe.Codec({bytes(alphabet[c] for c in t): i for t, i in vocab.items()}, pattern)
            # the leftmost added token, the longest of those that begin there
            self.added = {t["content"]: t["id"] for t in added if t["content"]}
            self.marks = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        else:
            from tokenizers import Tokenizer

            self.hf = Tokenizer.from_file(path)

    def encode(self, text: str, added: bool = False) -> np.ndarray:
        """Ids of a text; ``added`` takes the file's added tokens for tokens, as the library does, else they are spelled."""
        if not self.ranked:
            self.hf.encode_special_tokens = not added
            return np.array(self.hf.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        if not added or not (found := list(self.marks.finditer(text))):
            return self.codec.encode(text)
        out, at = [], 0
        for m in found:
            out += [self.codec.encode(text[at:m.start()]), np.array([self.added[m.group()]], dtype=np.uint32)]
            at = m.end()
        return np.concatenate([*out, self.codec.encode(text[at:])]).astype(np.uint32, copy=False)


def json_codec(path: str, pattern: str) -> JsonCodec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = JsonCodec(path, pattern)
    return _CODECS[path, pattern]


def _cut(pieces: list, size: int) -> list:
    """``size`` tokens off the end of a reversed list of pieces."""
    out = []
    while size:
        row, start, total, ids = pieces.pop()
        out.append((row, start, total, ids[:size]))
        if len(ids) > size:
            pieces.append((row, start + size, total, ids[size:]))
        size -= len(out[-1][-1])
    return out


class Packer:
    """The level array and the open windows of one partition."""

    def __init__(self, window: int, first_id: int, most_open: int = MOST_OPEN):
        self.window, self.next_id, self.most_open = window, first_id, most_open
        self.count = np.zeros(window + 1, dtype=np.int64)   # N(h); N(0) and N(window) stay 0
        self.n_open = 0
        self.open: dict[int, list[list]] = {}

    def level_for(self, size: int) -> int:
        """The level that a piece of ``size`` < window joins; 0 opens a window."""
        levels = np.flatnonzero(self.count[: self.window - size + 1])
        n, after = self.count[levels], self.count[levels + size]
        # change of the sum of squares; a window that becomes full leaves the sum
        change = 2 - 2 * n + 2 * after
        if len(levels) and levels[-1] + size == self.window:
            change[-1] = 1 - 2 * n[-1]
        best = 2 * int(self.count[size]) + 1
        if len(levels):
            i = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[i] <= best:
                return int(levels[i])
        return 0

    def level_to_close(self, size: int) -> int:
        """The level whose window takes what it has room for of ``size`` tokens that may be cut."""
        levels = np.flatnonzero(self.count)
        n, after = self.count[levels], np.minimum(levels + size, self.window)
        change = np.where(after == self.window, 1 - 2 * n, 2 - 2 * n + 2 * self.count[after])
        return int(levels[len(levels) - 1 - int(np.argmin(change[::-1]))])

    def _take(self, level: int) -> list:
        self.count[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def _keep(self, level: int, pieces: list) -> None:
        self.count[level] += 1
        self.n_open += 1
        self.open.setdefault(level, []).append(pieces)

    def place(self, piece: tuple) -> Iterator[list]:
        """Put one piece (its ids last) into a window; yields the windows that are full after it."""
        size = len(piece[-1])
        if size == self.window:
            yield [piece]
            return
        level = self.level_for(size)
        pieces = [*(self._take(level) if level else []), piece]
        if level + size == self.window:
            yield pieces
        else:
            self._keep(level + size, pieces)
        while self.n_open > self.most_open:
            yield from self.close()

    def close(self) -> Iterator[list]:
        """Deal the tokens of the emptiest window to others by the rule; yields those that become full."""
        left = int(np.flatnonzero(self.count)[0])
        pieces = self._take(left)[::-1]
        while left and self.n_open:
            level = self.level_to_close(left)
            moved = min(left, self.window - level)
            target = self._take(level) + _cut(pieces, moved)
            left -= moved
            if level + moved == self.window:
                yield target
            else:
                self._keep(level + moved, target)
        if left:
            self._keep(left, pieces[::-1])

    def rest(self) -> Iterator[list]:
        """The open windows closed until one is left, and that one in sequences of power-of-two lengths."""
        while self.n_open > 1:
            yield from self.close()
        left = int(np.flatnonzero(self.count)[0]) if self.n_open else 0
        pieces = self._take(left)[::-1] if left else []
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            yield _cut(pieces, size)


def pack(df: DataFrame, path: str, pattern: str, end_id: int = 1, window: int = 2048, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """Pieces of documents packed into sequences of at most ``window`` tokens; one row for each piece.

    Columns: ``key``, start (ids of the document before the piece), length, doc_tokens,
    sequence_id, offset (in the sequence, gapless), sequence_tokens, ids (packed little-endian
    unsigned 32-bit).  A document is the ids of its text, added tokens in it included, and then ``end_id``: a null or empty text is
    that id alone.  Repeated rows and null keys are documents like others; other columns are left out.
    A sequence holds pieces of one partition only, and its id carries the partition's number.
    """
    base = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    key_type = pa.int64() if isinstance(base.schema["_key"].dataType, T.LongType) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = json_codec(path, pattern)
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        cols: list[list] = [[] for _ in range(8)]

        def emit(pieces: list) -> None:
            offset, total = 0, sum(len(p[-1]) for p in pieces)
            for doc, start, doc_tokens, ids in pieces:
                for c, v in zip(cols, (doc, start, len(ids), doc_tokens, packer.next_id, offset, total, ids.tobytes()), strict=True):
                    c.append(v)
                offset += len(ids)
            packer.next_id += 1

        def flush() -> pa.RecordBatch:
            kinds = [key_type, *[pa.int64()] * 6, pa.binary()]
            b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["_key"] + [n for n, _ in FIELDS])
            for c in cols:
                c.clear()
            return b

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for doc, t in zip(keys, common.texts(batch, "_text"), strict=True):
                ids = np.append(coder.encode(t, True), np.uint32(end_id)).astype("<u4", copy=False)
                for at in range(0, len(ids), window):
                    piece = ids[at:at + window]
                    piece = piece if len(piece) == window else piece.copy()   # an open window must not hold the whole document
                    for full in packer.place((doc, at, len(ids), piece)):
                        emit(full)
                if len(cols[0]) >= 2000:
                    yield flush()
        for pieces in packer.rest():
            emit(pieces)
            if len(cols[0]) >= 2000:
                yield flush()
        if cols[0]:
            yield flush()

    schema = T.StructType([T.StructField("_key", base.schema["_key"].dataType)] + [T.StructField(n, k) for n, k in FIELDS])
    out = base.mapInArrow(run, schema)
    return out.withColumnRenamed("_key", key)
