"""Operator 12: best-fit packing by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits one window.  The program asks for the fewest configurations that
cover the histogram.  It is solved by multiplicative weights: each length class has a price, its size times a weight
that falls exponentially with the share of its demand already covered; a knapsack dynamic program over the window
finds the configuration of the highest total price, which is taken as often as the scarcest class in it allows, times
a step.  Classes are lengths rounded up to units of ``window / GRAIN``, so one knapsack is GRAIN short vector steps.

The fractional solution is rounded: each configuration is taken floor(x) times, then once more in order of what the
floor cut off, while its pieces last.  Its slots get pieces of true lengths; what the classes' rounding leaves free,
and the few pieces that no configuration took, are matched best-fit, the longest piece first, as are the pieces below
``window / SMALL``, which stay out of the program (the usual treatment of small items).

The program sees only the histogram, so its size depends on the window and not on the documents: bundles of equal
sequences stand for all their copies.  A piece finds its place from its length and its rank among the pieces of that
length; ranks come from counts by (task, length), so that no task sees all pieces of a common length.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, packing

GRAIN = 512         # units of the window that the knapsack counts in
SMALL = 16          # pieces up to window / SMALL fill gaps and stay out of the program
STEP = 0.25         # share of the scarcest class's demand that one step may cover
RATE = 2.0          # a class wholly covered has its weight divided by e**RATE
ROUNDS = 4000       # steps at most; demand not covered by then is placed best-fit

SPACE, LETTER, DIGIT, SIGN = range(4)
BLANKS = b" \t\n\r\x0b\x0c"
KIND = np.array([SPACE if c in BLANKS else LETTER if c >= 0x80 or chr(c).isalpha() else DIGIT if chr(c).isdigit() else SIGN for c in range(256)],
                dtype=np.uint8)

_CODECS: dict[str, "WordCodec"] = {}


class WordCodec:
    """Ids of a ``tokenizer.json`` without special tokens around a text.

    Where white space ends every token and is dropped, and the normaliser looks at single characters and their
    marks only, a text's ids are those of its blank-free runs one after the other, and each distinct run of a batch
    of texts is encoded once.  Runs of common letters, digits and ASCII signs are lower-cased and split here, all at
    once in numpy, one blank is put after every word, and a rank codec merges the bytes of a word and its blank,
    which stands for the word's end: when merge k makes the token k places after both alphabets, merging by id is
    merging by rank; merged words are remembered.  All other runs go to the ``tokenizers`` library; any file that is
    not of this kind is encoded whole by it.
    """

    MOST = 400_000                  # words remembered
    PIECE = 1_000                   # longer words go to the library: the rank codec is quadratic in them
    # fixed value: the splitting pattern for which the short way is known to hold
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    # bytes of ASCII signs and of letters U+00C0 to U+01FF, whose lower case and composed form no version of Unicode
    # changes; of these the two signs that are no letters and the dotted capital I are left to the library
    PLAIN = bytes([*range(0x21, 0x7f), *range(0x80, 0xc0), *range(0xc3, 0xc8)])
    ODD = tuple(c.encode() for c in "\u00d7\u00f7\u0130")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.hf = Tokenizer.from_file(path)
        self.marks = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.by_run = self._parts_at_space(spec)
        self.ranked = self._ranks(spec["model"]) if self.by_run else None
        self.known: dict[bytes, bytes] = {}

    @classmethod
    def _parts_at_space(cls, spec: dict) -> bool:
        """Whether tokens end at white space whatever stands beyond it."""
        norm, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
        kinds = [n.get("type") for n in norm.get("normalizers", [])]
        first, *rest = pre.get("pretokenizers", [pre])
        added = spec.get("added_tokens", [])
        return (kinds == ["NFC", "Replace", "Lowercase"] and norm["normalizers"][1].get("pattern") == {"Regex": r"\s+"}
                and norm["normalizers"][1].get("content") == " "
                and first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
                and first["pattern"].get("Regex") == cls.SPLIT
                and [(r.get("type"), r.get("add_prefix_space"), r.get("use_regex")) for r in rest] == [("ByteLevel", False, False)]
                and not (spec["model"].get("dropout") or spec.get("truncation") or spec.get("padding"))
                and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
                and not any(c.isspace() for t in added for c in t["content"]))

    @staticmethod
    def _ranks(model: dict):
        """The rank codec, or None where ids do not follow the merges or a token holds a blank."""
        import tiktoken

        suffix, alphabet, vocab = model.get("end_of_word_suffix"), packing._byte_alphabet(), model["vocab"]
        if not suffix or model.get("ignore_merges") or model.get("unk_token") or any(c not in vocab or c + suffix not in vocab for c in alphabet):
            return None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        low = max(vocab[c + e] for c in alphabet for e in ("", suffix)) + 1
        made = [a + b for a, b in merges]
        blank = next(c for c, v in alphabet.items() if v == 0x20)
        if any(vocab.get(m) != low + k or blank in m for k, m in enumerate(made)):
            return None
        ranks = {}
        for name in [*alphabet, *(c + suffix for c in alphabet), *made]:
            word, end = (name[: -len(suffix)], b" ") if name.endswith(suffix) else (name, b"")
            ranks[bytes(alphabet[c] for c in word) + end] = vocab[name]
        return tiktoken.Encoding("words", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={})._core_bpe

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.hf.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _odd(self, data: bytes) -> bool:
        """Whether bytes hold anything that the short way leaves to the library."""
        times, over, dotted = self.ODD
        return bool(data.translate(None, self.PLAIN + b" ")) or times in data or over in data or dotted in data or any(m in data for m in self.marks)

    @staticmethod
    def _words(runs: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """The lower-cased words of runs, and how many each run has."""
        b = np.frombuffer((b" ".join(runs) + b"  ").decode().lower().encode(), np.uint8)
        kind = KIND[b]
        end = (kind != SPACE) & ((kind != np.append(kind[1:], np.uint8(SPACE))) | (kind == DIGIT))
        for i in np.flatnonzero(b == 0x27).tolist():       # an apostrophe that begins a word may take letters along
            if i and kind[i - 1] == SIGN:
                continue
            two = bytes(b[i + 1:i + 3])
            n = 2 if two[:1] in (b"s", b"t", b"m", b"d") else 3 if two in (b"re", b"ve", b"ll") else 0
            if n:
                end[i] = False
                end[i + n - 1] = True
        times = (kind != SPACE).astype(np.int8) + end
        out = np.repeat(b, times)
        out[np.cumsum(times, dtype=np.int64)[end] - 1] = 0x20
        return out.tobytes().split(), np.bincount(np.cumsum(kind == SPACE)[end], minlength=len(runs))

    def _merged(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word."""
        out = list(map(self.known.get, words))
        for i, ids in enumerate(out):
            if ids is None:
                word = words[i]
                out[i] = self.known.get(word) or array("I", self.ranked.encode_single_piece(word + b" ")).tobytes()
                if len(self.known) >= self.MOST:
                    self.known.clear()
                self.known[word] = out[i]
        return out

    def _runs(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs one after the other, and where each begins (one entry more than runs)."""
        size, parts = np.zeros(len(runs), dtype=np.int64), {}
        length = np.fromiter(map(len, runs), np.int64, len(runs))
        short = (length > 0) & (length <= self.PIECE) & (self.ranked is not None)
        if self._odd(b" ".join(runs)):
            short &= ~np.fromiter(map(self._odd, runs), bool, len(runs))
        for i in np.flatnonzero(~short & (length > 0)).tolist():
            parts[i] = self._library(runs[i].decode())
            size[i] = len(parts[i])
        ids = np.empty(0, np.uint32)
        if short.any():
            words, many = self._words([r for r, plain in zip(runs, short.tolist(), strict=True) if plain])
            packed = self._merged(words)
            ids = np.frombuffer(b"".join(packed), np.uint32)
            stop = np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) // 4)[np.cumsum(many) - 1]
            size[short] = np.diff(stop, prepend=0)
        first = np.concatenate([[0], np.cumsum(size)])
        flat = np.empty(first[-1], dtype=np.uint32)
        rest = np.ones(len(flat), dtype=bool)
        for i, p in parts.items():
            flat[first[i]:first[i + 1]] = p
            rest[first[i]:first[i + 1]] = False
        flat[rest] = ids
        return flat, first

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a string array; null counts as empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_run:
            return [self._library(t) for t in texts.to_pylist()]
        parts = pc.ascii_split_whitespace(texts)
        distinct = parts.flatten().dictionary_encode()
        which = distinct.indices.to_numpy()
        flat, first = self._runs(distinct.dictionary.cast(pa.binary()).to_pylist())
        size = np.diff(first)[which]
        done = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.repeat(first[which] - done[:-1], size) + np.arange(done[-1])]
        at = done[parts.offsets.to_numpy() - parts.offsets[0].as_py()]
        return [ids[lo:hi] for lo, hi in zip(at[:-1], at[1:], strict=True)]


def codec(path: str) -> WordCodec:
    """One codec for each worker process and file."""
    if path not in _CODECS:
        _CODECS[path] = WordCodec(path)
    return _CODECS[path]


def knapsack(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, dict[int, int]]:
    """The most valuable multiset of items within ``room``: its value and {item: count}.

    ``sizes`` are ascending integers from 1; each item may be taken any number of times.
    """
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for w in range(1, room + 1):
        best[w], took[w] = best[w - 1], -1
        if n := fits[w]:
            value = best[w - sizes[:n]] + prices[:n]
            i = int(value.argmax())
            if value[i] > best[w]:
                best[w], took[w] = value[i], i
    counts, w = {}, room
    while w > 0:
        i = int(took[w])
        if i < 0:
            w -= 1
        else:
            counts[i] = counts.get(i, 0) + 1
            w -= int(sizes[i])
    return float(best[room]), counts


def solve(sizes: np.ndarray, demand: np.ndarray, room: int, step: float = STEP, rate: float = RATE, rounds: int = ROUNDS) -> dict[tuple, float]:
    """A fractional cover of ``demand``: {((item, count), ...): times}, by multiplicative weights."""
    demand = demand.astype(float)
    covered = np.zeros(len(sizes))
    cover: dict[tuple, float] = {}
    for _ in range(rounds):
        left = np.flatnonzero(covered < demand * (1 - 1e-9))
        if not len(left):
            break
        weight = np.exp(-rate * covered[left] / demand[left])
        _, counts = knapsack(sizes[left], sizes[left] * weight, room)
        items = left[list(counts)]
        many = np.array(list(counts.values()), dtype=float)
        times = min(max(step * float((demand[items] / many).min()), 1.0), float(((demand[items] - covered[items]) / many).max()))
        covered[items] += times * many
        config = tuple(sorted(zip(items.tolist(), counts.values(), strict=True)))
        cover[config] = cover.get(config, 0.0) + times
    return cover


def rounded(cover: dict[tuple, float], demand: np.ndarray) -> list[tuple[tuple, int]]:
    """Whole numbers of configurations that take no more than ``demand``: floors first, then one more while pieces last."""
    left = demand.astype(np.int64).copy()
    taken: dict[tuple, int] = {}

    def take(config: tuple, times: int) -> None:
        times = min(times, *(int(left[i]) // n for i, n in config))
        if times > 0:
            for i, n in config:
                left[i] -= n * times
            taken[config] = taken.get(config, 0) + times

    for config, x in cover.items():
        take(config, int(x))
    for config, x in sorted(cover.items(), key=lambda c: (int(c[1]) - c[1], c[0])):
        take(config, 1)
    return list(taken.items())


class Bundles:
    """Sequences that hold the same lengths: [((length, count), ...), copies], by free space."""

    def __init__(self, window: int):
        self.window = window
        self.by_free: dict[int, list[tuple[tuple, int]]] = {}
        self.free: list[int] = []

    def add(self, content: tuple, copies: int) -> None:
        room = self.window - sum(n * c for n, c in content)
        if room not in self.by_free:
            self.by_free[room] = []
            insort(self.free, room)
        self.by_free[room].append((content, copies))

    def best_fit(self, length: int, count: int) -> None:
        """Put ``count`` pieces of one length where they leave least room; open sequences for the rest."""
        while count:
            at = bisect_left(self.free, length)
            if at == len(self.free):
                each = self.window // length
                if count >= each:
                    self.add(((length, each),), count // each)
                if count % each:
                    self.add(((length, count % each),), 1)
                return
            room = self.free[at]
            content, copies = self.by_free[room].pop()
            if not self.by_free[room]:
                del self.by_free[room], self.free[at]
            used = min(copies, count)
            if used < copies:
                self.add(content, copies - used)
            self.add((*content, (length, 1)), used)
            count -= used

    def all(self) -> Iterator[tuple[tuple, int]]:
        for room in self.free:
            yield from self.by_free[room]


def plan(histogram: np.ndarray, window: int) -> tuple[list[tuple[tuple, int]], int]:
    """Bundles ((length, count), ...), copies that hold every piece of ``histogram`` (pieces by length, window + 1
    entries), and how many pieces the rounded program placed.  Pieces of the whole window are bundles of their own."""
    left = histogram.astype(np.int64).copy()
    bundles = Bundles(window)
    unit = max(1, window // GRAIN)
    room = window // unit
    large = np.flatnonzero(left[:window])
    large = large[large > window // SMALL]
    large = large[-(-large // unit) <= room]
    placed = 0
    if len(large):
        sizes, which = np.unique(-(-large // unit), return_inverse=True)
        demand = np.bincount(which, left[large]).astype(np.int64)
        remaining = large.tolist()                                          # ascending lengths with pieces left
        stacks: list[list[int]] = [[] for _ in sizes]
        for n, c in zip(remaining, which.tolist(), strict=True):
            stacks[c].append(n)
        for config, times in rounded(solve(sizes, demand, room), demand):
            while times and (content := _content(config, stacks, remaining, left, window)):
                copies = min(times, *(int(left[n]) // got for n, got in content.items()))
                for n, got in content.items():
                    left[n] -= got * copies
                    placed += got * copies
                    if not left[n]:
                        remaining.pop(bisect_left(remaining, n))
                bundles.add(tuple(content.items()), copies)
                times -= copies
    for n in np.flatnonzero(left)[::-1].tolist():
        bundles.best_fit(n, int(left[n]))
    return list(bundles.all()), placed


def _content(config: tuple, stacks: list[list[int]], remaining: list[int], left: np.ndarray, window: int) -> dict[int, int]:
    """True lengths for a configuration: the longest of each class, and for the last place of its smallest class the
    longest piece of all that fits what is then free, so that rounding to classes costs no room.  Empty if a class
    has too few pieces left."""
    content: dict[int, int] = {}
    (smallest, many), *others = config
    for c, need in [*others, (smallest, many - 1)]:
        while stacks[c] and not left[stacks[c][-1]]:
            stacks[c].pop()
        for n in reversed(stacks[c]):
            if need and (got := min(need, int(left[n]))):
                content[n] = got
                need -= got
        if need:
            return {}
    room = window - sum(n * got for n, got in content.items())
    at = bisect_right(remaining, room) - 1
    while at >= 0 and left[remaining[at]] <= content.get(remaining[at], 0):
        at -= 1
    if at >= 0:
        content[remaining[at]] = content.get(remaining[at], 0) + 1
    return content


class Places:
    """Where the r-th piece of a length goes: a bounded table of rank runs."""

    def __init__(self, bundles: list[tuple[tuple, int]], window: int):
        seen = np.zeros(window + 1, dtype=np.int64)
        runs, base = [], 0
        for content, copies in bundles:
            offset = 0
            for length, count in content:
                runs.append((length, int(seen[length]), count, base, offset))
                seen[length] += count * copies
                offset += length * count
            base += copies
        runs.sort()
        self.length, self.rank, self.count, self.base, self.offset = (np.array(c, dtype=np.int64) for c in zip(*runs, strict=True))
        self.first = np.searchsorted(self.length, np.arange(window + 2))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces; both arguments are int64 arrays."""
        order = np.lexsort((rank, length))
        run = np.empty(len(length), dtype=np.int64)
        for n, lo, hi in zip(*self._groups(length[order]), strict=True):
            a, b = self.first[n], self.first[n + 1]
            run[order[lo:hi]] = a + np.searchsorted(self.rank[a:b], rank[order[lo:hi]], side="right") - 1
        q = rank - self.rank[run]
        return self.base[run] + q // self.count[run], self.offset[run] + q % self.count[run] * length

    @staticmethod
    def _groups(ordered: np.ndarray) -> tuple[list[int], list[int], list[int]]:
        starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.empty(0, np.int64)
        return ordered[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(ordered)] if len(ordered) else []


def pack(df: DataFrame, path: str, end_id: int = 1, window: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents in as few sequences of at most ``window`` tokens as the program finds; one row for each.

    Columns: ``key``, piece (from 0), start (ids of the document before it), length, sequence_id, offset (in the
    sequence, gapless), ids (packed little-endian unsigned 32-bit).  A document is the ids of its text and then
    ``end_id``: a null or empty text is that id alone.  Only documents of more than ``window`` ids are cut, into
    whole windows and a rest.  Repeated rows and null keys are documents like others, other columns are left out, an
    empty table gives an empty result.  ``path`` is a file that each worker can read.
    """
    spark = df.sparkSession
    scratch = common.Scratch(spark)
    base = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    key_field = base.schema["_key"]
    fields = [T.StructField(n, T.LongType()) for n in ("piece", "start", "length", "_nth")]
    schema = T.StructType([key_field, *fields, T.StructField("_part", T.IntegerType()), T.StructField("ids", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = codec(path), TaskContext.get().partitionId()
        end, seen = np.uint32(end_id).astype("<u4").tobytes(), [0] * (window + 1)
        for whole in batches:
            for b in common.slices(whole, "_text"):
                rows, piece, nth, ids = [], [], [], []
                for i, found in enumerate(coder.encode(b.column(1))):
                    packed = found.astype("<u4", copy=False).tobytes() + end
                    for p, at in enumerate(range(0, len(packed), 4 * window)):
                        bit = packed[at:at + 4 * window]
                        rows.append(i)
                        piece.append(p)
                        ids.append(bit)
                        nth.append(seen[len(bit) // 4])
                        seen[len(bit) // 4] += 1
                number = np.array(piece, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows, pa.int64())), pa.array(number), pa.array(number * window), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array(nth, pa.int64()), pa.array([part] * len(ids), pa.int32()), pa.array(ids, pa.binary())], names=schema.names)

    pieces = scratch.keep(base.mapInArrow(cut, schema))
    counts = scratch.keep(pieces.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("n")))
    histogram = np.zeros(window + 1, dtype=np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():         # window rows at most
        histogram[r["length"]] = r["n"]
    if not histogram.any():
        return pieces.select(F.col("_key").alias(key), "piece", "start", "length", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "ids")
    bundles, _ = plan(histogram, window)
    places = spark.sparkContext.broadcast(Places(bundles, window))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = places.value.find(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    # tasks of one length: as many rows as the table has parts
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    ranked = pieces.join(offsets, ["_part", "length"]).withColumn("_at", place("length", F.col("_before") + F.col("_nth")))
    return ranked.select(F.col("_key").alias(key), "piece", "start", "length", "_at.sequence_id", "_at.offset", "ids")
