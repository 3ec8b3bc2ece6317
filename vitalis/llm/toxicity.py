"""Operator 4: toxicity by noisy-channel deobfuscation.

A word that may be disguised (look-alike digits or signs before a letter or a letter three times in a
row; in words that the character model was not trained on, any such sign, a separator between letters or
a letter twice; a word without a letter is a number) spans a lattice: each sign may stand for the
letters it resembles, a run of one letter for one or two of it, a separator for nothing or a word's end.
Letters and signs that stand alone, three or more with any separators between them, are a run in which
a word may end anywhere.  Viterbi
decoding under a character language model of order 4 picks the likeliest restored words.  Words whose
lattice spells no evidence on any path are not decoded, which changes no result.

Restored words are scored by evidence learned from labelled documents: a word has the lower
confidence bound (Wilson, z = ``Z``) of the share of toxic documents among those it occurs in; so have
the first 4, 5 or 6 letters that at least ``KINDS`` toxic words share (a stem with endings).  A document's
strongest evidence is then calibrated: among many words some look toxic by chance, so a quarter of the
labelled rows teaches no evidence but what share of documents is toxic for evidence of each strength
(isotonic, smoothed by the overall share).
Every labelled row teaches, and every row is scored whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

Z = 2.0                # standard deviations below the observed share
KINDS = 4              # distinct words of toxic documents that a stem needs
LEAST = 5              # toxic documents that evidence must occur in
THRESHOLD = 0.3
SPELLED = 2_400        # the character model's words occur in one of so many documents that teach evidence, and in 10
WORDS_KEPT = 400_000   # words whose evidence a worker remembers before it starts anew

# Letters that signs are used for.
LOOKALIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
             "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou"}
_SIGNS = re.escape("".join(LOOKALIKE))
_DISGUISED = re.compile(rf"[{_SIGNS}]+[^\W\d_]|([^\W\d_])\1\1")
_DOUBTFUL = re.compile(rf"[{_SIGNS}]|[^\W\d_](?:[^\w{_SIGNS}]|_)+[^\W\d_]|([^\W\d_])\1")
_SEPARATOR = re.compile(rf"[^\w{_SIGNS}]|_")
_LETTER = re.compile(r"[^\W\d_]")
_MARKS = re.compile(r"^[^\w@$€£|+*]+|[^\w@$€£|+*]+$")     # punctuation around a word, without signs that are no punctuation
# three or more letters or look-alike signs, each alone between separators of any kind and number ('*' is a separator too);
# a letter and a separator share no character, so that nothing is tried twice
_GAP = rf"[^\w{re.escape(''.join(c for c in LOOKALIKE if c != '*'))}]|_"
_ALONE = rf"(?!{_GAP}).(?![^\W_])"
_SPACED = re.compile(rf"(?<!{_GAP})((?:{_GAP})++\(?){_ALONE}(?:(?:{_GAP})++{_ALONE}){{2,}}+")
_CLAUSE = re.compile(r"([.,;:?]+\s+)")
_RUN = re.compile(r"(.)\1*", re.S)
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")

LM = dict[str, dict[str, float]]


def train_lm(words: dict[str, int], order: int = 4) -> LM:
    """log P(next character | up to order-1 characters) for all contexts seen; '^' starts, '$' ends a word.

    Witten-Bell smoothing: a context's unseen share goes to the context one character shorter.
    """
    counts: dict[str, Counter] = {}
    for w, n in words.items():
        s = "^" + w + "$"
        for i in range(1, len(s)):
            for k in range(order):
                if k <= i:
                    counts.setdefault(s[i - k:i], Counter())[s[i]] += n
    prob: dict[str, dict[str, float]] = {}
    for c in sorted(counts, key=len):
        total, kinds = sum(counts[c].values()), len(counts[c])
        base = prob.get(c[1:], {}) if c else {}
        prob[c] = {x: (n + kinds * base.get(x, 1e-4)) / (total + kinds) for x, n in counts[c].items()}
        prob[c][""] = kinds / (total + kinds)     # the share that goes to shorter contexts
    return {c: {x: math.log(p) for x, p in d.items()} for c, d in prob.items()}


def _logp(lm: LM, context: str, x: str) -> float:
    out = 0.0
    while True:
        d = lm.get(context)
        if d is not None:
            if x in d:
                return out + d[x]
            out += d[""]
        if not context:
            return out - 9.0
        context = context[1:]


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """Per run of equal characters: what it may stand for, with its log channel probability."""
    out = []
    for m in _RUN.finditer(word):
        c, n = m.group(1), m.end() - m.start()
        if c.isalpha():
            out.append([(c, 0.0)] if n == 1 else [(c, -0.7 if n == 2 else 0.0), (c * 2, 0.0 if n == 2 else -0.7)])
        elif c in LOOKALIKE:
            ways = [(x * k, -0.7 - math.log(len(LOOKALIKE[c])) - 0.7 * (k > 1)) for x in LOOKALIKE[c] for k in range(1, min(n, 2) + 1)]
            out.append([*ways, ("", -4.0)])
        else:
            out.append([("", 0.0)])
    return out


def decode(word: str, lm: LM, order: int = 4) -> str:
    """The likeliest word behind a disguised one: Viterbi over (last order-1 characters)."""
    best: dict[str, tuple[float, str]] = {"^": (0.0, "")}
    for ways in lattice(word):
        step: dict[str, tuple[float, str]] = {}
        for context, (score, so_far) in best.items():
            for s, cost in ways:
                c, v = context, score + cost
                for x in s:
                    v += _logp(lm, c, x)
                    c = (c + x)[-(order - 1):]
                if c not in step or v > step[c][0]:
                    step[c] = (v, so_far + s)
        best = step
    return max(((v + _logp(lm, c, "$"), s) for c, (v, s) in best.items()), default=(0.0, ""))[1]


def disguised(word: str, known: Container[str] = ()) -> bool:
    """Whether a word is to be decoded; words in ``known`` only for a sign before a letter or a letter three times."""
    if _DISGUISED.search(word):
        return True
    return _DOUBTFUL.search(word) is not None and _LETTER.search(word) is not None and _MARKS.sub("", word) not in known


def steps(word: str, spaced: bool) -> Iterator[tuple[list[tuple[str, float]], bool]]:
    """Lattice steps, and whether a word may end before each: at separators, or anywhere if ``spaced``."""
    if not spaced:
        for m in _RUN.finditer(word):
            ways = lattice(m.group())[0]
            yield ways, ways == [("", 0.0)]
        return
    for i, c in enumerate(word):
        again = [("", -0.7)] if i and c == word[i - 1] and c.isalpha() else []     # two words may share the run
        yield [*lattice(c)[0], *again], i > 0


def segment(word: str, lm: LM, spaced: bool = False, order: int = 4) -> list[str]:
    """The likeliest words behind a disguised one: decode() that may also end a word where steps() allows it."""
    best: dict[str, tuple[float, tuple]] = {"^": (0.0, ())}     # what is said so far is a chain of (before, piece)
    for ways, may_end in steps(word, spaced):
        if may_end and (ends := [(v + _logp(lm, c, "$"), (said, " ")) for c, (v, said) in best.items() if c != "^"]):
            v, said = max(ends, key=lambda x: x[0])
            if "^" not in best or v > best["^"][0]:
                best["^"] = (v, said)
        step: dict[str, tuple[float, tuple]] = {}
        for context, (score, said) in best.items():
            for s, cost in ways:
                c, v = context, score + cost
                for x in s:
                    v += _logp(lm, c, x)
                    c = (c + x)[-(order - 1):]
                if c not in step or v > step[c][0]:
                    step[c] = (v, (said, s) if s else said)
        best = step
    said = max(((v + _logp(lm, c, "$") * (c != "^"), said) for c, (v, said) in best.items()), key=lambda x: x[0])[1]
    out = []
    while said:
        said, s = said
        out.append(s)
    return "".join(reversed(out)).split()


def bare(word: str) -> str:
    return _EDGE.sub("", word)


def spaced_words(text: str) -> list[str]:
    """Words written letter by letter ('i d i o t', 'i / d / ! / o / t'), letters and signs joined."""
    return [_joined(m.group()) for m in _SPACED.finditer(" " + text)]


def _joined(run: str) -> str:
    return "".join(x for x in run if x.isalnum() or x in LOOKALIKE)


def restored(word: str, lm: LM, known: Container[str] = ()) -> str:
    """A lower-case word without edge signs, deobfuscated if it may be disguised."""
    return " ".join(segment(word, lm)) if disguised(word, known) else bare(word)


def _closed(gap: str, run: str, lm: LM) -> str:
    """The words behind a run of lone letters; punctuation stays where three or more letters lie on both sides."""
    parts = _CLAUSE.split("*" * gap.count("*") + run)
    if any(len(_joined(x)) < 3 for x in parts[::2]):
        parts = ["".join(parts)]
    return gap.replace("*", "") + "".join(x if i % 2 else " ".join(segment(_joined(x), lm, True)) for i, x in enumerate(parts))


def restore(text: str, lm: LM, known: Container[str] = ()) -> str:
    """The whole text in lower case with disguised words restored."""
    low = _SPACED.sub(lambda m: _closed(m.group(1), m.group()[m.end(1) - m.start():], lm), " " + text.lower())[1:]
    return re.sub(r"\S+", lambda m: restored(m.group(), lm, known) if disguised(m.group(), known) else m.group(), low)


def features(word: str) -> list[str]:
    return [word, *[word[:k] + "~" for k in (4, 5, 6) if len(word) > k]] if word else []


def _words(text: str) -> set[str]:
    """Words in lower case; those written letter by letter begin with a blank."""
    low = text.lower()
    return {*low.split(), *[" " + w for w in spaced_words(low)]}


class Evidence(dict):
    """word -> (share, restored word), computed once for each word a worker meets."""

    def __init__(self, shares: dict[str, float], lm: LM, known: Container[str] = ()):
        super().__init__()
        self.shares, self.lm, self.known = shares, lm, known
        self.stems = {f[:-1] for f in shares if f.endswith("~")}
        self.begun = {f[:k] for f in (*shares, *self.stems) for k in range(len(f) + 1)}

    def reachable(self, word: str, spaced: bool = False) -> bool:
        """Whether any path through a word's lattice spells a feature with evidence."""
        at, whole = {""}, not spaced and _SEPARATOR.search(word) is None
        for ways, may_end in steps(word, spaced):
            if may_end:
                if any(s in self.shares for s in at):
                    return True
                at.add("")
            at = {y for s in at for x, _ in ways if (y := s + x) in self.begun}
            if not at.isdisjoint(self.stems):
                return True
            if not at and whole:
                return False
        return any(s in self.shares for s in at)

    def decoded(self, word: str) -> list[str]:
        """Words behind one that may be disguised, none if no evidence can come of it."""
        if word[0] == " ":
            run = word[1:]
            if not self.reachable(run, True):
                return []
            # a one-letter word before the run is no part of it, whatever the model says
            return [decode(run, self.lm), *segment(run, self.lm, True), decode(run[1:], self.lm), *segment(run[1:], self.lm, True)]
        if disguised(word, self.known) and self.reachable(word):
            return [decode(word, self.lm), *segment(word, self.lm)]
        return []

    def __missing__(self, word: str) -> tuple[float, str]:
        if len(self) > WORDS_KEPT:
            self.clear()
        get, plain = self.shares.get, bare(word)
        best = max((get(f, 0.0) for f in features(plain)), default=0.0)
        out = (best, plain if best else "")
        for w in self.decoded(word):
            again = max((get(f, 0.0) for f in features(w)), default=0.0)
            out = max(out, (again, w if again else ""))
        self[word] = out
        return out


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> dict:
    """Evidence shares, the character model and the share of toxic documents without evidence.

    From every labelled row; rows with a null key, text or label teach nothing.  What reaches the driver are words
    with evidence, words that are as frequent as ``SPELLED`` says (a share of the documents, so that their number
    does not grow with them), and the documents counted by the strength of their evidence.
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y in (0, 1)")
    # labels grow with the documents, so they are not broadcast at any size
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null").join(known.hint("merge"), "k")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: list[Counter] = [Counter(), Counter()]
        docs_seen = [0, 0]

        def out() -> pa.RecordBatch:
            names = sorted(set(got[0]) | set(got[1]))
            b = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([g[x] for x in names], pa.int64()) for g in got]], names=["f", "clean", "toxic"])
            for g in got:
                g.clear()
            return b

        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs_seen[y] += 1
                words = {bare(w) for w in _words(t)} - {""}
                got[y].update({f for w in words for f in features(w)})
                if len(got[0]) + len(got[1]) > 600_000:
                    yield out()
        got[0][""], got[1][""] = docs_seen       # the number of documents goes under the empty feature
        yield out()

    hold = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit("calibration")), F.lit(4)) == 0
    counts = rows.where(~hold).select("t", "y").mapInArrow(count, "f string, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    scratch = common.Scratch(docs.sparkSession)
    counts = scratch.keep(counts)
    total = counts.where("f = ''").first()
    n0, n1 = (total["clean"], total["toxic"]) if total else (0, 0)
    prior = n1 / (n1 + n0) if n1 else 0.0
    words, stems = counts.where("f <> '' and not endswith(f, '~')"), counts.where("endswith(f, '~')")
    kinds = words.where("toxic > clean").withColumn("k", F.explode(F.array(*[F.lit(k) for k in (4, 5, 6)]))).where("char_length(f) > k").select(F.concat(F.expr("left(f, k)"), F.lit("~")).alias("f"))
    stems = stems.join(kinds.groupBy("f").agg(F.count("*").alias("kinds")).where(f"kinds >= {KINDS}"), "f", "left_semi")
    both = words.select("f", "clean", "toxic").unionByName(stems.select("f", "clean", "toxic")).where(f"toxic >= {LEAST}")
    m = F.col("toxic") + F.col("clean")
    rate = F.col("toxic") / m
    bound = (rate + Z * Z / (2 * m) - Z * F.sqrt(rate * (1 - rate) / m + Z * Z / (4 * m * m))) / (1 + Z * Z / m)
    strong = both.withColumn("share", bound).where(F.col("share") > max(0.2, 1.5 * prior))
    shares = {r["f"]: r["share"] for r in strong.select("f", "share").toLocalIterator()}
    # the character model: frequent plain words by the number of documents they occur in, toxic evidence in full
    plain = words.where(f"clean + toxic >= {max(10, (n0 + n1) / SPELLED)}").select("f", (F.col("clean") + F.col("toxic")).alias("n"))
    spelled = {r["f"]: r["n"] for r in plain.toLocalIterator()}
    weight = max(spelled.values(), default=1) // 20
    for w, s in shares.items():
        if not w.endswith("~") and s > 0.5:
            spelled[w] = spelled.get(w, 0) + weight
    model = {"shares": shares, "lm": train_lm(spelled), "known": frozenset(spelled), "steps": [(0.0, prior / 2), (1.0, 1.0)]}
    strengths = score(rows.where(hold).select("t", "y"), model, "t", raw=True).groupBy("score", "y").agg(F.count("*").alias("n"))
    seen = strengths.collect()     # at most two for each share
    scratch.drop()
    return model | {"steps": isotonic([(r["score"], r["y"], float(r["n"]), r["n"]) for r in seen], prior)}


def isotonic(points: list[tuple], prior: float) -> list[tuple[float, float]]:
    """Rising steps (strength, share of toxic) from (strength, label, weight), by pooling adjacent violators; a fourth
    number tells of how many documents a point is (1 if not given).

    A pool is flat from its weakest to its strongest evidence; between pools the share rises evenly.  A pool's
    share counts one more document, toxic to the extent of ``prior``.
    """
    pools: list[list[float]] = []      # weakest, strongest, toxic weight, weight, rows
    for x, y, w, *many in sorted(points):
        n = many[0] if many else 1
        if pools and pools[-1][1] == x:                  # ties are one point
            pools[-1][2:] = [u + v for u, v in zip(pools[-1][2:], (y * w, w, n), strict=True)]
        else:
            pools.append([x, x, y * w, w, n])
    merged: list[list[float]] = []
    for p in pools:
        merged.append(p)
        while len(merged) > 1 and merged[-2][2] * merged[-1][3] >= merged[-1][2] * merged[-2][3]:
            b = merged.pop()
            merged[-1] = [merged[-1][0], b[1], *[u + v for u, v in zip(merged[-1][2:], b[2:], strict=True)]]
    out, floor = [], 0.0
    for lo, hi, toxic, weight, n in merged:
        one = weight / n               # a document's weight in this pool
        floor = max(floor, (toxic + one * prior) / (weight + one))
        out += [(lo, floor), (hi, floor)] if hi > lo else [(lo, floor)]
    return out or [(0.0, prior / 2), (1.0, 1.0)]


def score(df: DataFrame, model: dict, text: str = "text", raw: bool = False) -> DataFrame:
    """Add score (0 to 1) and evidence, the restored word that decided (empty: none did).

    ``raw`` gives the strength of the evidence, not calibrated.  Null and empty texts score like texts without
    evidence; of equally strong words the last in order counts.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)   # evidence and frequent words
    held: list[Evidence] = []

    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        if not held:
            held.append(Evidence(shared.value["shares"], shared.value["lm"], shared.value["known"]))
        look = held[0].__getitem__
        best = [max(map(look, _words(t)), default=(0.0, "")) for t in common.texts(batch, text)]
        strength = np.array([b[0] for b in best])
        if not raw:
            at, share = np.array(shared.value["steps"]).T
            # the strength itself breaks ties between documents of one step
            strength = 0.99 * np.interp(strength, at, share) + 0.01 * strength
        return [pa.array(strength, pa.float64()), pa.array([b[1] for b in best], pa.string())]

    return common.add_columns(df, [T.StructField("score", T.DoubleType()), T.StructField("evidence", T.StringType())], fn, text)
