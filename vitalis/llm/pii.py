"""Operator 5: personal data by bootstrapped contextual extraction.

Seeds are the entities of four base patterns (email, ip, card, phone) and secrets in plain sight: runs of
``SECRET`` or more hexadecimal digits with a letter and a digit among them, which are spans of kind ``id``.
Every seed and every other identifier-like token (at least ``SHORTEST`` characters, with a digit) is an
instance that stands in lexical patterns: the word before, the word after, the two words before, the words
around (words of signs alone are passed over), and the four letters it begins with, if any.  Spark scores the graph of patterns and instances in rounds:
    pattern  = sum of its instances' scores / (instances + SMOOTH), 0 below LEAST seeds
    instance = 1 - product over its patterns of (1 - score), 1 for seeds
both over distinct surface forms, so copies of a document count once.  What has the form of a card (13 to
19 digits, in one run or in fours) or an ip and fails its check is evidence against the patterns that it stands in: it counts
among their instances, scores 0 in every round and is never found.  Instances that reach
``ACCEPT`` through high-confidence patterns are seeds of the next round, so that what they share leads to
others until scores settle, and in the end spans of kind ``id``; base spans stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

KINDS = ("email", "ip", "card", "phone", "id")
SHORTEST = 6
SECRET = 32
SMOOTH = 5.0
LEAST = 5
ACCEPT = 0.8
MOST_ROUNDS = 100
SETTLED = 0.001     # what all scores together may still rise by in a round that accepts nothing

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only begin where a run of digits begins, so the look-behind changes nothing but speed
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[0-9]\S*")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_WORD = re.compile(r"\S+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

_HEX = re.compile(rf"(?<![0-9A-Za-z])[0-9A-Fa-f]{{{SECRET},}}(?![0-9A-Za-z])")
REFUTED = len(KINDS)            # the kind of what has a base form and fails its check
PLAIN = REFUTED + 1             # the kind of secrets in plain sight

Span = tuple[int, int, int]     # place in KINDS (or REFUTED, PLAIN), start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the four base patterns, leftmost non-overlapping within each kind."""
    return [x for x in formed_spans(text) if x[0] < REFUTED]


def formed_spans(text: str) -> list[Span]:
    """The base spans; outside them, PLAIN secrets and as REFUTED the matches of ip and card that fail their check."""
    out: list[Span] = []
    more: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
        else:
            more.append((REFUTED, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19:
            if luhn(digits):
                out.append((2, *m.span()))
            elif all(len(g) == 4 for g in re.split("[ -]", m.group())[:-1]):     # not several numbers side by side
                more.append((REFUTED, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((3, *m.span()))
    for m in _HEX.finditer(text):
        if not m.group().isdigit() and not m.group().isalpha():
            more.append((PLAIN, *m.span()))
    if more:
        busy = sorted((s, e) for _, s, e in out)
        last = i = 0
        for k, s, e in sorted(more, key=lambda x: x[1:]):
            # a part of a longer name ('part-4111111111111112x') is no number of its own
            whole = (s == 0 or not text[s - 1].isalnum()) and (e == len(text) or not text[e].isalnum())
            while i < len(busy) and busy[i][1] <= s:
                i += 1
            if whole and s >= last and not (i < len(busy) and busy[i][0] < e):
                out.append((k, s, e))
                last = e
    return out


def other_tokens(text: str, taken: list[Span]) -> list[tuple[int, int]]:
    """Identifier-like tokens outside the base spans: with a digit, edge punctuation cut off."""
    busy = sorted((s, e) for _, s, e in taken)
    out, i, last = [], 0, 0
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        while start > last and not text[start - 1].isspace():
            start -= 1
        last = end
        while start < end and not text[start].isalnum():
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        while i < len(busy) and busy[i][1] <= start:
            i += 1
        if end - start >= SHORTEST and not (i < len(busy) and busy[i][0] < end):
            out.append((start, end))
    return out


_DIGIT = re.compile(r"[0-9]")


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span; words in lower case without edge signs, digits as 0.

    A word counts by the 64 characters nearest to the span, and no word is looked for beyond a longer one: pieces of
    one long run without blanks would else repeat it for each span in it.
    """
    def clean(w: str) -> str:
        return _DIGIT.sub("0", w.lower().strip(".,;:!?()[]\"'&$#%*")) or "-"

    # words around: look as far as two words reach, however long they are
    left: list[str] = []
    at = start
    while len(left) < 2:
        while at > 0 and text[at - 1].isspace():
            at -= 1
        stop = at
        while at > 0 and not text[at - 1].isspace() and stop - at < 64:
            at -= 1
        if at == stop:
            break
        if any(c.isalnum() for c in text[at:stop]):
            left.append(clean(text[at:stop]))
        if at > 0 and not text[at - 1].isspace():
            break
    m = _WORD.search(text, end)
    while m and not any(c.isalnum() for c in m.group()[:64]):
        m = _WORD.search(text, m.end())
    right = clean(m.group()[:64]) if m else "<end>"
    one = left[0] if left else "<start>"
    two = left[1] if len(left) > 1 else "<start>"
    begin = text[start:min(end, start + 4)]
    return [f"l:{one}", f"r:{right}", f"ll:{two} {one}", f"lr:{one} {right}", *([f"b:{begin.lower()}"] if len(begin) == 4 and begin.isalpha() else [])]


_ITEM = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                      T.StructField("surface", T.StringType()), T.StructField("patterns", T.ArrayType(T.StringType()))])
_ARROW_ITEM = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("surface", pa.string()), ("patterns", pa.list_(pa.string()))])


def extract(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``items``: base spans, refuted ones and other identifier-like tokens of each text, with their lexical patterns."""
    def fn(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = []
        for t in common.texts(batch, text):
            formed = formed_spans(t)
            rows.append([{"kind": k, "start": s, "end": e, "surface": t[s:e], "patterns": contexts(t, s, e)}
                         for k, s, e in [*formed, *((4, s, e) for s, e in other_tokens(t, formed))]])
        return [pa.array(rows, pa.list_(_ARROW_ITEM))]

    return common.add_columns(df, [T.StructField("items", T.ArrayType(_ITEM))], fn, text)


def bootstrap(items: DataFrame, scratch: common.Scratch, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """Accepted surfaces (a column ``surface``) from rows (kind, surface, patterns).

    Refuted instances score 0 and are not accepted.  Scores never fall, so rounds go on until one accepts no new surface and scores have settled; raises if
    ``most_rounds`` do not get there.
    """
    edges = items.select("surface", ((F.col("kind") < 4) | (F.col("kind") == PLAIN)).alias("seed"), (F.col("kind") == REFUTED).alias("refuted"), F.explode("patterns").alias("p"))
    edges = scratch.keep(edges.groupBy("p", "surface").agg(F.max("seed").alias("seed"), F.max("refuted").alias("refuted")))
    now = edges.select("p", "surface", "seed", F.col("seed").cast("double").alias("s"))
    scored, mark = None, (0, 0.0)
    for _ in range(most_rounds):
        pattern = now.groupBy("p").agg(F.sum("s").alias("s"), F.count("*").alias("n"), F.sum(F.col("seed").cast("long")).alias("seeds"))
        pattern = pattern.where(F.col("seeds") >= LEAST).select("p", (F.col("s") / (F.col("n") + SMOOTH)).alias("w"))
        # a seed scores 1 whatever its patterns; only other instances need the patterns' scores
        free = edges.where("not seed and not refuted").join(pattern, "p").groupBy("surface").agg(F.sum(F.log1p(-F.least("w", F.lit(0.999999)))).alias("g"))
        old, scored = scored, scratch.keep(free.select("surface", (1 - F.exp("g")).alias("x")))
        if old is not None:
            scratch.drop(old)
        r = scored.agg(F.count_if(F.col("x") >= ACCEPT).alias("n"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("x")).first()
        if r["n"] == mark[0] and r["x"] - mark[1] < SETTLED:
            break
        mark = (r["n"], r["x"])
        good = F.col("seed") | (F.coalesce("x", F.lit(0.0)) >= ACCEPT)
        now = edges.join(scored, "surface", "left").select("p", "surface", good.alias("seed"), F.when(good, 1.0).otherwise(F.coalesce("x", F.lit(0.0))).alias("s"))
    else:
        raise RuntimeError("the bootstrap did not settle")
    scratch.drop(edges)
    return scored.where(F.col("x") >= ACCEPT).select("surface")


def _found(df: DataFrame, text: str, scratch: common.Scratch, extra: list[str]) -> DataFrame:
    """Rows (_row, extra columns, items, found) with found: the accepted spans of kind id."""
    rows = extract(df.withColumn("_row", F.monotonically_increasing_id()), text)
    rows = scratch.keep(rows.select("_row", *extra, "items"))
    items = rows.select("_row", F.explode("items").alias("x")).select("_row", "x.*")
    good = bootstrap(items, scratch)
    spans = items.where("kind = 4").join(good, "surface", "left_semi").groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("found"))
    plain = F.transform(F.filter("items", lambda x: x["kind"] == PLAIN), lambda x: F.struct(F.lit(4).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    rows = rows.join(spans.hint("merge"), "_row", "left")      # alike at every size: the texts are dealt by row
    return rows.withColumn("found", F.concat(F.coalesce("found", _none()), plain))


def _none() -> Column:
    return F.array().cast("array<struct<kind:int,start:int,end:int>>")


def _joined(spans: Column) -> Column:
    """Span structs as kind:start:end in order of kind and start, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, spans, n_email, n_ip, n_card, n_phone, n_id) for every row.

    base and spans are comma-joined kind:start:end (code points, end exclusive); a null or empty text
    has none.  Repeated rows and null keys each give a row; a span found by several patterns is listed once.
    """
    scratch = common.Scratch(df.sparkSession)
    rows = _found(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", scratch, ["key"])
    slim = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    base = F.transform(F.filter("items", lambda x: x["kind"] < 4), slim)
    found = F.col("found")
    out = rows.select(F.col("key").alias(key), base.alias("b"), found.alias("f"))
    count = lambda k: F.size(F.filter("b", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return out.select(key, _joined(F.col("b")).alias("base"), _joined(F.concat("b", "f")).alias("spans"), *[count(k) for k in range(4)],
                      F.size("f").cast("long").alias("n_id"))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span of ``text`` replaced by its kind in square brackets; null texts stay null.

    Overlapping spans are replaced once, by the kind of the one that starts first (the longer at a tie).
    """
    scratch = common.Scratch(df.sparkSession)
    names = df.columns
    plain = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    t = f"c{[c.lower() for c in names].index(text.lower())}"
    rows = _found(plain, t, scratch, [f"c{i}" for i in range(len(names))])
    slim = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    base = F.transform(F.filter("items", lambda x: x["kind"] < 4), slim)
    rows = rows.select(*plain.columns, F.concat(base, F.col("found")).alias("s"))
    at = plain.columns.index(t)
    schema = plain.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = list(b.columns)
            out = []
            for value, spans_ in zip(cols[at].to_pylist(), cols[-1].to_pylist(), strict=True):
                if spans_:
                    parts, last = [], 0
                    for s, e, k in sorted((x["start"], -x["end"], x["kind"]) for x in spans_):
                        if s >= last:
                            parts += [value[last:s], f"[{KINDS[k]}]"]
                            last = -e
                    value = "".join([*parts, value[last:]])
                out.append(value)
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols[:-1], names=schema.names)

    return rows.mapInArrow(run, schema).toDF(*names)
