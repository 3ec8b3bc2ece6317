"""Edge rows and brute force for the operators on documents."""

import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from vitalis.llm import bpe, common, edit_embedding, language, lm_score, packing, pii, simhash, toxicity

from .conftest import DOCS, EXTRA, LONG

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
PATTERN = public_tokenizers.PATTERN


def reference_encoder(path):
    import tiktoken

    return tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


def test_bpe_tree_equals_whole_text():
    whole, codec, draw = reference_encoder(RANKS), bpe.Codec(bpe.load_ranks(RANKS), PATTERN), random.Random(3)
    bits = ["a", "'", "re", " ", "  ", "\n", "1", "é", "!", "　", "\x1c", "ll", "'s", "x" * 9, "中", "word "]
    for _ in range(600):
        codec.leaf = draw.randrange(1, 30)
        s = "".join(draw.choice(bits) for _ in range(draw.randrange(150)))
        ids = codec.encode(s)
        assert ids.tolist() == whole.encode_ordinary(s)
        assert codec.decode(ids) == s.encode()


def test_bpe_edges(crowded, none):
    whole = reference_encoder(RANKS)
    got = bpe.decode(bpe.encode(crowded, RANKS, PATTERN), RANKS, PATTERN)
    assert got.columns.count("ids") == 1 and "source" in got.columns
    rows = got.select("doc_id", "text", "ids", "decoded").collect()
    assert len(rows) == len(DOCS)
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == whole.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.decode(bpe.encode(none, RANKS, PATTERN), RANKS, PATTERN).count() == 0


def edit_distance_like(a, b):
    return sum(x == y for x, y in zip(a, b)) / max(len(a), len(b))


def test_fingerprints_are_those_of_single_texts():
    texts = ["the same walk for all " * k + "é" * (k % 7) for k in range(90)] + ["", "a", LONG]
    assert edit_embedding.fingerprints(texts) == [edit_embedding.fingerprints([t])[0] for t in texts]


def test_likeness_follows_edits():
    draw = random.Random(5)
    text = "".join(draw.choice("abcdefghij klmnop") for _ in range(4000))
    other = "".join(draw.choice("abcdefghij klmnop") for _ in range(4000))
    fp = lambda t: edit_embedding.fingerprints([t])[0]
    few = text[:1000] + "xx" + text[1003:2500] + text[2501:]
    assert edit_embedding.alike(fp(text), fp(text)) == 1
    assert edit_embedding.alike(fp(text), fp(few)) > 0.6 > 0.25 > edit_embedding.alike(fp(text), fp(other))


def test_compare_next(crowded, none, spark):
    edit = lambda a, b: a[: len(a) - len(a) // 3] + b[: len(a) // 3]
    rows = edit_embedding.compare_next(crowded, edit).collect()
    assert len(rows) == len(DOCS)
    order = sorted(((i if i is not None else -math.inf, t or "") for i, t, _ in DOCS), key=lambda r: (-r[0], r[1]))
    want = Counter((i if i != -math.inf else None, edit(t, order[(n + 1) % len(order)][1])) for n, (i, t) in enumerate(order))
    assert Counter((r["doc_id"], r["edited"]) for r in rows) == want
    by_text = {r["fingerprint"] for r in rows if r["doc_id"] in (1, 4)}
    assert len(by_text) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert edit_embedding.compare_next(none, edit).count() == 0
    one = spark.createDataFrame([(3, "only one here")], "doc_id long, text string")
    assert edit_embedding.compare_next(one, edit).first()["near_next"] == 1


def test_near_pairs(spark):
    draw = random.Random(8)
    base = ["".join(draw.choice("abcdef ghij") for _ in range(800)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)] + [(100 + i, t[:795] + "zz") for i, t in enumerate(base)] + [(200, ""), (201, None), (None, base[0])]
    df = edit_embedding.fingerprint(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r["a"], r["b"]) for r in edit_embedding.near_pairs(df).collect()}
    prints = {r["doc_id"]: r["fingerprint"] for r in df.collect()}
    assert got == {(i, 100 + i) for i in range(30) if prints[i] != prints[100 + i]}     # equal fingerprints are one member
    assert len(got) > 5


def whole_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


def test_packing_edges(crowded, none, spark):
    rows = packing.pack(crowded.where("doc_id is null or doc_id <> 4"), JSON, PATTERN).collect()
    ids = {i: [*whole_ids(t or ""), 1] for i, t, _ in DOCS}
    at, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        at[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(at) == set(ids) - {4}
    for i, pieces in at.items():
        pieces.sort(key=lambda r: r["start"])
        assert [x for r in pieces for x in np.frombuffer(r["ids"], "<u4").tolist()] == ids[i]
        assert all(r["doc_tokens"] == len(ids[i]) for r in pieces)
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        total = sum(r["length"] for r in pieces)
        assert [r["offset"] for r in pieces] == [sum(q["length"] for q in pieces[:n]) for n in range(len(pieces))]
        assert total == 2048 or total & (total - 1) == 0
    assert packing.pack(none, JSON, PATTERN).count() == 0


def test_packer_takes_the_level_of_least_squares():
    draw, packer = random.Random(4), packing.Packer(16, 0)
    for _ in range(400):
        size = draw.randrange(1, 16)
        n = packer.count.copy()
        best = {}
        for level in [0, *[h for h in range(1, 16) if n[h] and h + size <= 16]]:
            m = n.copy()
            if level:
                m[level] -= 1
            if level + size < 16:
                m[level + size] += 1
            best[level] = (int((m ** 2).sum()), -level)
        level = packer.level_for(size)
        assert best[level] == min(best.values())
        list(packer.place((0, 0, size, np.zeros(size, "<u4"))))
    assert (packer.count[1:16] == [len(packer.open.get(h, [])) for h in range(1, 16)]).all()
    assert packer.n_open == packer.count.sum()


def test_packer_closes_windows_by_least_squares():
    draw, packer = random.Random(5), packing.Packer(16, 0)
    for _ in range(2000):
        packer.count[1:16] = [draw.choice([0, 0, 1, 2, 5, 9]) for _ in range(15)]
        if not packer.count.any():
            continue
        size, best = draw.randrange(1, 16), {}
        for level in np.flatnonzero(packer.count).tolist():
            m = packer.count.copy()
            m[level] -= 1
            if level + size < 16:
                m[level + size] += 1
            best[level] = (int((m ** 2).sum()), -level)
        level = packer.level_to_close(size)
        assert best[level] == min(best.values())


@pytest.mark.parametrize("sizes", ["any", "over half"])
def test_packer_places_all_but_one_window_by_the_rule(sizes):
    window, most = 64, 12
    draw, packer = random.Random(6), packing.Packer(window, 0, most)
    docs, whole = {}, []
    for doc in range(700):
        n = draw.randrange(1, 150) if sizes == "any" else draw.randrange(33, 40)
        docs[doc] = ids = np.arange(n, dtype="<u4") + 1000 * doc
        for at in range(0, n, window):
            whole += packer.place((doc, at, n, ids[at:at + window]))
            assert packer.n_open <= most      # few open windows, also for pieces of which no two fit together
    n_rule, rest = len(whole), list(packer.rest())
    assert all(sum(len(p[-1]) for p in w) == window for w in whole)
    tail = [sum(len(p[-1]) for p in w) for w in rest]
    odd = [n for n in tail if n < window]
    assert all(n & (n - 1) == 0 for n in tail) and sum(odd) < window and len(odd) == len(set(odd))
    assert packer.n_open == 0 and not packer.count.any() and n_rule > 100
    back = defaultdict(list)
    for pieces in [*whole, *rest]:
        for doc, start, total, ids in pieces:
            assert total == len(docs[doc]) and ids.tolist() == docs[doc][start:start + len(ids)].tolist() and len(ids)
            back[doc] += ids.tolist()
    assert {d: sorted(x) for d, x in back.items()} == {d: x.tolist() for d, x in docs.items()}
    assert not list(packing.Packer(window, 0).rest())


def test_json_codec_equals_the_tokenizers_library():
    codec = packing.json_codec(JSON, PATTERN)
    assert codec.ranked
    for _, t, _ in DOCS:
        assert codec.encode(t or "").tolist() == whole_ids(t or "")
    assert codec.encode("a <|endoftext|> b").tolist() == whole_ids("a <|endoftext|> b")


def test_added_tokens_in_a_text_are_tokens(spark, tmp_path):
    import json

    from tokenizers import Tokenizer

    library, codec = Tokenizer.from_file(JSON), packing.json_codec(JSON, PATTERN)
    marked = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext|", "déjà<|endoftext|>\n\n vu <|ENDOFTEXT|>", "", "<|endof<|endoftext|>text|>"]
    for t in marked:
        want = library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t, True).tolist() == want
        rows = packing.pack(spark.createDataFrame([(1, t)], "doc_id long, text string"), JSON, PATTERN).orderBy("start").collect()
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in rows]).tolist() == [*want, 1]
    assert codec.encode(marked[0], True).tolist() == [64, 220, 50256, 275]
    # several added tokens, one the beginning of another; a file whose tokens take blanks goes to the library
    for n, strip in enumerate((False, True)):
        with open(JSON, encoding="utf-8") as f:
            spec = json.load(f)
        spec["added_tokens"] += [dict(spec["added_tokens"][0], id=50257 + k, content=c, lstrip=strip) for k, c in enumerate(("<|end", "<|end|>"))]
        path = str(tmp_path / f"{n}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(spec, f)
        other, library = packing.JsonCodec(path, PATTERN), Tokenizer.from_file(path)
        assert other.ranked != strip
        for t in [*marked, "x <|end|><|end <|endoftext|> y"]:
            assert other.encode(t, True).tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def toxic_model(spark):
    draw = random.Random(11)
    words = ["".join(draw.choice("aeioulrnst") for _ in range(draw.randrange(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        bad = i % 6 == 0
        w = [draw.choice(words) for _ in range(60)]
        if bad:
            w[draw.randrange(60)] = draw.choice(["idiot", "moron", "scum", "stupid"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    labels += [(2000, 1), (None, 1), (5, None), (6, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_toxicity_restores_disguised_words(toxic_model):
    lm = toxic_model["lm"]
    for disguised in ("1d10t", "id!ot", "!d!0t", "idiooooot", "m0r0n", "mor0n", "$cum", "5tup1d", "stuuuupid"):
        assert toxicity.restored(disguised, lm) in ("idiot", "moron", "scum", "stupid"), disguised
    assert toxicity.restore("you i d i o t, m.o.r.o.n", lm) == "you idiot, moron"
    assert toxicity.restored("plain,", lm) == "plain"


def test_toxicity_decodes_every_disguise(toxic_model):
    lm, known = toxic_model["lm"], toxic_model["known"]
    for word, plain in (("stupi6", None), ("idio7", "idiot"), ("stuupiid", "stupid"), ("id.iot", "idiot"), ("m-oron", "moron"), ("scu|", None), ("m_o_ron!", "moron"), ("$cuum", "scum")):
        assert toxicity.disguised(word, known)
        if plain:
            assert toxicity.restored(word, lm, known) == plain, word
    assert not toxicity.disguised("4550", known) and not any(toxicity.disguised(w, known) and not toxicity._DISGUISED.search(w) for w in known)
    seen = toxicity.Evidence(toxic_model["shares"], lm, known)
    strong = {w: seen[w] for w in ("idiot", "moron", "stupid")}
    for text, plain in (("you are a m o r o n", "moron"), ("such a s t u p i d", "stupid"), ("s t u p i d m o r o n", "moron"), ("an idio7", "idiot"),
                        ("stuupiid", "stupid"), ("id.iot", "idiot"), ("m-oron!", "moron"), ("you.moron", "moron"), ("m o r o n n o r", "moron"),
                        ("i  d  i  o  t", "idiot"), ("i d ! o t", "idiot"), ("i / d / i / o / t", "idiot"), ("you $ t u p i d", "stupid"), ("m, o, r, o, n", "moron"),
                        ("i d * o t", "idiot"), ("m\n\no\n\nr\n\no\n\nn", "moron"), ("(m o r o n!)", "moron"), ("i d i o t!!", "idiot"), ("i*d*i*o*t", "idiot"), ("! d 1 0 7", "idiot")):
        assert max(seen[w] for w in toxicity._words(text))[0] >= strong[plain][0] > 0, text


def test_spaced_words_take_lone_letters_only():
    for text, want in (("i d i o t", ["idiot"]), ("an i_d_i_o_t!", ["idiot"]), ("an i_d_i_o_t.", ["idiot"]), ("a b", []), ("the cat sat", []), ("x y zed", []),
                       ("x y z zed", ["xyz"]), ("", []), ("@ s s h", ["@ssh"]), ("a  b -- c", ["abc"]), ("ab c d e f gh", ["cdef"]), (" * ".join("abc"), ["a*b*c"])):
        assert toxicity.spaced_words(text) == want, text
    draw = random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choice("abé1!@*_ -/\n") for _ in range(draw.randrange(24)))
        alone, runs, run = lambda c: c.isalnum() or c in "!@", [], []
        parts = re.findall(r"[^*_ \-/\n]+|[*_ \-/\n]+", " " + text)
        for part in [*parts, "ab"]:
            if alone(part[0]) and len(part) > 1:
                run += part[0] if not part[1].isalnum() else ""
                runs += ["".join(run)] if sum(map(alone, run)) >= 3 else []
                run = []
            else:
                run += [c for c in part if alone(c) or c == "*"]
        got = toxicity.spaced_words(text)
        assert [x.strip("*") for x in got] == [x.strip("*") for x in runs], text
    start = time.time()
    for text in (" " * 300_000, "*" * 300_000, "a " * 150_000, "a" * 300_000, " a  b" * 60_000 + "x", "! " * 150_000):
        toxicity.spaced_words(text)
    assert time.time() - start < 5


def test_decoding_equals_enumeration_of_the_lattice(toxic_model):
    lm, draw = toxic_model["lm"], random.Random(12)

    def said(word, ends):
        """Every (text, log probability) that a lattice allows, with the end of each word."""
        paths = [("", "^", 0.0)]
        for ways, may_end in ends:
            if may_end:
                paths += [(t + " ", "^", v + toxicity._logp(lm, c, "$")) for t, c, v in paths if c != "^"]
            after = []
            for t, c, v in paths:
                for x, cost in ways:
                    w, d = v + cost, c
                    for y in x:
                        w += toxicity._logp(lm, d, y)
                        d = (d + y)[-3:]
                    after.append((t + x, d, w))
            paths = after
        return [(t, v + toxicity._logp(lm, c, "$") * (c != "^" or not word)) for t, c, v in paths]

    for _ in range(150):
        w = list(draw.choice(["idiot", "moron", "scum", "it"])[:5])
        for _ in range(draw.randrange(1, 3)):
            i = draw.randrange(len(w))
            w[i] = draw.choice([w[i] * 2, w[i] + ".", draw.choice("01345$@!"), w[i]])
        word = "".join(w)
        whole = [(t, v) for t, v in said("", [(x, False) for x in toxicity.lattice(word)])]
        best = max(v for _, v in whole)
        assert max(v for t, v in whole if t == toxicity.decode(word, lm)) == pytest.approx(best), word
        for spaced in (False, True):
            parts = said(word, list(toxicity.steps(word, spaced)))
            best = max(v for _, v in parts)
            assert max((v for t, v in parts if t.split() == toxicity.segment(word, lm, spaced)), default=None) == pytest.approx(best), (word, spaced)


def test_toxicity_gate_of_evidence_loses_nothing(toxic_model):
    lm, draw = toxic_model["lm"], random.Random(8)
    seen, found = toxicity.Evidence(toxic_model["shares"], lm, toxic_model["known"]), 0
    for _ in range(3000):
        w = list(draw.choice(["idiot", "moron", "scum", "stupid", "unrelated", "trial"]))
        for _ in range(draw.randrange(1, 4)):
            i = draw.randrange(len(w))
            w[i] = draw.choice([w[i] * 2, w[i] + ".", "-" + w[i], draw.choice("01345$@!+*"), w[i]])
        word = "".join(w)
        spaced = draw.random() < 0.3
        got = [toxicity.decode(word, lm), *toxicity.segment(word, lm, spaced)]
        if any(f in toxic_model["shares"] for x in got for f in toxicity.features(x)):
            found += 1
            assert seen.reachable(word, spaced), word
    assert found > 500


def test_toxicity_scores(toxic_model, crowded, none, spark):
    rows = [(1, "you absolute 1d10t there"), (2, "an i d i o t indeed"), (3, "what a MOROOOON!!"), (4, "nothing of that sort here"), (5, ""), (6, None), (7, "scum")]
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), toxic_model).collect()}
    assert all(got[i]["score"] >= 0.3 for i in (1, 2, 3, 7)) and all(0 <= got[i]["score"] < 0.3 for i in (4, 5, 6))
    assert (got[1]["evidence"], got[2]["evidence"], got[3]["evidence"]) == ("idiot", "idiot", "moron")
    assert toxicity.score(crowded, toxic_model).count() == len(DOCS)
    assert toxicity.score(none, toxic_model).count() == 0


def test_toxicity_learns_from_nothing(none, docs, spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for d in (none, docs):
        assert all(r["score"] < 0.3 for r in toxicity.score(docs, toxicity.learn(d, labels)).collect())


def test_toxicity_learns_from_every_labelled_row(spark):
    n = 30_000
    rare = {i: f"vile{'abcde'[i % 5]}" for i in range(0, n, 3001)}       # two documents for each of five words that share a stem
    rows = [(i, rare.get(i, "some plain words"), int(i in rare)) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    model = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    held = spark.createDataFrame([(i,) for i in range(n)], "k long").where("pmod(xxhash64(cast(k as string), 'calibration'), 4) = 0")
    kept = {r["k"] for r in held.collect()}
    steps = dict(model["steps"])
    # the weakest step counts every calibration row without evidence: with one more document it is that share exactly
    none = [i for i in kept if i not in rare or not any(f in model["shares"] for f in toxicity.features(rare[i]))]
    prior = sum(i not in kept for i in rare) / (n - len(kept))
    assert abs(steps[0.0] - (sum(i in rare for i in none) + prior) / (len(none) + 1)) < 1e-12


def test_isotonic_counts_documents():
    points = [(0.0, 0, 1.0)] * 40 + [(0.0, 1, 1.0)] * 2 + [(0.5, 1, 1.0)] * 7 + [(0.5, 0, 1.0)] * 3
    counted = [(0.0, 0, 40.0, 40), (0.0, 1, 2.0, 2), (0.5, 1, 7.0, 7), (0.5, 0, 3.0, 3)]
    assert toxicity.isotonic(points, 0.2) == toxicity.isotonic(counted, 0.2)


def test_isotonic_steps_rise():
    draw = random.Random(2)
    steps = toxicity.isotonic([(x := draw.random(), int(draw.random() < x), 1.0) for _ in range(300)], 0.5)
    assert [v for _, v in steps] == sorted(v for _, v in steps) and [x for x, _ in steps] == sorted(x for x, _ in steps)


def brute_spans(t):
    kinds = [("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
             ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"))]
    out = []
    for k, (name, rx) in enumerate(kinds):
        for m in rx.finditer(t):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": name == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                  "card": 13 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(digits))) % 10 == 0,
                  "phone": 9 <= len(digits) <= 15}[name]
            if ok:
                out.append((k, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    draw = random.Random(6)
    bits = ["a", "@", "a@b.c", ".", "..", "-", "+", "1", "12", " ", "255", "256", "4111 1111 1111 1111", "+1 (499) 555-6503", "(", "1.2.3.4", "é", "\n", "x@y", "@a.b@c.d"]
    for _ in range(4000):
        t = "".join(draw.choice(bits) for _ in range(draw.randrange(14)))
        assert sorted(pii.base_spans(t)) == sorted(brute_spans(t)), t


def test_pii_find_and_redact(crowded, none):
    rows = pii.find(crowded).collect()
    assert len(rows) == len(DOCS)
    text = {i: t or "" for i, t, _ in DOCS}
    for r in rows:
        spans = sorted(brute_spans(text[r["doc_id"]]))
        want = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        assert r["base"] == want and r["spans"].startswith(want)
    assert pii.find(none).count() == 0
    red = pii.redact(crowded)
    assert red.columns == crowded.columns and red.schema == crowded.schema
    got = {r["doc_id"]: r["text"] for r in red.select("doc_id", "text").collect()}
    assert got[8] == "Contact: [email] or [phone], from [ip]; card [card]."
    assert got[2] is None and got[3] == "" and got[5] == LONG
    assert pii.redact(none).count() == 0


def test_pii_bootstrap_finds_identifiers_of_no_known_form(spark):
    rows = [(i, f"note {chr(97 + i % 26)} account holder email user{i}@mail.example.com confirmed today") for i in range(60)]
    rows += [(100 + i, f"other {chr(97 + i % 26)} account holder email KEY{i}X7Q{i}Z99 confirmed today") for i in range(10)]
    rows += [(200 + i, f"section number part{i}x{i}00 of the plan {i}") for i in range(40)]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + i]["n_id"] == 1 for i in range(10))
    assert all(got[200 + i]["n_id"] == 0 for i in range(40))


def test_what_fails_its_check_is_refuted():
    def refuted(t):
        return [t[s:e] for k, s, e in pii.formed_spans(t) if k == pii.REFUTED]

    assert refuted("no 4111111111111112, 4111 1111 1111 1112 or 1.2.3.400 here") == ["4111111111111112", "4111 1111 1111 1112", "1.2.3.400"]
    assert refuted("4111 1111 1111 1111 and 10.0.0.7") == [] and refuted("20240101 20240102") == [] and refuted("x4111111111111112") == []
    assert refuted("123456789012 and 12345678901234567890") == [] and refuted("") == []
    draw = random.Random(16)
    bits = ["a", "@a.b", "4111111111111112", "4111 1111 1111 1111", "1.2.3.400", "1.2.3.4", " ", "-", "+", "12", "."]
    for _ in range(2000):
        t = "".join(draw.choice(bits) for _ in range(draw.randrange(8)))
        formed = pii.formed_spans(t)
        assert sorted(pii.base_spans(t)) == sorted(brute_spans(t))
        held = [x for x in formed if x[0] == pii.REFUTED]
        assert all(a == b or a[2] <= b[1] or b[2] <= a[1] for a in held for b in formed), t
        assert all(e <= s2 or e2 <= s for _, s, e in held for s2, e2 in pii.other_tokens(t, formed)), t


def test_pii_secrets_in_plain_sight_lead_to_others(spark):
    def plain(t):
        return [t[s:e] for k, s, e in pii.formed_spans(t) if k == pii.PLAIN]

    key = "0a" * 20
    assert plain(f'token = "{key}", {key[:31]} {"a" * 40} {"1" * 40} x{key} {key}@mail.org') == [key]
    assert pii.contexts(f'the token = "{key}" | now', 13, 53) == ["l:token", "r:now", "ll:the token", "lr:token now"]
    rows = [(i, f'note {chr(97 + i % 26)} session token = "{i:032x}b7" for {i % 7}') for i in range(1, 40)]
    rows += [(100 + i, f"note {chr(97 + i % 26)} session token = KEY-{i}X7Q{i} for {i % 7}") for i in range(10)]
    rows += [(200 + i, f"note {chr(97 + i % 26)} bought parts{i}x{i}00 of it") for i in range(40)]
    rows = [*rows, (300, None), (301, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert all(got[i]["n_id"] == (i < 200) and got[i]["base"] == "" for i, _ in rows)
    red = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert red[1] == 'note b session token = "[id]" for 1' and red[103] == "note d session token = [id] for 3"
    assert red[300] is None and red[301] == ""


def test_pii_takes_no_number_that_failed_its_check(spark):
    rows = [(i, f"note {chr(97 + i % 26)} paid with {4111111111111111 + 10 * i} at the till") for i in range(90)]
    rows += [(200 + i, f"note {chr(97 + i % 26)} paid with ACC-{i}X7Q{i} at the till") for i in range(10)]
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    cards = sum(got[i]["n_card"] for i in range(90))
    assert 5 <= cards < 30 and all(got[i]["n_id"] == 0 for i in range(90))
    assert all(got[200 + i]["n_id"] == 0 for i in range(10))       # most numbers there are no cards


def brute_bootstrap(rows):
    """Accepted surfaces of rows (kind, surface, patterns), by the formulas of the docstring."""
    edges, seed, refuted = defaultdict(set), set(), set()
    for kind, surface, patterns in rows:
        for p in patterns:
            edges[p].add(surface)
        seed |= {surface} if kind < 4 else set()
        refuted |= {surface} if kind == pii.REFUTED else set()
    score = {s: float(s in seed) for ss in edges.values() for s in ss}
    good, sum_before = set(seed), None
    while True:
        weight = {p: sum(score[s] for s in ss) / (len(ss) + pii.SMOOTH) for p, ss in edges.items() if len(ss & good) >= pii.LEAST}
        left = defaultdict(lambda: 1.0)
        for p, w in weight.items():
            for s in edges[p] - seed - refuted:
                left[s] *= 1 - w
        x = {s: 1 - v for s, v in left.items()}
        more, total = {s for s, v in x.items() if v >= pii.ACCEPT}, sum(x.values())
        if sum_before is not None and seed | more == good and total - sum_before < pii.SETTLED:
            return more
        good, sum_before = seed | more, total
        score = {s: 1.0 if s in good else x.get(s, 0.0) for s in score}


def test_pii_scores_equal_brute_force(spark):
    draw, accepted = random.Random(17), 0
    for _ in range(3):
        kinds = [draw.choice([0, 2, 4, 4, 4, 5]) for _ in range(150)]
        rows = [(k, f"s{i}", draw.sample([f"p{j}" for j in range(i // 10, i // 10 + 4)], 3)) for i, k in enumerate(kinds) for _ in range(2)]
        scratch = common.Scratch(spark)
        got = [r["surface"] for r in pii.bootstrap(spark.createDataFrame(rows, "kind int, surface string, patterns array<string>"), scratch).collect()]
        scratch.drop()
        want = brute_bootstrap(rows)
        assert len(got) == len(set(got)) and set(got) == want
        accepted += len(want)
    assert 0 < accepted < 300


def test_pii_bootstrap_goes_on_until_it_settles(spark):
    # 50 surfaces on each of 12 levels, each level known only by the three patterns it shares with the one before
    rows = [(0 if k == 0 else 4, f"{k}-{i}", [f"{x}{n}" for n in (k - 1, k) if n >= 0 for x in "abc"]) for k in range(13) for i in range(50)]
    rows += [(4, f"other-{i}", ["z"]) for i in range(50)]
    items = spark.createDataFrame(rows, "kind int, surface string, patterns array<string>")
    scratch = common.Scratch(spark)
    got = {r["surface"] for r in pii.bootstrap(items, scratch).collect()}
    assert got == {f"{k}-{i}" for k in range(1, 13) for i in range(50)}
    with pytest.raises(RuntimeError):
        pii.bootstrap(items, scratch, 5)
    scratch.drop()


def brute_simhash(t, words=3):
    import xxhash

    w = bytes(c + 32 if 65 <= c <= 90 else c for c in t.encode()).split()
    shingles = [b" ".join(w[i:i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(prints, tau):
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= tau:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_simhash_edges(crowded, none):
    rows = simhash.near_duplicates(crowded).collect()
    assert len(rows) == len(DOCS)
    for i, t, _ in DOCS:
        assert all(r["fingerprint"] == format(brute_simhash(t or ""), "016x") for r in rows if r["doc_id"] == i)
    part = {r["doc_id"]: r["component_id"] for r in rows}
    assert part[4] == part[1] == 1 and part[2] == part[3] == part[7] == 2
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("most", "plan"), [(64, None), (3, None), (4, [(list(range(32)), 1), (list(range(32, 64)), 0)]), (64, [(list(range(64)), 2)]),
                                             # nothing is crowded: the probes alone find every pair
                                             (10**6, None), (10**6, [(list(range(32)), 1), (list(range(32, 64)), 0)]), (10**6, [(list(range(64)), 2)])])
def test_simhash_links_connect_like_brute_force(spark, most, plan):
    draw = random.Random(9)
    prints = [draw.getrandbits(64) for _ in range(60)]
    for p in prints[:12]:       # near copies, chains, a crowded neighbourhood
        for _ in range(6):
            prints.append(p ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) * (draw.random() < 0.7))
    prints += [prints[0] ^ (1 << a) for a in range(40)]
    prints = sorted(set(prints))
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    scratch = common.Scratch(spark)
    df = spark.createDataFrame([(signed(p),) for p in prints], "f long")
    edges = [(r["a"], r["b"]) for r in simhash.links(df, 2, scratch, most, plan).collect()]
    at = {signed(p): n for n, p in enumerate(prints)}
    assert all((prints[at[a]] ^ prints[at[b]]).bit_count() <= 2 for a, b in edges)
    if most == 10**6:
        assert {(a, b) for a in at for b in at if a < b and (prints[at[a]] ^ prints[at[b]]).bit_count() <= 2} == set(edges)
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = find(at[a]), find(at[b])
        root[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(prints))] == brute_components(prints, 2)
    scratch.drop()


def test_threshold_allocation_is_optimal():
    draw = random.Random(1)
    from itertools import product

    for _ in range(50):
        cost = [{t: draw.random() for t in (-1, 0, 1, 2)} for _ in range(3)]
        want = min((sum(c[t] for c, t in zip(cost, ts)), ts) for ts in product((-1, 0, 1, 2), repeat=3) if sum(ts) == 0)
        got = simhash.allocate(cost, 0)
        assert math.isclose(got[0], want[0]) and tuple(got[1]) == want[1]


def lm_tokens(t):
    return [*bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split(), b" "]


def test_lm_scores(crowded, none, spark, monkeypatch):
    extra = [(100 + i, f"the quick word{i % 5} jumps over rare{i} things", "en") for i in range(40)]
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(i, t) for i, t, _ in DOCS + extra], schema).withColumn("train", common.crc_mod("doc_id", 3) != 0)
    train = {i: zlib.crc32(str(i).encode()) % 3 != 0 if i is not None else False for i, _, _ in DOCS + extra}
    c, pairs = Counter(), Counter()
    for i, t, _ in DOCS + extra:
        if train[i]:
            w = lm_tokens(t)
            c.update(w)
            pairs.update(zip([b" ", *w[:-1]], w))
    n, v = sum(c.values()), len(c)
    r = {x: 1.5 * 2 ** (k.bit_length() - 1) - 0.5 for x, k in (c | pairs).items()}
    room, sums = sum(r[x] for x in c), Counter()
    for h, w in pairs:
        sums[h] += r[h, w]

    def p(h, w):
        return (r.get((h, w), 0) + lm_score.MU * (r.get(w, 0) + 0.1) / (room + 0.1 * (v + 1))) / (sums[h] + lm_score.MU)

    for h in [*c, b"never seen"]:        # probabilities over the words and one unknown
        assert math.isclose(sum(p(h, w) for w in [*c, b"\0unknown"]), 1.0, rel_tol=1e-9)
    for heavy in (4_000_000, 10):        # all counts broadcast, and most of them joined
        monkeypatch.setattr(lm_score, "HEAVY", heavy)
        rows = lm_score.score(df, "train", key_bits=256).collect()       # next to no filter errors
        assert len(rows) == len(DOCS) + len(extra)
        text = {i: t for i, t, _ in DOCS + extra}
        for row in rows:
            w = lm_tokens(text[row["doc_id"]])
            base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
            assert row["n_tokens"] == len(w) and row["n_known"] == sum(c[x] > 0 for x in w) and row["train_tokens"] == n
            assert math.isclose(row["base_score"], base, rel_tol=1e-9) and row["held_out"] == (not train[row["doc_id"]])
            want = sum(math.log10(p(h, x)) for h, x in zip([b" ", *w[:-1]], w))
            assert row["score"] <= 0 and math.isclose(row["score"], want, rel_tol=1e-6)
    assert lm_score.score(none.withColumn("train", F.lit(True)), "train").count() == 0
    untrained = lm_score.score(crowded.withColumn("train", F.lit(False)), "train").collect()
    assert {x["n_known"] for x in untrained} == {0} and {x["train_tokens"] for x in untrained} == {0}
    assert all(-1e-9 < x["score"] <= 0 for x in untrained)       # one unknown word has the whole share
    contexts = np.random.default_rng(1).integers(0, 1 << 48, 1000, dtype=np.uint64)
    assert (lm_score.from_six_bytes(lm_score.six_bytes(contexts)) == contexts).all()


def test_filter_reads_counts_back():
    rng = np.random.default_rng(0)
    grams = np.unique(rng.integers(0, 1 << 48, 5000, dtype=np.uint64))
    counts = rng.integers(1, 300, len(grams))
    assert (lm_score.unpacked(lm_score.packed(grams)) == grams).all()
    level = 1 + np.floor(np.log2(counts)).astype(int)
    n_bits = int(level.sum()) * lm_score.BITS // 512 * 512 + 512
    bits = np.zeros(n_bits, dtype=bool)
    for k in range(1, level.max() + 1):
        for at in lm_score.places(grams[level >= k], k, n_bits):
            bits[at] = True

    class Held:
        value = (np.zeros(1, np.int64), np.array([n_bits]), np.packbits(bits, bitorder="little").tobytes())

    got = lm_score.Filter([(0, 1, Held)], 1).counts(grams)
    floor = np.exp2(level - 1.0)
    assert (got >= floor).all() and np.mean(got < 2 * floor) > 0.95           # never too low, seldom too high
    unknown = rng.integers(0, 1 << 48, 5000, dtype=np.uint64)
    assert np.mean(lm_score.Filter([(0, 1, Held)], 1).counts(unknown) > 0) < 0.05


def test_language_codes_equal_a_brute_force_tree(spark):
    rows = [("en", "the thing and the other thing"), ("de", "der die das und die andere"), ("en", "and then"), (None, "nothing"), ("fr", None)]
    model = language.learn(spark.createDataFrame(rows, "lang string, text string"))
    assert model["langs"] == ["de", "en"]
    size, sym = model["size"], model["symbols"]
    fold = lambda t: [int(sym[b]) for b in t.encode().translate(language._FOLD)]
    for k, name in enumerate(model["langs"]):
        n = [defaultdict(Counter) for _ in range(3)]
        for lang, t in rows:
            if lang == name and t:
                x = [0, 0, *fold(t)]
                for i in range(2, len(x)):
                    for o in range(3):
                        n[o][tuple(x[i - o:i])][x[i]] += 1

        def p(context, s, o):
            below = p(context[1:], s, o - 1) if o else 1 / size
            seen = n[o][tuple(context)]
            total, kinds = sum(seen.values()), len(seen)
            return below if not total else seen[s] / (total + kinds) if seen[s] else kinds / (total + kinds) * below

        for t in ("the und other", "xyz 日本", "a"):
            x = [0, 0, *fold(t)]
            want = -sum(math.log2(p(x[i - 2:i], x[i], 2)) for i in range(2, len(x)))
            assert math.isclose(language.code_lengths([t, "", t], model)[0][2, k], want, rel_tol=1e-5)


def test_language_learns_every_row(spark, monkeypatch):
    many = spark.range(120_000).select(F.lit("en").alias("lang"), F.lit("the thing").alias("text"))
    rare = [(f"l{i:02d}", f"only {i}") for i in range(20)]
    monkeypatch.setattr(language, "ENTRIES", 50)
    model = language.learn(many.unionByName(spark.createDataFrame(rare, "lang string, text string")).repartition(3))
    assert model["langs"] == ["en", *[name for name, _ in rare]]
    x, size = [0, 0, *[int(model["symbols"][b]) for b in b"the thing".translate(language._FOLD)]], model["size"]
    n = 120_000       # "th" is followed by "e" and by "i" once each in every copy
    assert math.isclose(model["bits"][0][(x[2] * size + x[3]) * size + x[4]], -math.log2(n / (2 * n + 2)), rel_tol=1e-6)


def test_language_edges(crowded, none, spark):
    rows = [("en", "the cat sat on the mat and looked at the other cat " * 3), ("fr", "le chat est sur la table et regarde les autres chats " * 3)]
    model = language.learn(spark.createDataFrame(rows, "lang string, text string"))
    got = language.identify(crowded, model)
    assert got.columns.count("score") == 1
    said = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got.select("doc_id", "lang_pred", "score").collect()}
    assert said[2] == said[3] == said[7] == ("und", 0.0) and said[1][0] == said[5][0] == "en"
    assert all(0 <= s <= 1 for _, s in said.values()) and got.count() == len(DOCS)
    assert language.identify(none, model).count() == 0
    nothing = language.learn(none)
    assert {r["lang_pred"] for r in language.identify(crowded, nothing).collect()} == {"und"}


def test_operators_keep_other_columns(crowded):
    out = simhash.fingerprint(crowded)
    assert {c for c in crowded.columns if c != "simhash"} < set(out.columns)
    assert set(EXTRA) & set(out.columns)
