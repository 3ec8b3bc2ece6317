"""Edge rows and brute force for ranked search, configuration packing and centroid clustering."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vitalis.llm import centroids, config_lp, fp_rank

from .conftest import DOCS

WORDS = public_tokenizers.path("word_bpe_49k.json")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ---------------------------------------------------------------- ranked search

def split(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranks(docs, items, top):
    """[(item row, [(doc_id, score)])] by the definition."""
    held = [(i, Counter(split(t)), len(split(t))) for i, t in docs]
    n_docs, length = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        best = []
        for i, tf, n in held:
            score = 0
            for t in set(split(text)):
                if t in tf:
                    m = 50 + (50 * n * n_docs) // length
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m))
            if score > 0:
                best.append((-score, i is None, i or 0))
        out.append((item, [(None if none else i, -s) for s, none, i in sorted(best)[:top]]))
    return out


def test_terms_are_those_of_the_pattern():
    draw = random.Random(2)
    for _ in range(300):
        s = "".join(draw.choice(["A", "z", "0", " ", "_", "é", "É", "\x7f", "\x80", "-", "中", "\n", "{", "`"]) for _ in range(draw.randrange(30)))
        assert [t.decode() for t in fp_rank.terms(s)] == split(s)


def test_tree_search_equals_brute_force():
    draw = random.Random(4)
    for trial in range(30):
        vocabulary = [f"w{i}".encode() for i in range(40)]
        docs = []
        for i in range(draw.randrange(1, 120)):
            tf = {t: draw.choice([1, 1, 1, 2, 3, 9]) for t in draw.sample(range(40), draw.randrange(1, 12))}
            if docs and draw.random() < 0.3:
                tf = dict(docs[draw.randrange(len(docs))][2])
            docs.append((draw.randrange(1 << 40) if draw.random() < 0.9 else fp_rank.NO_ID, draw.choice([50, 60, 60, 300]), tf))
        df = Counter(vocabulary[t] for _, _, tf in docs for t in tf)
        items = [(q, draw.sample(vocabulary, draw.randrange(0, 8))) for q in range(9)]
        queries, top = fp_rank.Queries(items, df, len(docs)), draw.choice([1, 5, 50])
        rows = []
        for i, m, tf in docs:
            at = sorted((queries.number[vocabulary[t]], c) for t, c in tf.items() if vocabulary[t] in queries.number)
            if at:
                rows.append((i, m, np.array([a for a, _ in at]), np.array([c for _, c in at])))
        best = fp_rank.Best(len(items), top)
        for lo in range(0, len(rows), 50):
            fp_rank.search(fp_rank.tree(rows[lo:lo + 50], top), queries, best)
        for (_, wanted), heap in zip(items, best.heaps, strict=True):
            scores = []
            for i, m, tf in docs:
                s = sum(int(queries.weight[queries.number[t]]) * ((10**9 * tf[int(t[1:])]) // (1000 * tf[int(t[1:])] + 20 * m))
                        for t in wanted if int(t[1:]) in tf)
                if s > 0:
                    scores.append((-s, i))
            assert sorted((-s, -i) for s, i in heap) == sorted(scores)[:top], trial


def test_bounds_prune():
    """A subtree that cannot reach the list is left out."""
    queries = fp_rank.Queries([(0, [b"a", b"b"])], {b"a": 300, b"b": 299}, 1000)
    both = [(i, 50, np.array([0, 1]), np.array([9, 9])) for i in range(60)]
    one = [(1000 + i, 50, np.array([1]), np.array([1 + i])) for i in range(200)]
    best = fp_rank.Best(1, 50)
    assert fp_rank.search(fp_rank.tree(both, 50), queries, best) == 1
    assert fp_rank.search(fp_rank.tree(one, 50), queries, best) == 0


@pytest.fixture(scope="module")
def searched(spark):
    draw = random.Random(9)
    words = ["fox", "Dog", "lazy", "the", "quick", "déjà", "x1", "中文", "over", "jumps", "rare"]
    docs = [(i, t) for i, t, _ in DOCS] + [(100 + i, " ".join(draw.choice(words[:10]) for _ in range(draw.randrange(40)))) for i in range(150)]
    docs += [(500 + i, "the lazy copy over and over") for i in range(70)] + [(-3, "rare dog"), (-3, "rare dog")]
    items = [(1, "The quick fox"), (2, None), (3, ""), (None, "rare dog the"), (4, "over over, lazy!"), (4, "over over, lazy!"), (5, "nothing-here zzz"), (6, "中文 déjà")]
    return docs, items


@pytest.mark.parametrize("most_pairs", [fp_rank.MOST_PAIRS, 4])
def test_rank_equals_brute_force(spark, searched, most_pairs):
    docs, items = searched
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(7).withColumn("rank", F.lit(1)).withColumn("SCORE", F.lit("x"))
    q = spark.createDataFrame(items, "item_id long, text string").repartition(3).withColumn("row", F.lit(0))
    rows = fp_rank.rank(d, q, most_pairs=most_pairs).collect()
    want = Counter((item, r + 1, i, s) for item, best in ranks(docs, items, 50) for r, (i, s) in enumerate(best))
    assert Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows) == want


def test_rank_of_empty_tables(spark, searched, none):
    docs, items = searched
    q = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert fp_rank.rank(none, q).collect() == []
    empty = fp_rank.rank(d, q.limit(0))
    assert empty.collect() == [] and empty.columns == ["item_id", "rank", "doc_id", "score"]
    assert fp_rank.rank(spark.createDataFrame([(1, None), (2, " . ")], "doc_id long, text string"), q).collect() == []


# ---------------------------------------------------------------- packing

def whole_ids(text):
    from tokenizers import Tokenizer

    whole_ids.tok = getattr(whole_ids, "tok", None) or Tokenizer.from_file(WORDS)
    return whole_ids.tok.encode(text or "", add_special_tokens=False).ids


def test_codec_gives_the_librarys_ids():
    codec, draw = config_lp.WordCodec(WORDS), random.Random(1)
    assert codec.by_run and codec.ranked is not None
    bits = ["a", "B", "'s", "'S", " ", "  ", "\n", "\x0b", "\x1c", "\x85", "\xa0", "é", "é", "İ", "Σ", "中文", "1", "٣", "!!", "<|endoftext|>",
            "<|ENDOFTEXT|>", "ll", "'LL", "ÿ", "ß", "ŉ", "Ǆ", "×", "ª", "word", "​", "ﬁ", "　", "_", "ther", "ing", "y" * 70, "-", ".", "ƀ", "ȿ", "ɐ", "Ⱥ", "÷"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randrange(14))) for _ in range(4000)] + [t or "" for _, t, _ in DOCS]
    texts += ["a " * 3 + "z" * 5000, "y" * 40_000]
    for t, ids in zip(texts, codec.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == whole_ids(t)
    cut = pa.array(["left out", *texts[:9], None, ""]).slice(1)
    assert [i.tolist() for i in codec.encode(cut)] == [whole_ids(t) for t in [*texts[:9], None, ""]]
    assert codec.encode(pa.array([], pa.string())) == []


def test_other_files_are_encoded_whole():
    codec = config_lp.WordCodec(public_tokenizers.path("byte_bpe_50k.json"))
    assert not codec.by_run
    assert codec.encode(pa.array(["Two words"]))[0].tolist() == codec.hf.encode("Two words", add_special_tokens=False).ids


def test_knapsack_equals_enumeration():
    draw = random.Random(6)
    for _ in range(60):
        sizes = np.array(sorted(draw.sample(range(1, 15), draw.randrange(1, 5))))
        prices = np.array([draw.random() * s for s in sizes])
        room = draw.randrange(1, 20)
        value, counts = config_lp.knapsack(sizes, prices, room)
        every = (c for c in itertools.product(*[range(room // s + 1) for s in sizes]) if np.dot(c, sizes) <= room)
        assert value == pytest.approx(max(np.dot(c, prices) for c in every))
        assert sum(sizes[i] * n for i, n in counts.items()) <= room
        assert sum(prices[i] * n for i, n in counts.items()) == pytest.approx(value)


def test_program_covers_and_comes_close_to_its_bound():
    draw = random.Random(8)
    sizes = np.array(sorted(draw.sample(range(20, 400), 30)))
    demand = np.array([draw.randrange(1, 300) for _ in sizes])
    cover = config_lp.solve(sizes, demand, 512)
    got = np.zeros(len(sizes))
    for config, x in cover.items():
        assert sum(sizes[i] * n for i, n in config) <= 512 and x > 0
        for i, n in config:
            got[i] += n * x
    assert (got >= demand * (1 - 1e-6)).all()
    taken = config_lp.rounded(cover, demand)
    used = np.zeros(len(sizes), dtype=int)
    for config, times in taken:
        for i, n in config:
            used[i] += n * times
    assert (used <= demand).all() and used.sum() > 0.7 * demand.sum()


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_every_piece(seed):
    draw, window = random.Random(seed), 4096
    histogram = np.zeros(window + 1, dtype=np.int64)
    for _ in range(draw.choice([0, 1, 5, 800])):
        histogram[draw.choice([draw.randrange(1, window + 1), draw.randrange(1, 900), 7, 2049])] += draw.choice([1, 1, 2, 40, 5000])
    bundles, placed = config_lp.plan(histogram, window)
    held = np.zeros_like(histogram)
    for content, copies in bundles:
        assert sum(n * c for n, c in content) <= window and copies > 0
        for n, c in content:
            held[n] += c * copies
    assert (held == histogram).all() and 0 <= placed <= histogram.sum()


def test_plan_needs_few_more_than_the_lower_bound():
    draw, window = np.random.default_rng(3), 4096
    lengths = np.clip(draw.lognormal(6.3, 1.0, 4000).astype(int), 1, window)
    bundles, placed = config_lp.plan(np.bincount(lengths, minlength=window + 1), window)
    bound = -(-int(lengths.sum()) // window)
    assert sum(c for _, c in bundles) <= 1.01 * bound + 1
    assert placed > 0.5 * len(lengths)


def test_pack_documents(crowded, none, spark):
    window = 64
    rows = config_lp.pack(crowded, WORDS, window=window).collect()
    assert sorted(rows[0].asDict()) == ["doc_id", "ids", "length", "offset", "piece", "sequence_id", "start"]
    sequences, documents = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] <= window and r["start"] == r["piece"] * window
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        documents.setdefault((r["doc_id"], r["piece"]), []).append(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    want = {}
    for i, t, _ in DOCS:
        ids = [*whole_ids(t), 1]
        for p in range(-(-len(ids) // window)):
            want.setdefault((i, p), []).append(ids[p * window:(p + 1) * window])
    assert {k: sorted(v) for k, v in documents.items()} == {k: sorted(v) for k, v in want.items()}
    empty = config_lp.pack(none, WORDS)
    assert empty.collect() == [] and empty.columns == config_lp.pack(crowded, WORDS).columns


# ---------------------------------------------------------------- centroids

def lloyd(rows, k=16, rounds=3, dims=64):
    kept = [(i, np.floor(64 * np.array(v, dtype=float)).astype(np.int64)) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1].tolist()))
    centres = [v for _, v in order[:k]]
    near = lambda v: min((int(((v - c) ** 2).sum()), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [np.array([sum(int(v[j]) for v in groups[n]) // len(groups[n]) for j in range(dims)]) if n in groups else c for n, c in enumerate(centres)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, d, c in found:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), tuple(centres[c].tolist())) for i, d, c in found)


def clustered(df, **kw):
    return Counter((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], tuple(r["centroid"])) for r in centroids.cluster(df, **kw).collect())


def test_nearest_equals_brute_force():
    draw = np.random.default_rng(5)
    for spread in (3, 1000, centroids.LARGEST):
        points = draw.integers(-spread, spread + 1, (300, 64))
        centres = np.vstack([draw.integers(-spread, spread + 1, (12, 64)), points[:3], points[:1]])
        pivots = np.vstack([points[3:10], points[3:5]])
        near = np.sqrt(np.array([centroids.squares(points, p) for p in pivots], dtype=float)).T
        who, best, _ = centroids.nearest(points, near, centres, pivots, centroids.pivot_pairs(pivots))
        every = np.array([centroids.squares(points, c) for c in centres])
        assert (best == every.min(0)).all() and (who == every.argmin(0)).all()


def test_bounds_skip_far_centroids():
    draw = np.random.default_rng(7)
    middles = draw.integers(-2000, 2000, (16, 64))
    points = np.repeat(middles, 40, axis=0) + draw.integers(-20, 21, (640, 64))
    near = np.sqrt(np.array([centroids.squares(points, p) for p in middles], dtype=float)).T
    who, _, checked = centroids.nearest(points, near, middles + 1, middles, centroids.pivot_pairs(middles))
    assert (who == np.repeat(np.arange(16), 40)).all() and checked.mean() < 1.5


def test_clusters_equal_brute_force(spark):
    draw = random.Random(11)
    middles = [[draw.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [x + draw.gauss(0, 0.3) for x in draw.choice(middles)]) for i in range(400)]
    rows += [(i, list(rows[7][1])) for i in (7, 7, 1001, 1002)] + [(None, [0.5] * 64), (None, [0.5] * 64)]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 65), (2004, [float("nan")] * 64), (2005, [float("inf")] + [0.0] * 63), (2006, [None] + [0.0] * 63)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).select("*", F.lit("x").alias("cluster"), F.lit(1).alias("DISTANCE"), F.lit(2).alias("point"))
    assert clustered(df) == lloyd(rows)
    assert clustered(df.select("vec_id", "embedding").where("vec_id < 6"), rounds=2) == lloyd([r for r in rows if r[0] is not None and r[0] < 6], rounds=2)


def test_cluster_edges(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    found = centroids.cluster(none)
    assert found.collect() == [] and found.columns == ["vec_id", "cluster", "distance", "checked", "cluster_inertia", "inertia", "centroid"]
    same = spark.createDataFrame([(i, [0.25, -0.26]) for i in range(40)], "vec_id long, embedding array<float>")
    rows = centroids.cluster(same, dims=2).collect()
    assert {(r["cluster"], r["distance"], r["inertia"], tuple(r["centroid"])) for r in rows} == {(0, 0, 0, (16, -17))} and len(rows) == 40
    huge = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        centroids.cluster(huge)
