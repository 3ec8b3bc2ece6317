"""Distributed ranks, order-statistic splits and projected neighbours: brute force, hot keys, plans."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitalis.operators import neighbors as N
from vitalis.operators import prep as P
from vitalis.operators import sampling as S
from vitalis.operators.ranking import range_ranked
from vitalis.operators.smote import smote_union


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_rank_equals_sorting(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["a", "b", None]), draw.choice([None, 1, 2, 2, 3, 50]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(6)
    got = range_ranked(df, ["g"], ["v", "id"]).collect()
    assert len(got) == len(rows)
    for g in ("a", "b", None):
        order = sorted(((v is not None, v or 0, i) for gg, v, i in rows if gg == g))
        assert [r["id"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["rank"])] == [i for *_, i in order]
        assert sorted(r["rank"] for r in got if r["g"] == g) == list(range(len(order)))


def test_range_rank_parts_one_repeated_row(spark):
    df = spark.range(4000).select(F.lit("x").alias("g"), F.lit(7).alias("v"))
    got = range_ranked(df, ["g"], ["v"])
    assert sorted(r["rank"] for r in got.collect()) == list(range(4000))
    assert range_ranked(df.limit(0), ["g"], ["v"]).collect() == []


@pytest.mark.parametrize("bits", [0, 3, 20])
def test_split_equals_ranking_all_rows(spark, bits):
    draw = random.Random(bits)
    rows = [(i if draw.random() < 0.7 else None, draw.choice([0, 0, 0, 1, None]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, y int, n int").repartition(5)
    split = S.stratified_split(df, "id", "y", bits=bits, tiebreak=["n"])
    ranked = S.ranked(df.withColumn("_h", S.hash_key("id")), ["y"], "_h", ["id", "n"], "r", "size", bits=4)
    want = {}
    for r in ranked.collect():
        a = int(r["size"] * 0.6 + 0.5)
        want[r["n"]] = "train" if r["r"] < a else "val" if r["r"] < a + int(r["size"] * 0.2 + 0.5) else "test"
    assert {r["n"]: r["split"] for r in split.collect()} == want


def test_hot_null_id_is_split_exactly(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id")).alias("id"), F.lit(1).alias("y"))
    parts = Counter(r["split"] for r in S.stratified_split(df, "id", "y").collect())
    assert parts == {"train": 1800, "val": 600, "test": 600}
    two = df.withColumn("y", (F.col("id") % 9 == 0).cast("int")).fillna(0, ["y"])
    sizes = Counter(r["y"] for r in S.downsample(two, "id", "y").collect())
    assert sizes[0] == sizes[1] == 334


def test_split_moves_only_the_rows_of_cut_buckets(spark):
    df = spark.range(20000).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    lines = _plan(S.stratified_split(df, "id", "y")).splitlines()
    top = next(i for i, line in enumerate(lines) if "Union" in line)
    column = lines[top].index("Union")
    clear = [line for line in lines[top + 1:] if line[column:column + 1] == ":"]      # the rows outside the cut buckets
    assert any("BroadcastHashJoin" in line for line in clear)
    assert not any(w in line for line in clear for w in ("Window", "Sort", "hashpartitioning", "rangepartitioning"))


def test_too_many_classes_raise(spark):
    df = spark.range(S.MAX_CLASSES + 1).select("id", F.col("id").alias("y"))
    with pytest.raises(ValueError, match="no class column"):
        S.stratified_split(df, "id", "y")


def test_label_codes_of_a_column_with_as_many_values_as_rows(spark):
    rows = [(f"v{i:05d}", "ab"[i % 2] if i % 5 else None) for i in range(3000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "many string, few string").repartition(6)
    codes = P.fit_label_codes(df, ["many", "few"])
    assert "Window" not in _plan(codes).split("Join")[0]
    got = {(r["column"], r["value"]): (r["code"], r["freq"]) for r in codes.collect()}
    assert [got["many", f"v{i:05d}"] for i in range(3000)] == [(i, 1) for i in range(3000)]
    assert [got["few", v][0] for v in ("a", "b", "nan")] == [0, 1, 2]


def test_projection_knn_finds_most_neighbours(spark):
    rng = np.random.default_rng(4)
    pts = np.concatenate([rng.normal(c, 1, (150, 8)) for c in (0, 3, 9)])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pts)], "id long, x array<double>").repartition(4)
    exact = N.exact_knn(df, 4)
    found = N.projection_knn(df, 4, cell=32)
    r = N.recall(found, exact).first()
    assert (r["points"], r["wanted"]) == (450, 1800) and r["recall"] >= 0.9
    true = {(i, j): float(np.sqrt(((pts[i] - pts[j]) ** 2).sum())) for i in range(450) for j in range(450)}
    rows = found.collect()
    assert all(abs(true[r["q_id"], r["c_id"]] - r["dist"]) < 1e-9 and r["q_id"] != r["c_id"] for r in rows)
    assert Counter(r["q_id"] for r in rows) == {i: 4 for i in range(450)}
    again = N.projection_knn(df.repartition(9), 4, cell=32)
    assert sorted(map(tuple, again.select("q_id", "c_id", "rank").collect())) == sorted((r["q_id"], r["c_id"], r["rank"]) for r in rows)


def test_projection_knn_with_a_large_group_of_copies(spark):
    """Cells hold equal numbers of rows whatever the points are."""
    df = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(2.0))).otherwise(F.array(F.col("id") * 1.0, F.lit(0.0))).alias("x"))
    rows = N.projection_knn(df, 3, tables=4, cell=16).collect()
    assert all(r["dist"] == 0 for r in rows if r["q_id"] % 3 == 0) and Counter(r["q_id"] for r in rows) == {i: 3 for i in range(900)}
    assert N.projection_knn(df.limit(1), 3).collect() == [] and N.projection_knn(df.limit(0), 3).collect() == []


def test_smote_by_projection(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, int(i < 30), *[float(v) for v in rng.normal(size=3)]) for i in range(120)], "id long, y int, a double, b double, c double")
    out = smote_union(df, "id", "y", ["a", "b", "c"], neighbours="projection")
    assert {(r["y"], r["synthetic"]): r["count"] for r in out.groupBy("y", "synthetic").count().collect()} == {(1, 0): 30, (0, 0): 90, (1, 1): 60}
    with pytest.raises(KeyError):
        smote_union(df, "id", "y", ["a"], neighbours="other")


def test_exact_knn_deals_a_large_block_into_tiles(spark, monkeypatch):
    """A block of many equal and near points takes several tasks and keeps exact distances, ties by id."""
    monkeypatch.setattr(N, "TILE", 16)
    rng = np.random.default_rng(8)
    pts = np.concatenate([np.repeat([[1.0, 2.0, 3.0]], 70, axis=0), rng.normal(1, 1e-3, (60, 3)), rng.normal(0, 5, (30, 3))])
    df = spark.createDataFrame([(int(i), [float(v) for v in p]) for i, p in enumerate(pts)], "id long, x array<double>")
    blocks = df.select("id", "x", F.lit(0).alias("block"))
    tiles = N._inside(blocks.select(F.col("id").alias("q_id"), F.col("x").alias("qx"), "block"), blocks, 4)
    exact = sorted((r["q_id"], r["c_id"], r["rank"], r["dist"]) for r in N.exact_knn(df, 4).collect())
    want, inside = [], []
    for i, p in enumerate(pts):
        d = [sum((float(a) - float(b)) ** 2 for a, b in zip(p, o)) for o in pts]
        best = sorted((x, j) for j, x in enumerate(d) if j != i)[:4]
        want += [(i, j, rank, x ** 0.5) for rank, (x, j) in enumerate(best, 1)]
        inside += [(i, j) for _, j in best]
    assert [(q, c) for q, c, _, _ in sorted(exact, key=lambda r: (r[0], r[2]))] == inside
    assert sorted((q, r) for q, _, r, _ in exact) == sorted((q, r) for q, _, r, _ in want)
    assert all(abs(a[3] - b[3]) < 1e-12 for a, b in zip(sorted(exact, key=lambda r: (r[0], r[2])), want))
    assert sorted((r["q_id"], r["c_id"]) for r in tiles.collect()) == sorted(inside)
    assert N.exact_knn(df.limit(1), 4).collect() == [] and N.exact_knn(df.limit(0), 4).collect() == []


def test_vectors_are_sent_once_to_a_group_of_blocks(spark, monkeypatch):
    """Evenly spread points visit nearly all blocks: a point goes to few groups, and the neighbours are those of brute force."""
    rng = np.random.default_rng(8)
    pts = rng.normal(size=(600, 12)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pts)], "id long, x array<float>")
    sent = []

    def spy(q, own, k, real=N._inside):
        sent.append((q.count(), q.schema["qx"].dataType.simpleString()))
        return real(q, own, k)

    monkeypatch.setattr(N, "_inside", spy)
    got = {(r["q_id"], r["rank"]): r["c_id"] for r in N.exact_knn(df, 3, n_blocks=50).collect()}
    assert sent[1][0] <= 8 * len(pts) and sent[1][1] == "array<float>"      # about 50 times before
    x = pts.astype(float)
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        assert [got[(i, r)] for r in (1, 2, 3)] == np.lexsort((np.arange(len(x)), d))[:3].tolist()


def test_orders_of_projections_carry_no_vectors(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 10), float(i // 10)]) for i in range(300)], "id long, x array<double>")
    columns = []

    def spy(rows, *a, real=N.range_ranked):
        columns.extend(rows.columns)
        return real(rows, *a)

    monkeypatch.setattr(N, "range_ranked", spy)
    monkeypatch.setattr(N, "SPAN", 32)      # several spans of two cells
    found = N.projection_knn(df, 2, tables=6, cell=16)
    assert N.recall(found, N.exact_knn(df, 2)).first()["recall"] > 0.9
    assert "x" not in columns
