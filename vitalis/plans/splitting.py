"""Split / resample plans (D2-D6, D8, D9) with oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import sampling as S
from . import extraction as X
from .common import rounded, sql_round, table

SEED = 42
FRACTIONS = (0.6, 0.2, 0.2)
SAMPLE_N = 1000
IMPUTE_COLS = ["height_cm", "weight_kg", "bmi", "click_mean", "view_std", "ECONOMY_mean", "SMALL_count"]


def labels(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").select("doc_id", "toxic")


def line_rows(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_id"),
                     (F.col("l_returnflag") == "R").cast("int").alias("label"))


def split_labels(spark, sf) -> DataFrame:
    return S.stratified_split(labels(spark, sf), "doc_id", "toxic", FRACTIONS, seed=SEED)


def q_split(spark, sf):
    return split_labels(spark, sf)


def q_split_lines(spark, sf):
    return S.stratified_split(line_rows(spark, sf), "line_id", "label", FRACTIONS, seed=SEED)


def q_split_profile(spark, sf):
    return rounded(S.split_profile(split_labels(spark, sf), "toxic"))


def q_split_conservation(spark, sf):
    return S.split_conservation(labels(spark, sf), split_labels(spark, sf), "doc_id") \
        .withColumn("conserved", F.col("conserved").cast("int"))


def train_part(spark, sf) -> DataFrame:
    return split_labels(spark, sf).where(F.col("split") == "train").drop("split")


def q_downsample(spark, sf):
    return S.downsample(train_part(spark, sf), "doc_id", "toxic", seed=SEED, shuffle_col=None)


def q_downsample_lines(spark, sf):
    return S.downsample(line_rows(spark, sf), "line_id", "label", seed=SEED, shuffle_col=None)


def q_sample_rows(spark, sf):
    return S.sample_rows(line_rows(spark, sf), "line_id", SAMPLE_N, seed=SEED)


DOC_SMOTE_FEATURES = ["n_chars", "quality", "text_len", "n_digits", "n_upper"]


def q_variant_sizes(spark, sf):
    """Original / down-sampled / SMOTE train variants of the document table."""
    from ..operators.smote import smote_union
    from .reporting import doc_features
    d = S.stratified_split(doc_features(spark, sf), "doc_id", "toxic", FRACTIONS, seed=SEED)
    tr = d.where(F.col("split") == "train").drop("split")
    v = S.variants({"original": tr, "downsampling": S.downsample(tr, "doc_id", "toxic", seed=SEED),
                    "smote": smote_union(tr, "doc_id", "toxic", DOC_SMOTE_FEATURES, categorical=["quality"],
                                         seed=SEED)})
    return v.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("toxic") == 1).alias("positives"))


def wide_split(spark, sf) -> DataFrame:
    w = Q.nans_to_nulls(X.wide_table(spark, sf)).select("subject_id", "label", *IMPUTE_COLS)
    return S.stratified_split(w, "subject_id", "label", FRACTIONS, seed=SEED)


def q_impute(spark, sf):
    w = wide_split(spark, sf)
    means = Q.fit_means(w.where(F.col("split") == "train"), IMPUTE_COLS)
    return rounded(Q.impute(w, means))


QUERIES = {
    "d3_stratified_split": q_split,
    "d3_split_lines": q_split_lines,
    "d4_split_profile": q_split_profile,
    "d4_split_conservation": q_split_conservation,
    "d6_downsample": q_downsample,
    "d6_downsample_lines": q_downsample_lines,
    "d9_sample_rows": q_sample_rows,
    "d8_variant_sizes": q_variant_sizes,
    "d2_impute": q_impute,
}

# ---------------------------------------------------------------------------
# oracle SQL
# ---------------------------------------------------------------------------


def sql_hash(id_expr: str, seed: int = SEED) -> str:
    return f"('0x' || substr(md5(CAST({id_expr} AS VARCHAR) || '|{seed}'), 1, 15))::BIGINT"


def sql_split(src: str, id_col: str, target: str, tiebreak: str = "") -> str:
    """Relation (all columns of ``src`` + split) using the same rank rule as the operator."""
    c1 = f"floor(n * {FRACTIONS[0]} + 0.5)"
    c2 = f"{c1} + floor(n * {FRACTIONS[1]} + 0.5)"
    return f"""(SELECT * EXCLUDE (h, rk, n),
        CASE WHEN rk < {c1} THEN 'train' WHEN rk < {c2} THEN 'val' ELSE 'test' END AS split
      FROM (SELECT *, row_number() OVER (PARTITION BY {target} ORDER BY h, {id_col}{', ' + tiebreak if tiebreak else ''}) - 1 AS rk,
                   count(*) OVER (PARTITION BY {target}) AS n
            FROM (SELECT *, {sql_hash(id_col)} AS h FROM {src})))"""


def sql_downsample(src: str, id_col: str, target: str) -> str:
    return f"""(SELECT * EXCLUDE (h, rk) FROM (
        SELECT *, row_number() OVER (PARTITION BY {target} ORDER BY h, {id_col}) - 1 AS rk
        FROM (SELECT *, {sql_hash(id_col)} AS h FROM {src}))
      WHERE rk < (SELECT min(c) FROM (SELECT count(*) AS c FROM {src} GROUP BY {target})))"""


LABELS = "(SELECT doc_id, toxic FROM labels)"
LINES = "(SELECT l_orderkey * 8 + l_linenumber AS line_id, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem)"
SPLIT_LABELS = sql_split(LABELS, "doc_id", "toxic")
TRAIN = f"(SELECT doc_id, toxic FROM {SPLIT_LABELS} WHERE split = 'train')"

_IMP_SELECT = ", ".join(
    f"{sql_round(f'CASE WHEN m.n_{c} > 0 THEN coalesce(CAST(s.{c} AS DOUBLE), m.m_{c}) ELSE s.{c} END')} AS {c}"
    for c in IMPUTE_COLS)
_IMP_MEANS = ", ".join(f"count_if({c} IS NULL) AS n_{c}, avg({c}) AS m_{c}" for c in IMPUTE_COLS)

SQL = {
    "d3_stratified_split": f"SELECT * FROM {SPLIT_LABELS}",
    "d3_split_lines": f"SELECT * FROM {sql_split(LINES, 'line_id', 'label')}",
    "d4_split_profile": f"""SELECT split, count(*) AS n, {sql_round('count(*) / (SELECT count(*) FROM labels)')} AS share,
        count_if(toxic = 1) AS positives, {sql_round('count_if(toxic = 1) / count(*)')} AS rate
        FROM {SPLIT_LABELS} GROUP BY split""",
    "d4_split_conservation": f"""SELECT (SELECT count(*) FROM (SELECT doc_id FROM {SPLIT_LABELS} GROUP BY doc_id
                                     HAVING count(DISTINCT split) > 1)) AS ids_in_several_parts,
        (SELECT count(*) FROM {SPLIT_LABELS}) AS rows_in_parts, (SELECT count(*) FROM labels) AS rows_in_source,
        CAST((SELECT count(*) FROM {SPLIT_LABELS}) = (SELECT count(*) FROM labels) AS INTEGER) AS conserved""",
    "d6_downsample": f"SELECT * FROM {sql_downsample(TRAIN, 'doc_id', 'toxic')}",
    "d6_downsample_lines": f"SELECT * FROM {sql_downsample(LINES, 'line_id', 'label')}",
    "d9_sample_rows": f"SELECT line_id, label FROM {LINES} ORDER BY {sql_hash('line_id')}, line_id LIMIT {SAMPLE_N}",
    "d8_variant_sizes": f"""SELECT 'original' AS variant, count(*) AS n, count_if(toxic = 1) AS positives FROM {TRAIN}
        UNION ALL SELECT 'downsampling', count(*), count_if(toxic = 1) FROM {sql_downsample(TRAIN, 'doc_id', 'toxic')}
        UNION ALL SELECT 'smote', 2 * greatest(count_if(toxic = 1), count_if(toxic <> 1)),
                         greatest(count_if(toxic = 1), count_if(toxic <> 1)) FROM {TRAIN}""",
}


def _impute_sql() -> str:
    from .quality import WIDE_SQL
    src = f"(SELECT subject_id, label, {', '.join(IMPUTE_COLS)} FROM wide)"
    return f"""WITH {WIDE_SQL}, s AS (SELECT * FROM {sql_split(src, 'subject_id', 'label')}),
        m AS (SELECT {_IMP_MEANS} FROM s WHERE split = 'train')
        SELECT s.subject_id, s.label, s.split, {_IMP_SELECT} FROM s CROSS JOIN m"""


SQL["d2_impute"] = _impute_sql()

# ---------------------------------------------------------------------------
# K-NN and SMOTE on embeddings (class 3 against the rest)
# ---------------------------------------------------------------------------
EMB_DIM = 64
EMB_CLASS = 3
SMOTE_K = 5


def embedding_rows(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", (F.col("label") == EMB_CLASS).cast("int").alias("y"),
                    *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(EMB_DIM)])


def q_knn(spark, sf):
    from ..operators.neighbors import exact_knn
    e = embedding_rows(spark, sf).where(F.col("y") == 1)
    pts = e.select(F.col("vec_id").alias("id"), F.array(*[f"e{i}" for i in range(EMB_DIM)]).alias("x"))
    n = pts.count()
    return rounded(exact_knn(pts, min(SMOTE_K, n - 1)))


def q_smote(spark, sf):
    from ..operators.smote import smote
    syn, _ = smote(embedding_rows(spark, sf), "vec_id", "y", [f"e{i}" for i in range(EMB_DIM)], k=SMOTE_K, seed=SEED)
    total = sum((F.col(f"e{i}") for i in range(EMB_DIM)), F.lit(0.0))
    return rounded(syn.select("vec_id", "_base_id", "_neighbor_id", "gap", "e0", "e1", total.alias("x_sum")))


def q_smote_counts(spark, sf):
    from ..operators.smote import smote_union
    out = smote_union(embedding_rows(spark, sf), "vec_id", "y", [f"e{i}" for i in range(EMB_DIM)], k=SMOTE_K, seed=SEED)
    return out.groupBy("y", "synthetic").agg(F.count(F.lit(1)).alias("n"))


RECALL_CELL = 64        # small cells, so that the small tables do not fit one


def q_projection_recall(spark, sf):
    """Neighbours of every embedding by random projections, held against the exact ones."""
    from ..operators.neighbors import exact_knn, projection_knn, recall
    pts = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("x"))
    found = projection_knn(pts, SMOTE_K, cell=RECALL_CELL, seed=SEED)
    return recall(found, exact_knn(pts, SMOTE_K)).select("points", "wanted", (F.col("recall") >= 0.9).cast("int").alias("enough"))


def q_smote_projection(spark, sf):
    """D7 with projected neighbours: sizes, and synthetic rows that do not lie between a row and a neighbour of its class."""
    from ..operators.smote import smote
    feats = [f"e{i}" for i in range(EMB_DIM)]
    rows = embedding_rows(spark, sf)
    syn, kept = smote(rows, "vec_id", "y", feats, k=SMOTE_K, seed=SEED, neighbours="projection")
    a = rows.select(F.col("vec_id").alias("_base_id"), F.col("y").alias("ya"), F.array(*feats).alias("xa"))
    b = rows.select(F.col("vec_id").alias("_neighbor_id"), F.col("y").alias("yb"), F.array(*feats).alias("xb"))
    j = syn.join(a, "_base_id").join(b, "_neighbor_id")
    off = F.exists(F.zip_with(F.array(*feats), F.zip_with("xa", "xb", lambda p, q: p + F.col("gap") * (q - p)), lambda x, y: F.abs(x - y)), lambda e: e > 1e-9)
    bad = off | (F.col("ya") != 1) | (F.col("yb") != 1) | (F.col("_base_id") == F.col("_neighbor_id"))
    made = j.agg(F.count(F.lit(1)).alias("synthetic"), F.count_if(bad).alias("misplaced"))
    return made.crossJoin(kept.agg(F.count(F.lit(1)).alias("kept")))


QUERIES.update({"d7_projection_recall": q_projection_recall, "d7_smote_projection": q_smote_projection, "d7_exact_knn": q_knn, "d7_smote": q_smote, "d7_smote_counts": q_smote_counts})

_EMB = f"""pts AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label = {EMB_CLASS}),
kk AS (SELECT least({SMOTE_K}, count(*) - 1) AS k, count(*) AS n_min FROM pts),
knn AS (SELECT q_id, c_id, rank, dist FROM (
    SELECT q.id AS q_id, c.id AS c_id,
           row_number() OVER (PARTITION BY q.id ORDER BY list_sum(list_transform(range(1, {EMB_DIM} + 1),
                 lambda i: (q.x[i] - c.x[i]) * (q.x[i] - c.x[i]))), c.id) AS rank,
           sqrt(list_sum(list_transform(range(1, {EMB_DIM} + 1), lambda i: (q.x[i] - c.x[i]) * (q.x[i] - c.x[i])))) AS dist
    FROM pts q JOIN pts c ON q.id <> c.id) WHERE rank <= (SELECT k FROM kk))"""


def _draw(tag: str) -> str:
    return f"('0x' || substr(md5(CAST(j AS VARCHAR) || '|{tag}|{SEED}'), 1, 15))::BIGINT"


_SMOTE = f"""{_EMB},
idx AS (SELECT id, x, row_number() OVER (ORDER BY {sql_hash('id')}, id) - 1 AS base_idx FROM pts),
gen AS (SELECT j, {_draw('base')} % (SELECT n_min FROM kk) AS base_idx,
               CAST({_draw('nn')} % (SELECT k FROM kk) + 1 AS INTEGER) AS rank,
               CAST({_draw('gap')} AS DOUBLE) / {float(2 ** 60)!r} AS gap
        FROM (SELECT unnest(range((SELECT count(*) FROM embeddings WHERE label <> {EMB_CLASS})
                                  - (SELECT n_min FROM kk))) AS j)),
syn AS (SELECT g.j, i.id AS base_id, n.c_id AS neighbor_id, g.gap,
               list_transform(range(1, {EMB_DIM} + 1), lambda t: i.x[t] + g.gap * (p.x[t] - i.x[t])) AS nx
        FROM gen g JOIN idx i USING (base_idx) JOIN knn n ON n.q_id = i.id AND n.rank = g.rank
        JOIN pts p ON p.id = n.c_id)"""

SQL.update({
    "d7_projection_recall": f"""SELECT count(*) AS points, CAST(count(*) * least({SMOTE_K}, count(*) - 1) AS BIGINT) AS wanted, 1 AS enough FROM embeddings""",
    "d7_smote_projection": f"""SELECT CAST(count_if(label <> {EMB_CLASS}) - count_if(label = {EMB_CLASS}) AS BIGINT) AS synthetic,
        CAST(0 AS BIGINT) AS misplaced, count(*) AS kept FROM embeddings""",
    "d7_exact_knn": f"WITH {_EMB} SELECT q_id, c_id, rank, {sql_round('dist')} AS dist FROM knn",
    "d7_smote": f"""WITH {_SMOTE} SELECT -(j + 1) AS vec_id, base_id AS _base_id, neighbor_id AS _neighbor_id,
        {sql_round('gap')} AS gap, {sql_round('nx[1]')} AS e0, {sql_round('nx[2]')} AS e1,
        {sql_round('list_sum(nx)')} AS x_sum FROM syn""",
    "d7_smote_counts": f"""SELECT CAST(label = {EMB_CLASS} AS INTEGER) AS y, 0 AS synthetic, count(*) AS n FROM embeddings GROUP BY 1
        UNION ALL SELECT 1, 1, (SELECT count(*) FROM embeddings WHERE label <> {EMB_CLASS})
                                - (SELECT count(*) FROM embeddings WHERE label = {EMB_CLASS})""",
})


# ---------------------------------------------------------------------------
# D3 on rows without a class or an id: they are a class of their own, none is lost
# ---------------------------------------------------------------------------

def q_split_nulls(spark, sf):
    rows = table(spark, sf, "labels").select(
        F.when(F.col("doc_id") % 11 != 0, F.col("doc_id")).alias("doc_id"),
        F.when(F.col("doc_id") % 7 != 0, F.col("toxic")).alias("toxic"))
    parts = S.stratified_split(rows, "doc_id", "toxic", FRACTIONS, seed=SEED)
    return parts.groupBy("toxic", "split").agg(F.count(F.lit(1)).alias("n"))


QUERIES["d3_split_nulls"] = q_split_nulls
SQL["d3_split_nulls"] = f"""WITH c AS (SELECT CASE WHEN doc_id % 7 <> 0 THEN toxic END AS toxic, count(*) AS n FROM labels GROUP BY 1),
    s AS (SELECT toxic, n, CAST(floor(n * {FRACTIONS[0]}::DOUBLE + 0.5) AS BIGINT) AS a, CAST(floor(n * {FRACTIONS[1]}::DOUBLE + 0.5) AS BIGINT) AS b FROM c),
    p AS (SELECT toxic, 'train' AS split, a AS n FROM s UNION ALL SELECT toxic, 'val', b FROM s UNION ALL SELECT toxic, 'test', n - a - b FROM s)
    SELECT toxic, split, n FROM p WHERE n > 0"""
