"""The subpackage's registered queries: thin wrappers that apply an operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, collision, common, config_lp, edit_embedding, fp_rank, language, lm_score, packing, pages, pii, simhash, toxicity


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN).select("doc_id", "ids")
    back = bpe.decode(ids, path, public_tokenizers.PATTERN)
    return back.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _tail_from_next(text: str, after: str) -> str:
    """The last third of a text replaced by the beginning of the next one."""
    n = len(text) // 3
    return text[: len(text) - n] + after[:n]


def op2_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    compared = edit_embedding.compare_next(docs, _tail_from_next)
    return compared.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents").select("doc_id", "text"), common.table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.where(common.crc_mod("doc_id", 4) != 2))
    scored = toxicity.score(docs, model).select("doc_id", "score", "evidence")
    return scored.select("doc_id", (common.crc_mod("doc_id", 4) == 2).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"), "evidence")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_id")


def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(common.table(spark, sf_dir, "pages"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs, words=3, tau=2)


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_score.score(docs.withColumn("train", common.crc_mod("doc_id", 10) != 0), "train")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = language.learn(docs.where(common.crc_mod("doc_id", 4) != 2))
    said = language.identify(docs.select("doc_id", "text"), model)
    return said.select("doc_id", (common.crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision.near_duplicates(common.table(spark, sf_dir, "embeddings"))


def op11_fp_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fp_rank.rank(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op12_config_lp(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = config_lp.pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(common.table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


QUERIES = {f.__name__: f for f in (op1_byte_bpe, op2_edit_embedding, op3_packing, op4_toxicity, op5_pii, op6_pages,
                                   op7_simhash, op8_lm_score, op9_language, op10_collision, op11_fp_rank, op12_config_lp, op13_centroids)}

# Tokenizers, seeded hashes and learned scores are beyond SQL: those queries are tested against brute force in
# tests/llm.  Four can be said: pages of the given tables mark their articles, so their text is a matter of
# patterns; links of vectors are a join with its reachability; ranks and clusters are integer arithmetic.
SQL: dict[str, str] = {
    "op6_pages": r"""WITH a AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_extract(html, '<article>(.*?)(</article>|$)', 1, 's'),
            '</?(p|h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM pages),
        d AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
            '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM a)
        SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d""",
    "op10_collision": """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0),
        p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
              WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
        r(vec_id, c) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.vec_id),
        m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id), k AS (SELECT a, count(*) AS n FROM p GROUP BY a)
        SELECT m.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, m.component_id, m.vec_id = m.component_id AS kept
        FROM m LEFT JOIN k ON k.a = m.vec_id""",
    "op11_fp_rank": r"""WITH t AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
        d AS (SELECT row_number() OVER () AS r, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM t WHERE len(w) > 0),
        g AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS l FROM d),
        q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
              'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
        c AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, n, unnest(w) AS term FROM d) u
              WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        f AS (SELECT term, CAST(floor(1000 * ln((2 * nd + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS wt FROM c CROSS JOIN g GROUP BY term, nd),
        s AS (SELECT q.item_id, c.r, c.doc_id, CAST(sum(f.wt * ((1000000000 * c.tf) // (1000 * c.tf + 20 * (50 + (50 * c.n * g.nd) // g.l)))) AS BIGINT) AS score
              FROM q JOIN c USING (term) JOIN f USING (term) CROSS JOIN g GROUP BY ALL),
        k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT * FROM k WHERE rank <= 50""",
}


def _clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """Assignment and update as common table expressions, one pair for each round."""
    gap = "list_sum(list_transform(list_zip(v.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = ["""v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"""c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, e FROM (SELECT sha256('1:' || vec_id) AS h, e FROM v ORDER BY h LIMIT {k}))"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS (SELECT v.vec_id, v.e, c.cluster, CAST({gap} AS BIGINT) AS distance FROM v CROSS JOIN c{r} c
            QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY distance, c.cluster) = 1)""")
        if r < rounds:
            parts.append(f"""m{r} AS (SELECT cluster, list(CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT) ORDER BY pos) AS e FROM (SELECT cluster, pos,
                CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM a{r}) GROUP BY cluster, pos) GROUP BY cluster),
            c{r + 1} AS (SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN m{r} m USING (cluster))""")
    return f"""WITH {', '.join(parts)} SELECT a.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance,
        CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(c.e, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c USING (cluster)"""


SQL["op13_centroids"] = _clusters_sql()
