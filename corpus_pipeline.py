"""The corpus pipeline: language ID, toxicity, SimHash near-dedup, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``.  All stages but the last return the columns of documents.  Null
texts are rejected by language ID (``und``); empty tables pass through all stages as empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalis.llm import common, language, packing, pii, simhash, toxicity


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those without a letter or text go."""
    model = language.learn(docs.where(common.crc_mod("doc_id", 4) != 2))
    said = language.identify(docs.select(*[F.col(c).alias(f"d_{c}") for c in docs.columns]), model, "d_text")
    return said.where("lang_pred <> 'und'").select(*[F.col(f"d_{c}").alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the toxicity threshold."""
    labels = common.table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.where(common.crc_mod("doc_id", 4) != 2))
    scored = toxicity.score(docs.select(*[F.col(c).alias(f"d_{c}") for c in docs.columns]), model, "d_text")
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*[F.col(f"d_{c}").alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints: the one with the smallest doc_id.

    Rows that share that id: equal texts stay once, different ones each.  Documents without an id stay, as nothing
    says which of them is which.
    """
    found = simhash.near_duplicates(docs, words=3, tau=2).where(F.col("doc_id") == F.col("component_id"))
    best = common.Scratch(spark).keep(found.groupBy("doc_id").agg(F.count("*").alias("rows_of_id")))
    kept = docs.join(best.select("doc_id").hint("merge"), "doc_id", "left_semi")
    if not best.where("rows_of_id > 1").isEmpty():
        shared = best.where("rows_of_id > 1").select("doc_id")
        kept = kept.join(shared, "doc_id", "left_anti").unionByName(kept.join(shared, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return kept.unionByName(docs.where("doc_id is null"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("language_id", keep_languages), ("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies), ("pii", redact), ("packing", pack)]

# Learned models, word shingle hashes over whole texts and tokenizers are beyond SQL; tests/llm compares run()
# with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared scratch folder."""
    scratch = common.Scratch(spark)
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
