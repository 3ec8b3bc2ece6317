"""Operators of a training-data pipeline: tokenising, fingerprints, packing, toxicity, PII,
page extraction, near-duplicates, LM scoring, language ID.

Every operator takes and returns DataFrames.  Python runs inside Spark tasks over Arrow
batches; whatever must meet across rows is joined, grouped and aggregated by Spark.
"""
