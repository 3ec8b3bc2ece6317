import pytest

LONG = "The long one goes on and on, 42 times over. " * 6000 + "x" * 3000

DOCS = [
    (1, "the quick brown fox jumps over the lazy dog", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "the quick brown fox jumps over the lazy dog", "en"),
    (4, "the quick brown fox jumps over the lazy dog", "en"),
    (None, "a text whose id is missing, mail me at someone@example.org", "en"),
    (5, LONG, "en"),
    (6, "y" * 40_000, None),
    (7, " \t\n ", "en"),
    (8, "Contact: jane.roe@mail.example.com or +1 (499) 555-6503, from 10.0.0.7; card 4111 1111 1111 1111.", "en"),
    (9, "çà et là, déjà vu 日本語 — ’tis\x00odd", "fr"),
]

# columns whose names the operators use for their own
EXTRA = {"score": "double", "ids": "string", "FINGERPRINT": "string", "key": "int", "row": "int", "f": "int", "k": "int", "t": "int", "_row": "int",
         "items": "string", "spans": "string", "evidence": "string", "lang_pred": "string", "simhash": "string", "decoded": "int", "label": "int"}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, lang, "src", len(t) if t is not None else None) for i, t, lang in DOCS]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def crowded(docs):
    """The documents with extra columns of clashing names."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(1).cast(t).alias(c) for c, t in EXTRA.items()])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
