import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

#: Names that operators use inside; a table may have columns of these names too.
EXTRA = (
    "fp root component_id words size row at hash score shard slot ids key own slice length doc_tokens candidates spans label n x "
    "id other dropped copies text_key text_hash _hit_doc _hit_key _hit_words _simhash_id _simhash_key _simhash_drop _pii_spans _id _key _d0"
).split()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with names that operators use themselves."""
    long = " ".join(f"w{i % 997} is{i}" for i in range(20_000))
    rows = [
        (None, "a null id with some words of text in it"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"),
        (5, "five words are right here"), (5, "five words are right here"), (6, "five words are right here"),
        (7, long), (8, "x" * 50_000), (-9, "Ünïcödé 😀 tëxt with odd spaces, signs!? and 123 numbers"), (2**62, "a far id"),
    ]
    names = ", ".join(f"'extra' AS {c}" for c in EXTRA)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.selectExpr("doc_id", "text", "'en' AS lang", "CAST(NULL AS STRING) AS source", "CAST(length(text) AS LONG) AS n_chars", *names.split(", "))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
