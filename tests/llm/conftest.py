import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tricky import tricky_texts  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", f"src{n % 3}", len(t) if t is not None else None) for n, (i, t) in enumerate(tricky_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with extra columns named like the operators' own."""
    from pyspark.sql import functions as F
    names = ("score", "predicted", "_text", "_row", "_id", "key", "chunk", "bucket", "label", "hash", "id", "row", "piece",
             "length", "rank", "n_words", "kept", "set_key", "rest", "n_tokens", "host", "rule", "dim", "part")
    return docs.select("*", *[F.lit(n).alias(n) for n in names])


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
