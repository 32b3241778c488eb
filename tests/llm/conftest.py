import random

import pytest
from pyspark.sql import types as T

WORDS = "the and of river mountain light house window paper stone green quiet table music winter market bread garden".split()

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
                    # extra columns with names that the operators use themselves
                    + [T.StructField(n, T.StringType()) for n in ("score", "chunk", "bucket", "fp", "label", "held_out", "n_words", "component_id", "token")])


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randrange(50)) if r.random() < 0.3 else "") for _ in range(n))


def rows_of(pairs):
    return [(i, t, "en" if i is not None and i % 3 else None, "s", len(t) if t is not None else None, *["x"] * 9) for i, t in pairs]


@pytest.fixture(scope="session")
def messy_pairs():
    """(doc_id, text) with distinct ids: null, empty, blank, one word, odd characters, very long, equal texts."""
    texts = [None, "", " \t\r\n ", "word", "A b\x0bc\x1cd", "é ß 中文字 🙂 ́x", " nbsp line", prose(15_000, 1), prose(200, 2), prose(200, 2),
             prose(90, 3) + " " + prose(60, 4), prose(60, 4) + " " + prose(90, 5), "same " * 120, "<|endoftext|> end", "x" * 5_000]
    return list(enumerate(texts))


@pytest.fixture(scope="session")
def messy(spark, messy_pairs):
    """The rows of ``messy_pairs``, one of them again, one without an id, and extra columns."""
    rows = rows_of([*messy_pairs, messy_pairs[8], (None, prose(30, 9))])
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
