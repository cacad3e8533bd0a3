import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, ties, repeated rows, shared passages."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    passage = " ".join(word() for _ in range(60))
    long = " ".join(word() for _ in range(9000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two three"), (5, "one two three"), (6, "One  two\tthree"), (7, passage), (8, f"start {passage} end"), (9, f"{passage}\n{passage}"), (10, long), (11, long), (12, long + " more"), (None, "One two three"), (None, None), (13, "x"), (13, "y"), (14, "same row"), (14, "same row"), (15, "ünï cödé ¡ \x1c sep arated"), (16, "\\ </s> [INST] <s>")]
    rows += [(100 + k, " ".join(word() for _ in range(rng.randint(1, 120)))) for k in range(40)]
    return [(i, t, "en", None if k % 7 == 0 else f"src{k % 3}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASH = ["digest", "seq", "kid", "tkey", "node", "body", "mask", "spans", "leg", "component", "__id", "f0", "words", "key"]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(edge_rows, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(None).cast("string") for c in CLASH})


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)
