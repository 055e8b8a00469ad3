from __future__ import annotations

import pytest
from pyspark.sql import functions as F

PROSE = "the quick brown fox jumps over the lazy dog and runs to the river where other animals drink water in the evening sun"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    rows = [
        (1, PROSE, "en", "s", 1),
        (1, PROSE, "en", "s", 1),
        (2, PROSE + " x", None, "s", None),
        (3, None, "en", None, None),
        (4, "", "de", "s", 0),
        (None, "mail me at a.b@c.org or +1 (980) 555-6268", "en", "s", 3),
        (None, None, None, None, None),
        (7, "ä\U0001f600 1.2.3.4 4111 1111 1111 1111 " * 3, "fr", "t", 5),
        (8, "ab " * 60_000, "en", "t", 7),
        (9, "z" * 150_000, "en", "t", 7),
        (10, " \t\n ", "en", "t", 7),
        (11, "<|endoftext|> $$$ !!! 12345", None, "", -1),
    ]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("fp", "score", "slot", "shard", "size", "base", "spans", "ids", "task", "nth", "component_id", "toxic", "start"):
        base = base.withColumn(name, F.lit("clash"))
    return base.cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
