from __future__ import annotations

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"word{i % 700} of the line{i % 13}" for i in range(20_000))


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls, empty and long texts, ties and repeated rows."""
    text = " ".join(f"alpha{i} beta{i}" for i in range(60))
    near = text.replace("beta7 ", "gamma ")
    return [
        (1, text, "en", "a", 3),
        (2, text, "en", "a", 3),
        (3, near, None, None, None),
        (3, near, None, None, None),
        (4, None, "en", "b", 0),
        (5, "", "en", "b", 0),
        (6, " \n\t ", "en", "c", 4),
        (7, "one", "en", "c", 3),
        (8, LONG, "en", "c", len(LONG)),
        (9, "x" * 50_000, "en", "c", 50_000),
        (None, "no number here", "en", "d", 14),
        (10, "naïve 𝔘nicode — ‏text\u2028line 'quoted' </s>[INST] <|endoftext|>", "en", "d", 5),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with columns named like those that operators add."""
    from pyspark.sql import functions as F

    names = ("n_words", "kept", "size", "target", "start", "tier", "spans", "base", "digest")
    return odd.withColumns({name: F.lit(name) for name in names})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
