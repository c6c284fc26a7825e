import random

import pytest

WORDS = [a + b for a in "ba ko ti ru ne mo".split() for b in "lan der sim pot zig".split()]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, repeated rows and ids, and extra columns with the names of results."""
    rng = random.Random(5)
    text = " ".join(rng.choices(WORDS, k=80))
    long = " ".join(rng.choices(WORDS, k=30_000))
    rows = [
        (1, text, "en", "s1"), (2, text, None, None), (2, text, None, None), (3, None, "en", "s1"), (4, "", "de", "s2"), (5, " \t\n", "de", "s2"), (6, long, "en", "s3"), (None, text, "en", None),
        (None, None, None, None), (7, "Zwei", "de", "s1"), (8, "12345 !!! 67", "en", "s1"), (9, "é\U0001f600 ünï <|endoftext|> x", "fr", "s2"), (10, text.replace(text.split()[40], "other"), "en", "s4"),
    ]
    extra = [(r[0], r[1], r[2], r[3], None if r[1] is None else len(r[1]), "x", 1, 0.5, "y") for r in rows]
    return spark.createDataFrame(extra, "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string, n_tokens int, score double, id string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
