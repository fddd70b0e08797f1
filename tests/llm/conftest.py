import random

import pytest

#: Extra columns of the fixture, named as operators name theirs.
EXTRA = ["id", "whole", "run", "row", "digest", "proof", "size", "part", "rank", "copies", "times", "keep_id", "found", "root", "uid", "u", "v", "n", "block", "host", "verdict", "rule", "draw", "toxic", "codes"]


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


BASE = words(1, 60)
NEAR = " ".join([*BASE.split()[:58], "other", "end"])

#: doc_id, text, lang, source: nulls in every column, empty and very long texts, ties and repeated rows.
ROWS = [
    (1, BASE, "en", "a"),
    (2, BASE.replace(" ", " \t\n"), "en", "a"),
    (3, NEAR, "en", "b"),
    (4, None, "en", "a"),
    (5, "", None, "b"),
    (6, "   \n ", "de", None),
    (7, words(2, 40_000), "en", "a"),
    (8, "one two three", "en", "b"),
    (9, "One  TWO three", "en", "b"),
    (10, "x" * 300_000, "en", None),
    (11, words(3, 200), "fr", "a"),
    (11, words(3, 200), "fr", "a"),
    (12, words(4, 200), None, None),
    (None, words(5, 50), "fr", "b"),
    (None, words(5, 50), "fr", "b"),
    (13, BASE, "en", "c"),
    (14, "Größe élève \U0001f600 + 12 <|endoftext|>  a   b\n\n c ", "de", "c"),
    (15, "1234 5678 !!", "es", "c"),
]


@pytest.fixture(scope="session")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").repartition(3).selectExpr("*", "length(text) AS n_chars", *(f"'x' AS `{c}`" for c in EXTRA if c not in ("doc_id",)))
    return df.cache()


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
