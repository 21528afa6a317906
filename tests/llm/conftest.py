import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, size int, fp string, hash long, rank int, lines_deleted int, quality_score double, copies string, _rid string, _gone int, _logits double, _id string, r int, z string, lines int, own int, hash2 string, sk string, item string, size2 int, `a b` int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows, and further columns with names that operators use."""
    rng = random.Random(5)
    body = "\n".join(words(rng, 12) for _ in range(8))
    long = "\n".join(words(rng, 40) for _ in range(400))
    texts = [(0, body), (1, body), (2, body.replace("\n", " \n", 1)), (3, None), (4, ""), (5, "   \n\t "), (6, "one"), (7, "one two"), (8, long), (9, long + "\nmore words at the end"), (10, "x" * 50_000), (11, words(rng, 300)), (12, "É ß ﬁ <b>&amp; é <|endoftext|> İ z"), (None, body), (None, None), (11, None), (13, "\n\n\n"), (14, words(rng, 3))]
    rows = [(i, t, None if n % 5 == 4 else "en", None if n % 4 == 3 else f"s{n % 3}", None, 1, 2, "x", 3, 4, 5, 0.5, "y", "r", 1, 0.1, "i", 2, "z", 3, 4, "h", "s", "t", 5, 6) for n, (i, t) in enumerate(texts)]
    return rows + [rows[11], rows[11], rows[0]]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
