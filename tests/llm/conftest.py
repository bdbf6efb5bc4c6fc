import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """Documents of (doc_id, text) or longer rows; missing columns are null."""
    full = [(*r, *([None] * (5 - len(r)))) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(rng: random.Random, n: int, letters: str = "abcdefghijklmnop") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(n))


@pytest.fixture
def rng():
    return random.Random(5)


def odd_rows(rng):
    """Nulls, empty, blank and very long texts, ties and repeated rows."""
    long = words(rng, 30_000)
    return [(None, words(rng, 40)), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (6, "one"), (6, "one"), (7, "one"),
            (8, words(rng, 30)), (8, words(rng, 30)), (9, "\U0001f600 été 中文 " + words(rng, 10)), (-5, words(rng, 6))]
