import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, `row` string, key string, node string, part int, `range` int, template string, line_hashes string, quality_counts string"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(("the", "an", "or", "is", "tion", "é", "ou", "ß")) for _ in range(r.randint(1, 4))) for _ in range(n)]
    return " ".join(w + ("." if k % 9 == 8 else "") + ("\n" if k % 31 == 30 else "") for k, w in enumerate(words)).replace("\n ", "\n")


def rows() -> list[tuple]:
    long = prose(7, 30_000)
    near = prose(3, 300)
    texts = [
        (1, None, "a"),
        (2, "", "a"),
        (3, " \t\n ", None),
        (4, "one", "b"),
        (5, near, "b"),
        (6, near, "c"),
        (7, near.replace(" the ", " xx ", 1), "c"),
        (8, long, "a"),
        (9, "a  b   c \n\n d\xa0 e", None),
        (10, "$$$ *** " * 60, "c"),
        (11, "Der " * 80, "c"),
        (12, prose(11, 120), "a"),
        (12, prose(11, 120), "a"),
        (13, "漢字 \U0001f600 naïve 'tis it's <|endoftext|> x", "b"),
        (None, prose(12, 90), "b"),
        (14, "the the the", "b"),
        (15, "the the the", "b"),
    ]
    return [(i, t, "en", s, len(t or ""), 1, "r", "k", "n", 1, 2, "t", "h", "q") for i, t, s in texts]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
