"""Small tables with the awkward rows that every operator must take."""

import random

import pytest

from tests.conftest import spark  # noqa: F401 - the session fixture

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliett kilo lima mike november oscar papa quebec romeo sierra tango".split()
EXTRA = ("size", "score", "rejected", "_n", "_spans", "n_removed", "k0", "thinned", "key", "parts")


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n)).capitalize() + "."


def text(seed: int, sentences: int = 12) -> str:
    rng = random.Random(seed)
    return "".join(sentence(rng, rng.randrange(4, 12)) + rng.choice([" ", " ", "\n"]) for _ in range(sentences)).strip()


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source): copies, near copies, shared passages, nulls, empty, very long and one-word texts, repeated rows."""
    out = [(i, text(i), ("en", "de", None)[i % 3], f"s{i % 4}") for i in range(30)]
    out += [(100 + i, text(3), "en", "s0") for i in range(4)]
    out += [(110 + i, text(5).replace("alpha", "zulu", 1), "en", None) for i in range(2)]
    out += [(120 + i, text(200 + i) + "\n" + text(7, 9) + "\n" + text(300 + i), "de", "hot") for i in range(3)]
    out += [(130, None, None, None), (131, "", "en", "s1"), (132, " \t\n ", "en", "s1"), (133, "word", "en", "s1"), (134, "word", "de", "s2"), (135, "123 456 789!", "en", "s2")]
    out += [(136, text(9, 4000), "en", "hot"), (137, "x" * 50_000, "en", "hot"), (138, "é ß 漢字 😀 " * 50, "fr", "ß")]
    out += [(200, text(50), "en", "s3"), (200, text(50), "en", "s3"), (None, text(60), "en", "s3"), (201, "Two words", "en", "s3")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):  # noqa: F811
    """The rows with extra columns whose names operators use inside."""
    data = [(*r, len(r[1] or ""), *range(len(EXTRA))) for r in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in EXTRA)
    return spark.createDataFrame(data, schema).repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
