from __future__ import annotations

import random

import pytest

LONG = " ".join(f"palabra{i % 977}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, w int, kept string, copy int, node string, component_id string"


def rows(texts):
    return [(i, t, ("en", "fr", None)[i % 3], ("b", "a", None, "ß")[i % 4], len(t or ""), 1.0, "x", 3, None, 9, "n", "c") for i, t in enumerate(texts)]


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, short and very long ones, ties and repeated rows, under columns whose names clash."""
    rng = random.Random(5)
    texts = [None, "", " \t\n", "one", "one two", LONG, "a\x00b é 𝒳 \r\n x", "1234 5678", prose(rng, 80)]
    texts += [texts[-1]] * 3 + [prose(rng, 60) for _ in range(8)] + ["The same line.\n" * 30]
    r = rows(texts)
    return spark.createDataFrame(r + [r[8], r[8], (None, "no id at all here", None, None, 3, 0.0, "", 0, "", 1, "", "")], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
