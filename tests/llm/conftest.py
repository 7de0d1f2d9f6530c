"""Documents that hold every awkward case."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, kept boolean, size long, n long, cell long, host string, target double, `order` long"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(4000)}" for _ in range(words))


def awkward() -> list[tuple]:
    """doc_id, text, lang, source; nulls, empty and very long texts, ties, repeated rows, near copies."""
    long = prose(1, 60_000)
    base = prose(2, 400)
    near = base.replace(base.split()[200], "other", 1)
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b\f\r", None, None), (4, "One", "de", "b"), (5, "one", "de", "b"), (6, "O n e", "de", "b"),
        (7, long, "en", "a"), (8, long + " tail", "en", "a"), (9, base, "en", "a"), (10, base, "en", "a"), (10, base, "en", "a"), (11, near, "en", "c"),
        (12, base.upper().lower(), "en", ""), (None, base, "en", None), (None, None, None, None), (13, "x y   z", "fr", "c"), (14, "Ärger \U0001f600 naïve", "de", "b"),
        (15, "a b c", "en", "c"), (16, "A B C", "en", "c"), (17, "a  b\tc", "en", "c"), (18, "<|endoftext|> stays text", "en", "c"), (19, "word " * 3000, "en", "a"), (20, "w" * 20_000, "en", "a"),
    ]
    rows += [(100 + i, prose(50 + i, 30 + i), "en", "abc"[i % 3]) for i in range(30)]
    rows += [(200 + i, base + f" end{i % 4}", "en", "a") for i in range(25)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    """awkward() as a stored table, with columns whose names clash with those that operators use."""
    from emberframe.session import stored

    rows = [(*r, 7, 7, None, 7, 7, 7, "h", 7.0, 7) for r in awkward()]
    return stored(spark.createDataFrame(rows, SCHEMA).repartition(3), "docs")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
