from __future__ import annotations

import random

import pytest

WORDS = "the of and to in is that it was for harbour engine violet stone river market window lantern copper meadow".split()
#: Null ids, null and empty texts, blanks, ties, repeated rows, a long text, letters outside ASCII.
ODD = [
    (None, "text without an id here and more", "en", "a"), (1, None, "en", None), (2, "", None, "b"), (3, " \n\t ", "de", "b"), (4, "same line of some length here\nx", "en", "a"),
    (5, "same line of some length here\ny", "en", "a"), (6, "  SAME line of some length HERE\t\nz", "en", "c"), (7, "é ü ñ 日本語 ß", "de", "c"), (8, "one", "en", "a"), (8, "one", "en", "a"),
    (9, "12345 !!! ###", None, "a"), (10, "long " * 20_000, "en", "hot"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward documents, with columns that clash with the operators' own names."""
    rows = [(i, t, la, s, len(t) if t is not None else None, "x", 1, None) for i, t, la, s in ODD]
    return spark.createDataFrame(rows, SCHEMA + ", mix_size string, nd_print int, dl_text string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def prose(spark):
    rng = random.Random(3)
    rows = []
    for i in range(120):
        text = "\n".join(" ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 40))).capitalize() + "." for _ in range(rng.randint(1, 6)))
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    return spark.createDataFrame(rows, SCHEMA)
