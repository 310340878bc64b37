from __future__ import annotations

import random

import pytest

#: Extra columns whose names clash, in some case, with columns that operators read or make.
EXTRA = ("TEXT", "Doc_Id", "score", "copy", "words", "fp", "key", "component", "c0", "of")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that are hard in one way each, and the schema of documents with extra columns."""
    copy = prose(5, 120)
    near = copy.split()
    near[60] = "changed"
    rows = [
        (None, "no id you idiot", "en", "s0"), (1, None, "en", "s0"), (2, "", None, None), (3, " \n\t ", "en", "s1"), (4, prose(4, 60_000), "en", "s0"),
        (5, copy, "en", "s0"), (6, copy, "en", "s0"), (6, copy, "en", "s0"), (7, " ".join(near), "de", "s1"), (8, "x" * 30_000, "en", "s1"),
        (9, "naïve Ünï 中文 字 😀 é \x00 \x1f end", "fr", "s2"), (10, "same words here " * 400, "en", ""), (10, "other text of one id", "en", "s2"), (11, "stupid stupid stupid", None, "s2"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame([(*r, len(r[1] or ""), *("extra",) * len(EXTRA)) for r in rows], schema).repartition(3)


@pytest.fixture(scope="session")
def marked(spark):
    """Labels, with nulls, an id with both labels, and ids that aren't there."""
    rows = [(i, i % 2, (i + 1) % 2) for i in (1, 4, 5, 6, 7, 8, 9, 10, 11)] + [(None, 1, 1), (4, None, 0), (5, 0, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
