from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, part int, id long, fp long, spans string"


def words(r: random.Random, n: int) -> list[str]:
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 6))) for _ in range(n)]


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    """Odd cases and ordinary ones: (doc_id, text, lang, source)."""
    r = random.Random(3)
    shared = " ".join(words(r, 60))
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", None),
        (3, " \t\n\x0b\x0c\r", None, "a"),
        (4, "one", "en", "b"),
        (5, "Straße ÉCOLE   日本語 😀 " * 3, "de", "b"),
        (6, "a" * 5000, None, "c"),
        (7, " ".join(words(r, 9000)), "en", "c"),
        (8, "x y z " * 400, "en", "c"),
        (9, shared, "en", "a"),
        (10, shared.replace(" ", "\n"), "en", "a"),
        (11, shared + " tail", "en", None),
        (12, "12345 !!! ---", None, "a"),
        (None, "no id here but some words", "en", "z"),
    ]
    for i in range(20, 60):
        body = words(r, r.randint(1, 120))
        if i % 4 == 0:
            body[len(body) // 2 : len(body) // 2] = shared.split()[: r.randint(30, 60)]
        rows.append((i, " ".join(body), r.choice(["en", "de"]), r.choice(["a", "b", "c", None])))
    rows.append(rows[-1])  # a repeated row
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With further columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 7, 1, 2, 3, "x") for i, t, lang, s in texts], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
