"""Small corpora with every kind of awkward row."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" + ("\n" if rng.random() < 0.05 else "") for _ in range(n))


def corpus(seed: int = 1, n: int = 40) -> list[tuple]:
    """Prose, exact and near copies, shared passages, empty, null, very long and one-word texts, a repeated row."""
    rng = random.Random(seed)
    rows, shared = [], prose(rng, 70)
    for i in range(n):
        kind = i % 8
        if kind == 5 and rows:
            text = rows[rng.randrange(len(rows))][1]
        elif kind == 6 and rows:
            ws = (rows[rng.randrange(len(rows))][1] or "").split(" ")
            ws[rng.randrange(len(ws))] = "edited"
            text = " ".join(ws)
        elif kind == 7:
            text = prose(rng, 40) + " " + shared + " " + prose(rng, 60)
        else:
            text = prose(rng, rng.randrange(3, 300))
        rows.append((i, text, "en", f"s{i % 3}" if i % 4 else "s0", len(text or "")))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s1", 0), (n + 2, "one", "en", "s1", 3), (n + 3, prose(rng, 9000), "en", "s2", 1), (n + 4, "é ñ " * 80, "fr", "s2", 1), (n + 5, " \n\t \n", "en", "s1", 5)]
    rows.append(rows[3])
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
