import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the of and stone river light over under green walks slowly toward market every morning while rain falls on quiet roofs near harbour lamps".split()


def prose(rnd: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        out.append(rnd.choice(WORDS) + rnd.choice(["", "", "ing", "ed", "er", str(rnd.randrange(60))]))
        if i % 11 == 10:
            out[-1] += rnd.choice([".", ".\n", ","])
    return " ".join(out)


def odd_rows():
    """Nulls in every column, empty, blank and one-word texts, repeats, odd Unicode, a very long text and a very long word."""
    rnd = random.Random(9)
    long = prose(rnd, 30_000)
    return [
        (1, None, "en", "a", None),
        (2, "", None, None, 0),
        (3, " \t\n\x0b\x0c\r ", "en", "a", 7),
        (4, "Word", "en", "b", 4),
        (None, "no id at all here", "en", "b", 17),
        (None, None, None, None, None),
        (6, long, "en", "a", len(long)),
        (7, "x" * 60_000, "en", "c", 60_000),
        (8, "naïve café 日本語 ﷺ \x85 non-breaking space   line 😀", "fr", "c", 40),
        (9, "same row twice. same row twice.", "en", "c", 31),
        (9, "same row twice. same row twice.", "en", "c", 31),
        (9, "other text under the same id", "en", "d", 28),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark):
    """Extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    base = spark.createDataFrame(odd_rows(), SCHEMA)
    names = "fp key first site doc line keys host rid words n score count length piece rank salt spans items found word label_id quality train _gone _blank doc_key component_id".split()
    return base.select("*", *(F.lit(None).cast("string").alias(n) for n in names))


@pytest.fixture(scope="session")
def documents(spark):
    """300 documents with near copies, shared lines and several sites."""
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        text = prose(rnd, rnd.randrange(1, 200))
        if i % 10 == 3 and rows:
            w = rows[rnd.randrange(len(rows))][1].split(" ")
            w[rnd.randrange(len(w))] = "changed"
            text = " ".join(w)
        if i % 3 == 0:
            text = "All of our offers end this week\n" + text
        if i % 25 == 7:
            text = rows[i // 2][1]
        rows.append((i, text, "en", f"site{i % 14}", len(text)))
    return spark.createDataFrame(rows, SCHEMA)
