import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sig string, score string, spans string, `n_words` string"


def prose(rng, n, syllables=("ka", "lo", "mi", "ren", "tu", "shé", "vo", "öl")):
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w.capitalize() if rng.random() < 0.1 else w for w in words)


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty, blank and long texts, exact and near copies, shared passages and repeated rows."""
    rng = random.Random(4)
    passage = prose(rng, 120)
    rows = [(i, prose(rng, rng.randint(60, 200)), rng.choice(["en", "de"]), rng.choice(["s0", "s1"])) for i in range(40)]
    base = rows[0][1].split()
    for i in range(40, 52):
        copy = list(base)
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = "changed"
        rows.append((i, " ".join(copy), "en", "s0"))
    for i in range(52, 60):
        rows.append((i, f"{prose(rng, rng.randint(5, 60))} {passage} {prose(rng, rng.randint(5, 60))}", "en", "s0"))
    rows += [(60, None, "en", "s0"), (61, "", None, None), (62, " \n\t ", "en", None), (63, "one two", "en", "s0"), (64, "One  two", "en", "s1"), (None, rows[1][1], "en", "s0"), (None, "words of a row without an id " * 12, "xx", "s9"), (65, rows[2][1], "de", "s1"), rows[3], rows[3]]
    rows += [(66, "line again and again\n" * 120 + prose(rng, 30), "en", "s0"), (67, prose(rng, 9000), "en", "s0"), (68, "a" * 1500, "en", "s0"), (69, "b" * 399, "en", "s0"), (70, "b" * 400 + "é", "en", "s0"), (71, "# * $ | < > % & " * 60, "en", "s0")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), "x", "y", "z", "w") for r in corpus], SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
