import random

import pytest

#: Columns whose names the operators use themselves.
CLASHING = "text_hash long, node long, size long, bucket int, key string, taken double, target string, kept boolean, firsts string, row string"


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "ren", "tion", "là", "über", "ña", "Za", "x"]) + rng.choice(["", "ing", "ly", "é"]) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, lang, source) with nulls, empty and long texts, repeated rows, ties and near copies."""
    rng = random.Random(5)
    base = [words(rng, n) for n in (60, 90, 150, 40, 300)]
    near = base[2].split()
    near[7] = "changed"
    long = "\n".join(words(rng, 40) for _ in range(400))
    rows = [
        (1, base[0], "en", "a"), (2, base[0], "en", "a"), (2, base[0], "en", "a"), (3, base[1] + "\n" + base[0], "fr", "b"),
        (4, base[2], "en", None), (5, " ".join(near), None, "b"), (6, None, "en", "a"), (7, "", "fr", None), (8, " \n\t ", "de", "c"),
        (9, "one", "en", "c"), (10, "12 34 !!", "en", "a"), (11, long, "en", "d"), (None, base[3], "en", "d"), (None, None, None, None),
        (12, base[4], "de", "c"), (13, base[4].upper(), "de", "c"), (13, base[1], "de", "c"), (14, "a\nb\na\n\nb", "en", "d"),
    ]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"
    extra = (7, 8, 9, 1, "k", 0.5, "t", True, "f", "r")
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *extra) for r in edge_rows], schema)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
