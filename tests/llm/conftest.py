import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, kept boolean, _uid long"


def clashing(rows):
    """Rows with extra columns whose names the operators use themselves."""
    return [(i, t, lang, "s", None if t is None else len(t), "keep me", None, 7) for i, t, lang in rows]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names."""
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, base = prose(60), prose(200)
    rows = [
        (1, base, "en"), (2, base, "en"), (2, base, "en"), (3, base.replace(words[0], "zz"), "en"), (4, None, None), (5, "", "en"), (6, " \n\t ", None), (7, "One", "fr"),
        (8, prose(30) + " " + shared + " " + prose(30), "en"), (9, prose(50) + "\n" + shared, "en"), (None, shared + " é", "fr"), (None, shared + " é", "fr"),
        (10, prose(4000), "en"), (11, "a" * 3000, "de"), (12, "日本語のテキスト " * 40, "ja"), (13, "line\nline\n" * 30, "en"), (14, "é" * 700 + prose(20), "fr"),
    ]
    return spark.createDataFrame(clashing(rows), SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
