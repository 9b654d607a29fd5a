import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(words))


@pytest.fixture(scope="session")
def prose_of():
    return prose


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows, and columns
    whose names clash with those of operators."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    texts = [base, base, near, prose(2, 80), prose(3, 3), "", None, "   ", "word", prose(4, 6000), "é" * 3000, "a b " * 300, "line one\n" + prose(5, 60) + "\nlast", "x\n" + prose(5, 60), "password = \"abcdefghijklmnop\" end", "I'm 12 ’s\t\n  é中😀"]
    rows = [(i, t, ["en", None, "de"][i % 3], ["s1", "s1", None, "s2"][i % 4], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[0], (None, "no id " + prose(6, 30), None, None, None)]
    clash = [(*r, 7, 8, "fp") for r in rows]
    return spark.createDataFrame(clash, SCHEMA + ", h long, bucket long, print string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def texts_of():
    return plain
