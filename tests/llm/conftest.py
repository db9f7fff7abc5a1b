import random

import pytest

CLASH = "key string, n long, bits long, score double, n_lines long, items string, keys string, component_id long, bucket int, node long"


@pytest.fixture(scope="session")
def corpus(spark):
    """Makes documents (doc_id, text, lang, and columns whose names clash with the operators' own)."""

    def make(rows):
        full = [(*r, *(None,) * (3 - len(r)), "k", 1, 2, 0.5, 3, "i", "ks", 9, 4, 5) for r in rows]
        return spark.createDataFrame(full, f"doc_id long, text string, lang string, {CLASH}")

    return make


@pytest.fixture(scope="session")
def words():
    """A seeded maker of prose."""

    def make(seed, n, size=400):
        r = random.Random(seed)
        stock = ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(r.randint(2, 8))) for _ in range(size)]
        return " ".join(r.choice(stock) for _ in range(n))

    return make
