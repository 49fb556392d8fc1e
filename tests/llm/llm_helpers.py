"""Documents with edge cases, and invented words, for the operator tests."""

import numpy as np
import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, component int"


def make(spark, rows, ddl=DOCS):
    """Documents from (doc_id, text[, lang[, source]]) with two extra columns whose names operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0",
             None if r[1] is None else len(r[1]), 0.5, 7) for r in rows]
    return spark.createDataFrame(full, ddl)


@pytest.fixture(scope="session")
def words():
    rng = np.random.default_rng(42)
    vocab = ["".join(rng.choice(list("abcdefghilmnoprstu"), rng.integers(3, 9))) for _ in range(3000)]
    return lambda n, seed: " ".join(np.random.default_rng(seed).choice(vocab, n))


EDGE = [(900, None), (901, ""), (902, "   \n\t "), (903, "one"), (904, "one two"), (None, "no id here at all"),
        (905, "ünï çødé 日本語 текст"), (906, "x" * 5000), (907, "De " * 3000)]
