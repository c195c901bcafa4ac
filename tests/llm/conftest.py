import random

import pytest

#: Columns of documents plus ones whose names could clash with the operators' own.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _doc string, block int, key binary, weight string, _keep long, _bad long"

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "lambda", "mu", "nu", "xi", "omicron", "pi", "rho", "sigma", "tau", "upsilon"]


def prose(rng: random.Random, n: int, words=None) -> str:
    """``n`` words, made so that long runs hardly repeat by chance."""
    return " ".join(rng.choice(words or WORDS) + str(rng.randrange(50)) for _ in range(n))


def row(doc_id, text, lang="en", source="s"):
    return doc_id, text, lang, source, len(text or ""), "x", 3, b"k", "w", 1, 2


@pytest.fixture(scope="session")
def table(spark):
    """A table of documents from (doc_id, text, ...) tuples, over a few partitions."""

    def make(rows, partitions=3):
        return spark.createDataFrame([row(*r) for r in rows], SCHEMA).repartition(partitions, "doc_id")

    return make


#: Texts that every operator must take.
ODD = [(9001, None), (9002, ""), (9003, " \t\r\n\x0b\x0c "), (9004, "\n\n\n"), (9005, "word " * 30_000), (None, "no id here"), (9006, "é ß 中文   🙂  "), (9007, "same"), (9008, "same"), (9007, "same")]
