"""Shared tables and helpers of the operators' tests."""

import random

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: names that the operators use themselves, as extra columns
CLASH = ["row", "node", "norm", "digest", "locator", "_k", "labels", "score", "kept", "value"]


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def same_rows(a, b):
    key = lambda r: tuple(map(repr, r))
    return sorted(map(tuple, a), key=key) == sorted(map(tuple, b), key=key)


@pytest.fixture(scope="session")
def rows():
    """Texts with copies, near copies, repeated rows, nulls, empty and very long texts, odd white space."""
    rng = random.Random(7)
    base = [words(rng, rng.randrange(30, 160)) for _ in range(25)]
    texts = list(base)
    for t in base[:8]:
        w = t.split(" ")
        texts += [t, "  " + t.replace(" ", "\n", 3) + "\t"]
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    line = "This Shared line is long enough to be counted as a key."
    texts += [f"{words(rng, 9)}\n{line}{' ' * i}\n{words(rng, 30)}" for i in range(7)] + [f"{line.upper()}\n{line}\n{words(rng, 12)}"]
    texts += [None, "", None, " \n\t", "a", "one two three", "one two three", "x" * 5000, "x" * 5000, words(rng, 20_000, 5000), "ÄÖ ﬁ ① ▁x▁ 　 é z", "<|endoftext|> a  b <s>\r\n c ", " lead", "trail ", "a\x1cb c"]
    out = [(i * 3 - 5, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [out[2], out[2], (None, "null id text " + texts[1], None, None, None), (None, texts[3], None, None, 1), (out[5][0], "another text under the same identifier", None, None, 2)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def clashing(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *(F.lit("z").alias(c) for c in CLASH))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
