import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
#: Names that operators use inside; rows carry them as columns of their own.
CLASHING = ["h", "fp", "n", "at", "copies", "slice", "bin", "part", "u", "v", "row", "hash", "key", "base", "text_hash", "n_lines", "n_removed", "rest", "covered", "edge", "target", "held_out", "rank"]


def make_rows():
    rng = random.Random(5)
    sentence = lambda k: " ".join(rng.choice(WORDS) for _ in range(k))
    shared = "\n".join(sentence(9) for _ in range(5))
    rows = [(i, "\n".join(sentence(rng.randint(1, 12)) for _ in range(rng.randint(1, 9))), "en", f"s{i % 4}") for i in range(40)]
    rows += [(i, f"{sentence(6)}\n{shared}\n{sentence(7)}", "en", "s0") for i in range(40, 48)]
    rows += [(50, rows[3][1], "en", "s1"), (51, rows[3][1], "en", None), (52, None, None, "s2"), (53, "", "en", "s2"), (54, " \n\t ", "en", "s3")]
    rows += [(None, "no id here at all", "en", "s1"), (None, None, None, None), (7, rows[7][1], "en", "s3"), (7, "another text under the same id", "de", "s3")]
    rows += [(60, sentence(9000), "en", "s1"), (61, "x" * 70000, "de", "s1"), (62, "ünïcode – 日本語 \U0001f600 a\x1cb  token = \"abcDEF1234567890\"", "de", "s2"), (63, rows[45][1] + " end", "en", "s0")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    base = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    return base.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
