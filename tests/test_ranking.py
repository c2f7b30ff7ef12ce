"""Cosine ranking against its definition, with keys that come again, and with terms too many to broadcast."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from groundspark.operators import lexical


def by_definition(docs, queries, k):
    counts = defaultdict(Counter)
    for key, text in docs:
        counts[key].update(re.findall("[a-z]+|[0-9]+", (text or "").lower()))
    df = Counter(t for c in counts.values() for t in c)
    idf = lambda t: math.log((len(docs) + 1) / (df[t] + 1)) + 1 if t in df else 1.0
    weights = lambda c, f: {t: (1 + math.log(n)) * f(t) for t, n in c.items()}
    out = {}
    for q, text in queries:
        wq = weights(Counter(re.findall("[a-z]+|[0-9]+", text.lower())), idf)
        nq = math.sqrt(sum(x * x for x in wq.values()))
        scores = []
        for key, c in counts.items():
            r = weights(c, idf)
            dot = sum(r.get(t, 0) * x for t, x in wq.items())
            if dot > 0:
                scores.append((-round(dot / nq / math.sqrt(sum(x * x for x in r.values())), 9), key))
        out.update({(q, key): (-s, i + 1) for i, (s, key) in enumerate(sorted(scores)[:k])})
    return out


def test_no_table_of_all_terms_is_kept(spark, monkeypatch):
    kept = []
    for name in ("checkpointed", "stored"):
        monkeypatch.setattr(lexical, name, lambda df, f=getattr(lexical, name): kept.append(f(df)) or kept[-1])
    docs = spark.createDataFrame([(i, "pump valve tank " * 3 + f"w{i}") for i in range(9)], "d long, text string")
    assert lexical.rank(docs, "d", "text", docs.limit(1).toDF("q", "asked"), "q", "asked", 2).count() == 2
    assert kept and not any({"d", "term"} <= set(df.columns) for df in kept)


@pytest.mark.parametrize("many", [False, True])
def test_ranks_are_those_of_the_definition(spark, monkeypatch, many):
    if many:
        monkeypatch.setattr(lexical, "SMALL", 5)
        monkeypatch.setattr(lexical, "HOT", 20)
    rng = random.Random(6)
    words = ["pump", "valve", "tank", *(f"w{i}" for i in range(30))]
    docs = [(i % 25, " ".join(rng.choice(words[: rng.choice((3, 33))]) for _ in range(rng.randint(1, 20)))) for i in range(40)] + [(90, None), (91, "..."), (92, "Pump-Pump")]
    queries = [(1, "pump tank"), (2, "W7 unheard valve valve"), (3, "unheard")]
    got = lexical.rank(spark.createDataFrame(docs, "d long, text string"), "d", "text", spark.createDataFrame(queries, "q long, asked string"), "q", "asked", 5)
    rows, want = got.collect(), by_definition(docs, queries, 5)
    assert {(r.q, r.d): r["rank"] for r in rows} == {key: at for key, (_, at) in want.items()}
    assert all(math.isclose(r.score, want[r.q, r.d][0], abs_tol=2e-9) for r in rows)
