"""The pipeline's near-dedup against all pairs of shingle sets."""

import random
from itertools import combinations

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_copies_of_likeness_080_are_linked(spark):
    rng = random.Random(11)
    texts = []
    for k in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        texts.append(" ".join(words))
        for edits in (2, 4, 5, 6, 8, 14):  # an edit changes five shingles
            changed = list(words)
            for at in rng.sample(range(0, 300, 10), edits):
                changed[at] = f"new{rng.randrange(5000)}"
            texts.append(" ".join(changed))
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    near = 0
    for i, j in combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
            near += 1
            a, b = sorted((top(i), top(j)))
            root[b] = a
    assert near > 40
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, "").collect()}
    assert kept == {top(i) for i in range(len(texts))}


def test_each_group_keeps_a_row_whatever_its_id(spark):
    rng = random.Random(3)
    one, two, three, four, five = (" ".join(f"w{rng.randrange(5000)}" for _ in range(40)) for _ in range(5))
    table = [(None, one), (None, two), (7, three), (7, four), (7, three), (9, four), (3, five), (8, five), (None, five)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in table], SCHEMA)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.dedup_near(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(None, one), (None, two), (7, three), (7, four), (3, five)], key=str)
