"""The pipeline's stages on a small corpus, with null and repeated ids, each against what its operator decides; near-dedup against all pairs of texts."""

import re
from collections import Counter
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from groundspark.llm import linedup, mixing, quality
from groundspark.llm.common import n_words, text_or_empty

COLUMNS = corpus_pipeline.COLUMNS


@pytest.fixture(scope="module")
def corpus(spark, docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    table = docs.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
    bad = spark.createDataFrame([(300 + i, f"BUY!! {w} BUY!! {w} BUY!!" * 4, "en", "s0", 0) for i, w in enumerate(["now", "here", "fast"] * 8)], table.schema)
    table.unionByName(bad).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(25)] + [(300 + i, 0, 0) for i in range(15)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def rows(df):
    return Counter(map(tuple, df.select(COLUMNS).collect()))


def one_of_each_group(docs):
    """(doc_id, text) of the rows that stay, by all pairs: five-word shingles, four bits or Jaccard 0.8, the smallest id (null last) and then hash of a group."""
    table = [(r.doc_id, r.text, r.h) for r in docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()]
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t, _ in table]
    runs = [[" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else [] for w in words]

    def bits(shingles):
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints, sets, root = [bits(x) for x in runs], [set(x) for x in runs], list(range(len(table)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(table)), 2):
        if bin(prints[i] ^ prints[j]).count("1") <= 4 or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
            root[top(j)] = top(i)
    best = {}
    for i, (doc_id, text, h) in enumerate(table):
        key = (doc_id is None, doc_id or 0, h)
        best[top(i)] = min(best.get(top(i), (key, doc_id, text)), (key, doc_id, text), key=lambda x: x[0])
    return Counter((doc_id, text) for _, doc_id, text in best.values())


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    labels = spark.read.parquet(f"{corpus}/labels.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert len(steps) == 5

    kept = steps["quality classifier"](spark, docs, corpus)
    good = {r.doc_id for r in quality.classify(docs, labels).where("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == good and not any(i in good for i in range(300, 324)) and all(i in good for i in range(40))

    lines = steps["line dedup"](spark, kept, corpus)
    want = Counter()
    for r in linedup.dedup_lines(kept).collect():
        if not r.n_removed or r.text:
            want[(r.doc_id, r.text, r.lang, r.source, len(r.text) if r.n_removed else r.n_chars)] += 1
    assert rows(lines) == want

    near = steps["SimHash near-dedup"](spark, lines, corpus)
    assert Counter((r.doc_id, r.text) for r in near.collect()) == one_of_each_group(lines)
    assert sum(r.doc_id is None for r in near.collect()) + sum(r.doc_id == 7 for r in near.collect()) >= 2

    mixed = steps["mixing sources to target weights"](spark, near, corpus)
    copies = {(r.doc_id, r.h): r.copies for r in mixing.mix(near.select("doc_id", "source", F.xxhash64("text").alias("h"), n_words(text_or_empty()).alias("size"))).collect()}
    wanted = Counter()
    for (i, h), n in copies.items():
        if n:
            wanted[(i, h)] = n
    assert Counter((r.doc_id, r.h) for r in mixed.select("doc_id", F.xxhash64("text").alias("h")).collect()) == wanted

    packed = steps["best-fit packing"](spark, mixed, corpus)
    assert Counter(r.doc_id for r in packed.where("piece = 0").collect()) == Counter(r.doc_id for r in mixed.collect())


def test_run_is_the_stages_in_order(spark, corpus):
    out = corpus_pipeline.run(spark, corpus)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0 and out.count() > 0


def test_stages_of_nothing(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
        assert docs.count() == 0, name
