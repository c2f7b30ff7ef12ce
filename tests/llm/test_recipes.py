"""Chunk recipes against plain comparison of texts."""

import hashlib
import random
from collections import defaultdict

import pytest

from groundspark.llm import recipes


def expected(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups["".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[3]))


@pytest.mark.parametrize("width", [16, 1])
def test_groups_are_those_of_equal_texts(spark, docs, rows, width):
    """With names of one byte, unlike chunks share names at first; longer ones are then given."""
    more = spark.createDataFrame([(100 + i, t.swapcase() if i % 2 else t) for i, (_, t, *_) in enumerate(rows) if t], "doc_id long, text string")
    got = recipes.exact_groups(docs.unionByName(more, allowMissingColumns=True), width).collect()
    want = expected([*rows, *((r.doc_id, r.text) for r in more.collect())])
    assert in_order([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got]) == in_order(want)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_names_of_one_byte_are_found_to_clash(spark, docs):
    assert recipes.stored(docs, 1).groupBy("name").count().where("count > 1").count() > 0
    assert recipes.stored(docs, 16).groupBy("name").count().where("count > 1").count() == 0


def test_no_rows(empty):
    assert recipes.exact_groups(empty).collect() == []


def rolling(data, i):
    h = 0
    for k in range(min(recipes.WINDOW, i + 1)):
        h += int(recipes._GEAR[data[i - k]]) << k
    return h % (1 << 64)


def test_cuts_are_those_of_the_rolling_hash(monkeypatch):
    data = random.Random(1).randbytes(20_000)
    want = [i + 1 for i in range(len(data)) if rolling(data, i) >> (64 - recipes.BITS) == 0]
    assert list(recipes.candidates(data)) == want and want
    monkeypatch.setattr(recipes, "STEP", 1000)
    assert list(recipes.candidates(data)) == want


def test_chunks_follow_the_content_and_keep_their_bounds():
    rng = random.Random(2)
    data = rng.randbytes(300_000)
    parts = recipes.chunks(data)
    assert b"".join(parts) == data
    assert all(recipes.LEAST <= len(p) <= recipes.MOST for p in parts[:-1]) and 0 < len(parts[-1]) <= recipes.MOST
    edited = recipes.chunks(data[:1000] + b"put in" + data[1000:])
    assert len(set(parts) - set(edited)) <= 3
    assert recipes.chunks(b"") == [] and recipes.chunks(b"x") == [b"x"]
    same = recipes.chunks(b"a" * 100_000)
    assert b"".join(same) == b"a" * 100_000 and len(set(same)) <= 2


def test_hot_groups(spark):
    rows = [(i, "the one text " * 300 if i % 3 else f"text {i} " * 40) for i in range(3000)]
    got = recipes.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()
    assert in_order([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got]) == in_order(expected(rows))
