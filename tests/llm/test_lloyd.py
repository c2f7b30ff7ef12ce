"""Codes against Lloyd's algorithm written out in whole numbers, and heaps against a full scan."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundspark.llm import lloyd


def expected(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, p: min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            members = defaultdict(list)
            for _, v, _ in kept:
                members[nearest(v, p)].append(cut(v, p))
            new.append([[sum(c) // len(members[e]) for c in zip(*members[e], strict=True)] if e in members else b for e, b in enumerate(books[p])])
        books = new
    out, by_label = [], defaultdict(int)
    for i, v, label in kept:
        codes = [nearest(v, p) for p in range(parts)]
        error = sum(far(cut(v, p), books[p][e]) for p, e in enumerate(codes))
        by_label[label] += error
        out.append((i, "".join(f"{e:02x}" for e in codes), error, label))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(i, c, e, by_label[label], digest) for i, c, e, label in out], key=repr)


def found(spark, rows, entries=256):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*", *[F.lit("own").alias(c) for c in ("x", "code", "gap", "sums", "named")])
    got = lloyd.compress(df.repartition(3), entries=entries).collect()
    return sorted([(r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got], key=repr)


def made(n, seed=1, length=8, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(rng.choice([-1, 0, 1]), 0.3) * spread for _ in range(length)], rng.choice([None, 1, 2])) for i in rng.sample(range(10 * n), n)]


ODD = [(None, [0.5] * 8, 1), (3, None, 1), (4, [], 1), (5, [0.1, None] * 4, 2), (6, [float("nan")] + [0.0] * 7, 2), (7, [float("inf")] * 8, 2), (8, [-0.0001] * 8, None), (8, [-0.0001] * 8, None), (8, [0.25] * 8, None)]


@pytest.mark.parametrize("entries", [256, 20])
def test_codes(spark, entries):
    rows = made(500) + ODD
    assert found(spark, rows, entries) == expected(rows, entries=entries)


def test_copies_and_ties(spark):
    """Two thirds are copies of one vector, and the rest lie on a grid, equally far from many entries."""
    rng = random.Random(4)
    rows = [(i, [0.5] * 8 if i % 3 else [rng.choice([0.0, 0.25, 0.5]) for _ in range(8)], i % 2) for i in range(600)]
    assert found(spark, rows, 30) == expected(rows, entries=30)


def test_large_components(spark):
    rows = made(60, length=4, spread=50_000.0)
    assert found(spark, rows, 9) == expected(rows, entries=9)
    assert len(found(spark, [*rows, (10_000, [1e300, -1e300, 0.0, 1.0], 1)])) == 61


def test_lengths_that_differ(spark):
    assert [r[0] for r in found(spark, [(1, [0.1] * 8, 1), (2, [0.1] * 12, 1), (3, [0.1] * 7, 1)])] == [1]


def test_no_rows(spark):
    assert found(spark, []) == [] and found(spark, [(1, None, 1)]) == []


def test_heaps_pop_what_drift_has_used_up_and_no_more():
    rng = np.random.default_rng(3)
    x = rng.integers(-1000, 1000, (4000, 4))
    old = rng.integers(-1000, 1000, (30, 4))
    code, gap = lloyd.scanned(x, old)
    new = old + rng.integers(-25, 25, old.shape)
    (drift,) = lloyd.moves([old], [new])
    again = lloyd.violated(code, gap, drift)
    assert sorted(again) == np.flatnonzero(gap <= drift[code]).tolist()
    left = np.setdiff1d(np.arange(len(x)), again)
    assert len(left) > 2000 and (lloyd.scanned(x[left], new)[0] == code[left]).all()


def test_a_later_round_scans_fewer_parts(spark, monkeypatch):
    class Shared:
        value = None

    rng = np.random.default_rng(5)
    x = rng.integers(-1000, 1000, (3000, 8))
    books, one = [x[:40, :4].copy(), x[:40, 4:].copy()], lloyd._Round(Shared)
    one.shared.value = (books, [np.zeros(40)] * 2)
    code, gap, sums = one.assign(x, None, None)
    new = [np.where(s[:, -1:] > 0, s[:, :-1] // np.maximum(s[:, -1:], 1), b) for s, b in zip(sums, books, strict=True)]
    total, drift, seen, scan = sums, [np.zeros(40)] * 2, [], lloyd.scanned
    monkeypatch.setattr(lloyd, "scanned", lambda x, e: seen.append(len(x)) or scan(x, e))
    for _ in range(12):
        drift = [d + m for d, m in zip(drift, lloyd.moves(books, new), strict=True)]
        books, one.shared.value = new, (new, drift)
        code, gap, change = one.assign(x, code, gap)
        total = total + change
        assert all((code[:, p] == scan(x[:, 4 * p : 4 * p + 4], books[p])[0]).all() for p in range(2))
        new = [np.where(s[:, -1:] > 0, s[:, :-1] // np.maximum(s[:, -1:], 1), b) for s, b in zip(total, books, strict=True)]
    assert sum(seen[-2:]) < 3000 < sum(seen[:2]) < 6000  # a full scan sees 3000 of either position
