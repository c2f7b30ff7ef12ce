"""Joins in time against loops."""

import random

import pytest

from groundspark.operators import intervals


def made(seed, n=120):
    rng = random.Random(seed)
    some = lambda: (rng.choice(["a", "a", "b", "c", None]), rng.choice([None, *range(-20, 40)]))
    left = [(i, *some()) for i in range(n)]
    right = [(100 + i, *some()) for i in range(n // 2)]
    return left + left[:5], right + right[:3]


@pytest.fixture(params=["as it is", "all dealt out"])
def dealt(request, monkeypatch):
    if request.param == "all dealt out":
        monkeypatch.setattr(intervals, "PART", 4)
        monkeypatch.setattr(intervals, "PARTS", 8)


def frames(spark, left, right):
    return spark.createDataFrame(left, "id int, k string, t long"), spark.createDataFrame(right, "rid int, k string, u long")


@pytest.mark.parametrize("span", [0, 1, 7])
def test_within(spark, dealt, span):
    left, right = made(span)
    want = sorted((i, r) for i, k, t in left for r, k2, u in right if None not in (k, t, u) and k == k2 and t - span <= u <= t)
    got = intervals.within(*frames(spark, left, right), ["k"], "t", "u", span)
    assert got.columns == ["id", "k", "t", "other"]
    assert sorted((r.id, r.other.rid) for r in got.collect()) == want


@pytest.mark.parametrize("strictly", [True, False])
def test_as_of(spark, dealt, strictly):
    left, right = made(5)
    want = []
    for i, k, t in left:
        before = [(u, r) for r, k2, u in right if None not in (k, t, u) and k == k2 and (u < t or (u == t and not strictly))]
        want.append((i, max(before)[1] if before else None))
    got = intervals.as_of(*frames(spark, left, right), ["k"], "t", "u", ["rid"], strictly)
    assert got.columns == ["id", "k", "t", "other"]
    assert sorted(((r.id, r.other and r.other.rid) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_nothing_before(spark):
    left, right = frames(spark, [(1, "a", 5)], [])
    assert [(r.id, r.other) for r in intervals.as_of(left, right, ["k"], "t", "u", ["rid"]).collect()] == [(1, None)]
    assert intervals.within(left, right, ["k"], "t", "u", 3).collect() == []
