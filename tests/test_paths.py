"""Regular paths and closures against walks one step at a time."""

import random

import pytest
from pyspark.sql import functions as F

from groundspark.operators import graph, paths
from groundspark.operators.paths import step

A, B = step("a"), step("b")
PATHS = {
    "step": A, "back": ~A, "then": A / B, "or": A | B, "star": A.star(), "plus": (A | B).plus(), "then star": A / B.star(), "back star": ~(A / B.star()), "maybe": A.maybe() / B, "nested": (A / ~B).plus() | B.maybe(), "two stars": A.star() / B.star(), "star of maybe": (A.maybe() / B.maybe()).star(), "turned twice": ~~(A / B),
}


def walked(triples, path):
    """All pairs, from what a path means."""
    nodes = {x for s, _, o in triples for x in (s, o)}
    if path.kind == "step":
        return {(o, s) if path.back else (s, o) for s, p, o in triples if p == path.predicate}
    parts = [walked(triples, p) for p in path.parts]
    if path.kind == "or":
        return parts[0] | parts[1]
    if path.kind == "then":
        return {(a, d) for a, b in parts[0] for c, d in parts[1] if b == c}
    if path.kind == "maybe":
        return parts[0] | {(n, n) for n in nodes}
    found = set(parts[0])
    while more := {(a, d) for a, b in found for c, d in parts[0] if b == c} - found:
        found |= more
    return found


@pytest.mark.parametrize("name", PATHS)
def test_paths_join_what_walks_join(spark, name):
    rng = random.Random(name)
    triples = [(f"n{rng.randrange(7)}", rng.choice("abc"), f"n{rng.randrange(7)}") for _ in range(14)]
    df = spark.createDataFrame(triples, "s string, p string, o string")
    want = walked(triples, PATHS[name])
    got = [tuple(r) for r in paths.reached(df, PATHS[name]).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    some = {"n0", "n3"}
    nodes = {x for s, _, o in triples for x in (s, o)}
    starts = spark.createDataFrame([(n,) for n in some], "node string")
    from_some = {tuple(r) for r in paths.reached(df, PATHS[name], starts).collect()}
    assert {p for p in from_some if p[0] in nodes} == {p for p in want if p[0] in some}


def test_a_chain_takes_rounds_as_its_logarithm(spark, monkeypatch):
    rounds, checkpointed = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: rounds.append(1) or checkpointed(df))
    n = 200
    got = graph.closure(spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    assert got.count() == n * (n + 1) // 2 and got.where("hops <> dst - src").count() == 0
    assert len(rounds) <= 10


def test_hops_are_the_fewest(spark):
    rng = random.Random(6)
    edges = {(rng.randrange(12), rng.randrange(12)) for _ in range(20)}
    far = {}
    for s in range(12):
        layer, hops = {d for a, d in edges if a == s}, 1
        while layer:
            far |= {(s, d): hops for d in layer if (s, d) not in far}
            layer, hops = {d for a, d in edges if a in layer} - {d for a, d in far if a == s}, hops + 1
    df = spark.createDataFrame(sorted(edges), "src int, dst int")
    assert {(r.src, r.dst): r.hops for r in graph.closure(df).collect()} == far
    some = graph.closure(df, spark.createDataFrame([(2,), (5,)], "src int"))
    assert {(r.src, r.dst): r.hops for r in some.collect()} == {k: v for k, v in far.items() if k[0] in (2, 5)}


def test_no_triples(spark):
    none = spark.createDataFrame([], "s string, p string, o string")
    assert paths.reached(none, A.star()).count() == paths.reached(none, A / B).count() == 0


@pytest.mark.parametrize("name", ["then", "then star", "back star", "maybe", "two stars", "turned twice", "plus"])
def test_counts_are_those_of_the_pairs(spark, name):
    rng = random.Random(name)
    triples = [(f"n{rng.randrange(7)}", rng.choice("abc"), f"n{rng.randrange(7)}") for _ in range(14)]
    want = walked(triples, PATHS[name])
    got = paths.counted(spark.createDataFrame(triples, "s string, p string, o string"), PATHS[name]).collect()
    assert [tuple(r) for r in got] == [(len(want), len({a for a, _ in want}), len({b for _, b in want}))]


def test_pairs_of_a_sequence_are_counted_without_being_written_out(spark, monkeypatch):
    sizes, stored = [], paths.stored
    monkeypatch.setattr(paths, "stored", lambda df: sizes.append((kept := stored(df)).count()) or kept)
    n = 400
    triples = [(f"o{i}", "a", "hub") for i in range(n)] + [("hub", "b", f"t{i}") for i in range(n)]
    got = paths.counted(spark.createDataFrame(triples, "s string, p string, o string"), A / B).collect()
    assert [tuple(r) for r in got] == [(n * n, n, n)] and max(sizes) <= n
