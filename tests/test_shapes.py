"""Shapes and tests against loops over triples, and two ways to judge actions against each other."""

import random
from collections import defaultdict

import pytest

from groundspark.operators import action_shapes, rules, shapes, triples
from groundspark.operators.paths import step
from groundspark.operators.shapes import Shape, Test
from groundspark.plans import actions

SCHEMA = "s string, p string, o string, o_kind string, o_type string"
A, B = step("a"), step("b")
SHAPES = [
    Shape("least", "C", A, least=1), Shape("most", "C", A, most=1), Shape("typed", "C", A, datatype="xsd:int"), Shape("iri", "D", B, iri=True), Shape("class", "C", B, cls="D"),
    Shape("among", "D", A, among=("1", "2")), Shape("far", "C", B / A, least=1), Shape("back", "D", ~B, least=1, cls="C"), Shape("chain", "C", B.plus(), cls="D"), Shape("none", "E", A, least=1),
]


def made(seed):
    rng = random.Random(seed)
    rows = set()
    for i in range(30):
        s = f"_:n{i}" if i % 5 == 0 else f"n{i}"
        for c in "CD":
            if rng.random() < 0.6:
                rows.add((s, "rdf:type", c, "iri", None))
        for _ in range(rng.randint(0, 3)):
            v = str(rng.randint(1, 4))
            rows.add(rng.choice([(s, "a", v, "typed", "xsd:int"), (s, "a", v, "plain", None), (s, "a", v, "typed", "xsd:date")]))
        for _ in range(rng.randint(0, 2)):
            j = rng.randrange(30)
            rows.add((s, "b", f"_:n{j}", "node", None) if j % 5 == 0 else (s, "b", f"n{j}", "iri", None))
    return sorted(rows, key=repr)


def values(rows, node, path):
    """(value, kind, type) at the end of the path, from what a path means."""
    kind = lambda x: "node" if x.startswith("_:") else "iri"
    if path.kind == "step":
        if path.back:
            return {(s, kind(s), None) for s, p, o, k, _ in rows if p == path.predicate and o == node and k in ("iri", "node")}
        return {(o, k, t) for s, p, o, k, t in rows if p == path.predicate and s == node}
    if path.kind == "then":
        return {x for v, k, _ in values(rows, node, path.parts[0]) if k in ("iri", "node") for x in values(rows, v, path.parts[1])}
    found = values(rows, node, path.parts[0])
    while more := {x for v, k, _ in found if k in ("iri", "node") for x in values(rows, v, path.parts[0])} - found:
        found |= more
    return found


@pytest.mark.parametrize("seed", [1, 2])
def test_shapes(spark, seed):
    rows = made(seed)
    types = defaultdict(set)
    for s, p, o, *_ in rows:
        if p == "rdf:type":
            types[s].add(o)
    want = set()
    for i, x in enumerate(SHAPES):
        for node in (n for n in types if x.of in types[n]):
            found = values(rows, node, x.path)
            bad = [
                (v, k, t) for v, k, t in found
                if (x.datatype and (k, t) != ("typed", x.datatype)) or (x.iri and k != "iri") or (x.cls and x.cls not in types.get(v, ())) or (x.among and v not in x.among)
            ]
            if len(found) < x.least or (x.most is not None and len(found) > x.most) or bad:
                want.add((node, x.family, i, len(found), len(bad)))
    got = [tuple(r) for r in shapes.shape_faults(spark.createDataFrame(rows, SCHEMA), SHAPES).collect()]
    assert len(got) == len(set(got)) and set(got) == want and {f for _, f, *_ in want} == {x.family for x in SHAPES[:-1]}


def test_tests(spark):
    tests = [Test("less", "C", {"x": A, "y": B / A}, "int(x) < int(y)"), Test("lacks", "C", {"x": A, "z[]": B / A}, "x is not null and not array_contains(z, x)"), Test("apart", "D", {"x": A, "w": ~B / A}, "x = w", each=B), Test("no values", "C", {"z[]": A}, "size(z) = 0")]
    rows = made(3)
    of = lambda c: [s for s, p, o, *_ in rows if p == "rdf:type" and o == c]
    texts = lambda node, path: {v for v, *_ in values(rows, node, path)}
    want = {(n, "less") for n in of("C") if any(int(x) < int(y) for x in texts(n, A) for y in texts(n, B / A))}
    want |= {(n, "lacks") for n in of("C") if texts(n, A) - texts(n, B / A)}
    want |= {(n, "apart") for n in of("D") if any(texts(m, A) & texts(m, ~B / A) for m in texts(n, B))}
    want |= {(n, "no values") for n in of("C") if not texts(n, A)}
    got = [(r.focus, r.family) for r in shapes.test_faults(spark.createDataFrame(rows, SCHEMA), tests).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len({f for _, f in want}) == 4


def test_both_ways_to_judge_actions_agree(spark):
    rows = action_shapes.compared(actions.corpus(spark), rules.World(spark), triples.plant(spark)).collect()
    assert len(rows) == 137 and sum(bool(r.columns) for r in rows) == 84
    assert [(r.cid, r.columns, r.triples) for r in rows if r.columns != r.triples] == []


def test_both_ways_agree_on_odd_actions(spark):
    rng = random.Random(7)
    tags = [r.tag for r in rules.World(spark).signals.select("tag").collect()] + ["NO_SUCH", None]
    one = lambda i: (
        f"x{i}", rng.choice(["write", "command", "answer"]), "VALID", rng.choice(tags), rng.choice(["L1-FIL", "L1-CAP", "PLANT", "NOWHERE", None]), rng.choice(["Start", "Stop", "Hold", "Explode", None]),
        rng.choice(["1.0", "330.0", "-5.0", "1e9", '"330"', None]), rng.choice(["BAR", "DEG_C", "KiloW", "PERCENT", "NO_UNIT", None]), rng.choice(["L1", "L2", None]), rng.choice(["2026-07-14T02:00:00Z", "2026-07-14T02:10:00Z", "soon", None]),
    )
    df = spark.createDataFrame([one(i) for i in range(400)], rules.ACTION)
    rows = action_shapes.compared(df, rules.World(spark), triples.plant(spark)).collect()
    assert len(rows) == 400 and [(r.cid, r.columns, r.triples) for r in rows if r.columns != r.triples] == []


def test_a_walk_goes_on_once_from_each_node_that_many_starts_came_to(spark, monkeypatch):
    n, sizes, stored = 500, [], shapes.stored

    def counted(df):
        kept = stored(df)
        if "state" in kept.columns:
            sizes.append(kept.count())
        return kept

    monkeypatch.setattr(shapes, "stored", counted)
    rows = [(f"a{i}", "rdf:type", "m:Act", "iri", None) for i in range(n)] + [(f"a{i}", "m:on", f"s{i % 3}", "iri", None) for i in range(n)]
    rows += [(f"s{i}", "m:unit", f"u{i}", "iri", None) for i in range(3)] + [("u0", "m:dim", "L", "plain", None), ("u1", "m:dim", "M", "plain", None)]
    tests = [Test("F-NONE", "m:Act", {"dim": step("m:on") / step("m:unit") / step("m:dim")}, "dim is null"), Test("F-M", "m:Act", {"dim": step("m:unit") / step("m:dim")}, "dim = 'M'", each=step("m:on"))]
    got = {(r.focus, r.family) for r in shapes.test_faults(spark.createDataFrame(rows, SCHEMA), tests).collect()}
    assert got == {(f"a{i}", f) for i in range(n) for f, at in (("F-NONE", 2), ("F-M", 1)) if i % 3 == at}
    assert sizes and max(sizes) <= 6
