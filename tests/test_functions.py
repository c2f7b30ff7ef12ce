import difflib
import random

import pytest
from pyspark.sql import functions as F

from groundspark.functions import stats, text
from groundspark.operators import graph, lexical


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("s, n", [("", 0), ("L1_FIL", 4), ("abcde 12345", 5), ("a b", 3), ("\U0001f600!", 2), ("x" * 9, 3)])
def test_surrogate_tokens(spark, s, n):
    assert one(spark, text.surrogate_tokens(F.lit(s))) == n


@pytest.mark.parametrize("v", [0.0, 3.0, 2.5, 1e6, 123456.0, 1234567.0, 0.0001, 0.00001, -4.98, 72.21, 1e-7, 999999.5])
def test_general_format(spark, v):
    assert one(spark, text.general_format(F.lit(v))) == f"{v:g}"


def test_text_functions(spark):
    assert one(spark, text.search_tokens(F.lit("PT0301 outlet-Pressure_x"))) == ["pt", "0301", "outlet", "pressure", "x"]
    assert one(spark, text.normalized_doi(F.lit(" https://doi.org/10.1/X "))) == "10.1/x" and one(spark, text.normalized_doi(F.lit("doi:"))) is None
    assert one(spark, text.normalized_title(F.lit("Über  Größe: ﬁne"))) == "uber groe fine"
    assert one(spark, text.first_author(F.array(F.lit("Jane van Doe"), F.lit("X")))) == "doe" and one(spark, text.first_author(F.array(F.lit("Doe, Jane")))) == "doe"
    assert one(spark, text.percent_encoded(F.lit("a b*~/ü"))) == "a%20b%2A~%2F%C3%BC"
    assert one(spark, text.percent_decoded(text.percent_encoded(F.lit("a+b c")))) == "a+b c"
    assert one(spark, text.expanded_node_id(F.lit("ns=1;i=5"), F.array(F.lit("u0"), F.lit("u1")))) == "nsu=u1;i=5" and one(spark, text.expanded_node_id(F.lit("i=7"), F.array(F.lit("u0")))) == "nsu=u0;i=7"
    assert one(spark, text.positions_to_text(F.create_map(F.lit("b"), F.array(F.lit(1)), F.lit("a"), F.array(F.lit(0), F.lit(2))))) == "a b a"
    assert one(spark, text.sequence_ratio(F.lit("abcd"), F.lit("bcde"))) == round(difflib.SequenceMatcher(None, "abcd", "bcde").ratio(), 4)


def test_agreement(spark):
    a = [1, 1, 1, 1, 0, 0, 0, 0, 0, 0]
    b = [1, 1, 1, 0, 1, 0, 0, 0, 0, 0]
    pairs = spark.createDataFrame(list(zip(a, b, strict=True)) + [(1, None)], "a int, b int")
    assert abs(stats.cohen_kappa(pairs, "a", "b").first().kappa - (0.8 - 0.52) / 0.48) < 1e-12
    perfect = spark.createDataFrame([(2, 2), (2, 2)], "a int, b int")
    assert stats.cohen_kappa(perfect, "a", "b", "quadratic").first().kappa == 1.0
    codes = spark.createDataFrame([(u, c) for u, cs in enumerate(zip(a, b, strict=True)) for c in cs], "u int, c int")
    nominal, ordinal, interval = (stats.krippendorff_alpha(codes, "u", "c", level).first().alpha for level in ("nominal", "ordinal", "interval"))
    assert abs(nominal - (1 - 4 * 19 / (2 * 8 * 12))) < 1e-9 and abs(nominal - ordinal) < 1e-9 and abs(nominal - interval) < 1e-9


def test_scores_of_nothing(spark):
    empty = spark.createDataFrame([(True, True)], "t boolean, g boolean").limit(0)
    row = stats.confusion(empty, F.col("t"), F.col("g")).first()
    assert row.recall is None and row.f1 == 0.0
    low, high = stats.wilson(F.lit(0), F.lit(0))
    assert one(spark, low) == 0.0 and one(spark, high) == 0.0


def test_closure_of_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (None, 5)], "src long, dst long")
    got = {(r.src, r.dst): r.hops for r in graph.closure(edges).collect()}
    assert got[(1, 1)] == 3 and got[(1, 4)] == 3 and len(got) == 12
    zero = {(r.src, r.dst) for r in graph.closure(edges, zero_hop=True).collect()}
    assert (4, 4) in zero and len(zero) == 13


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (50, 50)], "src long, dst long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[101] == 100 and got[50] == 50


@pytest.mark.parametrize("parts", [1, 7])
def test_components_of_edges_dealt_out(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.randrange(-200, 200), rng.randrange(-200, 200)) for _ in range(180)] + [(1_000 + i, 1_001 + i) for i in range(50)] + [(None, 2_000), (2_001, None)]
    rng.shuffle(rows)
    root = {x: x for r in rows for x in r if x is not None}
    for _ in root:
        for a, b in rows:
            if a is not None and b is not None:
                root[a] = root[b] = min(root[a], root[b])
    edges = spark.createDataFrame(rows, "src long, dst long").repartition(parts)
    assert sorted((r.node, r.root) for r in graph.components(edges).collect()) == sorted(root.items())
    text = edges.selectExpr("cast(src as string) src", "cast(dst as string) dst")
    assert len({r.root for r in graph.components(text).collect()}) == len(set(root.values()))


def test_packing_skips_and_goes_on(spark):
    items = spark.createDataFrame([("q", 1, 5), ("q", 2, 9), ("q", 3, 4), ("q", 4, 1)], "g string, o int, c int")
    assert tuple(lexical.pack_greedily(items, "g", "o", "c", 10).first()) == ("q", 10, "1,3,4")
