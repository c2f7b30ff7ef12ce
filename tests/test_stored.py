"""Copies of large tables: whole, compressed, and gone when nothing reads them again."""

import os

from pyspark.sql import functions as F

from groundspark.operators import isomorphism, shapes
from groundspark.operators.paths import step
from groundspark.session import checkpointed, discard, shared_folder, stored


def _bytes(spark):
    """Of all files in the folder that checkpoints of this session share."""
    folder = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    own = shared_folder(spark).removeprefix("file://").removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for top in {folder, own} for d, _, names in os.walk(top) for f in names)


def test_a_copy_is_whole_small_and_removed(spark):
    df = spark.range(20_000).select(F.concat(F.lit("_:node/"), "id").alias("s"), F.encode(F.md5(F.col("id").cast("string")), "utf-8").alias("b"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("n"))
    shared_folder(spark)
    before = _bytes(spark)
    raw = checkpointed(df)
    middle = _bytes(spark)
    copy = stored(df.repartition("n"))
    after = _bytes(spark)
    assert copy.exceptAll(raw).isEmpty() and raw.exceptAll(copy).isEmpty()
    assert after - middle < (middle - before) / 2
    discard(copy, raw)
    assert _bytes(spark) <= middle
    assert stored(df.where("false")).count() == 0


def test_a_triple_that_comes_again_counts_once(spark):
    triple = "s string, p string, o string, o_kind string, o_type string"
    rows = [("x", "has", "_:a", "node", None), ("_:a", "is", "y", "iri", None), ("_:a", "next", "_:b", "node", None), ("_:b", "is", "z", "plain", None)]
    one, twice = spark.createDataFrame(rows, triple), spark.createDataFrame(rows * 2, triple).repartition(3)
    other = spark.createDataFrame([*rows[:3], ("_:b", "is", "other", "plain", None)] * 2, triple)
    assert isomorphism.compare(one, twice).isEmpty()
    assert sorted((r.side, r.s) for r in isomorphism.compare(one, other).collect()) == [(x, s) for x in "ab" for s in ("_:a", "_:a", "_:b", "x")]


def test_shapes_and_tests_keep_compressed_copies_only(spark):
    triple = "s string, p string, o string, o_kind string, o_type string"
    rows = [x for i in range(3_000) for x in ((f"line:{i}", "rdf:type", "m:Line", "iri", None), (f"line:{i}", "m:of", f"part:{i % 7}", "iri", None))] + [(f"part:{i}", "m:size", str(i), "typed", "xsd:integer") for i in range(7)]
    shared_folder(spark)
    before = _bytes(spark)
    graph = spark.createDataFrame(rows, triple)
    rules = [shapes.Shape("F-SIZE", "m:Line", step("m:of") / step("m:size"), least=1, among=("1", "2"))]
    tests = [shapes.Test("F-TWO", "m:Line", {"size": step("m:of") / step("m:size")}, "size = '2'")]
    found = {r.focus: r.families for r in shapes.faults(graph, rules, tests).collect()}
    want = {f"line:{i}": ["F-TWO"] if i % 7 == 2 else ["F-SIZE"] for i in range(3_000) if i % 7 != 1}
    assert found == want
    assert _bytes(spark) - before < 600_000
