"""The suite of questions: packing, rendering and strategies against definitions and published figures."""

import random

import pytest
from pyspark.sql import functions as F

from groundspark import catalog, suite
from groundspark.fixtures import Plant, tables
from groundspark.operators import context, elements, grounding, lexical, retrieval


@pytest.fixture(scope="module")
def plant(spark):
    return Plant(spark)


def test_every_table_is_what_the_fixture_holds(spark, plant):
    for name, (_, rows) in tables().items():
        assert sorted(map(tuple, getattr(plant, name).collect()), key=str) == sorted(rows, key=str), name


def test_all_questions_find_the_gold_asset(spark):
    linked = {r.tid: r.assets for r in catalog.queries()["p_entity_links"](spark, "").collect()}
    gold = {r.tid: "-".join(r.gold_tag.split("_")[:2]) for r in suite.tasks(spark).where("gold_tag is not null").collect()}
    assert len(linked) == 35 and len(gold) == 19
    assert {t for t in gold if gold[t] not in linked[t].split(",")} == {"SAF-02"}  # names the line only


def test_packing_takes_what_fits_in_order(spark):
    rng, rows, want = random.Random(1), [], {}
    for g in range(20):
        costs, used, taken = [rng.randint(1, 40) for _ in range(rng.randint(0, 12))], 5, []
        for i, c in enumerate(costs):
            rows.append((g, i, c))
            if used + c <= 90:
                used += c
                taken.append(i)
        if costs:
            want[g] = (used, taken)
    got = lexical.fitted(spark.createDataFrame(rows, "g int, o int, c int"), ["g"], "o", "c", F.lit(90), F.lit(5))
    assert {r.g: (r.used, r.taken) for r in got.collect()} == want


@pytest.mark.parametrize("key", ["C1", "C2", "C4"])
def test_contexts_cost_what_their_text_costs_and_keep_the_budget(spark, plant, key):
    cond = elements.conditions()[key]
    tasks = suite.tasks(spark).where("tid in ('GRD-01', 'UNI-01', 'RNG-04')")
    ordered = retrieval.lexical_order(tasks, plant, cond).cache()
    packed = context.packed(tasks, ordered, plant, cond, (300, 1500, None)).cache()
    texts = {(r.tid, r.budget): r.n for r in context.texts(packed, plant, cond).select("tid", "budget", context.surrogate_tokens(F.col("text")).alias("n")).collect()}
    rows = packed.collect()
    assert len(rows) == 9 and all(r.tokens <= r.budget for r in rows if r.budget)
    assert all(texts[(r.tid, r.budget)] == r.tokens + (len(r.units) > 0) for r in rows)  # the line end before the definitions
    assert all((len(r.units) > 0) <= (key == "C4") for r in rows)


def test_audited_conversions_are_between_defined_units(spark, plant):
    cond = elements.conditions()["C4"]
    tasks = suite.tasks(spark).where("tid = 'UNI-01'")
    packed = context.packed(tasks, retrieval.lexical_order(tasks, plant, cond), plant, cond).cache()
    units = set(packed.first().units)
    conv = lambda audited: {r.fact for r in context.stated(packed, plant, cond, audited).where("fact like 'conv:%'").collect()}
    assert conv(True) == {f for f in conv(False) if set(f[5:].split("|")) <= units} and conv(True) < conv(False)


def test_facts_as_keys(spark):
    row = spark.range(1).select(elements.fact("feeds", F.lit("A"), F.lit("B")).alias("f")).select("f", elements.fact_parts(F.col("f")).alias("p")).first()
    assert row.f == "feeds:A|B" and (row.p.kind, row.p.args) == ("feeds", ["A", "B"])


def test_decoded_tags(spark):
    tags = ["L1_FIL_PT0301_PV", "AI_04001", "=1LCA10CP001XQ01", "UT_CHL_TIC0901_SP"]
    got = [r.d for r in spark.createDataFrame([(t,) for t in tags], "tag string").select(retrieval.decoded(F.col("tag")).alias("d")).collect()]
    assert got == ["line 1 first line filler filling fill pressure measurement reading value", "", "", "utilities utility chiller chilled water cooling temperature setpoint setpoint target"]


def test_probe_results_and_contexts_cost_what_was_published(spark):
    got = {r.tid: (r.rows, r.result_tokens, r.context_tokens) for r in catalog.queries()["p_probe_cost"](spark, "").collect()}
    assert {t: n for t, (n, _, _) in got.items()} == {"UNI-05": 1, "RNG-04": 1, "TOP-02": 3, "TOP-03": 5, "ACT-04": 1, "SAF-04": 3, "PRV-04": 3, "GRD-01": 1}
    assert {t: n for t, (_, n, _) in got.items() if t != "PRV-04"} == {"UNI-05": 1, "RNG-04": 25, "TOP-02": 23, "TOP-03": 77, "ACT-04": 8, "SAF-04": 140, "GRD-01": 19}
    assert {t: n for t, (_, _, n) in got.items()} == {"UNI-05": 5373, "RNG-04": 741, "TOP-02": 5461, "TOP-03": 5172, "ACT-04": 5172, "SAF-04": 5172, "PRV-04": 5492, "GRD-01": 5501}


def test_ranks_and_distractors(spark):
    asked = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "tid string, gold_tag string")
    found = spark.createDataFrame([("a", "x", 1), ("a", "w", 2), ("b", "w", 1), ("b", "y", 2)], "tid string, eid string, pos int")
    near = spark.createDataFrame([("a", "w"), ("b", "q")], "tid string, tag string")
    got = {r.tid: (r["rank"], r.top1, r.distractors) for r in grounding.ranks(asked, found, near).collect()}
    assert got == {"a": (1, True, 1), "b": (2, False, 0), "c": (None, False, 0)}
    scores = grounding.rank_scores(grounding.ranks(asked, found, near)).first()
    assert (scores.n, round(scores.top1, 3), scores.mrr, round(scores.recall, 3), scores.distractors) == (3, 0.333, 0.5, 0.667, 1)
