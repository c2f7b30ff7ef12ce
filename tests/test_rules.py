"""Validators against rules written out one action at a time, and what they must not let through."""

import random

import pytest
from pyspark.sql import functions as F

from groundspark.fixtures import Plant, frame, tables
from groundspark.operators import grade, naming, reports, rules
from groundspark.plans import actions

T = {name: rows for name, (_, rows) in tables().items()}
SIGNAL = {r[0]: dict(zip(["tag", "asset", "ord", "said", "unit", "kind", "low", "high", "access", "role", "al", "ah", "safe", "value"], r, strict=True)) for r in T["signals"]}
ASSET = {r[0]: {"parent": r[8], "packml": r[10], "state": r[11]} for r in T["assets"]}
UNIT = {r[0]: {"m": r[4], "s": r[5], "dim": dict(T["quantity_kinds"])[r[3]]} for r in T["units"]}
LEGAL = {(r[0], r[1]) for r in T["transitions"]}
VERBS = {r[0] for r in T["commands"]}


def number(v):
    if v in ("true", "false"):
        return float(v == "true")
    try:
        return None if v is None or v.startswith('"') else float(v)
    except ValueError:
        return None


def native(a, s):
    x, u = number(a["value"]), UNIT.get(a["unit"])
    own = UNIT[s["unit"]]
    return None if x is None or u is None or u["dim"] != own["dim"] else (x * u["m"] + u["s"] - own["s"]) / own["m"]


def signature(a):
    need = ("asset", "command") if a["kind"] == "command" else ("tag", "value", "unit")
    out = {"F-CARD"} if any(a[k] is None for k in need) else set()
    if a["kind"] == "command" and a["command"] not in VERBS:
        out.add("F-ENUM")
    if a["kind"] != "command" and a["value"] is not None and number(a["value"]) is None:
        out.add("F-CARD")
    return out


def catalogue(a, convert):
    out = signature(a)
    if a["kind"] == "command":
        return out | (set() if a["asset"] in ASSET else {"F-REF"})
    if a["tag"] is None:
        return out
    s = SIGNAL.get(a["tag"])
    if s is None:
        return out | {"F-REF"}
    write, x = a["kind"] == "write", number(a["value"])
    if write and s["access"] == "r":
        out.add("F-ACC")
    if convert:
        if x is not None and a["unit"] is not None:
            v = native(a, s)
            if v is None:
                out.add("F-DIM")
            elif write and not s["low"] <= v <= s["high"]:
                out.add("F-RANGE")
    else:
        if write and x is not None and not s["low"] <= x <= s["high"]:
            out.add("F-RANGE")
        if a["unit"] is not None and a["unit"] != s["unit"]:
            out.add("F-DIM")
    return out


def full(a):
    out = set()
    if a["kind"] == "command":
        out |= {"F-CARD"} if a["asset"] is None else set()
        out |= {"F-ENUM"} if a["command"] not in VERBS else set()
        if a["asset"] is None:
            return out
        known = ASSET.get(a["asset"], {})
        if not known.get("packml"):
            return out | {"F-REF"}
        return out | ({"F-STATE"} if a["command"] is not None and (known["state"], a["command"]) not in LEGAL else set())
    if any(a[k] is None for k in ("tag", "value", "unit")) or number(a["value"]) is None:
        out.add("F-CARD")
    if a["kind"] == "write" and a["evidence_time"] is not None and a["evidence_time"] < rules.CUTOFF:
        out.add("F-STALE")  # whatever the target
    if a["tag"] is None:
        return out
    s = SIGNAL.get(a["tag"])
    if s is None:
        return out | {"F-REF"}
    v = native(a, s)
    if a["unit"] in UNIT and UNIT[a["unit"]]["dim"] != UNIT[s["unit"]]["dim"]:
        out.add("F-DIM")
    if a["kind"] == "answer":
        if v is not None and s["value"] is not None and abs(v - s["value"]) > 0.01 * abs(s["value"]) + 1e-9:
            out.add("F-VALUE")
        return out
    if s["access"] == "r":
        out.add("F-ACC")
    if v is not None and not s["low"] <= v <= s["high"]:
        out.add("F-RANGE")
    if a["scope"] is not None:
        at = s["asset"]
        while at is not None and at != a["scope"]:
            at = ASSET[at]["parent"]
        if at is None:
            out.add("F-SCOPE")
    for _, tag, guard, op, least, states, _ in T["interlocks"]:
        if tag == a["tag"]:
            seen, state = SIGNAL[guard]["value"], ASSET[SIGNAL[guard]["asset"]]["state"]
            if (op == ">=" and seen is not None and seen < least) or (op == "state_in" and state is not None and state not in states.split(",")) or (op == "state_not_in" and state is not None and state in states.split(",")):
                out.add("F-ILK")
    return out


KEYS = [c.split(" ")[0] for c in rules.ACTION.split(", ")]


def anything(rng, k):
    kind = rng.choice(["write", "write", "command", "answer"])
    pick = lambda xs, p=0.9: rng.choice(xs) if rng.random() < p else None
    a = dict.fromkeys(KEYS) | {"cid": f"x{k}", "kind": kind, "gold": "VALID"}
    if kind == "command":
        return a | {"asset": pick([*ASSET, "L9-XXX"]), "command": pick([*VERBS, "Fly"])}
    s = SIGNAL[rng.choice(list(SIGNAL))]
    value = rng.choice([str(round(rng.uniform(s["low"] - 1, s["high"] + 1), 2)), str(s["value"] or 1.0), "true", '"330"', "1e3"])
    a |= {"tag": pick([s["tag"], s["tag"], "NO_SUCH_TAG"]), "value": value if rng.random() < 0.9 else None, "unit": pick([s["unit"], s["unit"], *UNIT, "NO_UNIT"])}
    return a | {"scope": pick([*ASSET], 0.3), "evidence_time": pick(["2026-07-14T02:19:00Z", "2026-07-13T22:40:00Z"], 0.6)} if kind == "write" else a


def test_tiers_are_the_rules_one_by_one(spark):
    rng = random.Random(6)
    cases = [anything(rng, k) for k in range(400)] + [r.asDict() for r in actions.corpus(spark).select(KEYS).collect()]
    df = spark.createDataFrame([tuple(a[k] for k in KEYS) for a in cases], rules.ACTION)
    got = {(r.cid, r.tier): set(r.families) for r in rules.judged(df, rules.World(spark)).collect()}
    g3 = set(rules.TIERS["G3"])
    for a in cases:
        want = {"G0": set(), "G1": signature(a), "G2": catalogue(a, False), "GP": catalogue(a, True), "G3": full(a) & g3, "G4": full(a)}
        for tier, families in want.items():
            assert got[a["cid"], tier] == families, (tier, a)
    own = df.where("cid like 'C%'")
    three = rules.three_valued(own, rules.World(spark))
    engine = rules.faults(rules.evidence(own, rules.World(spark))).select("cid", "faults")
    assert rules.disagreements(three, engine).count() == 0
    (s,) = rules.validator_summary(three).collect()
    assert (s.n, s.recall, s.fpr, s.diagnosis, s.abstentions) == (137, 1.0, 0.0, 1.0, 0) and 0.95 < s.recall_low < s.recall_high and s.recall_high == pytest.approx(1.0)


def test_published_cohort_and_families(spark):
    verdicts = rules.judged(actions.corpus(spark), rules.World(spark), gold_aware=True).cache()
    t = {r.family: r for r in rules.family_table(verdicts).collect()}
    assert {f: r.n for f, r in t.items()}["F-DIM"] == 13 and all(r.G4 == r.n and r.G0 == 0 for r in t.values()) and len(t) == 12
    c = {r.tier: r for r in rules.cohort(verdicts).collect()}
    assert (c["G2"].false_alarms, c["G2"].recall, c["G2"].scale_caught, c["G2"].scale_n) == (4, 0.679, 0, 4)
    assert (c["GP"].scale_caught, c["GP"].behavioural_caught, c["G4"].behavioural_caught, c["G4"].behavioural_n) == (4, 0, 22, 22)


def test_unknown_guards_abstain(spark):
    locks = frame(spark, "interlocks").withColumn("operator", F.lit("=="))
    a = spark.createDataFrame([("a", "write", "VALID", "L1_FIL_QIC0305_SP", None, None, "330.0", "MilliL", None, None)], rules.ACTION)
    assert [(r.disposition, r.missing) for r in rules.three_valued(a, rules.World(spark, interlocks=locks)).collect()] == [("abstain", ["guard_operator"])]
    assert rules.three_valued(a, rules.World(spark)).first().disposition == "reject"


@pytest.mark.parametrize("value", ['"330"', "true", "NaN", "Infinity"])
def test_no_number_is_rejected(spark, value):
    a = spark.createDataFrame([("a", "write", "VALID", "L2_FIL_QIC0305_SP", None, None, value, "MilliL", None, None)], rules.ACTION)
    assert "F-CARD" in rules.three_valued(a, rules.World(spark)).first().faults


def test_proposals(spark):
    rows = [("a", '{"action": "write_setpoint", "tag": "L1_FIL_PIC0301_SP", "value": 2.5, "unit": "BAR"}'), ("b", '{"tag": "L1_FIL_PIC0301_SP", "value": "2.5", "unit": "BAR"}'), ("c", '{"action": "packml_command", "asset": "L1-FIL", "command": "Start"}'), ("d", "no json")]
    got = {r.cid: (r.ok, r.families) for r in rules.validated(spark.createDataFrame(rows, "cid string, payload string"), rules.World(spark)).collect()}
    assert got == {"a": (True, []), "b": (False, ["F-CARD"]), "c": (False, ["F-STATE"]), "d": (False, ["F-CARD"])}


def test_lifted_actions(spark):
    graph = rules.lifted(actions.corpus(spark))
    assert graph.where("p = 'rdf:type'").count() == 137 and graph.where("p = 'm:valueUnit'").count() == actions.corpus(spark).where("kind = 'write' and unit is not null").count()


def test_names_that_meet_get_letters(spark):
    rows = [("a", 1, "L1_FIL", "PT1", "PV"), ("b", 2, "L1_FIL", "PT1", "PV"), ("c", 3, "L1_FIL", "PT1", "PV"), ("d", 4, "L1_FIL", "PT2", "PV")]
    tags = naming.bumped(spark.createDataFrame(rows, "tag string, ord int, head string, loop string, tail string"))
    assert {r.tag: r.new_tag for r in tags.collect()} == {"a": "L1_FIL_PT1_PV", "b": "L1_FIL_PT1A_PV", "c": "L1_FIL_PT1B_PV", "d": "L1_FIL_PT2_PV"}
    assert naming.injective(tags).count() == 0 and naming.in_scope(Plant(spark).signals, "L1").count() == 35


def test_reports(spark):
    rows = spark.createDataFrame([("C0", "INSUFFICIENT: x", "Yes", False), ("C0", "No", "Yes", False), ("C4", "yes it is", "Yes", True), ("C4", "", "Yes", True)], "cond string, answer string, gold string, sufficient boolean")
    scores = {r.cond: r for r in reports.with_ceilings(reports.answer_scores(reports.graded(rows), "cond"), spark.createDataFrame([("C4", 0.9)], "cond string, ceiling double")).collect()}
    assert (scores["C0"].accuracy, scores["C0"].refusal, scores["C0"].invented, scores["C0"].right_when_sufficient, scores["C0"].ceiling) == (0.0, 0.5, 0.5, None, None)
    assert (scores["C4"].accuracy, scores["C4"].right_when_sufficient, scores["C4"].invented, scores["C4"].ceiling) == (0.5, 0.5, None, 0.9)
    audit = reports.archive_audit(spark.createDataFrame([("C0", 2), ("C1", 105)], "cond string, n int"), rows)
    assert {r.cond: (r.raw_n, r.matches) for r in audit.collect()} == {"C0": (2, True), "C1": (0, False)}
    matrix = spark.createDataFrame([("A", "3", "2", "2"), ("B", "3", "3", "3"), ("C", "1", "3", "3")], "technology string, U3 string, U5 string, U6 string")
    assert tuple(reports.covering(matrix).first()) == (["A", "B"], ["B"]) and {r.criterion: r.n for r in reports.first_class(matrix, ["U3", "U5", "U6"]).collect()} == {"U3": 2, "U5": 2, "U6": 2}
    asked = spark.createDataFrame([("C4", 7, "facts", "why?")], "label string, tokens int, text string, question string").withColumn("prompt", reports.prompt(F.col("label"), F.col("tokens"), F.col("text"), F.col("question")))
    assert asked.first().prompt.startswith("CONTEXT (C4, 7 tokens)\n---") and asked.first().prompt.endswith("QUESTION: why?\nANSWER:")
    assert reports.completed(asked, lambda p: str(len(p))).first().answer == str(len(asked.first().prompt))
    assert reports.completed(asked, lambda p: p.missing).first().answer.startswith("error: ")
    mock = spark.range(1).select(grade.mock_answer(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("b")), F.lit("gold")).alias("x")).first().x
    assert mock == "INSUFFICIENT: a"
