"""The rules for proposed actions as shapes over triples: a second way to judge them, from the graph alone.

Where `rules` looks at columns of an action's evidence, this one sees actions and plant as one graph, and
knows nothing but what paths in it lead to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.fixtures import COMMANDS
from groundspark.operators import rules, shapes
from groundspark.operators.paths import step
from groundspark.operators.shapes import Shape, Test

WRITE, COMMAND, ANSWER = "m:SetpointWrite", "m:UnitCommand", "m:GroundedAnswer"
_TAG, _NOTATION = {WRITE: step("m:targetSignal"), ANSWER: step("m:aboutSignal")}, step("skos:notation")
_VALUE = {WRITE: step("m:value"), ANSWER: step("m:answerValue")}
_UNIT = {WRITE: step("m:valueUnit"), ANSWER: step("m:answerUnit")}
_DIM, _TIMES, _PLUS = step("m:dimensionVector"), step("qudt:conversionMultiplier"), step("qudt:conversionOffset")
_SEEN = ~step("sosa:observedProperty") / step("sosa:hasResult") / step("qudt:numericValue")

SHAPES = [
    *[Shape("F-CARD", kind, path, least=1, most=1) for kind in (WRITE, ANSWER) for path in (_TAG[kind], _VALUE[kind], _UNIT[kind])],
    *[Shape("F-CARD", kind, _VALUE[kind], datatype="xsd:double") for kind in (WRITE, ANSWER)],
    *[Shape("F-CARD", kind, _UNIT[kind], iri=True) for kind in (WRITE, ANSWER)],
    *[Shape("F-REF", kind, _TAG[kind], cls="m:Signal") for kind in (WRITE, ANSWER)],
    Shape("F-ACC", WRITE, _TAG[WRITE] / step("m:accessMode"), among=("rw",)),
    Shape("F-CARD", COMMAND, step("m:targetAsset"), least=1, most=1),
    Shape("F-REF", COMMAND, step("m:targetAsset"), cls="m:PackMLUnit"),
    Shape("F-ENUM", COMMAND, step("m:command"), least=1, most=1, among=tuple(COMMANDS)),
]


def _in_own_unit(kind: str) -> dict:
    """Paths to a value, its unit's factors and those of the signal's unit."""
    own = _TAG[kind] / step("qudt:unit")
    paths = {"v": _VALUE[kind], "du": _UNIT[kind] / _DIM, "mu": _UNIT[kind] / _TIMES, "ou": _UNIT[kind] / _PLUS}
    return paths | {"ds": own / _DIM, "ms": own / _TIMES, "os": own / _PLUS}


NATIVE = "((double(v) * double(mu) + double(ou) - double(os)) / double(ms))"
TESTS = [
    *[Test("F-DIM", kind, {x: _in_own_unit(kind)[x] for x in ("du", "ds")}, "du <> ds") for kind in (WRITE, ANSWER)],
    Test("F-RANGE", WRITE, _in_own_unit(WRITE) | {"lo": _TAG[WRITE] / step("m:engineeringLow"), "hi": _TAG[WRITE] / step("m:engineeringHigh")}, f"du = ds and not {NATIVE} between double(lo) and double(hi)"),
    Test("F-VALUE", ANSWER, _in_own_unit(ANSWER) | {"seen": _TAG[ANSWER] / _SEEN}, f"du = ds and abs({NATIVE} - double(seen)) > 0.01 * abs(double(seen)) + 1e-9"),
    Test("F-SCOPE", WRITE, {"tag": _TAG[WRITE] / _NOTATION, "scope": step("m:scopeAsset"), "above[]": _TAG[WRITE] / step("m:belongsTo") / step("m:isPartOf").star()}, "tag is not null and scope is not null and not array_contains(above, scope)"),
    Test("F-ILK", WRITE, {"op": step("m:guardOperator"), "least": step("m:guardValue"), "reads": step("m:guardSignal") / _SEEN}, "op = '>=' and double(reads) < double(least)", each=_TAG[WRITE] / step("m:interlockedBy")),
    Test("F-ILK", WRITE, {"op": step("m:guardOperator"), "listed[]": step("m:guardValue"), "state": step("m:guardSignal") / step("m:belongsTo") / step("m:packMLState")}, "state is not null and (op = 'state_in' and not array_contains(listed, state) or op = 'state_not_in' and array_contains(listed, state))", each=_TAG[WRITE] / step("m:interlockedBy")),
    Test("F-STALE", WRITE, {"et": step("m:evidenceTime")}, rf"et rlike '(Z|[+-]\\d\\d:?\\d\\d)$' and try_to_timestamp(et) < timestamp'{rules.CUTOFF}'"),
    Test("F-STATE", COMMAND, {"kinds[]": step("m:targetAsset") / step("rdf:type"), "state": step("m:targetAsset") / step("m:packMLState"), "command": step("m:command"), "legal[]": step("m:targetAsset") / step("m:legalCommand")}, "array_contains(kinds, 'm:PackMLUnit') and state is not null and command is not null and not array_contains(legal, command)"),
]


def judged(actions: DataFrame, plant: DataFrame) -> DataFrame:
    """cid, faults (ascending) of every action, from its triples and those of the plant (s, p, o, o_kind, o_type) in one graph."""
    graph = rules.lifted(actions).unionByName(plant)
    found = shapes.faults(graph, SHAPES, TESTS).select(F.regexp_replace("focus", "^plant:action/", "").alias("its"), "families")
    none = F.array().cast("array<string>")
    return actions.select("cid").join(found, F.col("cid") == F.col("its"), "left").select("cid", F.coalesce("families", none).alias("faults"))


def compared(actions: DataFrame, world: rules.World, plant: DataFrame) -> DataFrame:
    """cid, columns, triples: the faults of every action by either way."""
    by_columns = rules.faults(rules.evidence(actions, world)).select("cid", F.array_sort("faults").alias("columns"))
    return by_columns.join(judged(actions, plant).withColumnRenamed("faults", "triples"), "cid")
