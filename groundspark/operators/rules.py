"""Validation of proposed actions: evidence in one wide row, rules as columns, tiers as sets of rules.

Everything an action is judged by (catalogue, units, scope closure, interlocks, states) is small and
fixed, so it is broadcast; judging a stream or a table of actions shuffles nothing.

Actions have the columns cid, kind (write, command, answer), gold, tag, asset, command, value (JSON as
proposed: 330.0, true, NaN, and "330" with its quotes for a text), unit, scope, evidence_time; an absent key is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.fixtures import frame
from groundspark.functions import stats, units
from groundspark.operators import graph, triples

ACTION = "cid string, kind string, gold string, tag string, asset string, command string, value string, unit string, scope string, evidence_time string"
CAPABILITIES = ("units", "topology", "behaviour", "constraints", "provenance")
CUTOFF = "2026-07-14T02:05:00Z"
SIGNATURE = ("F-CARD", "F-ENUM")
STATE_GUARDS = ("state_in", "state_not_in")
#: What the tiers that share the full rules may report.
TIERS = {
    "G3": (*SIGNATURE, "F-REF", "F-ACC", "F-SCOPE", "F-RANGE", "F-DIM"),
    "G4": (*SIGNATURE, "F-REF", "F-ACC", "F-SCOPE", "F-RANGE", "F-DIM", "F-ILK", "F-STATE", "F-STALE", "F-VALUE"),
}


class World:
    """The tables that actions are judged by; any of them may be replaced to ask what if."""

    def __init__(self, spark: SparkSession, **replaced: DataFrame):
        self.signals, self.assets, self.interlocks, self.transitions = (replaced.get(n, frame(spark, n)) for n in ("signals", "assets", "interlocks", "transitions"))
        self.units = replaced.get("units", units.catalogue(spark))
        self.observations = replaced.get("observations", self.signals.where("value is not null").select("tag", F.col("value").alias("observed")))
        self.commands = frame(spark, "commands")

    def scopes(self) -> DataFrame:
        """asset_id, scopes: the asset and all above it."""
        up = graph.closure(self.assets.select(F.col("asset_id").alias("src"), F.col("parent").alias("dst")), zero_hop=True)
        return up.groupBy(F.col("src").alias("asset_id")).agg(F.collect_set("dst").alias("scopes"))

    def guards(self) -> DataFrame:
        """tag, guards: operator, threshold, listed states, observed value and state of the guard's owner."""
        owner = self.signals.select(F.col("tag").alias("guard_tag"), "asset_id").join(F.broadcast(self.assets.select("asset_id", F.col("state").alias("guard_state"))), "asset_id", "left")
        seen = self.observations.select(F.col("tag").alias("guard_tag"), F.col("observed").alias("guard_value"))
        rows = self.interlocks.join(F.broadcast(owner), "guard_tag", "left").join(F.broadcast(seen), "guard_tag", "left")
        return rows.groupBy("tag").agg(F.collect_list(F.struct("operator", "threshold", F.split("states", ",").alias("listed"), "guard_value", "guard_state")).alias("guards"))


def evidence(actions: DataFrame, world: World) -> DataFrame:
    """Actions with all they are judged by; nothing is dropped."""
    s = world.signals.select("tag", F.col("asset_id").alias("owner"), F.col("unit").alias("own_unit"), "low", "high", "access")
    u = world.units
    stated = u.select("unit", F.col("dim").alias("dim"), F.col("multiplier").alias("m1"), F.col("shift").alias("s1"))
    own = u.select(F.col("unit").alias("own_unit"), F.col("dim").alias("own_dim"), F.col("multiplier").alias("m2"), F.col("shift").alias("s2"))
    a = world.assets.select(F.col("asset_id").alias("asset"), "packml", "state")
    moves = world.transitions.groupBy("state").agg(F.collect_set("command").alias("legal"))
    verbs = world.commands.agg(F.collect_set("command").alias("verbs"))
    for small, key in ((s, "tag"), (stated, "unit"), (own, "own_unit"), (world.scopes().withColumnRenamed("asset_id", "owner"), "owner"), (world.guards(), "tag"), (world.observations, "tag"), (a, "asset"), (moves, "state")):
        actions = actions.join(F.broadcast(small), key, "left")
    # A truth value counts as a number here; the three-valued validator tells them apart.
    number = F.when(F.col("value").rlike(r"^(-?\d+(\.\d+)?([eE][-+]?\d+)?|NaN|-?Infinity)$"), F.col("value").try_cast("double")).when(F.col("value").isin("true", "false"), (F.col("value") == "true").cast("double"))
    joined = actions.join(F.broadcast(verbs), F.lit(True)).withColumn("number", number)
    native = F.when(F.col("dim") == F.col("own_dim"), units.converted(F.col("number"), F.col("m1"), F.col("s1"), F.col("m2"), F.col("s2")))
    return joined.withColumn("native", native)


def _when(condition: Column, name: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), name)


def _set(*found: Column) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def _guard_fails() -> Column:
    """Whether some guard does not hold; one that cannot be told, or whose operator is not known, does not fail."""

    def judge(g: Column) -> Column:
        listed = F.array_contains(g["listed"], g["guard_state"])
        return F.coalesce(F.when(g["operator"] == ">=", g["guard_value"] < g["threshold"]).when(g["operator"] == "state_in", ~listed).when(g["operator"] == "state_not_in", listed), F.lit(False))

    return F.coalesce(F.exists("guards", judge), F.lit(False))


def faults(rows: DataFrame) -> DataFrame:
    """evidence rows with the families that apply: `faults` by the full model, `signature` by the call alone, `flat` by a catalogue without unit calculus, `procedural` by one that converts units."""
    c = F.col
    write, command, answer = (c("kind") == k for k in ("write", "command", "answer"))
    valued, known = write | answer, c("own_unit").isNotNull()
    verb = F.coalesce(F.array_contains("verbs", c("command")), F.lit(False))
    lacks = F.when(valued, c("tag").isNull() | c("value").isNull() | c("unit").isNull()).otherwise(c("asset").isNull())
    no_number = valued & c("value").isNotNull() & c("number").isNull()
    signature = [_when(lacks | no_number | (command & c("command").isNull()), "F-CARD"), _when(command & ~verb, "F-ENUM")]
    unknown_tag, read_only = valued & c("tag").isNotNull() & ~known, _when(write & (c("access") == "r"), "F-ACC")
    # A catalogue asks whether an asset is known, the model whether it takes commands.
    listed = _when(F.when(valued, unknown_tag).otherwise(c("packml").isNull()), "F-REF")
    full = [
        _when(lacks | no_number, "F-CARD"),  # a command that is missing is none of those allowed
        _when(command & ~verb, "F-ENUM"),
        _when(F.when(valued, unknown_tag).otherwise(c("asset").isNotNull() & ~F.coalesce(c("packml"), F.lit(False))), "F-REF"),
        read_only,
        _when(valued & known & (c("dim") != c("own_dim")), "F-DIM"),
        _when(write & ~c("native").between(c("low"), c("high")), "F-RANGE"),
        _when(write & c("scope").isNotNull() & ~F.array_contains("scopes", c("scope")), "F-SCOPE"),
        _when(write & _guard_fails(), "F-ILK"),
        _when(write & (moment() < F.lit(CUTOFF).cast("timestamp")), "F-STALE"),
        _when(command & c("command").isNotNull() & c("packml") & c("state").isNotNull() & ~F.coalesce(F.array_contains("legal", c("command")), F.lit(False)), "F-STATE"),  # a verb that nothing knows is legal nowhere
        _when(answer & (F.abs(c("native") - c("observed")) > 0.01 * F.abs(c("observed")) + 1e-9), "F-VALUE"),
    ]
    flat = [*signature, listed, read_only, _when(write & ~c("number").between(c("low"), c("high")), "F-RANGE"), _when(valued & known & (c("unit") != c("own_unit")), "F-DIM")]
    stated = valued & known & c("number").isNotNull() & c("unit").isNotNull()
    procedural = [*signature, listed, read_only, _when(stated & ~F.coalesce(c("dim") == c("own_dim"), F.lit(False)), "F-DIM"), _when(write & ~c("native").between(c("low"), c("high")), "F-RANGE")]
    return rows.withColumns({"faults": _set(*full), "signature": _set(*signature), "flat": _set(*flat), "procedural": _set(*procedural)})


def moment() -> Column:
    """The evidence time; null if malformed or without a zone."""
    return F.when(F.col("evidence_time").rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp("evidence_time"))


def judged(actions: DataFrame, world: World, gold_aware: bool = False) -> DataFrame:
    """cid, gold, tier, families, detected, diagnosed: one row an action and tier.

    A scale error shows as F-RANGE. gold_aware gives it the finer label when the gold label says so, as the
    published diagnosis rates do; a gate in use has no gold label and leaves it off.
    """
    rows = faults(evidence(actions, world))
    options = [F.struct(F.lit(t).alias("tier"), F.array_intersect("faults", F.array(*map(F.lit, f))).alias("families")) for t, f in TIERS.items()]
    none = F.array().cast("array<string>")
    options += [F.struct(F.lit(t).alias("tier"), found.alias("families")) for t, found in (("G0", none), ("G1", F.col("signature")), ("G2", F.col("flat")), ("GP", F.col("procedural")))]
    long = rows.select("cid", "gold", F.explode(F.array(*options)).alias("t")).select("cid", "gold", "t.*")
    same = F.array_contains("families", F.col("gold"))
    scale = (F.col("gold") == "F-UNITSCALE") & (F.col("tier") != "G2") & F.array_contains("families", F.lit("F-RANGE"))
    return long.withColumn("detected", F.size("families") > 0).withColumn("diagnosed", same | scale if gold_aware else same)


def tier_scores(verdicts: DataFrame) -> DataFrame:
    """tier, caught, recall, diagnosis, false_alarms."""
    faulty = F.col("gold") != "VALID"
    n = verdicts.groupBy("tier").agg(F.count_if(faulty).alias("faulty"), F.count_if(faulty & F.col("detected")).alias("caught"), F.count_if(faulty & F.col("diagnosed")).alias("named"), F.count_if(~faulty & F.col("detected")).alias("false_alarms"))
    return n.select("tier", "caught", F.round(F.try_divide("caught", "faulty"), 3).alias("recall"), F.round(F.try_divide("named", "faulty"), 3).alias("diagnosis"), "false_alarms")


def three_valued(actions: DataFrame, world: World, removed: tuple[str, ...] = ("",)) -> DataFrame:
    """cid, gold, removed, faults, missing, disposition: reject, else abstain where evidence is missing, else accept.

    One row an action and removed capability ('' removes none).
    """
    c = F.col
    rows = faults(evidence(actions, world)).withColumn("removed", F.explode(F.array(*map(F.lit, removed))))
    can = {x: c("removed") != x for x in CAPABILITIES}
    write, command, answer = (c("kind") == k for k in ("write", "command", "answer"))
    known = c("own_unit").isNotNull()
    target = (write | answer) & known
    convertible = can["units"] & c("dim").isNotNull() & c("own_dim").isNotNull()
    finite = c("number").isNotNull() & ~c("value").isin("true", "false") & ~F.isnan("number") & (F.abs("number") < F.lit(float("inf")))
    unit_ok = finite & c("unit").isNotNull()
    no_machine = command & ~F.coalesce(c("packml"), F.lit(False))
    needs = {
        "F-DIM": can["units"] & finite, "F-RANGE": can["units"] & finite, "F-VALUE": can["units"] & can["provenance"] & finite, "F-SCOPE": can["topology"], "F-STALE": can["provenance"],
    }
    numeric = F.coalesce(F.exists("guards", lambda g: (g["operator"] == ">=") & (g["guard_value"] < g["threshold"])), F.lit(False))
    state = F.coalesce(F.exists("guards", lambda g: F.when(g["operator"] == "state_in", ~F.array_contains(g["listed"], g["guard_state"])).when(g["operator"] == "state_not_in", F.array_contains(g["listed"], g["guard_state"])).otherwise(False)), F.lit(False))
    found = [
        *[_when(F.array_contains("signature", F.lit(f)), f) for f in SIGNATURE],
        _when(target & ~finite, "F-CARD"),
        _when(F.array_contains("faults", F.lit("F-ACC")), "F-ACC"),
        _when(no_machine | ((write | answer) & ~known), "F-REF"),
        *[_when(F.array_contains("faults", F.lit(f)) & ok, f) for f, ok in needs.items()],
        # A command that is missing is not legal either.
        _when(command & can["behaviour"] & c("packml") & c("state").isNotNull() & ~F.coalesce(F.array_contains("legal", c("command")), F.lit(False)), "F-STATE"),
        _when(write & known & can["constraints"] & ((numeric & can["provenance"]) | (state & can["behaviour"])), "F-ILK"),
    ]
    of_numeric = F.coalesce(F.exists("guards", lambda g: g["operator"] == ">="), F.lit(False))
    of_state = F.coalesce(F.exists("guards", lambda g: g["operator"].isin(*STATE_GUARDS)), F.lit(False))
    of_unknown = F.coalesce(F.exists("guards", lambda g: ~g["operator"].isin(">=", *STATE_GUARDS)), F.lit(False))
    blind_value = F.coalesce(F.exists("guards", lambda g: (g["operator"] == ">=") & g["guard_value"].isNull()), F.lit(False))
    blind_state = F.coalesce(F.exists("guards", lambda g: g["operator"].isin(*STATE_GUARDS) & g["guard_state"].isNull()), F.lit(False))
    timed = write & known & c("evidence_time").isNotNull()
    lacking = [
        _when(command & ~no_machine & (~can["behaviour"] | c("state").isNull()), "behaviour"),
        _when(target & unit_ok & ~convertible, "units"),
        _when(answer & known & (~can["provenance"] | c("observed").isNull()), "provenance"),
        _when(write & known & c("scope").isNotNull() & ~can["topology"], "topology"),
        _when(write & known & ~can["constraints"], "constraints"),
        _when(write & known & can["constraints"] & ((of_numeric & ~can["provenance"]) | blind_value), "guard_observation"),
        _when(write & known & can["constraints"] & ((of_state & ~can["behaviour"]) | blind_state), "guard_state"),
        _when(write & known & can["constraints"] & of_unknown, "guard_operator"),
        _when(timed & ~can["provenance"], "provenance"),
        _when(timed & can["provenance"] & moment().isNull(), "evidence_time"),
    ]
    out = rows.select("cid", "gold", "removed", _set(*found).alias("faults"), _set(*lacking).alias("missing"))
    return out.withColumn("disposition", F.when(F.size("faults") > 0, "reject").when(F.size("missing") > 0, "abstain").otherwise("accept"))


def family_table(verdicts: DataFrame) -> DataFrame:
    """family, n, and a column a tier: how many of its faulty actions each tier catches."""
    tiers = ["G0", "G1", "G2", "G3", "G4", "GP"]
    faulty = verdicts.where("gold <> 'VALID'")
    return faulty.groupBy(F.col("gold").alias("family")).agg(F.countDistinct("cid").alias("n"), *[F.count_if((F.col("tier") == t) & F.col("detected")).alias(t) for t in tiers])


def cohort(verdicts: DataFrame, behavioural: tuple[str, ...] = ("F-ILK", "F-STATE", "F-STALE", "F-VALUE")) -> DataFrame:
    """tier, recall, false_alarms, fpr, diagnosis, and of scale errors and behavioural faults how many there are and are caught (scale errors: named)."""
    c = F.col
    faulty, scale, acts = c("gold") != "VALID", c("gold") == "F-UNITSCALE", c("gold").isin(*behavioural)
    count = F.count_if
    n = verdicts.groupBy("tier").agg(
        count(faulty).alias("faulty"), count(~faulty).alias("valid"), count(faulty & c("detected")).alias("caught"), count(~faulty & c("detected")).alias("false_alarms"), count(faulty & c("diagnosed")).alias("named"),
        count(scale).alias("scale_n"), count(scale & c("diagnosed")).alias("scale_caught"), count(acts).alias("behavioural_n"), count(acts & c("detected")).alias("behavioural_caught"))
    share = lambda a, b: F.round(F.try_divide(c(a).cast("double"), c(b)), 3)
    return n.select("tier", share("caught", "faulty").alias("recall"), "false_alarms", share("false_alarms", "valid").alias("fpr"), share("named", "faulty").alias("diagnosis"), "scale_n", "scale_caught", "behavioural_n", "behavioural_caught")


def validator_summary(verdicts: DataFrame, *by: str) -> DataFrame:
    """by..., n, recall, fpr, diagnosis, abstentions and the Wilson bounds of recall and fpr, of three-valued verdicts. A scale error is named by F-RANGE."""
    c = F.col
    faulty, reject = c("gold") != "VALID", c("disposition") == "reject"
    label = F.when(c("gold") == "F-UNITSCALE", "F-RANGE").otherwise(c("gold"))
    n = verdicts.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(faulty).alias("faulty"), F.count_if(~faulty).alias("valid"), F.count_if(faulty & reject).alias("caught"), F.count_if(~faulty & reject).alias("false_alarms"), F.count_if(faulty & F.array_contains("faults", label)).alias("named"), F.count_if(c("disposition") == "abstain").alias("abstentions"))
    recall, fpr = stats.wilson(c("caught"), c("faulty")), stats.wilson(c("false_alarms"), c("valid"))
    share = lambda a, b: F.try_divide(c(a).cast("double"), c(b))
    return n.select(*by, "n", share("caught", "faulty").alias("recall"), share("false_alarms", "valid").alias("fpr"), share("named", "faulty").alias("diagnosis"), "abstentions", recall[0].alias("recall_low"), recall[1].alias("recall_high"), fpr[0].alias("fpr_low"), fpr[1].alias("fpr_high"))


def disagreements(first: DataFrame, second: DataFrame) -> DataFrame:
    """cid, first, second: actions to which two validators (cid, faults) give different faults; one that a side lacks has none there."""
    none = F.array().cast("array<string>")
    of = lambda df, name: df.select("cid", F.array_sort(F.array_distinct("faults")).alias(name))
    joined = of(first, "first").join(of(second, "second"), "cid", "full").select("cid", *[F.coalesce(x, none).alias(x) for x in ("first", "second")])
    return joined.where("first <> second")


def lifted(actions: DataFrame) -> DataFrame:
    """Actions as triples (s, p, o, o_kind, o_type) by kind; absent keys give none."""
    c, lit = F.col, F.lit
    node = F.concat(lit("plant:action/"), "cid")
    signal, number = F.concat(lit("plant:signal/"), "tag"), c("value").try_cast("double")
    of = lambda kind: actions.where(c("kind") == kind)
    parts = [
        triples.emit(of("write"), node, ("rdf:type", lit("m:SetpointWrite"), "iri"), ("m:targetSignal", signal, "iri"), ("m:value", number, "xsd:double"), ("m:valueUnit", triples.iri("unit", "unit"), "iri"), ("m:scopeAsset", triples.iri("plant", "scope"), "iri"), ("m:evidenceTime", c("evidence_time"), "xsd:dateTime")),
        triples.emit(of("command"), node, ("rdf:type", lit("m:UnitCommand"), "iri"), ("m:targetAsset", triples.iri("plant", "asset"), "iri"), ("m:command", c("command"), "plain")),
        triples.emit(of("answer"), node, ("rdf:type", lit("m:GroundedAnswer"), "iri"), ("m:aboutSignal", signal, "iri"), ("m:answerValue", number, "xsd:double"), ("m:answerUnit", triples.iri("unit", "unit"), "iri")),
    ]
    return reduce(DataFrame.unionByName, parts).dropDuplicates()


# The actions that proposals name, and their kinds; others are writes.
ACTION_KINDS = {"write_setpoint": "write", "packml_command": "command", "answer": "answer"}


def proposals(payloads: DataFrame) -> DataFrame:
    """payloads (cid, payload: a JSON object) as actions; also of a stream. A payload that is no JSON has no keys."""
    v = F.try_parse_json("payload")
    text = lambda key: F.try_variant_get(v, f"$.{key}", "string").alias(key)
    named = F.try_variant_get(v, "$.action", "string")
    kind = F.coalesce(*[F.when(named == a, k) for a, k in ACTION_KINDS.items()], F.lit("write"))
    whole = F.try_variant_get(v, "$.value", "variant")
    # JSON has no NaN, so texts that spell one are texts.
    value = F.to_json(whole)
    return payloads.select("cid", kind.alias("kind"), F.lit("VALID").alias("gold"), text("tag"), text("asset"), text("command"), value.alias("value"), text("unit"), text("scope"), text("evidence_time"))


def validated(payloads: DataFrame, world: World) -> DataFrame:
    """cid, ok, families: what the last tier says to proposals."""
    rows = faults(evidence(proposals(payloads), world))
    return rows.select("cid", (F.size("faults") == 0).alias("ok"), F.array_sort("faults").alias("families"))
