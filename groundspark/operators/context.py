"""Contexts: elements written in a condition's own syntax, packed under a token budget, and what they then can prove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.fixtures import Plant
from groundspark.functions import units
from groundspark.functions.text import general_format, surrogate_tokens
from groundspark.operators import lexical
from groundspark.operators.elements import Condition, facts
from groundspark.operators.triples import IRDI, SNAPSHOT

BUDGET = 6000
SWEEP = (750, 1500, 3000, 6000, 12000, 24000)
#: Share of the budget for elements where a block of unit definitions may follow.
PAYLOAD = 0.85
# First lines.
HEADERS = {
    "C0": "# tag=value",
    "C1": "TagName,Description,EngUnits,Value",
    "C2": "# OPC UA / AAS typed nodes (JSON projection of NodeSet2 + submodels)",
    "C3": "# RDF (Turtle) - plant knowledge graph excerpt",
    "C4": "# RDF (Turtle) - plant knowledge graph excerpt",
}


def _text(template: str, **values: Column) -> Column:
    """template with <name> replaced by columns; null if any of them is."""
    out, at = [], 0
    while (a := template.find("<", at)) >= 0:
        b = template.index(">", a)
        out += [F.lit(template[at:a]), values[template[a + 1 : b]]]
        at = b + 1
    return F.concat(*out, F.lit(template[at:]))


def _lines(*parts: Column) -> Column:
    return F.array_join(F.array_compact(F.array(*parts)), "\n")


def _json(**fields: Column) -> Column:
    """A compact JSON object; fields that are null are left out, so an explicit null is the text null."""
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()])), ","), F.lit("}"))


def _string(c: Column) -> Column:
    """A JSON string; the plant's texts are ASCII."""
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _number(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("null"))


def _list(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, _string), ","), F.lit("]"))


def signal_texts(plant: Plant, cond: Condition) -> DataFrame:
    """eid, text of signals."""
    c, can = F.col, cond.kinds.__contains__
    table = F.create_map(*[F.lit(x) for kv in IRDI.items() for x in kv])
    locks = plant.interlocks.groupBy("tag").agg(F.array_sort(F.collect_list("id")).alias("locks"))
    s = plant.signals.join(F.broadcast(plant.units.select("unit", "symbol")), "unit").join(F.broadcast(locks), "tag", "left")
    s = s.withColumn("irdi", F.try_element_at(table, c("quantity_kind")))
    value = F.coalesce(general_format(c("value")), F.lit(""))
    if cond.key == "C0":
        return s.select(c("tag").alias("eid"), _text("<tag>=<value>", tag=c("tag"), value=value).alias("text"))
    if cond.key == "C1":
        return s.select(c("tag").alias("eid"), _text('"<tag>","<said>","<unit>","<value>"', tag=c("tag"), said=c("description"), unit=c("symbol"), value=value).alias("text"))
    if cond.key == "C2":
        bounds = lambda low, high: _json(Low=_number(c(low)), High=_number(c(high)))
        node = plant_node(s)
        record = _json(
            NodeId=_string(node), BrowseName=_string(c("tag")), DisplayName=_string(c("description")), ParentObject=_string(c("asset_id")), DataType=F.lit('"Double"'),
            AccessLevel=F.when(c("access") == "r", '"CurrentRead"').otherwise('"CurrentRead|CurrentWrite"'), EngineeringUnits=_json(DisplayName=_string(c("symbol")), Description=_string(c("quantity_kind"))), EURange=bounds("low", "high"),
            Role=_string(c("role")), Value=_number(c("value")), SemanticId=_string(c("irdi")), AlarmLimits=F.when(c("alarm_low").isNotNull() | c("alarm_high").isNotNull(), bounds("alarm_low", "alarm_high")),
        )
        return s.select(c("tag").alias("eid"), record.alias("text"))
    g = general_format
    names = {"tag": c("tag"), "said": c("description"), "owner": c("asset_id"), "unit": c("unit"), "kind": c("quantity_kind"), "low": g(c("low")), "high": g(c("high")), "access": c("access"), "role": c("role")}
    own = _lines(
        _text('plant:signal/<tag> a sio:Signal ; skos:notation "<tag>" ;', **names),
        _text('  rdfs:label "<said>" ; sio:belongsTo plant:<owner> ;', **names),
        _text("  qudt:unit unit:<unit> ; qudt:hasQuantityKind qk:<kind> ;", **names),
        _text("  sio:engineeringLow <low> ; sio:engineeringHigh <high> ;", **names),
        _text('  sio:accessMode "<access>" ; sio:signalRole "<role>"', **names),
        _text('  ; sio:semanticId "<irdi>"', irdi=c("irdi")),
        _text("  ; sio:alarmLow <x>", x=g(c("alarm_low"))),
        _text("  ; sio:alarmHigh <x>", x=g(c("alarm_high"))),
        F.array_join(F.transform("locks", lambda x: F.concat(F.lit("  ; sio:interlockedBy plant:interlock/"), x)), "\n") if can("interlock") else F.lit(None),
        F.lit(" ."),
    )
    result = "sosa:hasResult [ qudt:numericValue <value> ; qudt:unit unit:<unit> ] ."
    if can("time"):
        seen = f'plant:obs/<tag> a sosa:Observation ; sosa:observedProperty plant:signal/<tag> ; sosa:resultTime "{SNAPSHOT}" ; {result}'
    else:
        seen = f"plant:obs/<tag> sosa:observedProperty plant:signal/<tag> ; {result}"
    return s.select(c("tag").alias("eid"), _lines(own, F.when(c("value").isNotNull(), _text(seen, tag=c("tag"), value=g(c("value")), unit=c("unit")))).alias("text"))


def plant_node(signals: DataFrame) -> Column:
    """The OPC UA node of a signal: its own column, or the one that its tag gives."""
    return F.col("node_id") if "node_id" in signals.columns else F.concat(F.lit("ns=3;s="), F.replace("tag", F.lit("_"), F.lit(".")))


def asset_texts(plant: Plant, cond: Condition) -> DataFrame:
    """eid, text of assets; none under C0 and C1."""
    c, can = F.col, cond.kinds.__contains__
    if cond.key in ("C0", "C1"):
        return plant.assets.select(c("asset_id").alias("eid"), F.lit("").alias("text"))
    own = plant.signals.groupBy("asset_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "tag"))), lambda x: x["tag"]).alias("tags"))
    out = plant.feeds.groupBy(c("src").alias("asset_id")).agg(F.array_sort(F.collect_list("dst")).alias("down"))
    into = plant.feeds.groupBy(c("dst").alias("asset_id")).agg(F.array_sort(F.collect_list("src")).alias("up"))
    legal = plant.transitions.groupBy("state").agg(F.array_sort(F.collect_list("command")).alias("legal"))
    a = plant.assets
    for small, key in ((own, "asset_id"), (out, "asset_id"), (into, "asset_id"), (legal, "state")):
        a = a.join(F.broadcast(small), key, "left")
    made = c("manufacturer") != "-"
    if cond.key == "C2":
        record = _json(
            NodeId=F.concat(F.lit('"ns=3;s='), "asset_id", F.lit('"')), BrowseName=_string(c("asset_id")), DisplayName=_string(c("name")), ISA95Level=_string(c("level")), Organizes=_list(F.coalesce("tags", F.array().cast("array<string>"))),
            OrganizedBy=_string(c("parent")), Nameplate=F.when(made, _json(ManufacturerName=_string(c("manufacturer")), ManufacturerProductDesignation=_string(c("model")), SerialNumber=_string(c("serial")))),
        )
        return a.select(c("asset_id").alias("eid"), record.alias("text"))
    each = lambda arrow, many: F.array_join(F.transform(many, lambda x: F.concat(F.lit(f"  ; sio:{arrow} plant:"), x)), "\n")
    none = F.lit(None).cast("string")
    quoted = F.array_join(F.transform("legal", lambda x: F.concat(F.lit('"'), x, F.lit('"'))), ", ")
    text = _lines(
        _text('plant:<id> a sio:<kind> ; rdfs:label "<name>" ;', id=c("asset_id"), kind=c("kind"), name=c("name")),
        _text('  sio:isa95Level "<level>"', level=c("level")),
        _text("  ; sio:isPartOf plant:<parent>", parent=c("parent")),
        _text('  ; sio:location "<location>"', location=c("location")) if can("location") else none,
        F.when(made, _text('  ; sio:manufacturer "<m>" ; sio:modelDesignation "<d>" ; sio:serialNumber "<s>"', m=c("manufacturer"), d=c("model"), s=c("serial"))) if can("nameplate") else none,
        each("feeds", "down") if can("feeds") else none,
        each("isFedBy", "up") if can("feeds") else none,
        _text('  ; sio:packMLState "<state>"', state=c("state")) if can("state") else none,
        F.concat(F.lit("  ; sio:legalCommand "), F.when(c("state").isNotNull(), quoted)) if can("state") and can("legalcmd") else none,
        F.lit(" ."),
    )
    return a.select(c("asset_id").alias("eid"), text.alias("text"))


def other_texts(plant: Plant, cond: Condition) -> DataFrame:
    """eid, text of events, products and interlocks that the condition can state; the others are empty."""
    c = F.col
    event = _text(
        'plant:event/<id> a prov:Activity, sio:<type> ; prov:startedAtTime "<ts>" ; prov:wasAssociatedWith plant:<asset> ; rdfs:comment "<text>" ; sio:severity "<severity>" .',
        id=c("id"), type=c("type"), ts=c("ts"), asset=c("asset_id"), text=c("text"), severity=c("severity"),
    )
    amount = lambda name, unit: f"sio:{name} [ qudt:numericValue <{name}> ; qudt:unit unit:{unit} ]"
    product = _text(
        f'plant:product/<id> a sio:Product ; rdfs:label "<name>" ; sio:producedOn plant:<line> ; {amount("fillVolume", "MilliL")} ; {amount("fillPressure", "BAR")} ; {amount("capTorque", "N-M")} .',
        id=c("id"), name=c("name"), line=c("line"), fillVolume=c("fill_volume").cast("string"), fillPressure=c("fill_pressure").cast("string"), capTorque=c("cap_torque").cast("string"),
    )
    listed = F.array_join(F.transform(F.split("states", ","), lambda x: F.concat(F.lit('"'), x, F.lit('"'))), " ")
    interlock = _text(
        'plant:interlock/<id> a sio:Interlock ; rdfs:comment "<text>" ; sio:guardSignal plant:signal/<guard> ; sio:guardOperator "<op>" ; sio:guardValue <value> .',
        id=c("id"), text=c("text"), guard=c("guard_tag"), op=c("operator"), value=F.coalesce(listed, c("threshold").cast("string")),
    )
    of = lambda table, kind, text: table.select(c("id").alias("eid"), (text if kind in cond.kinds else F.lit("")).alias("text"))
    return of(plant.plant_events, "event", event).unionByName(of(plant.recipes, "recipe", product)).unionByName(of(plant.interlocks, "interlock", interlock))


def rendered(plant: Plant, cond: Condition) -> DataFrame:
    """eid, text, cost (with the line end): every element that the condition can write."""
    every = signal_texts(plant, cond).unionByName(asset_texts(plant, cond)).unionByName(other_texts(plant, cond))
    return every.where("text <> ''").withColumn("cost", surrogate_tokens(F.col("text")) + 1)


def unit_lines(plant: Plant) -> DataFrame:
    """unit, line, cost of its definition."""
    c, g = F.col, general_format
    u = plant.units.join(F.broadcast(plant.quantity_kinds), "quantity_kind")
    line = _text(
        'unit:<unit> a qudt:Unit ; qudt:symbol "<symbol>" ; qudt:hasQuantityKind qk:<kind> ; qudt:conversionMultiplier <m> ; qudt:conversionOffset <s> ; sio:dimensionVector "<dim>" .',
        unit=c("unit"), symbol=c("symbol"), kind=c("quantity_kind"), m=g(c("multiplier")), s=g(c("shift")), dim=units.format_dimension(c("dim")),
    )
    return u.select("unit", line.alias("line"), surrogate_tokens(line).alias("cost"))


def packed(questions: DataFrame, ordered: DataFrame, plant: Plant, cond: Condition, budgets: tuple[int | None, ...] = (BUDGET,)) -> DataFrame:
    """tid, budget, eids (accepted, in order), units (with definitions, ascending), tokens.

    questions: tid; ordered: tid, eid, pos. Elements are taken in order, each that still fits; those that do not are
    skipped. Where the condition knows units, elements leave room for their definitions, which follow as a
    whole if they fit the full budget. Budget null: no limit. A question without elements has the header.
    tokens counts each element with its line end and the definitions with those between them, not the one line end
    that joins the definitions to what stands before; a text with definitions is one token longer.
    """
    c = F.col
    dims = "dim" in cond.kinds
    spark = ordered.sparkSession
    limits = spark.createDataFrame([(b, None if b is None else int(b * PAYLOAD) if dims else b) for b in budgets], "budget int, payload int")
    costs = rendered(plant, cond).select("eid", "cost")
    items = ordered.join(F.broadcast(costs), "eid").join(F.broadcast(limits), F.lit(True))
    # Null is a budget of its own; groups are told by the limit's place in the list.
    items = items.withColumn("b", F.coalesce("budget", F.lit(-1)))
    fold = lexical.fitted(items, ["tid", "b"], "pos", "cost", c("payload"), surrogate_tokens(F.lit(HEADERS[cond.key])))
    taken = items.join(fold, ["tid", "b"]).where(F.array_contains("taken", c("pos").cast("long")))
    used = taken.join(F.broadcast(plant.signals.select(c("tag").alias("eid"), "unit")), "eid", "left").join(F.broadcast(unit_lines(plant).select("unit", c("cost").alias("unit_cost"))), "unit", "left")
    of_group = used.groupBy("tid", "b").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "eid"))), lambda x: x["eid"]).alias("eids"),
        F.array_sort(F.collect_set(F.struct("unit", "unit_cost"))).alias("u"))
    asked = questions.select("tid").join(F.broadcast(limits.select(F.coalesce("budget", F.lit(-1)).alias("b"))), F.lit(True))
    whole = asked.join(fold, ["tid", "b"], "left").join(of_group, ["tid", "b"], "left").withColumn("used", F.coalesce("used", surrogate_tokens(F.lit(HEADERS[cond.key]))))
    known = F.filter("u", lambda x: x["unit"].isNotNull())
    block = F.aggregate(known, F.lit(-1).cast("long"), lambda acc, x: acc + x["unit_cost"] + 1)  # a line end between lines
    fits = (F.size(known) > 0) & ((c("b") < 0) | (c("used") + block <= c("b"))) if dims else F.lit(False)
    whole = whole.withColumn("fits", F.coalesce(fits, F.lit(False)))
    none = F.array().cast("array<string>")
    return whole.select(
        "tid", F.nullif("b", F.lit(-1)).alias("budget"), F.coalesce("eids", none).alias("eids"),
        F.when(c("fits"), F.transform(known, lambda x: x["unit"])).otherwise(none).alias("units"),
        (c("used") + F.when(c("fits"), block).otherwise(0)).alias("tokens"))


def texts(contexts: DataFrame, plant: Plant, cond: Condition) -> DataFrame:
    """tid, budget, text: contexts as they are written."""
    c = F.col
    own = contexts.select("tid", "budget", F.posexplode("eids").alias("at", "eid")).join(F.broadcast(rendered(plant, cond).select("eid", "text")), "eid").select("tid", "budget", "at", "text")
    block = contexts.select("tid", "budget", F.posexplode("units").alias("at", "unit")).join(F.broadcast(unit_lines(plant)), "unit").select("tid", "budget", (c("at") + 10**6).alias("at"), c("line").alias("text"))
    body = own.unionByName(block).groupBy("tid", "budget").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("lines"))
    head = F.array(F.lit(HEADERS[cond.key]))
    joined = contexts.select("tid", "budget").join(body.withColumnsRenamed({"tid": "t", "budget": "b"}), (c("tid") == c("t")) & c("budget").eqNullSafe(c("b")), "left")
    return joined.select("tid", "budget", F.array_join(F.concat(head, F.coalesce("lines", F.array().cast("array<string>"))), "\n").alias("text"))


def stated(contexts: DataFrame, plant: Plant, cond: Condition, audited: bool = False) -> DataFrame:
    """tid, budget, fact: what contexts state: facts of their elements, and dimensions and conversions of the units defined.

    A unit's definition gives conversions to and from every unit of its kind; audited, only between units that are both defined.
    """
    c = F.col
    own = facts(plant).where(c("kind").isin(sorted(cond.kinds))).select("eid", "fact")
    of_elements = contexts.select("tid", "budget", F.explode("eids").alias("eid")).join(F.broadcast(own), "eid").select("tid", "budget", "fact")
    kinds = plant.units.select("unit", "quantity_kind")
    defined = contexts.select("tid", "budget", "units", F.explode("units").alias("unit")).join(F.broadcast(kinds), "unit")
    dims = defined.select("tid", "budget", F.concat(F.lit("dim:"), "unit").alias("fact"))
    pairs = defined.join(F.broadcast(kinds.withColumnsRenamed({"unit": "other"})), "quantity_kind")
    pairs = pairs.where(F.array_contains("units", c("other"))) if audited else pairs
    both = F.array(F.concat(F.lit("conv:"), "unit", F.lit("|"), "other"), F.concat(F.lit("conv:"), "other", F.lit("|"), "unit"))
    return of_elements.unionByName(dims).unionByName(pairs.select("tid", "budget", F.explode(both).alias("fact"))).distinct()


def sufficiency(contexts: DataFrame, known: DataFrame, required: DataFrame) -> DataFrame:
    """tid, budget, tokens, needed, found, share, sufficient, missing (facts in order): each context against what its question requires.

    required: tid, fact. A question that requires nothing is covered (share 1).
    """
    c = F.col
    asked = contexts.select("tid", "budget", "tokens").join(required, "tid", "left")
    have = known.select(c("tid").alias("t"), c("budget").alias("b"), c("fact").alias("f")).withColumn("there", F.lit(True))
    joined = asked.join(have, (c("tid") == c("t")) & c("budget").eqNullSafe(c("b")) & (c("fact") == c("f")), "left")
    out = joined.groupBy("tid", "budget").agg(F.first("tokens").alias("tokens"), F.count("fact").alias("needed"), F.count("there").alias("found"), F.array_sort(F.collect_list(F.when(c("there").isNull(), c("fact")))).alias("missing"))
    share = F.coalesce(F.try_divide(c("found").cast("double"), c("needed")), F.lit(1.0))
    return out.select("tid", "budget", "tokens", "needed", "found", share.alias("share"), (c("found") == c("needed")).alias("sufficient"), "missing")


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """by..., n, ceiling, coverage, mean_tokens, per_1k: contexts rolled up by any keys; a null budget is a group."""
    c = F.col
    n = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(c("sufficient").cast("double")).alias("ceiling"), F.avg("share").alias("coverage"), F.avg("tokens").alias("mean_tokens"))
    return n.withColumn("per_1k", F.try_divide("coverage", c("mean_tokens") / 1000))
