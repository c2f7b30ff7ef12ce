"""The tool definition for writing setpoints, as far as each condition knows the plant."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.fixtures import Plant
from groundspark.functions.text import surrogate_tokens
from groundspark.operators.interchange import _object, _string
from groundspark.operators.triples import IRDI

CONDITIONS = ("C0", "C1", "C2", "C3", "C4")


def _array(c: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(c, _string), ", "), F.lit("]"))


def blocked(plant: Plant) -> DataFrame:
    """tag: signals some guard of which does not hold now; a missing number does not block, a state not known is not listed."""
    guard = plant.signals.join(F.broadcast(plant.assets.select("asset_id", "state")), "asset_id").select(F.col("tag").alias("guard_tag"), "value", "state")
    listed = F.coalesce(F.array_contains(F.split("states", ","), F.col("state")), F.lit(False))
    fails = F.when(F.col("operator") == ">=", F.coalesce(F.col("value") < F.col("threshold"), F.lit(False))).when(F.col("operator") == "state_in", ~listed).otherwise(listed)
    return plant.interlocks.join(F.broadcast(guard), "guard_tag").where(fails).select("tag").distinct()


def schema(plant: Plant, cond: str, scope: str = "L1") -> DataFrame:
    """One row: text, the definition as JSON. scope: how the ids of the assets begin whose signals it is about (not the hierarchy)."""
    c, lit = F.col, F.lit
    inside = plant.signals.where(F.startswith(c("asset_id"), lit(scope)))
    tag = [("type", _string("string")), ("description", _string("Tag to write"))]
    value = _object(("type", _string("number")), ("description", _string("Value to write")))
    unit = [("type", _string("string")), ("description", _string("Unit of the value"))]
    rows = plant.spark.range(1)
    extra: list[tuple[str, Column]] = []
    if cond == "C1":
        rows = inside.agg(F.concat(lit("Tag name, e.g. "), F.min_by("tag", "ord")).alias("said"))
        tag[1] = ("description", _string(c("said")))
    elif cond in ("C2", "C3", "C4"):
        u = plant.units.select("unit", "symbol")
        kinds = plant.units.groupBy("quantity_kind").agg(F.array_sort(F.collect_set("symbol")).alias("accepted"))
        table = F.create_map(*[lit(x) for kv in IRDI.items() for x in kv])
        locks = plant.interlocks.groupBy("tag").agg(F.min_by(F.struct("id", "guard_tag", "operator", "threshold", "states"), "id").alias("lock"))
        w = inside.where("access = 'rw'").join(F.broadcast(u), "unit").join(F.broadcast(kinds), "quantity_kind", "left").join(F.broadcast(locks), "tag", "left")
        w = w.join(F.broadcast(blocked(plant).withColumn("stopped", lit(True))), "tag", "left").withColumn("free", F.when(c("stopped").isNull(), "true").otherwise("false"))
        bounds = [("minimum", c("low").cast("string")), ("maximum", c("high").cast("string"))]
        if cond == "C2":
            entry, units = _object(("unit", _string(c("symbol"))), *bounds), F.collect_set("symbol")
        else:
            threshold = F.coalesce(_array(F.split(c("lock.states"), ",")), c("lock.threshold").cast("string"))
            guard = F.when(c("lock").isNotNull(), _object(("id", _string(c("lock.id"))), ("guard", _string(c("lock.guard_tag"))), ("operator", _string(c("lock.operator"))), ("threshold", threshold), ("currentlySatisfied", c("free"))))
            more = [("interlock", guard), ("writableNow", c("free"))] if cond == "C4" else []
            semantic = F.coalesce(_string(F.try_element_at(table, c("quantity_kind"))), lit("null"))
            entry = _object(("quantityKind", _string(c("quantity_kind"))), ("canonicalUnit", _string(c("symbol"))), ("acceptedUnits", _array(c("accepted"))), *bounds, ("semanticId", semantic), *more)
            units = F.array_distinct(F.flatten(F.collect_list("accepted")))
        per = F.concat(_string(c("tag")), lit(": "), entry)
        rows = w.agg(F.array_sort(F.collect_list(F.struct("ord", "tag", per.alias("entry")))).alias("s"), F.array_sort(units).alias("units"))
        tag.append(("enum", _array(F.transform("s", lambda x: x["tag"]))))
        unit.append(("enum", _array(c("units"))))
        extra.append(("x-perTagConstraints", F.concat(lit("{"), F.array_join(F.transform("s", lambda x: x["entry"]), ", "), lit("}"))))
    if cond == "C4":
        legal = plant.transitions.groupBy("state").agg(F.array_sort(F.collect_list("command")).alias("legal"))
        machines = plant.assets.where(c("packml") & c("state").isNotNull() & F.startswith(c("asset_id"), lit(scope))).join(F.broadcast(legal), "state", "left")
        one = F.concat(_string(c("asset_id")), lit(": "), _object(("packMLState", _string(c("state"))), ("legalCommands", _array(F.coalesce("legal", F.array().cast("array<string>"))))))
        commands = machines.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("x")))), lambda r: r["x"]), ", ").alias("commands"))
        rows = rows.join(commands, lit(True))
        extra.append(("x-availableCommands", F.concat(lit("{"), c("commands"), lit("}"))))
    required = _array(F.array(lit("tag"), lit("value"), lit("unit")))
    parameters = _object(("type", _string("object")), ("properties", _object(("tag", _object(*tag)), ("value", value), ("unit", _object(*unit)))), ("required", required))
    return rows.select(_object(("name", _string("write_setpoint")), ("description", _string("Write a value to a process setpoint.")), ("parameters", parameters), *extra).alias("text"))


def sizes(plant: Plant, scope: str = "L1") -> DataFrame:
    """cond, tokens."""
    return reduce(DataFrame.unionByName, [schema(plant, cond, scope).select(F.lit(cond).alias("cond"), surrogate_tokens(F.col("text")).alias("tokens")) for cond in CONDITIONS])
