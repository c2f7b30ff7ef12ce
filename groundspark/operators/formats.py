"""The plant in interchange formats: historian CSV, Turtle, expanded JSON-LD, WoT thing descriptions, NGSI-LD entities.

Each writer gives one row a line, subject or entity, so files are written in parallel; only a single
subject's or asset's parts meet in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.fixtures import COMMANDS, frame
from groundspark.functions.text import general_format, surrogate_tokens
from groundspark.operators.triples import PREFIXES, SNAPSHOT, expanded

HISTORIAN = ("TagName", "Description", "EngUnits", "Value")


def _signals(spark: SparkSession) -> DataFrame:
    return frame(spark, "signals").join(F.broadcast(frame(spark, "units").select("unit", "symbol")), "unit").withColumn("part", F.split("tag", "_"))


def historian(spark: SparkSession) -> DataFrame:
    """ord, line: all fields quoted, numbers as %g, no value as an empty field; the header is not among the lines."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    value = F.coalesce(general_format(F.col("value")), F.lit(""))
    return _signals(spark).select("ord", F.concat_ws(",", *map(quoted, (F.col("tag"), F.col("description"), F.col("symbol"), value))).alias("line"))


def historian_cost(spark: SparkSession) -> DataFrame:
    """tokens of the whole export, line ends included."""
    lines = historian(spark).agg(F.sum(surrogate_tokens(F.col("line")) + 1).alias("n"))
    return lines.select((F.col("n") + surrogate_tokens(F.lit(",".join(HISTORIAN)))).cast("long").alias("tokens"))


def turtle(triples: DataFrame) -> DataFrame:
    """block: a subject with its predicates, in order; prefixes are the writer's first lines."""
    text = F.col("o")
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    plain = F.concat(F.lit('"'), text, F.lit('"'))
    name = lambda c: F.when(c.rlike(r"^[a-z0-9]*:[A-Za-z][A-Za-z0-9_-]*$"), c).otherwise(expanded(c))
    o = F.when(F.col("o_kind").isin("iri", "node"), name(F.col("o"))).when(F.col("o_kind") == "lang", F.concat(plain, F.lit("@"), "o_type")).when(F.col("o_kind") == "typed", F.concat(plain, F.lit("^^"), "o_type")).otherwise(plain)
    of_predicate = triples.groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_list(o)), ", ").alias("objects"))
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("p", "objects"))), lambda x: F.concat(name(x["p"]), F.lit(" "), x["objects"]))
    return of_predicate.groupBy("s").agg(F.array_join(pairs, " ;\n    ").alias("body")).select(F.concat(name(F.col("s")), F.lit(" "), "body", F.lit(" .")).alias("block"))


def turtle_prefixes() -> list[str]:
    return [f"@prefix {k}: <{v}> ." for k, v in PREFIXES.items()]


def _bare(c: Column) -> Column:
    return F.regexp_replace(expanded(c), "^<|>$", "")


def json_ld(triples: DataFrame) -> DataFrame:
    """node: a subject as an expanded JSON-LD object."""
    value = F.struct(F.when(F.col("o_kind").isin("iri", "node"), _bare(F.col("o"))).alias("@id"), F.when(~F.col("o_kind").isin("iri", "node"), F.col("o")).alias("@value"), F.when(F.col("o_kind") == "lang", F.col("o_type")).alias("@language"), F.when(F.col("o_kind") == "typed", _bare(F.col("o_type"))).alias("@type"))
    of_predicate = triples.groupBy("s", "p").agg(F.collect_list(value).alias("values"))
    rows = of_predicate.groupBy("s").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(_bare(F.col("p")).alias("k"), F.to_json("values").alias("v"))))).alias("m"))
    body = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ",")
    return rows.select(F.concat(F.lit('{"@id":"'), _bare(F.col("s")), F.lit('",'), body, F.lit("}")).alias("node"))


def wot(spark: SparkSession) -> DataFrame:
    """asset_id, thing: a description of each asset with signals."""
    c, lit = F.col, F.lit
    op = F.when(c("access") == "rw", F.array(lit("readproperty"), lit("writeproperty"))).otherwise(F.array(lit("readproperty")))
    node = F.concat(lit("opc.tcp://plant.example/ns=3;s="), F.replace("tag", lit("_"), lit(".")))
    entry = F.struct(c("description").alias("title"), lit("number").alias("type"), F.concat(lit("qudt:"), "unit").alias("unit"), c("low").alias("minimum"), c("high").alias("maximum"), (c("access") == "r").alias("readOnly"), lit(True).alias("observable"), F.concat(lit("qk:"), "quantity_kind").alias("@type"), F.array(F.struct(node.alias("href"), op.alias("op"), lit("application/opcua+json").alias("contentType"))).alias("forms"))
    props = _signals(spark).groupBy("asset_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", entry.alias("entry"))))).alias("properties"))
    command = F.struct(lit("PackML unit command").alias("title"), F.struct(lit("string").alias("type"), F.array(*map(lit, COMMANDS)).alias("enum")).alias("input"), F.array(F.struct(F.concat(lit("opc.tcp://plant.example/ns=3;s="), "asset_id", lit(".UNIT.CMD")).alias("href"), F.array(lit("invokeaction")).alias("op"))).alias("forms"))
    actions = F.when(c("packml"), F.create_map(lit("packmlCommand"), command)).otherwise(F.create_map().cast("map<string,struct<title:string,input:struct<type:string,enum:array<string>>,forms:array<struct<href:string,op:array<string>>>>>"))
    things = frame(spark, "assets").join(props, "asset_id")
    return things.select("asset_id", F.to_json(F.struct(F.array(lit("https://www.w3.org/2022/wot/td/v1.1")).alias("@context"), F.array(lit("Thing"), F.concat(lit("m:"), "kind")).alias("@type"), F.concat(lit("urn:plant:"), "asset_id").alias("id"), c("name").alias("title"), F.concat("kind", lit(" - ISA-95 "), "level").alias("description"), F.struct(F.struct(lit("nosec").alias("scheme")).alias("nosec_sc")).alias("securityDefinitions"), lit("nosec_sc").alias("security"), "properties", actions.alias("actions"))).alias("thing"))


def ngsi_ld(spark: SparkSession) -> DataFrame:
    """asset_id, entity: signals under their short names; of two with one name the later stays."""
    c, lit = F.col, F.lit
    short = F.when(c("tag").endswith("QIC0305_SP"), "FillVolumeSetpoint").otherwise(F.concat(c("part")[2], F.initcap(c("part")[3])))
    entry = F.to_json(F.struct(lit("Property").alias("type"), c("value").alias("value"), c("symbol").alias("unitCode"), lit(SNAPSHOT).alias("observedAt"), F.struct(lit("Property").alias("type"), c("tag").alias("value")).alias("sourceTag")), {"ignoreNullFields": "false"})
    named = _signals(spark).groupBy("asset_id", short.alias("short")).agg(F.max_by(entry, "ord").alias("entry"))
    own = named.groupBy("asset_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(lit(',"'), "short", lit('":'), "entry"))), "").alias("signals"))
    head = F.to_json(F.struct(F.concat(lit("urn:ngsi-ld:"), "kind", lit(":"), "asset_id").alias("id"), c("kind").alias("type"), F.struct(lit("Property").alias("type"), c("name").alias("value")).alias("name"), F.struct(lit("Property").alias("type"), c("level").alias("value")).alias("isa95Level"), F.array(lit("https://uri.etsi.org/ngsi-ld/v1/ngsi-ld-core-context-v1.7.jsonld")).alias("@context"), F.when(c("parent").isNotNull(), F.struct(lit("Relationship").alias("type"), F.concat(lit("urn:ngsi-ld:Asset:"), "parent").alias("object"))).alias("isPartOf")))
    return frame(spark, "assets").join(own, "asset_id", "left").select("asset_id", F.concat(F.regexp_replace(head, r"\}$", ""), F.coalesce("signals", lit("")), lit("}")).alias("entity"))
