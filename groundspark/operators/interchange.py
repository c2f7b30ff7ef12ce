"""The plant as an asset administration shell environment and as an OPC UA NodeSet, and what such files say."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.fixtures import Plant
from groundspark.functions.text import surrogate_tokens, xml_escape
from groundspark.operators.triples import IRDI, SNAPSHOT

# Fixed values of the two formats: identifiers, semantic ids and data types.
BASE = "https://example.org/plantmodels"
IEC61360 = "https://admin-shell.io/DataSpecificationTemplates/DataSpecificationIec61360/3/0"
NAMEPLATE = [("ManufacturerName", "manufacturer", "0173-1#02-AAO677#002"), ("ManufacturerProductDesignation", "model", "0173-1#02-AAW338#001"), ("SerialNumber", "serial", "0173-1#02-AAM556#002"), ("YearOfConstruction", "year", "0173-1#02-AAP906#001")]
SERIAL = "0173-1#02-AAM556#002"
DOUBLE, UNSIGNED = "i=11", "i=7"
NUMERIC = ["i=11", "i=7", "Double", "UInt32"]
CEFACT = "http://www.opcfoundation.org/UA/units/un/cefact"


def _string(c: Column | str) -> Column:
    c = F.lit(c) if isinstance(c, str) else c
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _object(*fields: tuple[str, Column | None]) -> Column:
    """A JSON object as it is written with a space after commas and colons; fields that are None or null are left out."""
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f'"{k}": '), v) for k, v in fields if v is not None])), ", "), F.lit("}"))


def _list(*items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.array_compact(F.array(*items)), ", "), F.lit("]"))


def _reference(value: Column | str, kind: str = "GlobalReference") -> Column:
    return _object(("type", _string("ExternalReference")), ("keys", _list(_object(("type", _string(kind)), ("value", _string(value))))))


def _property(name: Column | str, value: Column, kind: str, semantic: Column | str | None, unit: Column | None = None, said: Column | None = None) -> Column:
    semantic_id = None if semantic is None else _reference(semantic) if isinstance(semantic, str) else F.when(semantic.isNotNull(), _reference(semantic))
    content = None if unit is None else _object(("modelType", _string("DataSpecificationIec61360")), ("preferredName", _list(_object(("language", _string("en")), ("text", _string(name))))), ("unit", _string(unit)), ("dataType", _string("REAL_MEASURE")))
    return _object(
        ("modelType", _string("Property")), ("idShort", _string(name)), ("valueType", _string(kind)), ("value", F.coalesce(_string(value), F.lit("null"))), ("semanticId", semantic_id),
        ("description", None if said is None else _list(_object(("language", _string("en")), ("text", _string(said))))),
        ("embeddedDataSpecifications", None if unit is None else _list(_object(("dataSpecification", _reference(IEC61360)), ("dataSpecificationContent", content)))))


def _submodel(asset: Column, part: str, name: str, semantic: str, elements: Column) -> Column:
    identifier = F.concat(F.lit(f"{BASE}/aas/"), asset, F.lit(f"/{part}"))
    return _object(("modelType", _string("Submodel")), ("id", _string(identifier)), ("idShort", _string(name)), ("kind", _string("Instance")), ("semanticId", _reference(semantic)), ("submodelElements", elements))


def short_names(signals: DataFrame) -> DataFrame:
    part = F.split("tag", "_")
    return signals.withColumn("short", F.when(F.col("tag").endswith("QIC0305_SP"), "FillVolumeSetpoint").otherwise(F.concat(part[2], F.initcap(part[3]))))


def shells(plant: Plant) -> DataFrame:
    """asset_id, ord, shell, submodels (array) as JSON texts; of assets with signals or a maker."""
    c = F.col
    table = F.create_map(*[F.lit(x) for kv in IRDI.items() for x in kv])
    s = short_names(plant.signals).join(F.broadcast(plant.units.select("unit", "symbol")), "unit").withColumn("irdi", F.try_element_at(table, c("quantity_kind")))
    of = lambda name: _property(name, c("value").cast("string"), "xs:double", c("irdi"), c("symbol"), c("description"))
    own = s.select("asset_id", F.struct("ord", of(c("short")).alias("technical"), of(c("tag")).alias("operational")).alias("p"))
    own = own.groupBy("asset_id").agg(F.array_sort(F.collect_list("p")).alias("props"))
    a = plant.assets.join(F.broadcast(own), "asset_id", "left").where("props is not null or manufacturer <> '-'").withColumn("year", F.substring(F.coalesce("commissioned", F.lit("")), 1, 4))
    me, has = c("asset_id"), c("props").isNotNull()
    listed = lambda field: F.array_join(F.transform("props", lambda p: p[field]), ", ")
    state = F.when(c("state").isNotNull(), _property("PackMLState", c("state"), "xs:string", f"{BASE}/sm/PackMLState"))
    collection = _object(("modelType", _string("SubmodelElementCollection")), ("idShort", _string("TechnicalProperties")), ("value", F.concat(F.lit("["), F.coalesce(listed("technical"), F.lit("")), F.lit("]"))))
    operational = F.concat(F.lit("["), F.concat_ws(", ", listed("operational"), state), F.lit("]"))
    submodels = F.array_compact(F.array(
        _submodel(me, "nameplate", "Nameplate", "https://admin-shell.io/zvei/nameplate/2/0/Nameplate", _list(*[_property(n, c(col), "xs:string", sem) for n, col, sem in NAMEPLATE])),
        _submodel(me, "technicaldata", "TechnicalData", "https://admin-shell.io/ZVEI/TechnicalData/Submodel/1/2", _list(collection)),
        F.when(has, _submodel(me, "operationaldata", "OperationalData", f"{BASE}/sm/OperationalData", operational))))
    refer = lambda part: _reference(F.concat(F.lit(f"{BASE}/aas/"), me, F.lit(f"/{part}")), "Submodel")
    shell = _object(
        ("modelType", _string("AssetAdministrationShell")), ("id", _string(F.concat(F.lit(f"{BASE}/aas/"), me))), ("idShort", _string(F.replace(me, F.lit("-"), F.lit("_")))),
        ("assetInformation", _object(("assetKind", _string("Instance")), ("globalAssetId", _string(F.concat(F.lit(f"{BASE}/asset/"), me))), ("specificAssetIds", _list(_object(("name", _string("SerialNumber")), ("value", _string(c("serial"))), ("semanticId", _reference(SERIAL))))))),
        ("submodels", _list(refer("nameplate"), refer("technicaldata"), F.when(has, refer("operationaldata")))))
    return a.select("asset_id", "ord", shell.alias("shell"), submodels.alias("submodels"))


def environment(plant: Plant) -> DataFrame:
    """One row: text, the whole environment as one JSON document (a plant's assets)."""
    rows = shells(plant).agg(F.array_sort(F.collect_list(F.struct("ord", "shell", "submodels"))).alias("r"))
    each = lambda f: F.array_join(f, ", ")
    return rows.select(F.concat(F.lit('{"assetAdministrationShells": ['), each(F.transform("r", lambda x: x["shell"])), F.lit('], "submodels": ['), each(F.flatten(F.transform("r", lambda x: x["submodels"]))), F.lit('], "conceptDescriptions": []}')).alias("text"))


_AAS = """assetAdministrationShells array<struct<assetInformation:struct<globalAssetId:string>,submodels:array<struct<keys:array<struct<value:string>>>>>>,
submodels array<struct<id:string,idShort:string,submodelElements:array<struct<idShort:string,valueType:string,value:string,semanticId:struct<keys:array<struct<value:string>>>,
embeddedDataSpecifications:array<struct<dataSpecificationContent:struct<unit:string>>>>>>>"""


def aas_facts(environments: DataFrame) -> DataFrame:
    """category, key, value that environments (text) state: names, plates, states, membership, types, values, units, semantic ids."""
    c = F.col
    e = environments.select(F.from_json("text", _AAS).alias("e"))
    shell = e.select(F.explode("e.assetAdministrationShells").alias("s"))
    owner = shell.select(F.substring_index("s.assetInformation.globalAssetId", "/", -1).alias("asset"), F.explode("s.submodels").alias("r")).select("asset", F.element_at("r.keys", -1)["value"].alias("id"))
    parts = e.select(F.explode("e.submodels").alias("m")).select("m.id", c("m.idShort").alias("name"), c("m.submodelElements").alias("elements")).join(owner, "id")
    plates = parts.where("name = 'Nameplate'").select("asset", F.map_from_entries(F.transform("elements", lambda x: F.struct(x["idShort"], x["value"]))).alias("v"))
    plate = [F.try_element_at("v", F.lit(n)) for n, _, _ in NAMEPLATE[:3]]
    named = plates.where(reduce(lambda x, y: x & y, [F.coalesce(p, F.lit("")) != "" for p in plate]) & (plate[0] != "-"))
    element = parts.where("name = 'OperationalData'").select("asset", F.explode("elements").alias("x"))
    state = element.where("x.idShort = 'PackMLState' and x.value <> ''")
    signal = element.where("x.idShort <> 'PackMLState'")
    tag, value = c("x.idShort"), F.nullif("x.value", F.lit(""))
    unit = F.try_element_at(F.filter(F.transform("x.embeddedDataSpecifications", lambda d: d["dataSpecificationContent"]["unit"]), lambda u: u.isNotNull()), F.lit(1))
    return _facts(
        (named, "nameplate", c("asset"), F.concat_ws("|", *plate)), (state, "state", c("asset"), c("x.value")), (signal, "identity", tag, tag), (signal, "membership", tag, c("asset")),
        (signal, "datatype", tag, F.when(c("x.valueType").isin("xs:double", "xs:float", "xs:int", "xs:unsignedInt"), "numeric")), (signal, "value", tag, value), (signal, "unit", tag, unit),
        (signal, "semantic_id", tag, F.try_element_at("x.semanticId.keys", F.lit(1))["value"]))


def _facts(*each: tuple[DataFrame, str, Column, Column]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("category"), key.alias("key"), value.cast("string").alias("value")).where("value is not null") for df, name, key, value in each])


def reference_facts(plant: Plant) -> DataFrame:
    """category, key, value: all that the plant's tables state; several values joined by |."""
    c = F.col
    a, s = plant.assets, plant.signals.join(F.broadcast(plant.units.select("unit", "symbol")), "unit")
    table = F.create_map(*[F.lit(x) for kv in IRDI.items() for x in kv])
    legal = plant.transitions.groupBy("state").agg(F.array_join(F.array_sort(F.collect_list("command")), "|").alias("legal"))
    units = a.where("state is not null").join(F.broadcast(legal), "state", "left")
    tag, me = c("tag"), c("asset_id")
    return _facts(
        (a, "parent", me, c("parent")), (a.where("manufacturer <> '-'"), "nameplate", me, F.concat_ws("|", "manufacturer", "model", "serial")), (units, "state", me, c("state")), (units, "legal_commands", me, F.coalesce("legal", F.lit(""))),
        (s, "identity", tag, tag), (s, "datatype", tag, F.lit("numeric")), (s, "access", tag, c("access")), (s, "range", tag, F.concat_ws("|", "low", "high")), (s, "unit", tag, c("symbol")), (s, "quantity_kind", tag, c("quantity_kind")), (s, "membership", tag, me),
        (s, "semantic_id", tag, F.try_element_at(table, c("quantity_kind"))), (s, "value", tag, c("value")), (s.where("value is not null"), "observation_time", tag, F.lit(SNAPSHOT)),
        (plant.feeds, "feeds", F.concat_ws("->", "src", "dst"), F.lit("true")), (plant.interlocks, "interlock", c("id"), F.concat_ws("|", "tag", "guard_tag")))


def nodeset_blocks(plant: Plant) -> DataFrame:
    """ord, block: the lines of each asset and its variables."""
    c, lit = F.col, F.lit
    s = plant.signals.join(F.broadcast(plant.units.select("unit", "symbol", c("quantity_kind").alias("unit_kind"))), "unit")
    node = xml_escape(c("node_id") if "node_id" in s.columns else F.concat(lit("ns=3;s="), F.replace("tag", lit("_"), lit("."))))
    level = F.when(c("access") == "r", "1").otherwise("3")
    kind = F.when(c("role").isin("state", "command"), UNSIGNED).otherwise(DOUBLE)
    says = xml_escape(c("description"))

    def line(*parts: Column | str) -> Column:
        return F.concat(*[lit(p) if isinstance(p, str) else p for p in parts])

    def value(body: Column) -> Column:
        return line("    <Value><ExtensionObject><Body>", body, "</Body></ExtensionObject></Value>")

    def prop(name: str, data_type: str, body: Column) -> list[Column]:
        return [line('  <UAVariable NodeId="', node, f'.{name}" BrowseName="{name}" DataType="{data_type}" ParentNodeId="', node, '">'), line(f"    <DisplayName>{name}</DisplayName>"), value(body), lit("  </UAVariable>")]

    variable = [
        line('  <UAVariable NodeId="', node, '" BrowseName="3:', xml_escape(c("tag")), '" DataType="', kind, '" AccessLevel="', level, '" UserAccessLevel="', level, '">'),
        line("    <DisplayName>", says, "</DisplayName>"), line("    <Description>", says, "</Description>"), lit("    <References>"), lit('      <Reference ReferenceType="HasTypeDefinition">i=2368</Reference>'),
        line('      <Reference ReferenceType="HasComponent" IsForward="false">ns=3;s=', xml_escape(c("asset_id")), "</Reference>"), line('      <Reference ReferenceType="HasProperty">', node, ".EURange</Reference>"),
        line('      <Reference ReferenceType="HasProperty">', node, ".EngineeringUnits</Reference>"), lit("    </References>"), lit("  </UAVariable>"),
        *prop("EURange", "i=884", line("<Range><Low>", c("low").cast("string"), "</Low><High>", c("high").cast("string"), "</High></Range>")),
        *prop("EngineeringUnits", "i=887", line(f"<EUInformation><NamespaceUri>{CEFACT}</NamespaceUri><DisplayName><Text>", xml_escape(c("symbol")), "</Text></DisplayName><Description><Text>", xml_escape(c("unit_kind")), "</Text></Description></EUInformation>")),
    ]
    rows = s.select("asset_id", F.struct("ord", line('      <Reference ReferenceType="HasComponent">', node, "</Reference>").alias("ref"), F.array_join(F.array(*variable), "\n").alias("lines")).alias("v"))
    own = rows.groupBy("asset_id").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    a = plant.assets.join(F.broadcast(own), "asset_id", "left")
    me = xml_escape(c("asset_id"))
    head = F.array_compact(F.array(line('  <UAObject NodeId="ns=3;s=', me, '" BrowseName="3:', me, '">'), line("    <DisplayName>", xml_escape(c("name")), "</DisplayName>"), line("    <Description>", xml_escape(c("kind")), " at ISA-95 level ", c("level"), "</Description>"), lit("    <References>"),
                                   line('      <Reference ReferenceType="Organizes" IsForward="false">ns=3;s=', xml_escape(c("parent")), "</Reference>")))
    none = F.array().cast("array<string>")
    of = lambda field: F.coalesce(F.transform("vs", lambda v: v[field]), none)
    return a.select("ord", F.array_join(F.concat(head, of("ref"), F.array(lit("    </References>"), lit("  </UAObject>")), of("lines")), "\n").alias("block"))


NODESET_HEAD = """<?xml version="1.0" encoding="utf-8"?>
<UANodeSet xmlns="http://opcfoundation.org/UA/2011/03/UANodeSet.xsd" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">
  <NamespaceUris><Uri>https://example.org/plantmodels/opcua</Uri></NamespaceUris>
  <Models><Model ModelUri="https://example.org/plantmodels/opcua" Version="1.0.0" PublicationDate="2026-07-14T00:00:00Z"/></Models>"""


def nodeset(plant: Plant) -> DataFrame:
    """One row: text, the whole NodeSet file (a plant's assets)."""
    rows = nodeset_blocks(plant).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "block"))), lambda x: x["block"]).alias("b"))
    return rows.select(F.array_join(F.concat(F.array(F.lit(NODESET_HEAD)), "b", F.array(F.lit("</UANodeSet>"))), "\n").alias("text"))


def nodeset_facts(nodes: DataFrame) -> DataFrame:
    """category, key, value that the nodes of a NodeSet (as `sources.nodeset.nodes` gives them) state of the plant."""
    c = F.col
    name = F.regexp_replace("browse_name", "^[^:]*:", "")
    back = lambda kind: F.try_element_at(F.transform(F.filter("refs", lambda r: (r["type"] == kind) & ~r["forward"]), lambda r: F.substring_index(r["target"], ";s=", -1)), F.lit(1))
    variables = nodes.where("node_class = 'UAVariable'")
    tags = variables.where("parent is null and browse_name like '%:%'").withColumn("tag", name)
    of = variables.where("parent is not null").join(tags.select(c("node_id").alias("of"), "tag"), c("parent") == c("of"))
    inner = lambda path: F.get_json_object("value", f"$.Body.{path}")
    ranges, unit = of.where("browse_name = 'EURange'"), of.where("browse_name = 'EngineeringUnits'")
    access = F.try_element_at("attributes", F.lit("AccessLevel")).try_cast("int")
    tag = c("tag")
    return _facts(
        (nodes.where("node_class = 'UAObject'"), "parent", name, back("Organizes")), (tags, "identity", tag, tag), (tags, "datatype", tag, F.when(c("data_type").isin(NUMERIC), "numeric")), (tags, "access", tag, F.when(access.bitwiseAND(F.lit(2)) > 0, "rw").when(access.isNotNull(), "r")),
        (tags, "membership", tag, back("HasComponent")), (tags, "value", tag, c("value").try_cast("double")), (ranges, "range", tag, F.concat(inner("Range.Low"), F.lit("|"), inner("Range.High"))),
        (unit, "unit", tag, inner("EUInformation.DisplayName.Text")), (unit, "quantity_kind", tag, inner("EUInformation.Description.Text")))


def sizes(texts: dict[str, DataFrame]) -> DataFrame:
    """format, bytes, tokens, ratio (tokens to those of the format with the fewest bytes) of one-row texts."""
    each = [df.select(F.lit(name).alias("format"), F.octet_length("text").alias("bytes"), surrogate_tokens(F.col("text")).alias("tokens")) for name, df in texts.items()]
    rows = reduce(DataFrame.unionByName, each)
    base = rows.agg(F.min_by("tokens", "bytes").alias("base"))  # a row a format
    return rows.join(F.broadcast(base), F.lit(True)).withColumn("ratio", F.try_divide(F.col("tokens").cast("double"), "base")).drop("base")


def documents(spark: SparkSession) -> dict[str, DataFrame]:
    """Each format of the plant as a one-row text."""
    from groundspark.operators import formats, triples

    plant = Plant(spark)
    joined = lambda rows, sep, head="", tail="": rows.agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "x"))), lambda r: r["x"]), sep), F.lit(tail)).alias("text"))
    graph = triples.plant(spark)
    return {
        "csv": joined(formats.historian(spark).select(F.col("ord").alias("o"), F.col("line").alias("x")), "\n", ",".join(formats.HISTORIAN) + "\n"),
        "ngsi-ld": joined(formats.ngsi_ld(spark).select(F.col("asset_id").alias("o"), F.col("entity").alias("x")), ", ", "[", "]"),
        "wot": joined(formats.wot(spark).select(F.col("asset_id").alias("o"), F.col("thing").alias("x")), ", ", "[", "]"),
        "turtle": joined(formats.turtle(graph).select(F.col("block").alias("o"), F.col("block").alias("x")), "\n\n", "\n".join(formats.turtle_prefixes()) + "\n\n", "\n"),
        "opcua": nodeset(plant),
        "aas": environment(plant),
        "json-ld": joined(formats.json_ld(graph).select(F.col("node").alias("o"), F.col("node").alias("x")), ", ", "[", "]"),
        "n-triples": joined(triples.n_triples(graph).select(F.col("line").alias("o"), F.col("line").alias("x")), "\n", "", "\n"),
    }
