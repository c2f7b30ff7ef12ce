"""A NodeSet instance in other formats, each of which keeps every node and every reference; and a bundle of them with hashes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.functions.text import percent_encoded
from groundspark.operators import formats, triples
from groundspark.sources import nodeset

CONTEXT = "https://uri.etsi.org/ngsi-ld/v1/ngsi-ld-core-context-v1.8.jsonld"
_KEEP = {"ignoreNullFields": "false"}


def _expanded(c: Column) -> Column:
    return F.when(c.isNotNull(), F.concat(F.lit("nsu="), c["uri"], F.lit(";"), c["identifier"]))


def iri(expanded: Column) -> Column:
    """`urn:opcua-node:<namespace>:<identifier>` of an expanded id, both percent-encoded."""
    uri, identifier = F.regexp_extract(expanded, "^nsu=([^;]*);", 1), F.regexp_replace(expanded, "^nsu=[^;]*;", "")
    return F.concat(F.lit("urn:opcua-node:"), percent_encoded(uri), F.lit(":"), percent_encoded(identifier))


def records(nodes: DataFrame) -> DataFrame:
    """A row a node: role, ord, label, raw and expanded ids, names, type, value, everything else as text, and refs (type, forward, target; expanded)."""
    c = F.col
    refs = F.transform(F.arrays_zip("refs", "ref_types", "targets"), lambda r: F.struct(_expanded(r["ref_types"]).alias("type"), r["refs"]["forward"].alias("forward"), _expanded(r["targets"]).alias("target")))
    named = nodes.join(nodeset.labelled(nodes).withColumnsRenamed({"role": "r", "node_id": "i"}), (c("role") == c("r")) & (c("node_id") == c("i")))
    return named.select(
        "role", "ord", "label", "node_class", "node_id", _expanded(c("node")).alias("expanded"), c("node.uri").alias("namespace"), "browse_name", c("browse.uri").alias("browse_uri"), "display_name", "description", "data_type",
        _expanded(c("type")).alias("type"), "value", "value_xml", _expanded(c("parent_node")).alias("parent"), F.to_json("attributes").alias("attributes"), F.to_json("other_xml").alias("other_xml"), refs.alias("refs"))


def as_json(rows: DataFrame) -> DataFrame:
    """expanded, n_refs, text: a JSON object a node, keys in order, nulls written."""
    fields = sorted(x for x in rows.columns if x not in ("ord",))
    return rows.select("expanded", F.size("refs").alias("n_refs"), F.to_json(F.struct(*fields), _KEEP).alias("text"))


def as_table(rows: DataFrame) -> DataFrame:
    """Texts only, one row a node; references as JSON, nulls empty."""
    text = [F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in rows.columns if x not in ("refs", "ord", "label")]
    return rows.select(*text, F.to_json("refs", _KEEP).alias("references"))


def as_triples(rows: DataFrame) -> DataFrame:
    """Triples of all nodes; a reference is a node of its own, named by its owner and place."""
    c = F.col
    me = F.replace(iri(c("expanded")), F.lit("urn:opcua-node:"), F.lit("node:"))
    plain = ("node_id", "expanded", "namespace", "node_class", "browse_name", "browse_uri", "display_name", "description", "data_type", "type", "value", "value_xml", "parent", "attributes", "other_xml")
    own = triples.emit(rows, me, ("rdf:type", F.concat(F.lit("ua:"), "node_class"), "iri"), *[(f"ua:{x}", c(x), "plain") for x in plain])
    edges = rows.select("expanded", F.posexplode("refs").alias("at", "r")).withColumn("edge", F.concat(F.lit("_:ref/"), F.md5("expanded"), F.lit("/"), "at"))
    links = triples.emit(edges, me, ("ua:reference", c("edge"), "node"))
    parts = triples.emit(edges, c("edge"), ("ua:referenceType", F.coalesce("r.type", F.lit("")), "plain"), ("ua:target", F.coalesce("r.target", F.lit("")), "plain"), ("ua:isForward", c("r.forward"), "xsd:boolean"))
    return own.unionByName(links).unionByName(parts)


def as_json_ld(rows: DataFrame) -> DataFrame:
    return formats.json_ld(as_triples(rows))


def as_ngsi_ld(rows: DataFrame) -> DataFrame:
    """expanded, n_refs, entity: an NGSI-LD entity a node; what a node lacks has no property."""
    c = F.col
    prop = lambda x: F.when(x.isNotNull(), F.struct(F.lit("Property").alias("type"), x.alias("value")))
    of = {"sourceNodeId": "node_id", "expandedNodeId": "expanded", "nodeClass": "node_class", "browseName": "browse_name", "displayName": "display_name", "description": "description", "dataType": "data_type", "nodeValue": "value", "additionalNodeMetadataXml": "other_xml"}
    refs = F.transform("refs", lambda r: F.struct(r["type"].alias("referenceType"), r["forward"].alias("isForward"), r["target"].alias("targetNodeId")))
    body = F.struct(iri(c("expanded")).alias("id"), F.lit("OPCUAInstanceNode").alias("type"), *[prop(c(x)).alias(k) for k, x in of.items()], prop(refs).alias("references"), F.array(F.lit(CONTEXT)).alias("@context"))
    return rows.select("expanded", F.size("refs").alias("n_refs"), F.to_json(body).alias("entity"))


def as_aas(rows: DataFrame, shell: str) -> DataFrame:
    """role, ord, kind (node or reference), owner, element: submodel elements, a collection a node and a relationship a reference with a target.

    References point to a collection of the same submodel where the file defines the node, else to its IRI.
    """
    c, lit = F.col, F.lit
    submodel = f"{shell}/submodel/opcua-instance"
    text = lambda name, v: F.struct(lit("Property").alias("modelType"), lit(name).alias("idShort"), lit("xs:string").alias("valueType"), v.alias("value"))
    names = {"SourceNodeId": "node_id", "ExpandedNodeId": "expanded", "NodeClass": "node_class", "NamespaceUri": "namespace", "BrowseName": "browse_name", "DisplayName": "display_name", "Description": "description", "DataType": "type", "SourceAttributes": "attributes", "DecodedValue": "value", "SourceValueXml": "value_xml", "AdditionalNodeMetadataXml": "other_xml", "ParentNodeId": "parent"}
    collection = F.struct(lit("SubmodelElementCollection").alias("modelType"), c("label").alias("idShort"), F.array(*[text(k, c(x)) for k, x in names.items()]).alias("value"), lit(True).alias("ordered"))
    own = rows.select("role", (c("ord") * 100000).alias("ord"), lit("node").alias("kind"), c("expanded").alias("owner"), F.to_json(collection, _KEEP).alias("element"))
    known = rows.select(c("role").alias("k_role"), c("expanded").alias("k_id"), c("label").alias("k_label")).dropDuplicates(["k_role", "k_id"])
    edges = rows.select("role", "ord", "expanded", "label", F.posexplode("refs").alias("at", "r")).where("r.target is not null")
    edges = edges.join(known, (c("role") == c("k_role")) & (c("r.target") == c("k_id")), "left")
    keys = lambda label, target: F.when(label.isNotNull(), F.array(F.struct(lit("Submodel").alias("type"), lit(submodel).alias("value")), F.struct(lit("SubmodelElementCollection").alias("type"), label.alias("value")))).otherwise(F.array(F.struct(lit("GlobalReference").alias("type"), iri(target).alias("value"))))
    refer = lambda label, target: F.struct(F.when(label.isNotNull(), "ModelReference").otherwise("ExternalReference").alias("type"), keys(label, target).alias("keys"))
    here, there = refer(c("label"), c("expanded")), refer(c("k_label"), c("r.target"))
    said = F.concat(lit("NodeSet owner="), "expanded", lit("; IsForward="), c("r.forward").cast("string"), lit("; ReferenceType="), F.coalesce("r.type", lit("unknown")))
    relation = F.struct(lit("RelationshipElement").alias("modelType"), F.concat("label", lit("_Reference"), F.lpad(c("at").cast("string"), 4, "0")).alias("idShort"), F.when(c("r.forward"), here).otherwise(there).alias("first"), F.when(c("r.forward"), there).otherwise(here).alias("second"), F.array(F.struct(lit("en").alias("language"), said.alias("text"))).alias("description"))
    return own.unionByName(edges.select("role", (c("ord") * 100000 + c("at") + 1).alias("ord"), lit("reference").alias("kind"), c("expanded").alias("owner"), F.to_json(relation).alias("element")))


_ELEMENT = "idShort string, value array<struct<idShort:string,value:string>>, description array<struct<text:string>>, first struct<type:string,keys:array<struct<value:string>>>, second struct<type:string,keys:array<struct<value:string>>>"


def aas_facts(elements: DataFrame) -> DataFrame:
    """category, key, value that the elements of as_aas state of nodes, and their references."""
    c = F.col
    e = elements.select("kind", F.from_json("element", _ELEMENT).alias("e"))
    nodes = e.where("kind = 'node'").select(c("e.idShort").alias("label"), F.map_from_entries(F.transform("e.value", lambda p: F.struct(p["idShort"], p["value"]))).alias("p"))
    at = lambda k: F.try_element_at("p", F.lit(k))
    fields = {"identity": "ExpandedNodeId", "browse_name": "BrowseName", "display_name": "DisplayName", "description": "Description", "datatype": "DataType", "value": "DecodedValue"}
    own = nodes.select(at("ExpandedNodeId").alias("key"), F.explode(F.array(*[F.struct(F.lit(k).alias("category"), at(v).alias("value")) for k, v in fields.items()])).alias("f")).select("f.category", "key", "f.value").where("value is not null")
    said = F.col("e.description")[0]["text"]
    part = lambda k: F.regexp_extract(said, rf"{k}=(.*?)(; |$)", 1)
    refs = e.where("kind = 'reference'").select(F.regexp_extract(said, r"^NodeSet owner=(.*); IsForward=", 1).alias("owner"), part("IsForward").alias("forward"), F.regexp_extract(said, r"; ReferenceType=(.*)$", 1).alias("type"), F.when(part("IsForward") == "true", c("e.second")).otherwise(c("e.first")).alias("to"))
    refs = refs.withColumn("key_", F.element_at("to.keys", -1)["value"]).join(nodes.select("label", at("ExpandedNodeId").alias("there")), (c("to.type") == "ModelReference") & (c("key_") == c("label")), "left")
    target = F.coalesce("there", F.concat(F.lit("nsu="), F.url_decode(F.split_part(F.regexp_replace("key_", "^urn:opcua-node:", ""), F.lit(":"), F.lit(1))), F.lit(";"), F.url_decode(F.split_part(F.regexp_replace("key_", "^urn:opcua-node:", ""), F.lit(":"), F.lit(2)))))
    return own.unionByName(refs.select(F.lit("reference").alias("category"), F.concat_ws("|", "owner", "type", "forward", target).alias("key"), F.lit("true").alias("value")))


def source_facts(rows: DataFrame) -> DataFrame:
    """category, key, value of the nodes themselves, in the same categories."""
    c = F.col
    fields = {"identity": "expanded", "browse_name": "browse_name", "display_name": "display_name", "description": "description", "datatype": "type", "value": "value"}
    own = rows.select(c("expanded").alias("key"), F.explode(F.array(*[F.struct(F.lit(k).alias("category"), c(v).alias("value")) for k, v in fields.items()])).alias("f")).select("f.category", "key", "f.value").where("value is not null")
    refs = rows.select("expanded", F.explode("refs").alias("r")).where("r.target is not null")
    return own.unionByName(refs.select(F.lit("reference").alias("category"), F.concat_ws("|", "expanded", F.coalesce("r.type", F.lit("unknown")), c("r.forward").cast("string"), "r.target").alias("key"), F.lit("true").alias("value")).distinct())


def retained(rows: DataFrame, shell: str = "urn:shell") -> DataFrame:
    """projection, nodes, references, same_ids: what each format keeps of the nodes."""
    aas, graph = as_aas(rows, shell), as_triples(rows)
    of = {
        "json": as_json(rows).select("expanded", "n_refs"),
        "table": as_table(rows).select("expanded", F.size(F.from_json("references", "array<struct<target:string>>")).alias("n_refs")),
        "ngsi_ld": as_ngsi_ld(rows).select(F.get_json_object("entity", "$.expandedNodeId.value").alias("expanded"), "n_refs"),
        "aas": aas.groupBy(F.col("owner").alias("expanded")).agg(F.count_if(F.col("kind") == "reference").alias("n_refs")),
        "rdf": graph.where("p in ('ua:expanded', 'ua:reference')").groupBy("s").agg(F.max(F.when(F.col("p") == "ua:expanded", F.col("o"))).alias("expanded"), F.count_if(F.col("p") == "ua:reference").alias("n_refs")),
    }
    ids = rows.select("expanded").distinct()
    out = None
    for name, df in of.items():
        lost = ids.exceptAll(df.select("expanded").distinct()).unionByName(df.select("expanded").distinct().exceptAll(ids)).agg(F.count("*").alias("lost"))
        row = df.agg(F.countDistinct("expanded").alias("nodes"), F.sum("n_refs").alias("references")).join(lost, F.lit(True)).select(F.lit(name).alias("projection"), "nodes", "references", (F.col("lost") == 0).alias("same_ids"))
        out = row if out is None else out.unionByName(row)
    return out


def read_n_triples(lines: DataFrame) -> DataFrame:
    """s, p, o, o_kind, o_type of N-Triples lines (column line), with full IRIs."""
    c = F.col
    shape = r'^(<[^<> ]+>|_:\w+) <([^<> ]+)> (?:(<[^<> ]+>|_:\w+)|"((?:[^"\\]|\\.)*)"(?:@(\w+)|\^\^<([^<> ]+)>)?) \.$'
    part = lambda i: F.regexp_extract("line", shape, i)
    text = F.regexp_replace(part(4), r"\\\\", "\u0001")
    for written, meant in ((r"\\n", "\n"), (r"\\r", "\r"), (r"\\t", "\t"), (r"\\\"", '"')):
        text = F.regexp_replace(text, written, meant)
    text = F.replace(text, F.lit("\u0001"), F.lit("\\"))
    named = part(3) != ""
    kind = F.when(named & F.startswith(part(3), F.lit("_")), "node").when(named, "iri").when(part(5) != "", "lang").when(part(6) != "", "typed").otherwise("plain")
    bare = lambda x: F.regexp_replace(x, "^<|>$", "")
    rows = lines.where(c("line").rlike(shape))
    return rows.select(bare(part(1)).alias("s"), part(2).alias("p"), F.when(named, bare(part(3))).otherwise(text).alias("o"), kind.alias("o_kind"), F.coalesce(F.nullif(part(5), F.lit("")), F.nullif(part(6), F.lit(""))).alias("o_type"))


def round_trip(graph: DataFrame) -> DataFrame:
    """One row: written, read, missing, added: triples that go through N-Triples. Nodes without a name keep their labels, so equality is that of sets."""
    bare = lambda x: F.regexp_replace(triples.expanded(x), "^<|>$", "")
    o = F.when(F.col("o_kind").isin("iri", "node"), bare(F.col("o"))).otherwise(F.col("o"))
    full = graph.select(bare(F.col("s")).alias("s"), bare(F.col("p")).alias("p"), o.alias("o"), "o_kind", F.when(F.col("o_kind") == "typed", bare(F.col("o_type"))).otherwise(F.col("o_type")).alias("o_type"))
    back = read_n_triples(triples.n_triples(graph))
    count = lambda df, name: df.agg(F.count("*").alias(name))
    return count(full, "written").join(count(back, "read"), F.lit(True)).join(count(full.exceptAll(back), "missing"), F.lit(True)).join(count(back.exceptAll(full), "added"), F.lit(True))


def write_case(spark: SparkSession, path: str, role: str, folder: str) -> dict:
    """Writes the files found under path, the projections of the one named role and a manifest with hashes into folder; returns the manifest."""
    files = nodeset.contents(spark, path)
    whole = nodeset.bundle(files)
    every = nodeset.nodes(whole)
    rows = records(every.where(F.col("role") == role))
    files.select("role", F.base64("content").alias("content")).write.parquet(f"{folder}/inputs")
    outputs = {"snapshot": as_json(rows).select("text"), "ngsi_ld": as_ngsi_ld(rows).select(F.col("entity").alias("text")), "aas": as_aas(rows, "urn:shell").orderBy("ord").select(F.col("element").alias("text")), "n_triples": triples.n_triples(as_triples(rows)).select(F.col("line").alias("text")), "json_ld": as_json_ld(rows).select(F.col("node").alias("text"))}
    hashes = {}
    for name, df in outputs.items():
        df.write.text(f"{folder}/{name}")
        # Lines have no order of their own, so what is hashed are their number and sums of parts of their hashes.
        part = lambda i: F.sum(F.conv(F.substring(F.sha2("text", 256), 16 * i + 1, 16), 16, 10).cast("decimal(38,0)")).cast("string")
        hashes[name] = df.agg(F.sha2(F.concat_ws("/", F.count("*").cast("string"), *map(part, range(4))), 256).alias("h")).first()["h"]
    as_table(rows).write.csv(f"{folder}/table", header=True, escape='"')
    manifest = {
        "inputs": {r["role"]: r["sha256"] for r in nodeset.documents(whole).collect()}, "outputs": hashes, "retained": [r.asDict() for r in retained(rows).collect()],
        "unresolved": nodeset.unresolved(every).count(), "datatype_conflicts": nodeset.datatype_conflicts(every, role).count(), "namespace_conflicts": nodeset.namespace_conflicts(every, role).count(),
    }
    report = ["# Case", "", *(f"* {k}: {v['nodes']} nodes, {v['references']} references, all ids: {v['same_ids']}" for k, v in ((r["projection"], r) for r in manifest["retained"])), f"* unresolved references: {manifest['unresolved']}"]
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True, indent=1),)], "text string").coalesce(1).write.text(f"{folder}/manifest", lineSep="\n")
    spark.createDataFrame([("\n".join(report),)], "text string").coalesce(1).write.text(f"{folder}/report")
    return manifest
