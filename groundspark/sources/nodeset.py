"""OPC UA NodeSet2 files: documents, nodes and references as tables, and the audits of a bundle.

XML is read element by element, each file once (nested values need a recursive reader); identifiers are
then resolved and audits made with SQL functions. Nothing of a node is dropped: a value keeps its raw XML
beside its JSON form, and children that have no column of their own are kept as XML by name.
"""

from __future__ import annotations

import hashlib
import json
import xml.etree.ElementTree as ET
from io import BytesIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundspark.session import checkpointed

CORE = "http://opcfoundation.org/UA/"
_NIL = "{http://www.w3.org/2001/XMLSchema-instance}nil"
_TEXT, _TEXTS, _MAP = pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string())
_MODEL = pa.list_(pa.struct([("uri", _TEXT), ("version", _TEXT), ("published", _TEXT), ("required", _TEXTS)]))
_REF = pa.list_(pa.struct([("type", _TEXT), ("forward", pa.bool_()), ("target", _TEXT)]))
_NODE = pa.list_(pa.struct([("ord", pa.int32()), *((x, _TEXT) for x in ("node_class", "node_id", "browse_name", "parent", "data_type", "display_name", "description")), ("attributes", _MAP), ("value", _TEXT), ("value_xml", _TEXT), ("other_xml", _MAP), ("refs", _REF)]))
_BUNDLE = pa.schema([("role", _TEXT), ("sha256", _TEXT), ("last_modified", _TEXT), ("namespaces", _TEXTS), ("aliases", _MAP), ("models", _MODEL), ("extensions", _TEXTS), ("nodes", _NODE)])
BUNDLE = """role string, sha256 string, last_modified string, namespaces array<string>, aliases map<string,string>, models array<struct<uri:string,version:string,published:string,required:array<string>>>, extensions array<string>,
nodes array<struct<ord:int,node_class:string,node_id:string,browse_name:string,parent:string,data_type:string,display_name:string,description:string,attributes:map<string,string>,value:string,value_xml:string,other_xml:map<string,string>,refs:array<struct<type:string,forward:boolean,target:string>>>>"""
_OWN = ("DisplayName", "Description", "References", "Value")
_WHOLE = {"Byte", "SByte", "Int16", "UInt16", "Int32", "UInt32", "Int64", "UInt64"}


def _tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def typed(e: ET.Element):
    """The value of a typed element: nil is None, lists are lists, leaves are parsed where they can be, others become maps."""
    kind, text = _tag(e), (e.text or "").strip()
    if e.get(_NIL) == "true":
        return None
    if kind.startswith("ListOf"):
        return [typed(c) for c in e]
    if len(e):
        out: dict = {}
        for c in e:
            out.setdefault(_tag(c), []).append(typed(c))
        return {k: v[0] if len(v) == 1 else v for k, v in out.items()}
    try:
        if kind == "Boolean":
            return {"true": True, "1": True, "false": False, "0": False}.get(text.lower(), text)
        return int(text) if kind in _WHOLE else float(text) if kind in ("Float", "Double") else text
    except ValueError:
        return text


def _attributes(e: ET.Element, *without: str) -> list[tuple[str, str]]:
    return [(k, v) for k, v in e.attrib.items() if k not in without]


def _node(e: ET.Element, ord_: int) -> dict:
    own: dict[str, ET.Element] = {}
    for child in e:
        own.setdefault(_tag(child), child)
    value, other = own.get("Value"), {}
    for child in e:
        if _tag(child) not in _OWN:
            other[_tag(child)] = other.get(_tag(child), "") + ET.tostring(child, encoding="unicode").strip()
    if value is None:
        decoded = None
    elif len(value):
        decoded = json.dumps(typed(value[0]), sort_keys=True)
    else:
        decoded = json.dumps((value.text or "").strip())
    refs = [{"type": r.get("ReferenceType"), "forward": r.get("IsForward", "true").lower() != "false", "target": (r.text or "").strip()} for r in own.get("References", ())]
    said = {name: (own[name].text or "").strip() if name in own else None for name in ("DisplayName", "Description")}
    return {
        "ord": ord_, "node_class": _tag(e), "node_id": e.get("NodeId"), "browse_name": e.get("BrowseName"), "parent": e.get("ParentNodeId"), "data_type": e.get("DataType"), "display_name": said["DisplayName"], "description": said["Description"],
        "attributes": _attributes(e, "NodeId", "BrowseName", "ParentNodeId", "DataType"), "value": decoded, "value_xml": None if value is None else ET.tostring(value, encoding="unicode").strip(), "other_xml": list(other.items()), "refs": refs,
    }


def parse(role: str, content: bytes) -> dict:
    """A file as one row of BUNDLE."""
    doc: dict = {"role": role, "sha256": hashlib.sha256(content).hexdigest(), "last_modified": None, "namespaces": [], "aliases": [], "models": [], "extensions": [], "nodes": []}
    depth = 0
    for event, e in ET.iterparse(BytesIO(content), events=("start", "end")):
        depth += 1 if event == "start" else -1
        if event == "start":
            if depth == 1:
                doc["last_modified"] = e.get("LastModified")
            continue
        if depth != 1:
            continue
        kind = _tag(e)
        if kind == "NamespaceUris":
            doc["namespaces"] = [(u.text or "").strip() for u in e]
        elif kind == "Aliases":
            doc["aliases"] = list({a.get("Alias"): (a.text or "").strip() for a in e}.items())
        elif kind == "Models":
            doc["models"] = [{"uri": m.get("ModelUri"), "version": m.get("Version"), "published": m.get("PublicationDate"), "required": [r.get("ModelUri") for r in m]} for m in e]
        elif kind == "Extensions":
            doc["extensions"] = [ET.tostring(x, encoding="unicode").strip() for x in e]
        elif kind.startswith("UA"):
            doc["nodes"].append(_node(e, len(doc["nodes"])))
        e.clear()
    return doc


def _read(batches):
    for batch in batches:
        for role, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield pa.RecordBatch.from_pylist([parse(role, content)], schema=_BUNDLE)


def contents(spark: SparkSession, path: str) -> DataFrame:
    """role (the file's name without its ending), content."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("role"), "content")


def bundle(files: DataFrame) -> DataFrame:
    """A row a file (role, content): its document and all its nodes, read once."""
    return checkpointed(files.select("role", "content").mapInArrow(_read, BUNDLE))


def documents(files: DataFrame) -> DataFrame:
    return (files if "nodes" in files.columns else bundle(files)).drop("nodes")


def expanded(raw: Column, namespaces: Column, aliases: Column) -> Column:
    """struct(uri, identifier) of an alias or `ns=i;id`; without an index it is the core namespace."""
    named = F.coalesce(F.try_element_at(aliases, raw), raw)
    index = F.coalesce(F.nullif(F.regexp_extract(named, r"^ns=(\d+);", 1), F.lit("")).cast("int"), F.lit(0))
    uri = F.when(index == 0, F.lit(CORE)).otherwise(F.try_element_at(namespaces, F.when(index == 0, 1).otherwise(index)))
    return F.when(named.isNotNull(), F.struct(uri.alias("uri"), F.regexp_replace(named, r"^ns=\d+;", "").alias("identifier")))


def nodes(files: DataFrame) -> DataFrame:
    """Nodes of files (or of a bundle) with node, type (of their data), parent_node, and of each reference ref_types and targets resolved; browse (uri, name)."""
    b = files if "nodes" in files.columns else bundle(files)
    n = b.select("role", "namespaces", "aliases", F.explode("nodes").alias("n")).select("role", "namespaces", "aliases", "n.*")
    at = lambda c: expanded(c, F.col("namespaces"), F.col("aliases"))
    browse = F.coalesce(F.nullif(F.regexp_extract("browse_name", r"^(\d+):", 1), F.lit("")).cast("int"), F.lit(0))
    uri = F.when(browse == 0, F.lit(CORE)).otherwise(F.try_element_at("namespaces", F.when(browse == 0, 1).otherwise(browse)))
    of = lambda field: F.transform("refs", lambda r: at(r[field]))
    return n.select("*", at(F.col("node_id")).alias("node"), at(F.col("data_type")).alias("type"), at(F.col("parent")).alias("parent_node"), F.struct(uri.alias("uri"), F.regexp_replace("browse_name", r"^\d+:", "").alias("name")).alias("browse"), of("type").alias("ref_types"), of("target").alias("targets"))


def unresolved(all_nodes: DataFrame) -> DataFrame:
    """role, node_id, type, uri, identifier, core: references whose target no document of the bundle defines."""
    refs = all_nodes.select("role", "node_id", F.explode(F.arrays_zip("refs", "targets")).alias("r")).select("role", "node_id", F.col("r.refs.type").alias("type"), "r.targets.uri", "r.targets.identifier")
    defined = all_nodes.select("node.uri", "node.identifier").distinct()
    return refs.join(defined, ["uri", "identifier"], "left_anti").withColumn("core", F.col("uri") == CORE)


def datatype_conflicts(all_nodes: DataFrame, role: str) -> DataFrame:
    """role, node_id, identifier, uri (declared), others: data types not defined where declared, but under the same identifier elsewhere."""
    defined = all_nodes.select(F.col("node.uri").alias("d_uri"), F.col("node.identifier").alias("d_id")).distinct()
    asked = all_nodes.where((F.col("role") == role) & F.col("type").isNotNull() & F.col("browse.uri").isNotNull()).select("role", "node_id", "type.uri", "type.identifier")
    missing = asked.join(defined, (F.col("uri") == F.col("d_uri")) & (F.col("identifier") == F.col("d_id")), "left_anti")
    same = missing.join(defined, (F.col("identifier") == F.col("d_id")) & ~F.col("uri").eqNullSafe(F.col("d_uri")))
    return same.groupBy("role", "node_id", "identifier", "uri").agg(F.array_sort(F.collect_set("d_uri")).alias("others"))


def namespace_conflicts(all_nodes: DataFrame, role: str) -> DataFrame:
    """node_id, value: NamespaceUri nodes whose value is not among the declared namespaces."""
    plain = F.regexp_extract("value", r'^"(.*)"$', 1)
    return all_nodes.where((F.col("role") == role) & (F.col("browse.name") == "NamespaceUri") & F.col("value").startswith('"') & ~F.array_contains("namespaces", plain)).select("node_id", plain.alias("value"))


def sizes(all_nodes: DataFrame) -> DataFrame:
    return all_nodes.groupBy("role").agg(F.count("*").alias("nodes"), F.sum(F.size("refs")).alias("refs"))


def safe_name(name: Column) -> Column:
    """Letters, digits and _ only, 80 characters at most; a name that does not begin with a letter begins with N_."""
    safe = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"\W+", "_"), "^_+|_+$", "")
    return F.substring(F.when(safe.rlike("^[A-Za-z]"), safe).otherwise(F.concat(F.lit("N_"), safe)), 1, 80)


def labelled(all_nodes: DataFrame) -> DataFrame:
    """role, node_id, label: a safe name of each node, numbered in file order."""
    n = F.row_number().over(Window.partitionBy("role").orderBy("ord"))
    name = F.coalesce(F.nullif(F.col("browse.name"), F.lit("")), F.col("node_class"))
    return all_nodes.select("role", "node_id", F.concat(F.lit("Node"), F.lpad(n.cast("string"), 3, "0"), F.lit("_"), safe_name(name)).alias("label"))
