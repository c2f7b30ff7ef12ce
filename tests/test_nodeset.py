"""A pump station's NodeSet and the model it is built on: reading, audits, and projections that lose nothing."""

import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from groundspark.operators import coverage, projections, triples
from groundspark.sources import nodeset

STATION = """<?xml version="1.0"?>
<UANodeSet xmlns="http://opcfoundation.org/UA/2011/03/UANodeSet.xsd" xmlns:u="http://opcfoundation.org/UA/2008/02/Types.xsd" LastModified="2025-03-01T00:00:00Z">
  <NamespaceUris><Uri>http://water.example/station</Uri><Uri>http://water.example/pumps</Uri></NamespaceUris>
  <Models><Model ModelUri="http://water.example/station" Version="0.3" PublicationDate="2025-02-01T00:00:00Z"><RequiredModel ModelUri="http://water.example/pumps"/></Model></Models>
  <Aliases><Alias Alias="Organizes">i=35</Alias><Alias Alias="Mode">ns=2;i=70</Alias></Aliases>
  <Extensions><Extension><Tool xmlns="urn:tool">export</Tool></Extension></Extensions>
  <UAObject NodeId="ns=1;i=1" BrowseName="1:Well"><DisplayName>Well &amp; sump</DisplayName>
    <References><Reference ReferenceType="Organizes">ns=1;i=2</Reference><Reference ReferenceType="Organizes">ns=1;i=3</Reference></References></UAObject>
  <UAObject NodeId="ns=1;i=2" BrowseName="2:Pump" ParentNodeId="ns=1;i=1">
    <References><Reference ReferenceType="i=40">ns=2;i=7</Reference><Reference ReferenceType="Organizes" IsForward="false">ns=1;i=1</Reference></References></UAObject>
  <UAVariable NodeId="ns=1;i=3" BrowseName="1:9 level (m)" DataType="Mode" AccessLevel="3"><Description>over the floor</Description>
    <Value><u:ExtensionObject><u:Body><u:Reading><u:At>noon</u:At><u:Samples><u:Double>1.25</u:Double></u:Samples></u:Reading></u:Body></u:ExtensionObject></Value></UAVariable>
  <UAVariable NodeId="ns=1;s=note" BrowseName="1:Note" DataType="ns=1;i=7"><Value>plain words</Value></UAVariable>
  <UAMethod NodeId="ns=1;s=drain" BrowseName="1:Drain"><References><Reference ReferenceType="ns=2;i=80">ns=1;s=nowhere</Reference></References>
    <InverseName>filled by</InverseName></UAMethod>
  <UAVariable NodeId="ns=1;i=9" BrowseName="1:NamespaceUri" DataType="i=12"><Value><u:String>http://water.example/old</u:String></Value></UAVariable>
</UANodeSet>"""
PUMPS = """<UANodeSet xmlns="http://opcfoundation.org/UA/2011/03/UANodeSet.xsd"><NamespaceUris><Uri>http://water.example/pumps</Uri></NamespaceUris>
  <UAObjectType NodeId="ns=1;i=7" BrowseName="1:PumpType"/>
  <UADataType NodeId="ns=1;i=70" BrowseName="1:Mode"><Definition Name="1:Mode"><Field Name="Off" Value="0"/></Definition></UADataType>
  <UAReferenceType NodeId="ns=1;i=80" BrowseName="1:DrainsTo"/></UANodeSet>"""


@pytest.fixture(scope="module")
def read(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("nodesets")
    (folder / "station.xml").write_text(STATION)
    (folder / "pumps.xml").write_text(PUMPS)
    whole = nodeset.bundle(nodeset.contents(spark, str(folder)))
    return str(folder), whole, nodeset.nodes(whole).cache()


def test_documents(read):
    docs = {r.role: r for r in nodeset.documents(read[1]).collect()}
    d = docs["station"]
    assert d.namespaces[1] == "http://water.example/pumps" and d.aliases == {"Organizes": "i=35", "Mode": "ns=2;i=70"} and d.last_modified == "2025-03-01T00:00:00Z"
    assert [(m.version, m.published, m.required) for m in d.models] == [("0.3", "2025-02-01T00:00:00Z", ["http://water.example/pumps"])]
    assert len(d.extensions) == 1 and "export" in d.extensions[0] and docs["pumps"].models == []


def test_nodes_keep_everything(read):
    n = {(r.role, r.node_id): r for r in read[2].collect()}
    assert len(n) == 9
    level = n["station", "ns=1;i=3"]
    assert json.loads(level.value) == {"Body": {"Reading": {"At": "noon", "Samples": {"Double": 1.25}}}} and "noon" in level.value_xml and level.attributes == {"AccessLevel": "3"}
    assert (level.type.uri, level.type.identifier) == ("http://water.example/pumps", "i=70")
    assert json.loads(n["station", "ns=1;s=note"].value) == "plain words"
    pump = n["station", "ns=1;i=2"]
    assert (pump.parent_node.uri, pump.parent_node.identifier) == ("http://water.example/station", "i=1") and (pump.browse.uri, pump.browse.name) == ("http://water.example/pumps", "Pump")
    assert [(r.type, r.forward) for r in pump.refs] == [("i=40", True), ("Organizes", False)] and [t.identifier for t in pump.ref_types] == ["i=40", "i=35"]
    assert "filled by" in n["station", "ns=1;s=drain"].other_xml["InverseName"] and "Off" in n["pumps", "ns=1;i=70"].other_xml["Definition"]
    assert n["station", "ns=1;i=1"].display_name == "Well & sump"


def test_audits(read):
    n = read[2]
    assert {r.role: (r.nodes, r.refs) for r in nodeset.sizes(n).collect()} == {"station": (6, 5), "pumps": (3, 0)}
    assert [(r.node_id, r.identifier, r.core) for r in nodeset.unresolved(n).collect()] == [("ns=1;s=drain", "s=nowhere", False)]
    (conflict,) = nodeset.datatype_conflicts(n, "station").collect()
    assert (conflict.node_id, conflict.identifier, conflict.others) == ("ns=1;s=note", "i=7", ["http://water.example/pumps"])
    assert [tuple(r) for r in nodeset.namespace_conflicts(n, "station").collect()] == [("ns=1;i=9", "http://water.example/old")]
    labels = {r.node_id: r.label for r in nodeset.labelled(n.where("role = 'station'")).collect()}
    assert labels["ns=1;i=3"] == "Node003_N_9_level_m" and labels["ns=1;i=1"] == "Node001_Well"


def test_projections_lose_nothing(read):
    rows = projections.records(read[2].where("role = 'station'")).cache()
    assert {r.projection: (r.nodes, r.references, r.same_ids) for r in projections.retained(rows).collect()} == dict.fromkeys(["json", "table", "ngsi_ld", "aas", "rdf"], (6, 5, True))
    want = projections.source_facts(rows)
    counts = {r.category: (r.total, r.correct) for r in coverage.counted(coverage.compared(want, projections.aas_facts(projections.as_aas(rows, "urn:station")))).collect()}
    assert counts["identity"] == (6, 6) and counts["reference"] == (5, 5) and all(a == b for a, b in counts.values())
    trip = projections.round_trip(projections.as_triples(rows)).first()
    assert trip.written == trip.read > 60 and trip.missing == trip.added == 0
    entity = json.loads(projections.as_ngsi_ld(rows).where("entity like '%ns=1;s=drain%'").first().entity)
    assert entity["id"] == "urn:opcua-node:http%3A%2F%2Fwater.example%2Fstation:s%3Ddrain" and entity["references"]["value"][0]["targetNodeId"].endswith("s=nowhere") and "dataType" not in entity


def test_the_plant_goes_through_n_triples(spark):
    trip = projections.round_trip(triples.plant(spark)).first()
    assert (trip.written, trip.read, trip.missing, trip.added) == (2465, 2465, 0, 0)


def test_case(spark, read, tmp_path):
    manifest = projections.write_case(spark, read[0], "station", str(tmp_path / "case"))
    assert set(manifest["inputs"]) == {"station", "pumps"} and manifest["unresolved"] == 1 and all(len(h) == 64 for h in manifest["outputs"].values())
    assert "6 nodes, 5 references" in spark.read.text(str(tmp_path / "case" / "report")).agg(F.concat_ws(" ", F.collect_list("value")).alias("t")).first().t


def test_typed_values():
    value = lambda body: nodeset.typed(ET.fromstring(body))
    assert value("<UInt16>12</UInt16>") == 12 and value("<Float>2.5</Float>") == 2.5 and value("<Boolean>0</Boolean>") is False and value("<Int64>twelve</Int64>") == "twelve"
    assert value("<ListOfInt32><Int32>1</Int32><Int32>2</Int32></ListOfInt32>") == [1, 2]
    assert value("<Pair><Key>a</Key><Item>1</Item><Item>2</Item></Pair>") == {"Key": "a", "Item": ["1", "2"]}
    assert value('<Guid xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" xsi:nil="true"/>') is None
