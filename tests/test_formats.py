import json

from groundspark.operators import formats, triples


def test_writers(spark):
    t = triples.plant(spark).cache()
    subjects = t.select("s").distinct().count()
    blocks = [r.block for r in formats.turtle(t).collect()]
    assert len(blocks) == subjects and all(b.endswith(" .") for b in blocks) and any(b.startswith("plant:L1-FIL ") and "m:feeds plant:L1-CAP" in b for b in blocks)
    nodes = [json.loads(r.node) for r in formats.json_ld(t).collect()]
    assert len(nodes) == subjects and sum(len(v) for n in nodes for k, v in n.items() if k != "@id") == 2465
    filler = next(n for n in nodes if n["@id"] == "https://example.org/plant/L1-FIL")
    assert filler["http://www.w3.org/2000/01/rdf-schema#label"] == [{"@value": "Line 1 Rotary Filler", "@language": "en"}]


def test_entities(spark):
    things = {r.asset_id: json.loads(r.thing) for r in formats.wot(spark).collect()}
    assert len(things) == 11 and sum(len(t["properties"]) for t in things.values()) == 73
    assert things["L1-FIL"]["properties"]["L1_FIL_PIC0301_SP"]["forms"][0]["op"] == ["readproperty", "writeproperty"]
    assert things["UT-CMP"]["actions"] == {} and len(things["L1-CAP"]["actions"]["packmlCommand"]["input"]["enum"]) == 9
    entities = {r.asset_id: json.loads(r.entity) for r in formats.ngsi_ld(spark).collect()}
    assert len(entities) == 17 and entities["L1-FIL"]["FillVolumeSetpoint"]["value"] == 500.0 and entities["L1-FIL"]["isPartOf"]["object"] == "urn:ngsi-ld:Asset:L1" and "isPartOf" not in entities["ENT"]


def test_nothing_differs_from_itself(spark):
    t = triples.plant(spark)
    assert triples.difference(t, t).count() == 0
    assert triples.difference(t, t.where("p <> 'm:feeds'")).count() == 14
