"""The plant's formats: what they cost, what they keep, and the tool schema that an agent is given."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundspark.fixtures import Plant, values_sql
from groundspark.operators import coverage, interchange, toolschema
from groundspark.operators.triples import IRDI
from groundspark.plans.registry import query
from groundspark.session import checkpointed
from groundspark.sources import nodeset

_IRDI = ", ".join(f"'{k}'" for k in IRDI)


def recovered(spark):
    """reference, opcua, aas: facts of the plant, and what its two files say when read back."""
    plant = Plant(spark)
    files = interchange.nodeset(plant).select(F.lit("plant").alias("role"), F.encode("text", "UTF-8").alias("content"))
    return checkpointed(interchange.reference_facts(plant)), checkpointed(interchange.nodeset_facts(nodeset.nodes(files))), checkpointed(interchange.aas_facts(interchange.environment(plant)))


@query(f"""WITH {values_sql('signals', 'assets', 'feeds', 'interlocks', 'units')}, s AS (SELECT s.*, u.quantity_kind AS unit_kind FROM signals s JOIN units u ON s.unit = u.unit),
f(category, total, opcua, opcua_conflict, aas) AS (
SELECT 'identity', count(*), count(*), 0, count(*) FROM s UNION ALL SELECT 'semantic_id', count(*), 0, 0, count(*) FROM s WHERE quantity_kind IN ({_IRDI}) UNION ALL SELECT 'nameplate', count(*), 0, 0, count(*) FROM assets WHERE manufacturer <> '-'
UNION ALL SELECT 'datatype', count(*), count(*), 0, count(*) FROM s UNION ALL SELECT 'access', count(*), count(*), 0, 0 FROM s UNION ALL SELECT 'range', count(*), count(*), 0, 0 FROM s UNION ALL SELECT 'unit', count(*), count(*), 0, count(*) FROM s
UNION ALL SELECT 'quantity_kind', count(*), count(*) FILTER (unit_kind = quantity_kind), count(*) FILTER (unit_kind <> quantity_kind), 0 FROM s UNION ALL SELECT 'membership', count(*), count(*), 0, count(*) FROM s
UNION ALL SELECT 'parent', count(*), count(*), 0, 0 FROM assets WHERE parent IS NOT NULL UNION ALL SELECT 'feeds', count(*), 0, 0, 0 FROM feeds UNION ALL SELECT 'state', count(*), 0, 0, count(*) FROM assets WHERE state IS NOT NULL
UNION ALL SELECT 'legal_commands', count(*), 0, 0, 0 FROM assets WHERE state IS NOT NULL UNION ALL SELECT 'interlock', count(*), 0, 0, 0 FROM interlocks UNION ALL SELECT 'value', count(*), 0, 0, count(*) FROM s WHERE value IS NOT NULL
UNION ALL SELECT 'observation_time', count(*), 0, 0, 0 FROM s WHERE value IS NOT NULL)
SELECT category, total, opcua, opcua_conflict, aas, greatest(opcua, aas) AS both_together FROM f""")
def p_facts_recovered(spark, sf_dir):
    """Facts that are right when read back from the OPC UA file, the shells, and both together."""
    reference, opcua, aas = recovered(spark)
    count = lambda seen, name: coverage.counted(coverage.compared(reference, seen)).select("category", F.col("correct").alias(name), *([F.col("total"), F.col("conflict").alias("opcua_conflict")] if name == "opcua" else []))
    out = count(opcua, "opcua").join(count(aas, "aas"), "category").join(count(coverage.merged(opcua, aas, reference), "both_together"), "category")
    return out.select("category", "total", "opcua", "opcua_conflict", "aas", "both_together")


@query("SELECT * FROM (VALUES ('csv', 2256), ('opcua', 52324), ('aas', 65929)) AS t(format, tokens)")
def p_format_tokens(spark, sf_dir):
    """Token cost of three formats, as published; the others are written in their own spacing and order."""
    return interchange.sizes(interchange.documents(spark)).where("format in ('csv', 'opcua', 'aas')").select("format", "tokens")


@query()
def p_format_sizes(spark, sf_dir):
    """Bytes, tokens and ratio to the smallest, of all eight formats."""
    return interchange.sizes(interchange.documents(spark)).select("format", "bytes", "tokens", F.round("ratio", 1).alias("ratio"))


@query("SELECT * FROM (VALUES ('C0', 205), ('C1', 218), ('C2', 981), ('C3', 1669), ('C4', 2317)) AS t(cond, tokens)")
def p_schema_tokens(spark, sf_dir):
    """Token cost of the tool schema under each condition, as published."""
    return toolschema.sizes(Plant(spark))
