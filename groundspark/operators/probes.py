"""Answering by a query instead of a packed context: eight probes as SQL over the plant's tables, and what each costs in tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.fixtures import Plant
from groundspark.functions.text import surrogate_tokens
from groundspark.operators import graph

#: Each over tables in braces; `above` and `down` are the closures of the hierarchy and of the flow.
PROBES = {
    "UNI-05": """SELECT CAST(SUM(s.value * u.multiplier) / 1000 AS BIGINT) AS kw FROM {assets} a JOIN {signals} s ON s.asset_id = a.asset_id JOIN {units} u ON u.unit = s.unit
WHERE a.parent = 'AREA-UTIL' AND s.quantity_kind = 'Power'""",
    "RNG-04": """SELECT s.tag, s.value, s.alarm_low, s.alarm_high FROM {above} h JOIN {signals} s ON s.asset_id = h.src
WHERE h.dst = 'SITE-KA' AND (s.value < s.alarm_low OR s.value > s.alarm_high) ORDER BY s.tag""",
    "TOP-02": "SELECT a.name FROM {down} f JOIN {assets} a ON a.asset_id = f.dst WHERE f.src = 'L1-PAS' ORDER BY a.name",
    "TOP-03": "SELECT asset_id, name FROM {assets} WHERE parent = 'L1' ORDER BY asset_id",
    "ACT-04": "SELECT a.asset_id, a.state FROM {assets} a JOIN {transitions} t ON t.state = a.state WHERE a.parent = 'L1' AND t.command = 'Start' ORDER BY a.asset_id",
    "SAF-04": """SELECT s.tag, i.text FROM {assets} a JOIN {signals} s ON s.asset_id = a.asset_id JOIN {interlocks} i ON i.tag = s.tag
WHERE a.parent = 'L1' AND s.access = 'rw' ORDER BY s.tag""",
    "PRV-04": """SELECT e.id, e.ts, e.text FROM {plant_events} e WHERE (e.asset_id = 'L1-CAP' OR e.asset_id IN (SELECT src FROM {down} WHERE dst = 'L1-CAP'))
AND e.ts BETWEEN '2026-07-14T02:09:00Z' AND '2026-07-14T02:16:00Z' ORDER BY e.ts""",
    "GRD-01": "SELECT s.tag, s.value, u.symbol FROM {signals} s JOIN {units} u ON u.unit = s.unit WHERE s.asset_id = 'L1-FIL' AND s.description = 'Outlet pressure'",
}


def run(plant: Plant, tid: str) -> DataFrame:
    text = PROBES[tid]
    made = {"above": lambda: graph.closure(plant.assets.select(F.col("asset_id").alias("src"), F.col("parent").alias("dst"))), "down": lambda: graph.closure(plant.feeds)}
    tables = [t for t in ("assets", "signals", "units", "interlocks", "transitions", "plant_events", "above", "down") if f"{{{t}}}" in text]
    return plant.spark.sql(text, **{t: made[t]() if t in made else getattr(plant, t) for t in tables})


def cost(plant: Plant) -> DataFrame:
    """tid, rows, query_tokens, result_tokens, tokens: rows are written with ` | ` between cells, one a line."""
    out = []
    for tid, text in PROBES.items():
        result = run(plant, tid)
        line = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in result.columns])
        body = result.agg(F.count("*").alias("rows"), F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))  # a probe's few rows
        out.append(body.select(F.lit(tid).alias("tid"), "rows", surrogate_tokens(F.lit(text.replace("{", "").replace("}", ""))).alias("query_tokens"), surrogate_tokens(F.col("text")).alias("result_tokens")))
    return reduce(DataFrame.unionByName, out).withColumn("tokens", F.col("query_tokens") + F.col("result_tokens"))


def against_contexts(costs: DataFrame, contexts: DataFrame) -> DataFrame:
    """costs with context_tokens, sufficient and saving (contexts' tokens over the probe's; null where a probe costs nothing)."""
    other = contexts.select("tid", F.col("tokens").alias("context_tokens"), "sufficient")
    return costs.join(other, "tid", "left").withColumn("saving", F.try_divide("context_tokens", "tokens"))
