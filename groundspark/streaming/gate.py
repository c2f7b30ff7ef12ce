"""Proposed actions judged as they arrive: an extension, a stream joined to the broadcast world."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.operators import rules


def gate(actions: DataFrame, world: rules.World) -> DataFrame:
    """Verdicts of a stream (or table) of actions: cid, faults, missing, disposition. Stateless: nothing is kept between batches."""
    return rules.three_valued(actions, world).select("cid", "faults", "missing", "disposition")


def fresh_evidence(actions: DataFrame, observations: DataFrame, minutes: int = 15) -> DataFrame:
    """Actions (cid, tag, at) with observations (tag, seen) of the same tag at most so many minutes before; both may be streams.

    Watermarks let the state of both sides go after the window.
    """
    a = actions.withWatermark("at", f"{minutes} minutes")
    o = observations.withColumnRenamed("tag", "seen_tag").withWatermark("seen", f"{minutes} minutes")
    inside = (F.col("tag") == F.col("seen_tag")) & (F.col("seen") <= F.col("at")) & (F.col("seen") >= F.col("at") - F.expr(f"interval {minutes} minutes"))
    return a.join(o, inside).drop("seen_tag")
