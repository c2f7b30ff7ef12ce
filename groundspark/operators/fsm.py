"""State machines: legal commands, steps, shortest plans.

A machine is a table of transitions (state, command, next_state, settled); the units' own where none is given. Commands that are
`everywhere` are known to be refused in some states only; it words the reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.fixtures import ANYWHERE, frame
from groundspark.operators.joins import small
from groundspark.session import checkpointed

MAX_PLAN = 12


def legal(spark: SparkSession, transitions: DataFrame | None = None) -> DataFrame:
    """state, commands: what each state that has any takes."""
    moves = frame(spark, "transitions") if transitions is None else transitions
    return moves.groupBy("state").agg(F.array_join(F.array_sort(F.collect_list("command")), ",").alias("commands"))


def _states(transitions: DataFrame) -> DataFrame:
    return transitions.select(F.explode(F.array("state", "next_state", "settled")).alias("state")).distinct()


def step(asked: DataFrame, transitions: DataFrame | None = None, everywhere: tuple[str, ...] = ()) -> DataFrame:
    """asked (state, command) with allowed, next_state, settled and reason; unknown names are not allowed."""
    c, spark = F.col, asked.sparkSession
    own = transitions is None
    table = frame(spark, "transitions") if own else transitions
    moves = small(table)
    verbs = F.broadcast((frame(spark, "commands") if own else table.select("command")).distinct().withColumn("known", F.lit(True)))
    everywhere = tuple(ANYWHERE) if own else everywhere
    joined = asked.join(moves, ["state", "command"], "left").withColumn("allowed", c("next_state").isNotNull())
    known = (frame(spark, "states") if own else _states(table)).join(small(legal(spark, table)), "state", "left").select("state", F.coalesce("commands", F.lit("")).alias("commands"))
    joined = joined.join(small(known), "state", "left").join(verbs, "command", "left").withColumn("known", F.coalesce("known", F.lit(False))).select(*joined.columns, "commands", "known")
    text = F.format_string
    reason = (
        F.when(c("commands").isNull(), text("unknown state '%s'", "state"))
        .when(~c("known"), text("unknown PackML command '%s'", "command"))
        .when(c("allowed"), text("%s --%s--> %s", "state", "command", "next_state"))
        .when(c("command").isin(list(everywhere)), text("%s is not accepted in state %s", "command", "state"))
        .otherwise(text("%s is illegal in state %s; legal commands are %s", "command", "state", F.replace("commands", F.lit(","), F.lit(", "))))
    )
    return joined.withColumn("reason", reason).drop("commands", "known")


def plans(spark: SparkSession, transitions: DataFrame | None = None, most: int = MAX_PLAN) -> DataFrame:
    """start, goal, length, plan: the shortest commands between settled states, `most` at most, of equally long ones the first by name."""
    table = frame(spark, "transitions") if transitions is None else transitions
    moves = table.select(F.col("state").alias("at"), "command", "settled")
    starts = (frame(spark, "states") if transitions is None else _states(table)).select(F.col("state").alias("start"), F.col("state").alias("goal"), F.lit(0).alias("length"), F.array().cast("array<string>").alias("path"))
    seen = newest = starts
    for length in range(1, most + 1):
        ahead = newest.join(small(moves), F.col("goal") == F.col("at")).select("start", F.col("settled").alias("goal"), F.concat("path", F.array("command")).alias("path"))
        ahead = ahead.groupBy("start", "goal").agg(F.min("path").alias("path"))
        newest = checkpointed(ahead.join(seen, ["start", "goal"], "left_anti").select("start", "goal", F.lit(length).alias("length"), "path"))
        if newest.isEmpty():
            break
        seen = seen.unionByName(newest)
    return seen.select("start", "goal", "length", F.array_join("path", ",").alias("plan"))
