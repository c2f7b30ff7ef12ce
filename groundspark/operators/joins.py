"""Joins that keep hot keys spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.session import checkpointed

#: Keys that `join_once` broadcasts at most.
HOT = 20_000
#: A key of so few rows is never hot: they are no load for a task, however small the table.
FEW = 64
#: Rows of a table that `small` lets be broadcast.
SMALL = 200_000


def join_once(rows: DataFrame, once: DataFrame, keys: list[str], n: str = "n", spread: bool = True) -> DataFrame:
    """rows joined by keys (without nulls) to a table with one row a key, whose column n counts the rows of that key (or is at least as large).

    Keys of more than a HOTth of all rows (and more than FEW) are fewer than HOT, so they are broadcast and their rows stay where
    they are spread; no other key gathers more than a HOTth of the rows, or FEW, in a task. Where no key is hot, nothing is
    broadcast: each broadcast takes some megabytes of the driver's memory, and loops have many. Without spread, rows that lie evenly already
    stay where they are if there are HOT keys in all, which are then broadcast as they are. n is not in the result.
    """
    once = checkpointed(once)
    total, most, each = once.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0)), F.count("*")).first()
    values = [c for c in once.columns if c not in (*keys, n)]
    if not spread and each <= HOT:
        return rows.join(F.broadcast(once.drop(n)), keys).select(*rows.columns, *values)
    least = max(total / HOT, FEW)
    if most <= least:
        return rows.join(once.drop(n), keys).select(*rows.columns, *values)
    names = [f"_{k}" for k in keys]
    value = F.struct(*[F.col(c) for c in values])
    table = once.select(*[F.col(k).alias(x) for k, x in zip(keys, names, strict=True)], value.alias("_value"), (F.col(n) > least).alias("_hot"))
    hot = table.where("_hot").select(*[F.col(x).alias(f"_hot{x}") for x in names], F.col("_value").alias("_hot_value"))
    rest = table.where("not _hot").withColumn("_place", F.xxhash64(*names)).drop("_hot")
    tried = rows.join(F.broadcast(hot), [F.col(k) == F.col(f"_hot{x}") for k, x in zip(keys, names, strict=True)], "left")
    # Where a row of a hot key has its value already, it goes wherever its own hash says, and meets nothing there.
    tried = tried.withColumn("_at", F.when(F.col("_hot_value").isNull(), F.xxhash64(*keys)).otherwise(F.xxhash64(*rows.columns)))
    joined = tried.join(rest, [F.col("_at") == F.col("_place"), *[F.col(k) == F.col(x) for k, x in zip(keys, names, strict=True)]], "left")
    found = joined.withColumn("_value", F.coalesce("_hot_value", "_value")).where("_value is not null")
    return found.select(*rows.columns, "_value.*")


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it has SMALL rows at most; else as it is."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df
