"""Facts (category, key, value) compared with a reference, and merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers that differ by less than this share are the same.
TOLERANCE = 1e-9


def same(a: Column, b: Column) -> Column:
    """Equal as texts, or as numbers within the tolerance."""
    x, y = a.try_cast("double"), b.try_cast("double")
    close = F.abs(x - y) <= TOLERANCE * F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
    return F.coalesce((a == b) | close, a == b, F.lit(False))


def compared(reference: DataFrame, observed: DataFrame) -> DataFrame:
    """category, key, value, seen, outcome: correct, conflict or missing; facts that only the observation has are left out."""
    seen = observed.select("category", "key", F.col("value").alias("seen"))
    joined = reference.join(seen, ["category", "key"], "left")
    return joined.withColumn("outcome", F.when(F.col("seen").isNull(), "missing").when(same(F.col("value"), F.col("seen")), "correct").otherwise("conflict"))


def counted(outcomes: DataFrame) -> DataFrame:
    """category, total, correct, conflict, missing."""
    count = lambda x: F.count_if(F.col("outcome") == x).alias(x)
    return outcomes.groupBy("category").agg(F.count("*").alias("total"), count("correct"), count("conflict"), count("missing"))


def merged(first: DataFrame, second: DataFrame, reference: DataFrame) -> DataFrame:
    """category, key, value of either source; where both have one, the first's if it equals the reference, else the second's."""
    a, b = first.withColumnRenamed("value", "va"), second.withColumnRenamed("value", "vb")
    joined = a.join(b, ["category", "key"], "full").join(reference.withColumnRenamed("value", "vr"), ["category", "key"], "left")
    keep_first = F.col("vb").isNull() | (F.col("va").isNotNull() & same(F.col("va"), F.col("vr")))
    return joined.select("category", "key", F.when(keep_first, F.col("va")).otherwise(F.col("vb")).alias("value"))
