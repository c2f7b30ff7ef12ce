"""Joins in time: rows within a span before, and the last row before.

Times are whole numbers, such as microseconds. Both joins cut time, so that no task holds a key's whole history: spans into
buckets as long as the span, which a row can only reach from its own and the one before; the last row before into parts of about equally many
rows of each key that has many, where a part that begins with no row yet takes the last one of an earlier part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.operators.joins import join_once, small

#: Rows of one key and bucket, or of one key, beyond which they are dealt out.
PART = 100_000
#: Parts into which a key of more rows is cut.
PARTS = 1024


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{ts}`)")


def _known(by: list[str], at: str) -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in (*by, at)])


def _bucket(t: str, width: int) -> Column:
    """floor(t / width) of whole numbers."""
    return F.expr(f"{t} div {width} - if({t} % {width} < 0, 1, 0)")


def within(left: DataFrame, right: DataFrame, by: list[str], at: str, other_at: str, span: int) -> DataFrame:
    """Rows of left, each with every row of right (a struct, `other`) of the same keys whose time is `span` or less before its own, or equal.

    Rows without a key or a time meet none. A bucket with many rows of left is cut by their hash, and right's rows go to each cut.
    """
    width = max(span, 1)
    mine = left.where(_known(by, at)).select(F.struct(*left.columns).alias("_row"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], F.col(at).cast("long").alias("_t"))
    mine = mine.withColumn("_b", _bucket("_t", width))
    theirs = right.where(_known(by, other_at)).select(F.struct(*right.columns).alias("other"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], F.col(other_at).cast("long").alias("_u"))
    theirs = theirs.withColumn("_own", _bucket("_u", width)).withColumn("_b", F.explode(F.array("_own", F.col("_own") + 1))).drop("_own")
    keys = [*[f"_{i}" for i in range(len(by))], "_b"]
    hot = small(mine.groupBy(*keys).agg(F.ceil(F.count("*") / PART).cast("int").alias("_cuts")).where("_cuts > 1"))
    mine = mine.join(hot, keys, "left").withColumn("_cut", F.pmod(F.xxhash64("_row"), F.coalesce("_cuts", F.lit(1))).cast("int")).drop("_cuts")
    theirs = theirs.join(hot, keys, "left").withColumn("_cut", F.explode(F.sequence(F.lit(0), F.coalesce("_cuts", F.lit(1)) - 1))).drop("_cuts")
    met = mine.join(theirs, [*keys, "_cut"]).where(F.col("_u").between(F.col("_t") - span, F.col("_t")))
    return met.select("_row.*", "other")


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, other_at: str, ties: list[str], strictly: bool = False) -> DataFrame:
    """Every row of left with `other`, the last row of right (a struct) of the same keys at its time or before; null if there is none.

    strictly: before its time. Of rows of right at one time the one with the largest ties is the last. Rows of left without a
    key or a time have none.
    """
    keys = [f"_{i}" for i in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)]
    last = F.max_by(F.struct(*right.columns), F.struct(*ties))
    theirs = right.where(_known(by, other_at)).groupBy(*by, other_at).agg(last.alias("other")).select(*named, F.col(other_at).cast("long").alias("_t"), "other")
    mine = left.where(_known(by, at)).groupBy(*by, at).agg(F.count("*").alias("_n")).select(*named, F.col(at).cast("long").alias("_t"), "_n")
    # At one time, rows of right come first, unless only those before count.
    turn = (1, 0) if strictly else (0, 1)
    every = theirs.select(*keys, "_t", F.lit(turn[0]).alias("_turn"), "other", F.lit(None).cast("long").alias("_n"))
    every = every.unionByName(mine.select(*keys, "_t", F.lit(turn[1]).alias("_turn"), F.lit(None).cast(theirs.schema["other"].dataType).alias("other"), "_n"))
    cuts = F.percentile_approx("_t", [i / PARTS for i in range(1, PARTS)], F.lit(10 * PARTS))
    hot = small(every.groupBy(*keys).agg(F.count("*").alias("_rows"), cuts.alias("_cuts")).where(F.col("_rows") > PART).drop("_rows"))
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_t"))), F.lit(0))
    every = every.join(hot, keys, "left").withColumn("_part", F.when(F.col("_cuts").isNull(), 0).otherwise(part)).drop("_cuts")
    so_far = Window.partitionBy(*keys, "_part").orderBy("_t", "_turn").rowsBetween(Window.unboundedPreceding, 0)
    found = every.withColumn("other", F.last("other", ignorenulls=True).over(so_far)).where("_n is not null")
    ends = every.groupBy(*keys, "_part").agg(F.max_by("other", F.when(F.col("other").isNotNull(), F.col("_t"))).alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = small(ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).where("_carried is not null").drop("_end"))
    found = found.join(carried, [*keys, "_part"], "left").select(*keys, "_t", "_n", F.struct(F.coalesce("other", "_carried").alias("other")).alias("_found"))
    told = left.where(_known(by, at)).select(F.struct(*left.columns).alias("_row"), *named, F.col(at).cast("long").alias("_t"))
    met = join_once(told, found, [*keys, "_t"], "_n").select("_row.*", "_found.other")
    untold = left.where(~_known(by, at)).withColumn("other", F.lit(None).cast(theirs.schema["other"].dataType))
    return met.unionByName(untold)
