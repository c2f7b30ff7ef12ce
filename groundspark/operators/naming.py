"""Naming schemes: what keeps a mapping of tags one to one, and a plant under other names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.operators.joins import small
from groundspark.session import checkpointed


def bumped(candidates: DataFrame) -> DataFrame:
    """tag, new_tag: of candidates (tag, ord, head, loop, tail) that give one name, all but the first get a letter after their loop, A and on.

    A name is head_loop_tail. Only names that meet are numbered, in the order of ord.
    """
    n = F.row_number().over(Window.partitionBy("head", "loop", "tail").orderBy("ord"))
    letter = F.when(n > 1, F.chr((63 + n).cast("int"))).otherwise("")
    return candidates.select("tag", F.concat("head", F.lit("_"), "loop", letter, F.lit("_"), "tail").alias("new_tag"))


def injective(tags: DataFrame) -> DataFrame:
    """new_tag, n: names that more than one tag got; none for a mapping that is one to one."""
    return tags.groupBy("new_tag").agg(F.count("*").alias("n")).where("n > 1")


def in_scope(signals: DataFrame, scope: str) -> DataFrame:
    """Signals whose asset's id begins with scope, as texts, not by the hierarchy."""
    return signals.where(F.startswith("asset_id", F.lit(scope)))


def numbered(rows: DataFrame, by: list[str], order: list[str], name: str = "n") -> DataFrame:
    """rows with their number, from 1 and without gaps, among those of equal `by` (nulls together) in order; order must part them.

    Rows are dealt out by ranges of key and order, so a key with many is spread; each range numbers its own, and starts at
    what the ranges before hold of the key, of which there is one count a range and key.
    """
    ranged = checkpointed(rows.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    local = F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order))
    counts = ranged.groupBy("_range", *by).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("_before", before).where("_before is not null").select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_of_{c}") for c in by], "_before")
    same = F.col("_range") == F.col("_r")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return ranged.withColumn("_local", local).join(small(starts), same, "left").select(*rows.columns, (F.col("_local") + F.coalesce("_before", F.lit(0))).alias(name))


def told_apart(rows: DataFrame, name: str, order: list[str], suffix: Column | None = None) -> DataFrame:
    """rows with new_name: the name where it is the first in order, with a suffix where it is not, until no two are equal.

    suffix: of the column `n` (1 for the second, and on). A name with a suffix may be another row's own name;
    that row was there first, and the one that came upon it takes the next number, in rounds until all names differ. order must part the rows.
    """
    suffix = F.concat(F.lit("#"), F.col("n")) if suffix is None else suffix
    fixed = None
    # What is left to name, with the next number that each may take.
    open_ = numbered(rows, [name], order, "_place").withColumn("_next", F.col("_place") - 1)
    while True:
        tried = open_.withColumn("n", F.col("_next")).withColumn("new_name", F.when(F.col("_next") == 0, F.col(name)).otherwise(F.concat(name, suffix))).drop("n")
        taken = tried if fixed is None else fixed.unionByName(tried)
        # A row's own name comes before one with a suffix, and what was fixed in an earlier round before both.
        old = F.lit(1) if fixed is None else F.col("_fixed")
        first = Window.partitionBy("new_name").orderBy(*([old] if fixed is not None else []), F.col("_next") > 0, *order)
        ranked = checkpointed((taken if "_fixed" in taken.columns else taken.withColumn("_fixed", F.lit(1))).withColumn("_rank", F.row_number().over(first)))
        fixed = ranked.where("_rank = 1").drop("_rank").withColumn("_fixed", F.lit(0))
        met = ranked.where("_rank > 1").drop("_rank", "new_name").withColumn("_fixed", F.lit(1))
        if met.isEmpty():
            return fixed.select(*rows.columns, "new_name")
        # All rows of the name move on by as many numbers as it has rows, so that they never meet each other.
        size = rows.groupBy(name).agg(F.count("*").alias("_size"))
        open_ = met.join(size, name).withColumn("_next", F.col("_next") + F.col("_size")).drop("_size")
