"""Units: tokens, dimensions, affine conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundspark.fixtures import frame


def catalogue(spark: SparkSession) -> DataFrame:
    """unit, symbol, quantity_kind, multiplier, shift, aliases, dim (the exponents as text)."""
    kinds = frame(spark, "quantity_kinds").select(F.col("quantity_kind").alias("kind"), "dim")
    return frame(spark, "units").join(F.broadcast(kinds), F.col("quantity_kind") == F.col("kind")).drop("kind")


def tokens(spark: SparkSession) -> DataFrame:
    """token -> unit. Of several units a later symbol or name wins; an alias never overrides."""
    u = frame(spark, "units")
    names = u.select(F.explode(F.array(F.struct(F.lower("symbol").alias("token"), F.lit(0).alias("alias")), F.struct(F.lower("unit").alias("token"), F.lit(0).alias("alias")))).alias("t"), "unit", "ord")
    aliases = u.select(F.explode(F.transform(F.split(F.lower("aliases"), ";"), lambda a: F.struct(a.alias("token"), F.lit(1).alias("alias")))).alias("t"), "unit", "ord")
    ranked = names.unionByName(aliases).select("t.token", "t.alias", "unit", "ord")
    first = Window.partitionBy("token").orderBy("alias", F.when(F.col("alias") == 1, F.col("ord")).otherwise(-F.col("ord")))
    return ranked.withColumn("n", F.row_number().over(first)).where("n = 1").select("token", "unit")


def token_key(token: Column) -> Column:
    return F.lower(F.trim(token))


def to_si(value: Column, multiplier: Column, shift: Column) -> Column:
    return value * multiplier + shift


def converted(value: Column, m1: Column, s1: Column, m2: Column, s2: Column) -> Column:
    return (to_si(value, m1, s1) - s2) / m2


def format_dimension(dim: Column) -> Column:
    """`L^-1.M^1.T^-2`, `1` for no dimension."""
    parts = F.zip_with(F.array(*map(F.lit, ("L", "M", "T", "I", "Theta", "N", "J"))), F.split(dim, " "), lambda n, e: F.when(e != "0", F.concat(n, F.lit("^"), e)))
    text = F.array_join(F.array_compact(parts), ".")
    return F.when(text == "", "1").otherwise(text)


def convertible(spark: SparkSession) -> DataFrame:
    """Pairs of units of equal dimension: src, dst, and their factors."""
    a = catalogue(spark).select(F.col("unit").alias("src"), "dim", F.col("multiplier").alias("m1"), F.col("shift").alias("s1"))
    b = catalogue(spark).select(F.col("unit").alias("dst"), "dim", F.col("multiplier").alias("m2"), F.col("shift").alias("s2"))
    return a.join(F.broadcast(b), "dim")
