"""Scores: intervals, confusion, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.operators.joins import small


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, cut to [0, 1]; (0, 0) without trials."""
    p, k = hits / n, F.lit(z * z)
    middle, half = (p + k / (2 * n)) / (1 + k / n), F.lit(z) * F.sqrt(p * (1 - p) / n + k / (4 * n * n)) / (1 + k / n)
    cut = lambda c: F.when(n == 0, 0.0).otherwise(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
    return cut(middle - half), cut(middle + half)


def confusion(df: DataFrame, truth: Column, guess: Column, *by: str) -> DataFrame:
    """tp, fp, fn, tn and recall, precision, f1, fpr, accuracy; null where a denominator is 0, but f1 is 0 there."""
    counts = df.groupBy(*by).agg(F.count_if(truth & guess).alias("tp"), F.count_if(~truth & guess).alias("fp"), F.count_if(truth & ~guess).alias("fn"), F.count_if(~truth & ~guess).alias("tn"))
    ratio = lambda a, b: F.try_divide(F.expr(a).cast("double"), F.expr(b))
    return counts.select("*", ratio("tp", "tp + fn").alias("recall"), ratio("tp", "tp + fp").alias("precision"), F.coalesce(ratio("2 * tp", "2 * tp + fp + fn"), F.lit(0.0)).alias("f1"), ratio("fp", "fp + tn").alias("fpr"), ratio("tp + tn", "tp + fp + fn + tn").alias("accuracy"))


def cohen_kappa(pairs: DataFrame, first: str, second: str, weights: str | None = None) -> DataFrame:
    """One row: n, kappa. Pairs with a null are left out; no expected disagreement gives 1; no pairs give null.

    The k x k table of categories is what meets in one task, never the pairs.
    """
    p = pairs.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    seen = p.groupBy(F.col(first).alias("a"), F.col(second).alias("b")).agg(F.count("*").alias("n"))
    rows, cols = seen.groupBy("a").agg(F.sum("n").alias("ra")), seen.groupBy("b").agg(F.sum("n").alias("cb"))
    every = Window.partitionBy()
    grid = rows.join(F.broadcast(cols), F.lit(True)).join(small(seen), ["a", "b"], "left")  # categories squared
    span = F.greatest(F.max(F.greatest("a", "b")).over(every) - F.min(F.least("a", "b")).over(every), F.lit(0))
    far = F.abs(F.col("a") - F.col("b")) / F.when(span == 0, 1).otherwise(span)
    w = F.when(F.col("a") == F.col("b"), 0.0).otherwise(1.0) if weights is None else far if weights == "linear" else far * far
    sums = grid.withColumn("w", w).agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.sum(F.col("w") * F.coalesce("n", F.lit(0))).alias("seen"), F.sum(F.col("w") * F.col("ra") * F.col("cb")).alias("chance"))
    return sums.select("n", F.when(F.col("chance") == 0, 1.0).otherwise(1 - F.col("seen") * F.col("n") / F.col("chance")).alias("kappa"))


def krippendorff_alpha(codes: DataFrame, unit: str, code: str, level: str = "nominal") -> DataFrame:
    """One row: n, alpha over codes(unit, code); nulls and units with one code are left out. Levels: nominal, interval, ordinal.

    Pairs are counted from each unit's number of every code, so a unit with many codes costs no pairs.
    """
    per = codes.where(F.col(code).isNotNull()).groupBy(unit, F.col(code).alias("c")).agg(F.count("*").alias("n"))
    total = per.groupBy(unit).agg(F.sum("n").alias("m"), F.collect_list(F.struct("c", "n")).alias("cs")).where("m >= 2")
    left = total.select("m", "cs", F.explode("cs").alias("x"))
    pairs = left.select("m", "x", F.explode("cs").alias("y")).select(F.col("x.c").alias("a"), F.col("y.c").alias("b"), (F.col("x.n") * (F.col("y.n") - F.when(F.col("x.c") == F.col("y.c"), 1).otherwise(0)) / (F.col("m") - 1)).alias("v"))
    table = pairs.groupBy("a", "b").agg(F.sum("v").alias("v"))
    marginal = table.groupBy("a").agg(F.sum("v").alias("na"))
    upto = Window.orderBy("a").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = marginal.withColumn("upto", F.sum("na").over(upto))  # one row a category
    grid = ranked.join(F.broadcast(ranked.toDF("b", "nb", "upto_b")), F.lit(True)).join(small(table), ["a", "b"], "left")
    if level == "nominal":
        d = F.when(F.col("a") == F.col("b"), 0.0).otherwise(1.0)
    elif level == "interval":
        d = F.pow(F.col("a") - F.col("b"), 2)
    else:
        inside = F.abs(F.col("upto") - F.col("upto_b")) + F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb"))
        d = F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.pow(inside - (F.col("na") + F.col("nb")) / 2, 2))
    sums = grid.withColumn("d", d).agg(F.sum(F.coalesce("v", F.lit(0.0))).alias("n"), F.sum(F.coalesce("v", F.lit(0.0)) * F.col("d")).alias("seen"), F.sum(F.col("na") * F.col("nb") * F.col("d")).alias("chance"))
    return sums.select("n", F.when(F.col("chance") == 0, 1.0).otherwise(1 - F.col("seen") * (F.col("n") - 1) / F.col("chance")).alias("alpha"))
