"""Agreement by weights and levels, bound to the line items: their number against a class of their quantity, and the numbers within an order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.functions import stats
from groundspark.plans.registry import query, table


@query("""WITH p AS (SELECT l_linenumber AS a, CAST(1 + floor(l_quantity / 8) AS INTEGER) AS b FROM lineitem WHERE l_linenumber IS NOT NULL AND l_quantity IS NOT NULL),
ra AS (SELECT a, count(*) AS ra FROM p GROUP BY 1), cb AS (SELECT b, count(*) AS cb FROM p GROUP BY 1), seen AS (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2),
g AS (SELECT a, b, ra, cb, coalesce(n, 0) AS n, abs(a - b) / greatest((SELECT max(greatest(a, b)) - min(least(a, b)) FROM ra, cb), 1) AS far FROM ra CROSS JOIN cb LEFT JOIN seen USING (a, b)),
w AS (SELECT weights, n, ra, cb, CASE weights WHEN 'none' THEN CAST(a <> b AS INTEGER) WHEN 'linear' THEN far ELSE far * far END AS w FROM g, (VALUES ('none'), ('linear'), ('quadratic')) AS t(weights))
SELECT weights, CAST(sum(n) AS BIGINT) AS n, round(1 - sum(w * n) * sum(n) / sum(w * ra * cb), 9) AS kappa FROM w GROUP BY 1""")
def t_kappa_weights(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("a"), (1 + F.floor(F.col("l_quantity") / 8)).cast("int").alias("b"))
    return _each({w or "none": stats.cohen_kappa(pairs, "a", "b", w) for w in (None, "linear", "quadratic")}, "weights", "kappa")


@query("""WITH u AS (SELECT l_orderkey AS u, l_linenumber AS c, count(*) OVER (PARTITION BY l_orderkey) AS m, row_number() OVER () AS i FROM lineitem WHERE l_linenumber IS NOT NULL),
t AS (SELECT x.c AS a, y.c AS b, sum(1.0 / (x.m - 1)) AS v FROM u x JOIN u y ON x.u = y.u AND x.i <> y.i GROUP BY 1, 2),
n AS (SELECT a, sum(v) AS na, sum(sum(v)) OVER (ORDER BY a) AS upto FROM t GROUP BY 1),
g AS (SELECT x.a, y.a AS b, x.na, y.na AS nb, coalesce(v, 0) AS v, abs(x.upto - y.upto) + CASE WHEN x.a < y.a THEN x.na ELSE y.na END - (x.na + y.na) / 2 AS steps FROM n x CROSS JOIN n y LEFT JOIN t ON t.a = x.a AND t.b = y.a),
d AS (SELECT level, v, na, nb, CASE WHEN a = b THEN 0 WHEN level = 'nominal' THEN 1 WHEN level = 'interval' THEN (a - b) * (a - b) ELSE steps * steps END AS d FROM g, (VALUES ('nominal'), ('interval'), ('ordinal')) AS l(level))
SELECT level, CAST(round(sum(v)) AS BIGINT) AS n, round(1 - sum(v * d) * (sum(v) - 1) / sum(na * nb * d), 9) AS alpha FROM d GROUP BY 1""")
def t_alpha_levels(spark, sf_dir):
    codes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return _each({level: stats.krippendorff_alpha(codes, "l_orderkey", "l_linenumber", level) for level in ("nominal", "interval", "ordinal")}, "level", "alpha")


def _each(found: dict[str, DataFrame], by: str, value: str) -> DataFrame:
    rows = [df.select(F.lit(x).alias(by), F.round("n").cast("long").alias("n"), F.round(value, 9).alias(value)) for x, df in found.items()]
    return reduce(DataFrame.unionByName, rows)
