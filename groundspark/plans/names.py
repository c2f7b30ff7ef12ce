"""Names and numbers for the rows of the testdata tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from groundspark.fixtures import values_sql
from groundspark.functions import units
from groundspark.operators import naming
from groundspark.plans.registry import query, table


@query("SELECT p_partkey, upper(substring(p_type, 1, 3)) || '-' || lpad(CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS VARCHAR), 8, '0') AS code FROM part")
def t_part_codes(spark, sf_dir):
    """Codes of a type's letters and a counter without gaps."""
    parts = naming.numbered(table(spark, sf_dir, "part").select("p_partkey", "p_type"), ["p_type"], ["p_partkey"])
    return parts.select("p_partkey", F.concat(F.upper(F.substring("p_type", 1, 3)), F.lit("-"), F.lpad(F.col("n").cast("string"), 8, "0")).alias("code"))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM orders")
def t_order_numbers(spark, sf_dir):
    """Numbers within a few hot keys."""
    return naming.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderstatus"], ["o_orderkey"]).select("o_orderkey", "o_custkey", "n")


@query("""WITH r AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS n FROM part)
SELECT p_partkey, p_name || CASE WHEN n > 0 THEN '#' || n ELSE '' END AS new_name FROM r""")
def t_part_names(spark, sf_dir):
    """Names that parts share, told apart."""
    return naming.told_apart(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", ["p_partkey"]).select("p_partkey", "new_name")


@query(lambda: f"""WITH {values_sql("units", "quantity_kinds")}, u AS (SELECT units.*, dim, string_split(dim, ' ') AS e FROM units JOIN quantity_kinds USING (quantity_kind)),
named AS (SELECT lower(symbol) AS token, unit, 0 AS alias, -ord AS o FROM u UNION ALL SELECT lower(unit), unit, 0, -ord FROM u UNION ALL SELECT unnest(string_split(lower(aliases), ';')), unit, 1, ord FROM u),
tok AS (SELECT token, unit FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY alias, o) AS n FROM named) WHERE n = 1),
e AS (SELECT event_id, value, '  ' || upper(s.symbol) || ' ' AS said, t.unit AS target FROM events JOIN u s ON s.ord = event_id % 36 JOIN u t ON t.ord = user_id % 35)
SELECT event_id, tok.unit, target, CASE WHEN a.dim = b.dim THEN (value * a.multiplier + a.shift - b.shift) / b.multiplier END AS converted, value * a.multiplier + a.shift AS si,
coalesce(nullif(array_to_string(list_filter(list_transform(list_zip(['L', 'M', 'T', 'I', 'Theta', 'N', 'J'], a.e), lambda x: CASE WHEN x[2] <> '0' THEN x[1] || '^' || x[2] END), lambda x: x IS NOT NULL), '.'), ''), '1') AS dimension
FROM e JOIN tok ON tok.token = lower(trim(said)) JOIN u a ON a.unit = tok.unit JOIN u b ON b.unit = target""")
def t_event_units(spark, sf_dir):
    """Each event's value in a unit that is written carelessly, in base units and in another unit where one can be had from the other."""
    c, u = F.col, units.catalogue(spark)
    of = lambda x: u.select(*[c(k).alias(f"{x}_{k}") for k in ("unit", "ord", "symbol", "multiplier", "shift", "dim")])
    e = table(spark, sf_dir, "events").join(F.broadcast(of("s")), c("event_id") % 36 == c("s_ord")).join(F.broadcast(of("t")), c("user_id") % 35 == c("t_ord"))
    said = e.withColumn("token", units.token_key(F.concat(F.lit("  "), F.upper("s_symbol"), F.lit(" ")))).join(F.broadcast(units.tokens(spark)), "token").join(F.broadcast(of("a")), c("unit") == c("a_unit"))
    converted = F.when(c("a_dim") == c("t_dim"), units.converted(c("value"), c("a_multiplier"), c("a_shift"), c("t_multiplier"), c("t_shift")))
    return said.select("event_id", "unit", c("t_unit").alias("target"), converted.alias("converted"), units.to_si(c("value"), c("a_multiplier"), c("a_shift")).alias("si"), units.format_dimension(c("a_dim")).alias("dimension"))
