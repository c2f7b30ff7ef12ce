"""Constraints on triples and the two judges of actions, bound to the testdata tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.fixtures import frame, values_sql
from groundspark.operators import action_shapes, rules, shapes, triples
from groundspark.operators.paths import step
from groundspark.operators.shapes import Shape, Test
from groundspark.plans.graphs import numbered_lines
from groundspark.plans.registry import query, table

_OF, _BY = step("m:of"), step("m:by")
SHAPES = [
    Shape("F-REF", "m:Line", _BY, least=1, most=1, cls="m:Supplier"),
    Shape("F-NATION", "m:Line", _BY / step("m:inNation"), least=1),
    Shape("F-SIZE", "m:Part", step("m:size"), least=1, most=1, datatype="xsd:integer", among=tuple(str(n) for n in range(1, 41))),
    Shape("F-SOLD", "m:Part", ~_OF, least=5, most=40, cls="m:Line"),
    Shape("F-LINK", "m:Line", _OF, iri=True),
]
TESTS = [Test("F-PRICE", "m:Line", {"price": step("m:price"), "quantity": step("m:quantity"), "each": _OF / step("m:retailPrice")}, "double(price) > 1.02 * double(quantity) * double(each)")]


def trade_graph(spark, sf_dir: str) -> DataFrame:
    """Parts, line items and nine of ten suppliers as triples, so that some links lead nowhere."""
    c, name = F.col, lambda kind, key: triples.iri(kind, F.col(key).cast("string"))
    line = F.concat_ws("/", F.lit("line:l"), "l_orderkey", "n")
    return triples.emit(table(spark, sf_dir, "part"), name("part", "p_partkey"), ("rdf:type", F.lit("m:Part"), "iri"), ("m:size", c("p_size"), "xsd:integer"), ("m:retailPrice", c("p_retailprice"), "xsd:double")).unionByName(
        triples.emit(table(spark, sf_dir, "supplier").where("s_suppkey % 10 <> 0"), name("supplier", "s_suppkey"), ("rdf:type", F.lit("m:Supplier"), "iri"), ("m:inNation", name("nation", "s_nationkey"), "iri"))).unionByName(
        triples.emit(numbered_lines(spark, sf_dir), line, ("rdf:type", F.lit("m:Line"), "iri"), ("m:of", name("part", "l_partkey"), "iri"), ("m:by", name("supplier", "l_suppkey"), "iri"), ("m:quantity", c("l_quantity"), "xsd:double"), ("m:price", c("l_extendedprice"), "xsd:double")))


@query("""WITH l AS (SELECT concat('line:l/', l_orderkey, '/', row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) AS focus, * FROM lineitem),
sold AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
f AS (SELECT focus, 'F-REF' AS family FROM l WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 0)
UNION ALL SELECT focus, 'F-NATION' FROM l WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 0 AND s_nationkey IS NOT NULL)
UNION ALL SELECT focus, 'F-PRICE' FROM l JOIN part ON p_partkey = l_partkey WHERE l_extendedprice > 1.02 * l_quantity * p_retailprice
UNION ALL SELECT 'part:' || p_partkey, 'F-SIZE' FROM part WHERE p_size NOT BETWEEN 1 AND 40
UNION ALL SELECT 'part:' || p_partkey, 'F-SOLD' FROM part LEFT JOIN sold ON k = p_partkey WHERE coalesce(n, 0) NOT BETWEEN 5 AND 40)
SELECT focus, string_agg(family, ',' ORDER BY family) AS families FROM f GROUP BY 1""")
def t_shapes_trade(spark, sf_dir):
    """Every part and line item that breaks one of SHAPES or TESTS."""
    return shapes.faults(trade_graph(spark, sf_dir), SHAPES, TESTS).select("focus", F.array_join("families", ",").alias("families"))


def event_actions(spark, sf_dir: str) -> DataFrame:
    """Every event as a proposed action on the plant; what it names follows from its keys, and some of it does not exist."""
    c = F.col
    kind = F.when(c("event_type") == "purchase", "answer").when(c("event_type") == "signup", "command").otherwise("write")
    e = table(spark, sf_dir, "events").select(c("event_id").cast("string").alias("cid"), kind.alias("kind"), (c("user_id") % 80).alias("t"), (c("user_id") % 18).alias("a"), (c("event_id") % 36).alias("u"), (c("event_id") % 10).alias("c"), "value", c("event_id").alias("id"))
    by_ord = lambda name, key, at: F.broadcast(frame(spark, name).select(c("ord").alias(at), c(key)))
    e = e.join(by_ord("signals", "tag", "t"), "t", "left").join(by_ord("assets", "asset_id", "a"), "a", "left").join(by_ord("units", "unit", "u"), "u", "left")
    commands = F.array(*map(F.lit, rules_commands()))
    own = lambda kinds, x: F.when(c("kind").isin(*kinds), x)
    valued = ("write", "answer")
    return e.select(
        "cid", "kind", F.lit("VALID").alias("gold"), own(valued, F.when(c("t") < 79, F.coalesce("tag", F.lit("NO_SUCH_TAG")))).alias("tag"), own(("command",), c("asset_id")).alias("asset"),
        own(("command",), F.get(commands, c("c").cast("int"))).alias("command"), own(valued, c("value").cast("string")).alias("value"), own(valued, c("unit")).alias("unit"),
        own(("write",), F.get(F.array(F.lit("L1"), F.lit("L2"), F.lit(None)), (c("id") % 3).cast("int"))).alias("scope"),
        own(("write",), F.when(c("id") % 4 == 0, "2026-07-14T02:00:00Z").when(c("id") % 4 == 1, "2026-07-14T02:10:00Z")).alias("evidence_time"),
    )


def rules_commands() -> list[str]:
    """The verbs, and one that there is not."""
    return [*sorted(action_shapes.COMMANDS)[:8], "Explode"]


def _judges_sql() -> str:
    verbs = ", ".join(f"'{c}'" for c in rules_commands())
    known = ", ".join(f"'{c}'" for c in action_shapes.COMMANDS)
    return f"""WITH RECURSIVE {values_sql("signals", "assets", "units", "quantity_kinds", "transitions", "interlocks")},
up(a, b) AS (SELECT asset_id, asset_id FROM assets UNION SELECT up.a, assets.parent FROM up JOIN assets ON up.b = assets.asset_id WHERE assets.parent IS NOT NULL),
dims AS (SELECT units.*, dim FROM units JOIN quantity_kinds USING (quantity_kind)),
act AS (SELECT event_id, CASE event_type WHEN 'purchase' THEN 'answer' WHEN 'signup' THEN 'command' ELSE 'write' END AS kind, CASE WHEN user_id % 80 < 79 THEN coalesce(s.tag, 'NO_SUCH_TAG') END AS tag, a.asset_id AS asset, ([{verbs}])[1 + event_id % 10] AS command, e.value,
 u.unit, (['L1', 'L2', NULL])[1 + event_id % 3] AS scope, CASE event_id % 4 WHEN 0 THEN 'old' WHEN 1 THEN 'new' END AS seen FROM events e LEFT JOIN signals s ON s.ord = user_id % 80 LEFT JOIN assets a ON a.ord = user_id % 18 LEFT JOIN units u ON u.ord = event_id % 36),
j AS (SELECT act.*, s.tag IS NOT NULL AS known, s.asset_id AS owner, s.access, s.low, s.high, s.value AS reads, du.dim AS du, ds.dim AS ds, (act.value * du.multiplier + du.shift - ds.shift) / ds.multiplier AS native, m.packml, m.state
 FROM act LEFT JOIN signals s ON s.tag = act.tag LEFT JOIN dims du ON du.unit = act.unit LEFT JOIN dims ds ON ds.unit = s.unit LEFT JOIN assets m ON m.asset_id = act.asset),
lock AS (SELECT DISTINCT i.tag FROM interlocks i JOIN signals g ON g.tag = i.guard_tag JOIN assets a ON a.asset_id = g.asset_id WHERE i.operator = '>=' AND g.value < i.threshold
 OR i.operator = 'state_in' AND a.state IS NOT NULL AND NOT list_contains(string_split(i.states, ','), a.state) OR i.operator = 'state_not_in' AND list_contains(string_split(i.states, ','), a.state)),
f AS (SELECT event_id, 'F-CARD' AS family FROM j WHERE kind <> 'command' AND (tag IS NULL OR value IS NULL OR unit IS NULL) OR kind = 'command' AND asset IS NULL
UNION SELECT event_id, 'F-ENUM' FROM j WHERE kind = 'command' AND (command IS NULL OR command NOT IN ({known}))
UNION SELECT event_id, 'F-REF' FROM j WHERE kind <> 'command' AND tag IS NOT NULL AND NOT known OR kind = 'command' AND asset IS NOT NULL AND NOT coalesce(packml, FALSE)
UNION SELECT event_id, 'F-ACC' FROM j WHERE kind = 'write' AND access = 'r'
UNION SELECT event_id, 'F-DIM' FROM j WHERE kind <> 'command' AND du <> ds
UNION SELECT event_id, 'F-RANGE' FROM j WHERE kind = 'write' AND du = ds AND native NOT BETWEEN low AND high
UNION SELECT event_id, 'F-SCOPE' FROM j WHERE kind = 'write' AND known AND scope IS NOT NULL AND NOT EXISTS (SELECT 1 FROM up WHERE a = owner AND b = scope)
UNION SELECT event_id, 'F-ILK' FROM j WHERE kind = 'write' AND tag IN (SELECT tag FROM lock)
UNION SELECT event_id, 'F-STALE' FROM j WHERE kind = 'write' AND seen = 'old'
UNION SELECT event_id, 'F-STATE' FROM j WHERE kind = 'command' AND packml AND state IS NOT NULL AND command IS NOT NULL AND NOT EXISTS (SELECT 1 FROM transitions t WHERE t.state = j.state AND t.command = j.command)
UNION SELECT event_id, 'F-VALUE' FROM j WHERE kind = 'answer' AND du = ds AND abs(native - reads) > 0.01 * abs(reads) + 1e-9)
SELECT CAST(event_id AS VARCHAR) AS cid, coalesce(string_agg(family, ',' ORDER BY family), '') AS columns, columns AS triples FROM events LEFT JOIN f USING (event_id) GROUP BY event_id"""


@query(_judges_sql)
def t_two_judges(spark, sf_dir):
    """Every event as an action: its faults by the rules over columns, and by shapes over the triples of actions and plant."""
    found = action_shapes.compared(event_actions(spark, sf_dir), rules.World(spark), triples.plant(spark))
    return found.select("cid", F.array_join("columns", ",").alias("columns"), F.array_join("triples", ",").alias("triples"))
