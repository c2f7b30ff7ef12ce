"""Queries over the plant fixture: the eight probes, naming schemes, commands, action spaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundspark.fixtures import frame, values_sql
from groundspark.functions import units
from groundspark.operators import formats, fsm, graph, naming, triples
from groundspark.plans.registry import query

#: The grid of values of the action space.
VALUE_GRID = (0.0, 0.1, 0.5, 1.0, 2.0, 2.5, 3.0, 5.0, 7.5, 10.0, 15.0, 20.0, 25.0, 30.0, 45.0, 50.0, 60.0, 75.0, 100.0, 120.0, 150.0, 200.0, 250.0, 330.0, 500.0, 750.0, 1000.0, 2000.0)
WINDOW = ("2026-07-14T02:09:00Z", "2026-07-14T02:16:00Z")

WITH = lambda *names: f"WITH RECURSIVE {values_sql(*names)}"
_UP = "up(src, dst) AS (SELECT asset_id, parent FROM assets WHERE parent IS NOT NULL UNION SELECT up.src, a.parent FROM up JOIN assets a ON up.dst = a.asset_id WHERE a.parent IS NOT NULL)"
_FLOW = "flow(src, dst) AS (SELECT src, dst FROM feeds UNION SELECT flow.src, f.dst FROM flow JOIN feeds f ON flow.dst = f.src)"


def parents(spark: SparkSession) -> DataFrame:
    return frame(spark, "assets").select(F.col("asset_id").alias("src"), F.col("parent").alias("dst")).where("dst is not null")


def blocked_tags(spark: SparkSession) -> DataFrame:
    """tag, id of interlocks whose guard does not hold now. No value of a numeric guard does not block; a state not known is not listed."""
    s, a = frame(spark, "signals"), frame(spark, "assets")
    guard = s.join(F.broadcast(a.select("asset_id", "state")), "asset_id").select(F.col("tag").alias("guard_tag"), "value", "state")
    listed = F.coalesce(F.array_contains(F.split("states", ","), F.col("state")), F.lit(False))
    blocks = F.when(F.col("operator") == ">=", F.coalesce(F.col("value") < F.col("threshold"), F.lit(False))).when(F.col("operator") == "state_in", ~listed).otherwise(listed)
    return frame(spark, "interlocks").join(guard, "guard_tag").where(blocks).select("tag", "id")


@query(f"""{WITH('assets', 'signals', 'units')} SELECT sum(s.value * u.multiplier) / 1000 AS kw
FROM assets a JOIN signals s USING (asset_id) JOIN units u ON s.unit = u.unit WHERE a.parent = 'AREA-UTIL' AND s.quantity_kind = 'Power'""")
def p_uni05_total_power(spark, sf_dir):
    a = frame(spark, "assets").where("parent = 'AREA-UTIL'").select("asset_id")
    s = frame(spark, "signals").where("quantity_kind = 'Power' and value is not null")
    u = frame(spark, "units").select("unit", "multiplier")
    return s.join(F.broadcast(a), "asset_id").join(F.broadcast(u), "unit").agg((F.sum(F.col("value") * F.col("multiplier")) / 1000).alias("kw"))


@query(f"""{WITH('assets', 'signals')}, {_UP} SELECT s.tag, s.value, s.alarm_low, s.alarm_high FROM up JOIN signals s ON s.asset_id = up.src
WHERE up.dst = 'SITE-KA' AND (s.value < s.alarm_low OR s.value > s.alarm_high)""")
def p_rng04_alarm_violations(spark, sf_dir):
    inside = graph.closure(parents(spark)).where("dst = 'SITE-KA'").select(F.col("src").alias("asset_id"))
    return frame(spark, "signals").join(inside, "asset_id", "left_semi").where("value < alarm_low or value > alarm_high").select("tag", "value", "alarm_low", "alarm_high").orderBy("tag")


@query(f"{WITH('assets', 'feeds')}, {_FLOW} SELECT DISTINCT a.name AS label FROM flow JOIN assets a ON a.asset_id = flow.dst WHERE flow.src = 'L1-PAS'")
def p_top02_downstream(spark, sf_dir):
    start = frame(spark, "assets").where("asset_id = 'L1-PAS'").select(F.col("asset_id").alias("src"))
    down = graph.closure(frame(spark, "feeds"), start)
    return frame(spark, "assets").join(down, F.col("asset_id") == F.col("dst"), "left_semi").select(F.col("name").alias("label")).orderBy("label")


@query(f"{WITH('assets')} SELECT asset_id, name FROM assets WHERE parent = 'L1'")
def p_top03_members(spark, sf_dir):
    return frame(spark, "assets").where("parent = 'L1'").select("asset_id", "name").orderBy("asset_id")


@query(f"{WITH('assets', 'transitions')} SELECT asset_id, a.state FROM assets a JOIN transitions t ON a.state = t.state WHERE parent = 'L1' AND command = 'Start'")
def p_act04_startable(spark, sf_dir):
    t = frame(spark, "transitions").where("command = 'Start'").select("state")
    return frame(spark, "assets").where("parent = 'L1'").join(F.broadcast(t), "state").select("asset_id", "state").orderBy("asset_id")


@query(f"{WITH('assets', 'signals', 'interlocks')} SELECT s.tag, i.text FROM assets a JOIN signals s USING (asset_id) JOIN interlocks i ON i.tag = s.tag WHERE a.parent = 'L1' AND s.access = 'rw'")
def p_saf04_interlocked(spark, sf_dir):
    a = frame(spark, "assets").where("parent = 'L1'").select("asset_id")
    s = frame(spark, "signals").where("access = 'rw'").join(F.broadcast(a), "asset_id")
    return s.join(F.broadcast(frame(spark, "interlocks").select("tag", "text")), "tag").select("tag", "text").orderBy("tag")


@query(f"""{WITH('feeds', 'plant_events')}, {_FLOW}, up(asset_id) AS (SELECT src FROM flow WHERE dst = 'L1-CAP' UNION SELECT 'L1-CAP')
SELECT e.id, e.ts, e.text FROM plant_events e JOIN up USING (asset_id) WHERE e.ts BETWEEN '{WINDOW[0]}' AND '{WINDOW[1]}'""")
def p_prv04_upstream_events(spark, sf_dir):
    """Events of the capper or anything upstream of it in a fixed window; ISO texts of one zone compare as times."""
    up = graph.closure(frame(spark, "feeds"), zero_hop=True).where("dst = 'L1-CAP'").select(F.col("src").alias("asset_id"))
    return frame(spark, "plant_events").where(F.col("ts").between(*WINDOW)).join(up, "asset_id", "left_semi").select("id", "ts", "text").orderBy("ts")


@query(f"{WITH('signals', 'units')} SELECT s.tag, s.value, u.symbol FROM signals s JOIN units u ON s.unit = u.unit WHERE s.asset_id = 'L1-FIL' AND s.description = 'Outlet pressure'")
def p_grd01_lookup(spark, sf_dir):
    s = frame(spark, "signals").where("asset_id = 'L1-FIL' and description = 'Outlet pressure' and value is not null")
    return s.join(F.broadcast(frame(spark, "units").select("unit", "symbol")), "unit").select("tag", "value", "symbol")


@query(f"{WITH('signals')} SELECT lower(description) AS description, count(*) AS n, string_agg(tag, ',' ORDER BY tag) AS tags FROM signals GROUP BY 1 HAVING count(*) > 1")
def p_homographs(spark, sf_dir):
    return frame(spark, "signals").groupBy(F.lower("description").alias("description")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("tag")), ",").alias("tags")).where("n > 1")


@query(f"""{WITH('units', 'quantity_kinds')}, u AS (SELECT * FROM units JOIN quantity_kinds USING (quantity_kind))
SELECT a.unit AS src, b.unit AS dst, round((10.0 * a.multiplier + a.shift - b.shift) / b.multiplier, 6) AS of_ten FROM u a JOIN u b ON a.dim = b.dim""")
def p_unit_convert_matrix(spark, sf_dir):
    c = F.col
    return units.convertible(spark).select("src", "dst", F.round(units.converted(F.lit(10.0), c("m1"), c("s1"), c("m2"), c("s2")), 6).alias("of_ten"))


@query(f"""{WITH('units')}, named AS (SELECT lower(symbol) AS token, unit, ord, 0 AS alias FROM units UNION ALL SELECT lower(unit), unit, ord, 0 FROM units
UNION ALL SELECT unnest(string_split(lower(aliases), ';')), unit, ord, 1 FROM units)
SELECT token, unit FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY alias, CASE WHEN alias = 1 THEN ord ELSE -ord END) AS n FROM named) WHERE n = 1""")
def p_unit_tokens(spark, sf_dir):
    return units.tokens(spark)


@query(f"""{WITH('quantity_kinds')}, e AS (SELECT quantity_kind, unnest(['L', 'M', 'T', 'I', 'Theta', 'N', 'J']) AS n, unnest(string_split(dim, ' ')) AS x, unnest(range(7)) AS i FROM quantity_kinds)
SELECT quantity_kind, coalesce(string_agg(n || '^' || x, '.' ORDER BY i) FILTER (x <> '0'), '1') AS dimension FROM e GROUP BY 1""")
def p_dimensions(spark, sf_dir):
    return frame(spark, "quantity_kinds").select("quantity_kind", units.format_dimension(F.col("dim")).alias("dimension"))


@query(f"{WITH('transitions')} SELECT state, string_agg(command, ',' ORDER BY command) AS commands FROM transitions GROUP BY 1")
def p_legal_commands(spark, sf_dir):
    return fsm.legal(spark)


@query(f"""{WITH('states', 'commands', 'transitions')} SELECT s.state, c.command, t.next_state IS NOT NULL AS allowed, t.next_state, t.settled,
CASE WHEN t.next_state IS NOT NULL THEN s.state || ' --' || c.command || '--> ' || t.next_state WHEN c.command IN ('Stop', 'Abort') THEN c.command || ' is not accepted in state ' || s.state
ELSE c.command || ' is illegal in state ' || s.state || '; legal commands are ' || coalesce((SELECT string_agg(x.command, ', ' ORDER BY x.command) FROM transitions x WHERE x.state = s.state), '') END AS reason
FROM states s CROSS JOIN commands c LEFT JOIN transitions t ON t.state = s.state AND t.command = c.command""")
def p_fsm_step(spark, sf_dir):
    asked = frame(spark, "states").join(F.broadcast(frame(spark, "commands")), F.lit(True))
    return fsm.step(asked).select("state", "command", "allowed", "next_state", "settled", "reason")


@query(f"""{WITH('states', 'transitions')}, walk(start, goal, length, plan) AS (SELECT state, state, 0, '' FROM states UNION
SELECT w.start, t.settled, w.length + 1, CASE WHEN w.plan = '' THEN t.command ELSE w.plan || ',' || t.command END FROM walk w JOIN transitions t ON t.state = w.goal WHERE w.length < 5)
SELECT start, goal, length, plan FROM (SELECT *, row_number() OVER (PARTITION BY start, goal ORDER BY length, string_split(plan, ',')) AS n FROM walk) WHERE n = 1""")
def p_fsm_plan(spark, sf_dir):
    return fsm.plans(spark)


@query(f"""{WITH('assets', 'signals', 'interlocks')}, g AS (SELECT s.tag AS guard_tag, s.value, a.state FROM signals s JOIN assets a USING (asset_id))
SELECT i.tag, i.id FROM interlocks i JOIN g USING (guard_tag) WHERE CASE operator WHEN '>=' THEN coalesce(value < threshold, false)
WHEN 'state_in' THEN NOT coalesce(list_contains(string_split(states, ','), state), false) ELSE coalesce(list_contains(string_split(states, ','), state), false) END""")
def p_blocked_tags(spark, sf_dir):
    return blocked_tags(spark)


_GRID = ", ".join(f"({v})" for v in VALUE_GRID)


@query(f"""{WITH('assets', 'signals', 'interlocks', 'units', 'quantity_kinds')}, grid(v) AS (VALUES {_GRID}), u AS (SELECT * FROM units JOIN quantity_kinds USING (quantity_kind)),
g AS (SELECT s.tag AS guard_tag, s.value, a.state FROM signals s JOIN assets a USING (asset_id)),
blocked AS (SELECT DISTINCT i.tag FROM interlocks i JOIN g USING (guard_tag) WHERE CASE operator WHEN '>=' THEN coalesce(value < threshold, false)
 WHEN 'state_in' THEN NOT coalesce(list_contains(string_split(states, ','), state), false) ELSE coalesce(list_contains(string_split(states, ','), state), false) END),
c AS (SELECT s.access = 'rw' AND s.unit = a.unit AND grid.v BETWEEN s.low AND s.high AS g2,
 s.access = 'rw' AND a.dim = b.dim AND (grid.v * a.multiplier + a.shift - b.shift) / b.multiplier BETWEEN s.low AND s.high AS g3, s.tag IN (SELECT tag FROM blocked) AS stopped
 FROM signals s JOIN u b ON s.unit = b.unit CROSS JOIN u a CROSS JOIN grid),
n AS (SELECT count(*) AS g0, count(*) FILTER (g2) AS g2, count(*) FILTER (g3) AS g3, count(*) FILTER (g3 AND NOT stopped) AS g4, count(*) FILTER (g2 AND g3 AND NOT stopped) AS both FROM c)
SELECT 'G0' AS tier, g0 AS size, round(log2(g0), 6) AS bits, round(g4 / g0, 6) AS "precision", 1.0::DOUBLE AS recall FROM n
UNION ALL SELECT 'G2', g2, round(log2(g2), 6), round("both" / g2, 6), round("both" / g4, 6) FROM n UNION ALL SELECT 'G3', g3, round(log2(g3), 6), round(g4 / g3, 6), 1.0 FROM n
UNION ALL SELECT 'G4', g4, round(log2(g4), 6), 1.0, 1.0 FROM n""")
def p_action_space_write(spark, sf_dir):
    """All (tag, unit, value) of the grid by what each tier admits, against the last tier."""
    c = F.col
    cat = units.catalogue(spark)
    own = cat.select(c("unit").alias("own"), c("dim").alias("own_dim"), c("multiplier").alias("m2"), c("shift").alias("s2"))
    stated = cat.select(c("unit").alias("stated"), "dim", c("multiplier").alias("m1"), c("shift").alias("s1"))
    signals = frame(spark, "signals").join(F.broadcast(own), c("unit") == c("own")).join(F.broadcast(blocked_tags(spark).select("tag").distinct().withColumn("stopped", F.lit(True))), "tag", "left")
    tried = signals.join(F.broadcast(stated), F.lit(True)).withColumn("v", F.explode(F.array(*map(F.lit, VALUE_GRID))))
    g2 = (c("access") == "rw") & (c("stated") == c("unit")) & c("v").between(c("low"), c("high"))
    g3 = (c("access") == "rw") & (c("dim") == c("own_dim")) & units.converted(c("v"), c("m1"), c("s1"), c("m2"), c("s2")).between(c("low"), c("high"))
    g4 = g3 & c("stopped").isNull()
    n = tried.agg(F.count("*").alias("G0"), F.count_if(g2).alias("G2"), F.count_if(g3).alias("G3"), F.count_if(g4).alias("G4"), F.count_if(g2 & g4).alias("both"))
    row = lambda tier, common: F.struct(F.lit(tier).alias("tier"), c(tier).alias("size"), F.round(F.log2(c(tier)), 6).alias("bits"), F.round(c(common) / c(tier), 6).alias("precision"), F.round(c(common) / c("G4"), 6).alias("recall"))
    return n.select(F.explode(F.array(row("G0", "G4"), row("G2", "both"), row("G3", "G4"), row("G4", "G4"))).alias("r")).select("r.*")


@query(f"""{WITH('assets', 'commands', 'transitions')}, c AS (SELECT a.packml, t.command IS NOT NULL AS legal FROM assets a CROSS JOIN commands c LEFT JOIN transitions t ON t.state = a.state AND t.command = c.command AND a.packml)
SELECT count(*) AS g0, count(*) FILTER (packml) AS g2, count(*) FILTER (legal) AS g4 FROM c""")
def p_action_space_command(spark, sf_dir):
    tried = frame(spark, "assets").join(F.broadcast(frame(spark, "commands")), F.lit(True))
    found = tried.join(F.broadcast(frame(spark, "transitions")), ["state", "command"], "left")
    return found.agg(F.count("*").alias("g0"), F.count_if("packml").alias("g2"), F.count_if(F.col("packml") & F.col("next_state").isNotNull()).alias("g4"))


@query(f"{WITH('signals')} SELECT tag, CASE access WHEN 'rw' THEN 'AO_' ELSE 'AI_' END || lpad(CAST(4001 + 7 * (row_number() OVER (ORDER BY ord) - 1) AS VARCHAR), 5, '0') AS new_tag FROM signals")
def p_naming_opaque(spark, sf_dir):
    n = F.row_number().over(Window.orderBy("ord")) - 1  # the plant's tags
    return frame(spark, "signals").select("tag", F.concat(F.when(F.col("access") == "rw", "AO_").otherwise("AI_"), F.lpad((4001 + 7 * n).cast("string"), 5, "0")).alias("new_tag"))


@query(f"""{WITH('assets', 'signals')}, b AS (SELECT a.asset_id, a.ord, string_split(min(s.tag), '_')[1] || '_' || string_split(min(s.tag), '_')[2] AS prefix FROM assets a JOIN signals s USING (asset_id) GROUP BY 1, 2),
r AS (SELECT asset_id, coalesce(lead(prefix) OVER (ORDER BY ord), first_value(prefix) OVER (ORDER BY ord)) AS prefix FROM b)
SELECT s.tag, r.prefix || '_' || string_split(s.tag, '_')[3] || '_' || string_split(s.tag, '_')[4] AS new_tag FROM signals s JOIN r USING (asset_id)""")
def p_naming_inconsistent(spark, sf_dir):
    """Each asset's tags under the prefix of the next asset that has signals, the last under that of the first."""
    s, part = frame(spark, "signals"), lambda i: F.split_part("tag", F.lit("_"), F.lit(i))
    bearing = s.groupBy("asset_id").agg(F.min(F.concat_ws("_", part(1), part(2))).alias("prefix")).join(frame(spark, "assets").select("asset_id", F.col("ord").alias("a_ord")), "asset_id")
    w = Window.orderBy("a_ord")
    turned = bearing.select("asset_id", F.coalesce(F.lead("prefix").over(w), F.first("prefix").over(w)).alias("to"))
    return naming.bumped(s.join(F.broadcast(turned), "asset_id").select("tag", "ord", F.col("to").alias("head"), part(3).alias("loop"), part(4).alias("tail")))


@query("SELECT 2465 AS triples, 2465 AS lines, 0 AS damaged")
def p_triples(spark, sf_dir):
    """The published number of triples; every one is a well-formed line of its own."""
    lines = triples.n_triples(triples.plant(spark))
    whole = r'^(<[^<> ]+>|_:\w+) <[^<> ]+> (<[^<> ]+>|_:\w+|"([^"\\]|\\.)*"(@en|\^\^<[^<> ]+>)?) \.$'
    return lines.agg(F.count("*").alias("triples"), F.countDistinct("line").alias("lines"), F.count_if(~F.col("line").rlike(whole)).alias("damaged"))


#: System and function letters of the plant designation, and vendors' names of roles.
SYSTEMS = {"Pasteuriser": "LCA", "Filler": "LCB", "Capper": "LCC", "Labeller": "LCD", "CIPSkid": "LCE", "Compressor": "SCA", "Chiller": "SCB"}
FUNCTIONS = {"measurement": "XQ", "setpoint": "XW", "command": "XG", "state": "XS", "kpi": "XK"}
ROLES = {"measurement": "Value", "setpoint": "Setpoint", "command": "Command", "state": "State", "kpi": "Kpi"}


def _case(column: str, table: dict[str, str], other: str):
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col(column)), F.lit(other))


def _case_sql(column: str, table: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{other}' END"


def _named(spark: SparkSession) -> DataFrame:
    a = frame(spark, "assets").select("asset_id", "kind", "manufacturer", "model")
    return frame(spark, "signals").join(F.broadcast(a), "asset_id")


@query(f"""{WITH('assets', 'signals')}, k AS (SELECT s.tag, s.ord, {_case_sql('a.kind', SYSTEMS, 'XXX')} AS sys, CASE WHEN a.asset_id LIKE 'L2%' THEN 20 ELSE 10 END AS unit, {_case_sql('s.role', FUNCTIONS, 'XQ')} AS fn FROM signals s JOIN assets a USING (asset_id))
SELECT tag, '=' || unit // 10 || sys || unit || 'CP' || lpad(CAST(row_number() OVER (PARTITION BY sys, unit, fn ORDER BY ord) AS VARCHAR), 3, '0') || fn || '01' AS new_tag FROM k""")
def p_naming_kks(spark, sf_dir):
    """Designations with a counter for each system, unit and function."""
    rows = _named(spark).select("tag", "ord", _case("kind", SYSTEMS, "XXX").alias("sys"), F.when(F.col("asset_id").startswith("L2"), 20).otherwise(10).alias("unit"), _case("role", FUNCTIONS, "XQ").alias("fn"))
    n = F.row_number().over(Window.partitionBy("sys", "unit", "fn").orderBy("ord"))
    return rows.select("tag", F.concat(F.lit("="), F.floor(F.col("unit") / 10).cast("int"), "sys", "unit", F.lit("CP"), F.lpad(n.cast("string"), 3, "0"), "fn", F.lit("01")).alias("new_tag"))


@query(f"""{WITH('assets', 'signals')} SELECT s.tag, CASE WHEN a.manufacturer = '-' THEN 'Gen' ELSE replace(string_split(a.manufacturer, ' ')[1], ',', '') END || '.' || coalesce(nullif(regexp_replace(string_split(a.model, ' ')[1], '[^A-Za-z0-9]', '', 'g'), ''), 'Dev')
|| '.Ch' || lpad(CAST(row_number() OVER (PARTITION BY s.asset_id ORDER BY s.ord) AS VARCHAR), 2, '0') || '.' || {_case_sql('s.role', ROLES, 'Value')} AS new_tag FROM signals s JOIN assets a USING (asset_id)""")
def p_naming_vendor(spark, sf_dir):
    """Maker, model, channel and role."""
    n = F.row_number().over(Window.partitionBy("asset_id").orderBy("ord"))
    maker = F.when(F.col("manufacturer") == "-", "Gen").otherwise(F.replace(F.split_part("manufacturer", F.lit(" "), F.lit(1)), F.lit(","), F.lit("")))
    model = F.coalesce(F.nullif(F.regexp_replace(F.split_part("model", F.lit(" "), F.lit(1)), "[^A-Za-z0-9]", ""), F.lit("")), F.lit("Dev"))
    return _named(spark).select("tag", F.concat(maker, F.lit("."), model, F.lit(".Ch"), F.lpad(n.cast("string"), 2, "0"), F.lit("."), _case("role", ROLES, "Value")).alias("new_tag"))


@query("SELECT 2256 AS tokens")
def p_historian_tokens(spark, sf_dir):
    """The published token cost of the historian export."""
    return formats.historian_cost(spark)
