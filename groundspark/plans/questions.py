"""The suite of questions: what searches find, what contexts hold, and how far that suffices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark import suite
from groundspark.fixtures import Plant, values_sql
from groundspark.operators import context, elements, grounding, probes, retrieval
from groundspark.operators.triples import IRDI
from groundspark.plans import plant as plant_queries
from groundspark.plans.registry import query
from groundspark.session import checkpointed


def _sql(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def values(columns: str, rows) -> str:
    return f"{columns.split('(')[0]}({columns.split('(')[1]} AS (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in rows) + ")"


def questions(spark) -> DataFrame:
    """Those about one signal."""
    return suite.tasks(spark).where("gold_tag is not null")


_TASKS = values("tasks(tid, gold_tag, question)", [(a, b, c) for a, b, c, _ in suite.TASKS])
_KINDS = values("kinds_of(cond, fact_kind)", [(key, k) for key, cond in elements.conditions().items() for k in sorted(cond.kinds)])
_SAID_K = values("said_k(kind, word)", [(k, w) for k, ws in elements.SAID_OF_KINDS.items() for w in ws])
_SAID_L = values("said_l(line, word)", [(k, w) for k, ws in elements.SAID_OF_LINES.items() for w in ws])
_CUES = values("cues(intent, word)", [(k, w) for k, ws in retrieval.CUES.items() for w in ws])
_TOKENS = lambda c: f"regexp_extract_all(lower({c}), '[a-z]+|[0-9]+')"

FACTS = f"""facts(fact_kind, fact) AS (
SELECT unnest(['value', 'time']), unnest(['value:' || tag, 'time:' || tag]) FROM signals WHERE value IS NOT NULL
UNION SELECT k, k || ':' || tag FROM signals, (VALUES ('desc'), ('unit'), ('qk'), ('range'), ('access'), ('role')) AS t(k)
UNION SELECT 'alarm', 'alarm:' || tag FROM signals WHERE alarm_low IS NOT NULL OR alarm_high IS NOT NULL
UNION SELECT 'sig_of', 'sig_of:' || tag || '|' || asset_id FROM signals
UNION SELECT 'semid', 'semid:' || tag FROM signals WHERE quantity_kind IN ({', '.join(map(_sql, IRDI))})
UNION SELECT k, k || ':' || asset_id FROM assets, (VALUES ('label'), ('isa95'), ('class')) AS t(k)
UNION SELECT 'parent', 'parent:' || asset_id || '|' || parent FROM assets WHERE parent IS NOT NULL
UNION SELECT 'nameplate', 'nameplate:' || asset_id FROM assets WHERE manufacturer <> '-'
UNION SELECT 'location', 'location:' || asset_id FROM assets WHERE location IS NOT NULL
UNION SELECT k, k || ':' || asset_id FROM assets, (VALUES ('state'), ('legalcmd')) AS t(k) WHERE state IS NOT NULL
UNION SELECT 'feeds', 'feeds:' || src || '|' || dst FROM feeds
UNION SELECT 'event', 'event:' || id FROM plant_events UNION SELECT 'recipe', 'recipe:' || id FROM recipes UNION SELECT 'interlock', 'interlock:' || tag FROM interlocks)"""


@query(f"WITH {values_sql('signals', 'assets', 'feeds', 'plant_events', 'recipes', 'interlocks')}, {_KINDS}, {FACTS} SELECT cond, count(*) AS facts FROM facts JOIN kinds_of USING (fact_kind) GROUP BY 1")
def p_facts_by_condition(spark, sf_dir):
    return elements.facts_by_condition(Plant(spark)).groupBy("cond").agg(F.countDistinct("fact").alias("facts"))


_LINKS = f"""q AS (SELECT tid, lower(question) AS q, {_TOKENS('question')} AS words FROM tasks),
qk AS (SELECT DISTINCT tid, kind FROM q JOIN said_k ON contains(q.q, word)), ql AS (SELECT DISTINCT tid, line FROM q JOIN said_l ON contains(q.q, word)),
hit AS (SELECT q.tid, a.asset_id, CASE
 WHEN (length(a.asset_id) > 2 AND list_has_all(q.words, {_TOKENS('a.asset_id')})) OR contains(q.q, lower(a.name)) THEN 1
 WHEN EXISTS (SELECT 1 FROM qk WHERE qk.tid = q.tid AND qk.kind = a.kind) AND (NOT EXISTS (SELECT 1 FROM ql WHERE ql.tid = q.tid) OR EXISTS (SELECT 1 FROM ql WHERE ql.tid = q.tid AND (starts_with(a.asset_id, line) OR starts_with(coalesce(a.parent, ''), line)))) THEN 2
 WHEN EXISTS (SELECT 1 FROM ql WHERE ql.tid = q.tid AND ql.line = a.asset_id) THEN 3 END AS tier FROM q, assets a),
link AS (SELECT tid, asset_id FROM (SELECT *, min(tier) OVER (PARTITION BY tid) AS best FROM hit WHERE tier IS NOT NULL) WHERE tier = best)"""


@query(f"WITH {values_sql('assets')}, {_TASKS}, {_SAID_K}, {_SAID_L}, {_LINKS} SELECT t.tid, string_agg(asset_id, ',' ORDER BY asset_id) AS assets FROM tasks t LEFT JOIN link USING (tid) GROUP BY 1")
def p_entity_links(spark, sf_dir):
    """The assets that each of the 35 questions names; null for none."""
    linked = elements.linked_assets(suite.tasks(spark)).groupBy("tid").agg(F.array_join(F.array_sort(F.collect_set("asset_id")), ",").alias("assets"))
    return suite.tasks(spark).select("tid").join(linked, "tid", "left")


@query(f"WITH {_TASKS}, {_CUES}, hit AS (SELECT DISTINCT tid, intent FROM tasks JOIN cues ON contains(lower(question), word)) SELECT t.tid, coalesce(string_agg(intent, ',' ORDER BY intent), '') AS intents FROM tasks t LEFT JOIN hit USING (tid) GROUP BY 1")
def p_intents(spark, sf_dir):
    return suite.tasks(spark).select("tid", F.array_join(F.array_sort(retrieval.intents(F.col("question"))), ",").alias("intents"))


@query(f"""WITH {values_sql('signals', 'assets', 'feeds', 'plant_events', 'recipes', 'interlocks')}, {_TASKS}, {_SAID_K}, {_SAID_L}, {_LINKS},
child AS (SELECT DISTINCT tid, a.asset_id FROM link JOIN assets a ON a.parent = link.asset_id), near AS (SELECT * FROM link UNION SELECT * FROM child),
up AS (SELECT DISTINCT tid, a.parent AS asset_id FROM near JOIN assets a USING (asset_id) WHERE a.parent IS NOT NULL), core AS (SELECT * FROM near UNION SELECT * FROM up),
flow AS (SELECT src, dst FROM feeds UNION SELECT dst, src FROM feeds), fed AS (SELECT tid, dst AS asset_id FROM core JOIN flow ON src = asset_id EXCEPT SELECT * FROM core),
sib AS (SELECT l.tid, b.asset_id FROM link l JOIN assets a USING (asset_id) JOIN assets b ON b.parent = a.parent),
everything AS (SELECT * FROM core UNION SELECT * FROM fed UNION SELECT * FROM sib),
lock AS (SELECT DISTINCT tid, i.id, i.guard_tag FROM everything e JOIN signals s USING (asset_id) JOIN interlocks i ON i.tag = s.tag),
sig AS (SELECT tid, tag AS eid FROM (SELECT * FROM core UNION SELECT * FROM fed) JOIN signals USING (asset_id) UNION SELECT tid, guard_tag FROM lock),
reached AS (SELECT tid, asset_id AS eid FROM everything UNION SELECT * FROM sig UNION SELECT tid, id FROM lock UNION SELECT tid, id FROM everything JOIN plant_events USING (asset_id)
 UNION SELECT tid, r.id FROM (SELECT tid, asset_id AS eid FROM everything UNION SELECT * FROM sig) JOIN recipes r ON starts_with(eid, r.line))
SELECT tid, count(*) AS n, string_agg(eid, ',' ORDER BY eid) AS eids FROM reached GROUP BY 1""")
def p_neighbourhoods(spark, sf_dir):
    """What typed relations reach from the assets of each question."""
    reached = retrieval.expand(checkpointed(elements.linked_assets(suite.tasks(spark))), Plant(spark))
    return reached.groupBy("tid").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("eid")), ",").alias("eids"))


def _published(columns: str, rows: str) -> str:
    """A published table: its figures, not a computation."""
    return f"SELECT * FROM (VALUES {rows}) AS t({columns})"


_3 = lambda *names: [F.round(n, 3).alias(n) for n in names]


@query(_published("cond, n, top1, verifiable, mrr, recall, distractors", "('C0', 19, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0), ('C1', 19, 0.789, 0.0, 0.866, 1.0, 10), ('C2', 19, 0.947, 0.947, 0.974, 1.0, 7), ('C3', 19, 1.0, 1.0, 1.0, 1.0, 4), ('C4', 19, 1.0, 0.842, 1.0, 1.0, 4)"))
def p_grounding(spark, sf_dir):
    """Grounding of the 19 mentions under each condition, as published."""
    rows = grounding.by_condition(questions(spark), Plant(spark), list(elements.conditions().values()), suite.distractors(spark))
    return rows.select("cond", "n", *_3("top1", "verifiable", "mrr", "recall"), "distractors")


def _contexts(spark, keys=("C0", "C1", "C2", "C3", "C4"), budgets=(context.BUDGET,), routed=False) -> DataFrame:
    """cond and sufficiency rows of all tasks; the neighbourhood is found once for all conditions that have one."""
    plant, tasks = Plant(spark), checkpointed(suite.tasks(spark))
    required, near, out = checkpointed(suite.required(plant)), None, []
    for key in keys:
        cond = elements.conditions()[key]
        if key in retrieval.FLAT:
            order = checkpointed(retrieval.lexical_order(tasks, plant, cond, k=retrieval.MAX_ELEMENTS))
        else:
            near = near if near is not None else checkpointed(retrieval.neighbourhood(tasks, plant, routed).where(F.col("pos") <= retrieval.MAX_ELEMENTS))
            order = near.unionByName(checkpointed(retrieval.lexical_order(tasks.join(near, "tid", "left_anti"), plant, cond, k=retrieval.MAX_ELEMENTS)))
        out.append(grounding.answerable(tasks, order, plant, cond, required, budgets).withColumn("cond", F.lit(key)))
    return checkpointed(reduce(DataFrame.unionByName, out))


@query(_published("cond, n, ceiling, coverage", "('C0', 35, 0.0::DOUBLE, 0.1), ('C1', 35, 0.0, 0.252), ('C2', 35, 0.229, 0.549), ('C3', 35, 0.514, 0.761), ('C4', 35, 0.857, 0.857)"))
def p_sufficiency(spark, sf_dir):
    """How far contexts of 6,000 tokens suffice, as published."""
    return context.summary(_contexts(spark), "cond").select("cond", "n", *_3("ceiling", "coverage"))


@query(_published("cond, GRD, UNI, RNG, TOP, PRV, ACT, SAF, REC, ceiling, coverage", "('C3', 1.0::DOUBLE, 1.0::DOUBLE, 0.8, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.543, 0.774), ('C4', 1.0, 0.8, 0.8, 1.0, 1.0, 1.0, 1.0, 1.0, 0.943, 0.959)"))
def p_routing(spark, sf_dir):
    """Sufficiency with routing by intent, by category, as published."""
    rows = _contexts(spark, ("C3", "C4"), routed=True).withColumn("category", F.substring("tid", 1, 3))
    cells = rows.groupBy("cond").pivot("category", list(suite.CATEGORIES)).agg(F.round(F.avg(F.col("sufficient").cast("double")), 3))
    return cells.join(context.summary(rows, "cond").select("cond", *_3("ceiling", "coverage")), "cond")


@query()
def p_budget_sweep(spark, sf_dir):
    """The same under six budgets."""
    return context.summary(_contexts(spark, budgets=context.SWEEP), "cond", "budget").select("cond", "budget", "n", *_3("ceiling", "coverage", "mean_tokens"))


@query(_published("cond, strategy, ceiling, coverage", "('C2', 'lexical', 0.229, 0.549), ('C2', 'oracle_all', 0.314, 0.649), ('C2', 'membership', 0.229, 0.485), ('C4', 'lexical', 0.714, 0.846), ('C4', 'oracle_all', 0.971, 0.995), ('C4', 'membership', 0.457, 0.688), ('C4', 'graph', 0.8, 0.929)"))
def p_crossed_retrieval(spark, sf_dir):
    """Ways of choosing crossed with conditions, audited, at 6,000 tokens (oracle_all: no budget), as published."""
    plant, tasks = Plant(spark), checkpointed(suite.tasks(spark))
    required, out = checkpointed(suite.required(plant)), []
    for key, strategies in (("C2", ("lexical", "oracle_all", "membership")), ("C4", ("lexical", "oracle_all", "membership", "graph"))):
        cond = elements.conditions()[key]
        for strategy in strategies:
            order = checkpointed(retrieval.by_strategy(tasks, plant, cond, strategy))
            rows = grounding.answerable(tasks, order, plant, cond, required, (None,) if strategy == "oracle_all" else (context.BUDGET,), audited=True)
            out.append(rows.select(F.lit(key).alias("cond"), F.lit(strategy).alias("strategy"), "sufficient", "share", "tokens"))
    return context.summary(reduce(DataFrame.unionByName, out), "cond", "strategy").select("cond", "strategy", *_3("ceiling", "coverage"))


# The kinds of facts that go with each capability.
REMOVED = {"units": {"dim", "conv"}, "topology": {"feeds"}, "behaviour": {"state", "legalcmd"}, "constraints": {"interlock"}, "provenance": {"time", "event"}}


@query(_published("removed, ceiling", "('none', 0.8), ('behaviour', 0.629), ('constraints', 0.686), ('provenance', 0.743), ('topology', 0.629), ('units', 0.8)"))
def p_context_ablation(spark, sf_dir):
    """Sufficiency of routed C4 contexts without each capability, in the order of the full condition, as published."""
    plant, tasks, full = Plant(spark), checkpointed(suite.tasks(spark)), elements.conditions()["C4"]
    required, order = checkpointed(suite.required(plant)), checkpointed(retrieval.by_strategy(tasks, plant, full, "graph"))
    out = [grounding.answerable(tasks, order, plant, full.without(REMOVED.get(name, set())), required, audited=True).withColumn("removed", F.lit(name)) for name in ("none", *REMOVED)]
    return context.summary(reduce(DataFrame.unionByName, out), "removed").select("removed", *_3("ceiling"))


@query(_published("scheme, resolver, top1, wrong", ", ".join(f"('{s}', '{r}', {a}::DOUBLE, {b}::DOUBLE)" for s, cells in {
    "mnemonic": (0.79, 0.21, 0.95, 0.05), "opaque": (0.53, 0.47, 0.53, 0.47), "kks": (0.89, 0.11, 0.89, 0.11), "vendor": (0.42, 0.58, 0.42, 0.58), "inconsistent": (0.84, 0.16, 0.63, 0.37)}.items()
    for r, a, b in (("C1", *cells[:2]), ("C1+conv", *cells[2:]), ("C2+conv", 0.95, 0.05), ("C4", 1.0, 0.0)))))
def p_naming_grounding(spark, sf_dir):
    """Grounding under five naming schemes, as published."""
    schemes = {"mnemonic": Plant(spark).signals.select("tag", F.col("tag").alias("new_tag"))}
    for name in ("opaque", "kks", "vendor", "inconsistent"):
        schemes[name] = getattr(plant_queries, f"p_naming_{name}")(spark, sf_dir)
    rows = grounding.by_scheme(questions(spark), Plant(spark), schemes, elements.conditions())
    return rows.select("scheme", "resolver", F.round("top1", 2).alias("top1"), F.round("wrong", 2).alias("wrong"))


@query()
def p_probe_cost(spark, sf_dir):
    """Tokens of eight probes and their results against those of packed C4 contexts."""
    return probes.against_contexts(probes.cost(Plant(spark)), _contexts(spark, ("C4",))).select("tid", "rows", "query_tokens", "result_tokens", "context_tokens", "sufficient", F.round("saving", 1).alias("saving"))
