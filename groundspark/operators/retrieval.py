"""Retrieval over the plant: lexical by condition, and structured by typed relations from the assets that a question names.

Every step is a join of question-wise sets (tid, eid) with the plant's relations, which are small and
broadcast; what is written in one row or ranked in one window is a question's own neighbourhood.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.fixtures import Plant
from groundspark.operators import lexical
from groundspark.operators.elements import Condition, elements, index_text, linked_assets
from groundspark.session import checkpointed

MAX_ELEMENTS = 200
#: Conditions without relations to follow.
FLAT = ("C0", "C1", "C2")
# Words by which a question shows what it is after.
CUES = {
    "behaviour": ["can i", "may i", "is it legal", "allowed", "permitted", "safe", "start", "stop", "reset", "hold", "unhold", "abort", "suspend", "command", "sequence", "state", "change", "write", "set "],
    "constraint": ["safe", "interlock", "protect", "locked", "lock", "may i", "can i", "permitted", "allowed", "while", "guard"],
    "provenance": ["why", "when", "how old", "before", "after", "alarm", "fired", "maintenance", "history", "recent", "last", "quoting", "preced", "root cause"],
    "recipe": ["recipe", "specification", "spec", "batch", "product", "match", "target", "conform", "cola", "lemonade"],
}
# Which of those a kind of element serves; other kinds serve all.
SERVES = {"interlock": ["constraint", "behaviour"], "event": ["provenance"], "product": ["recipe"]}
# What the parts of a mnemonic tag stand for.
GLOSSES = {
    "L1": "line 1 first line",
    "L2": "line 2 second line",
    "UT": "utilities utility",
    "FIL": "filler filling fill",
    "PAS": "pasteuriser pasteurizer tunnel",
    "CAP": "capper crowner capping cap",
    "LAB": "labeller labeler labelling label",
    "CIP": "cip cleaning clean in place",
    "CMP": "compressor compressed air",
    "CHL": "chiller chilled water cooling",
    "PT": "pressure",
    "TT": "temperature",
    "FT": "flow",
    "LT": "level",
    "ST": "speed carousel",
    "TQ": "torque",
    "AT": "analyser concentration ph",
    "JT": "power electrical",
    "VT": "vibration bearing",
    "ZT": "position deviation",
    "PU": "pasteurisation units",
    "CNT": "count reject",
    "KPI": "oee effectiveness",
    "XV": "valve product valve",
    "UNIT": "unit packml",
    "PIC": "pressure setpoint",
    "TIC": "temperature setpoint",
    "LIC": "level setpoint",
    "SIC": "speed setpoint",
    "QIC": "volume setpoint",
    "TQC": "torque setpoint",
    "PV": "measurement reading value",
    "SP": "setpoint target",
    "CMD": "command",
    "STATE": "state",
    "OEE": "overall equipment effectiveness",
}


def intents(question: Column) -> Column:
    """Array of the intents whose cues stand anywhere in a question, also inside words."""
    q = F.lower(question)
    return F.array_compact(F.array(*[F.when(F.exists(F.array(*map(F.lit, cues)), lambda w: F.contains(q, w)), name) for name, cues in CUES.items()]))


def serves(etype: Column, wanted: Column) -> Column:
    """Whether elements of a kind serve one of the intents."""
    return F.coalesce(*[F.when(etype == kind, F.arrays_overlap(F.array(*map(F.lit, of)), wanted)) for kind, of in SERVES.items()], F.lit(True))


def decoded(tag: Column) -> Column:
    """The words that a reader takes from the parts of a tag: by the letters each begins with, or else by the part itself; '' if nothing is known."""
    table = F.create_map(*[F.lit(x) for kv in GLOSSES.items() for x in kv])
    letters = lambda p: F.nullif(F.upper(F.regexp_extract(p, "^([A-Za-z]+)", 1)), F.lit(""))
    gloss = F.transform(F.split(tag, "[_.]"), lambda p: F.coalesce(F.try_element_at(table, F.coalesce(letters(p), F.upper(p))), F.try_element_at(table, F.upper(p))))
    return F.array_join(F.array_compact(gloss), " ")


def expand(seeds: DataFrame, plant: Plant) -> DataFrame:
    """tid, eid, stage: what relations reach from a question's seeds (tid, asset_id); the first stage that reaches an element counts.

    Stages: 0 the seeds, 1 their signals and those of 3 and 2, 2 parents (of seeds and children), 3 children,
    4 what these feed or are fed by, 5 interlocks on the signals of any asset reached, 6 events, 7 products,
    8 siblings of seeds. Signals of 4 and guards of 5 have stage 1. Siblings bring no signals; a guard's own
    interlocks are not followed.
    """
    c = F.col
    own = seeds.select("tid", c("asset_id").alias("eid")).distinct()
    a = F.broadcast(plant.assets.select("asset_id", "parent"))
    s = F.broadcast(plant.signals.select("tag", "asset_id"))
    flows = F.broadcast(plant.feeds.select("src", "dst").unionByName(plant.feeds.select(c("dst").alias("src"), c("src").alias("dst"))))
    children = own.join(a, c("eid") == c("parent")).select("tid", c("asset_id").alias("eid")).distinct()
    near = own.unionByName(children).distinct()
    parents = near.join(a, c("eid") == c("asset_id")).where("parent is not null").select("tid", c("parent").alias("eid")).distinct()
    core = near.unionByName(parents).distinct()
    fed = core.join(flows, c("eid") == c("src")).select("tid", c("dst").alias("eid")).distinct().join(core, ["tid", "eid"], "left_anti")
    above = own.join(a, c("eid") == c("asset_id")).where("parent is not null").select("tid", c("parent").alias("up"))
    siblings = above.join(a, c("up") == c("parent")).select("tid", c("asset_id").alias("eid")).distinct()
    assets = checkpointed(core.unionByName(fed).unionByName(siblings).distinct())
    signals = core.unionByName(fed).join(s, c("eid") == c("asset_id")).select("tid", c("tag").alias("eid"))
    owned = F.broadcast(plant.interlocks.join(s, "tag").select("id", "asset_id", "guard_tag"))
    locks = assets.join(owned, c("eid") == c("asset_id")).select("tid", "id", "guard_tag")
    signals = checkpointed(signals.unionByName(locks.select("tid", c("guard_tag").alias("eid"))).distinct())
    events = assets.join(F.broadcast(plant.plant_events.select("id", "asset_id")), c("eid") == c("asset_id")).select("tid", c("id").alias("eid"))
    seen = assets.unionByName(signals)
    products = seen.join(F.broadcast(plant.recipes.select("id", "line")), F.startswith(c("eid"), c("line"))).select("tid", c("id").alias("eid"))
    stages = [own, signals, parents, children, fed, locks.select("tid", c("id").alias("eid")), events, products, siblings]
    every = reduce(DataFrame.unionByName, [x.select("tid", "eid", F.lit(k).alias("stage")) for k, x in enumerate(stages)])
    return every.groupBy("tid", "eid").agg(F.min("stage").alias("stage"))


def reranked(reached: DataFrame, seeds: DataFrame, questions: DataFrame, plant: Plant, routed: bool) -> DataFrame:
    """tid, eid, pos (from 1): the neighbourhood in the order in which a budget buys the most of it.

    The seeds, then other assets, then constraints, events and recipes (routed: those that the question has
    a reason for) with the signals that they name, then the seeds' signals, then what was put off, then
    other signals, those of the seeds and their children first. Within each by likeness to the question.
    """
    c = F.col
    e = F.broadcast(elements(plant).select("eid", "etype", "ord", "owner", "own_text"))
    q = questions.select("tid", "question", intents(c("question")).alias("wanted") if routed else F.array(*map(F.lit, CUES)).alias("wanted"))
    seed = seeds.select(c("tid").alias("asker"), c("asset_id").alias("seed"), "place")
    rows = reached.select("tid", "eid").join(e, "eid").join(F.broadcast(q.select("tid", "wanted")), "tid")
    # An anchor is a seed or a seed's signal.
    rows = rows.withColumn("of", F.when(c("etype") == "asset", c("eid")).when(c("etype") == "signal", c("owner")))
    rows = checkpointed(rows.join(seed, (c("tid") == c("asker")) & (c("of") == c("seed")), "left").drop("asker"))
    rest = rows.where("place is null")
    counts = lexical.term_counts(elements(plant), "eid", "own_text")
    scores = lexical.rank_within(rest.select("tid", "eid"), counts, lexical.term_counts(q, "tid", "question"), "tid", "eid")
    child = seed.join(F.broadcast(plant.assets.select("asset_id", "parent")), c("seed") == c("parent")).select(c("asker").alias("tid"), c("asset_id").alias("owner")).distinct().withColumn("scoped", F.lit(True))
    rows = rows.join(scores, ["tid", "eid"], "left").join(child, ["tid", "owner"], "left")
    anchor, asset, signal = c("place").isNotNull(), c("etype") == "asset", c("etype") == "signal"
    group = F.when(anchor & asset, 1).when(asset, 2).when(anchor, 4).when(signal, 6).when(serves(c("etype"), c("wanted")), 3).otherwise(5)
    score = F.when(anchor, 0.0).otherwise(-F.coalesce("score", F.lit(0.0)))
    far = F.when(signal & ~anchor & c("scoped").isNull(), 1).otherwise(0)
    tie = F.when(anchor, F.lpad((c("place") * 100000 + c("ord")).cast("string"), 18, "0")).otherwise(c("eid"))
    keyed = rows.select("tid", "eid", F.struct(group.alias("g"), far.alias("far"), score.alias("score"), tie.alias("tie"), F.lit(0).alias("sub")).alias("key"))
    named = plant.interlocks.select(c("id").alias("eid"), F.explode(F.array(F.struct(F.lit(1).alias("sub"), c("tag").alias("also")), F.struct(F.lit(2).alias("sub"), c("guard_tag").alias("also")))).alias("n"))
    closure = keyed.join(F.broadcast(named), "eid").select("tid", c("n.also").alias("eid"), F.struct("key.g", "key.far", "key.score", "key.tie", c("n.sub").alias("sub")).alias("key"))
    closure = closure.join(reached.select("tid", "eid"), ["tid", "eid"], "left_semi")
    first = keyed.unionByName(closure).groupBy("tid", "eid").agg(F.min("key").alias("key"))
    return first.select("tid", "eid", F.row_number().over(Window.partitionBy("tid").orderBy("key")).alias("pos"))


def lexical_order(questions: DataFrame, plant: Plant, cond: Condition, decode: bool = False, k: int = 1000) -> DataFrame:
    """tid, eid, pos: elements by likeness of what the condition lets a search see; decode: and of what tags say by convention."""
    index = index_text(plant, cond)
    if decode:
        index = index.withColumn("text", F.when(F.col("etype") == "signal", F.concat_ws(" ", "text", decoded(F.col("eid")))).otherwise(F.col("text")))
    return lexical.rank(index, "eid", "text", questions, "tid", "question", k).select("tid", "eid", F.col("rank").alias("pos"))


def neighbourhood(questions: DataFrame, plant: Plant, routed: bool = False) -> DataFrame:
    """tid, eid, pos of the questions that name an asset."""
    seeds = checkpointed(linked_assets(questions, plant))
    return reranked(checkpointed(expand(seeds, plant)), seeds, questions, plant, routed)


def retrieve(questions: DataFrame, plant: Plant, cond: Condition, routed: bool = False, most: int = MAX_ELEMENTS) -> DataFrame:
    """tid, eid, pos: lexical without relations; with them the neighbourhood, or lexical for questions that name no asset."""
    if cond.key in FLAT:
        return lexical_order(questions, plant, cond, k=most)
    found = checkpointed(neighbourhood(questions, plant, routed).where(F.col("pos") <= most))
    return found.unionByName(lexical_order(questions.join(found, "tid", "left_anti"), plant, cond, k=most))


def candidate_signals(questions: DataFrame, plant: Plant, cond: Condition, k: int = 5, decode: bool = False) -> DataFrame:
    """tid, eid, pos: the k signals that a mention may mean; with relations the neighbourhood's, by likeness among themselves."""
    signals = F.broadcast(elements(plant).where("etype = 'signal'").select("eid"))

    def lexically(asked: DataFrame) -> DataFrame:
        return lexical_order(asked, plant, cond, decode).join(signals, "eid", "left_semi")

    if cond.key in FLAT:
        found = lexically(questions)
    else:
        reached = checkpointed(expand(linked_assets(questions, plant), plant).join(signals, "eid", "left_semi").select("tid", "eid"))
        counts = lexical.term_counts(index_text(plant, cond), "eid", "text")
        scores = lexical.rank_within(reached, counts, lexical.term_counts(questions, "tid", "question"), "tid", "eid")
        ranked = scores.select("tid", "eid", F.row_number().over(Window.partitionBy("tid").orderBy(F.desc("score"), "eid")).alias("pos"))
        found = ranked.unionByName(lexically(questions.join(reached, "tid", "left_anti")).select("tid", "eid", "pos"))
    placed = found.select("tid", "eid", F.row_number().over(Window.partitionBy("tid").orderBy("pos")).alias("pos"))
    return placed.where(F.col("pos") <= k)


def by_strategy(questions: DataFrame, plant: Plant, cond: Condition, strategy: str) -> DataFrame:
    """tid, eid, pos by one way of choosing, whatever the condition: lexical, oracle_all, membership or graph."""
    if strategy == "lexical":
        return lexical_order(questions, plant, cond)
    if strategy == "graph":
        return retrieve(questions, plant, cond, routed=True)
    every = elements(plant).select("eid", "ord", "owner", "etype")
    if strategy == "oracle_all":
        placed = every.select("eid", F.row_number().over(Window.orderBy("ord")).alias("pos"))  # the plant's elements
        return questions.select("tid").join(F.broadcast(placed), F.lit(True))
    if strategy != "membership":
        raise ValueError(f"unknown strategy {strategy}")
    seeds = checkpointed(linked_assets(questions, plant).select("tid", "asset_id"))
    mine = seeds.join(F.broadcast(every), (F.col("eid") == F.col("asset_id")) | (F.col("owner") == F.col("asset_id"))).select("tid", "eid", "ord").distinct()
    ranked = checkpointed(lexical_order(questions, plant, cond))
    # What a search does not find follows in the plant's order.
    joined = mine.join(ranked, ["tid", "eid"], "left")
    order = Window.partitionBy("tid").orderBy(F.col("pos").isNull(), "pos", "ord")
    chosen = joined.select("tid", "eid", F.row_number().over(order).alias("pos"))
    return chosen.unionByName(ranked.join(seeds, "tid", "left_anti"))
