"""Scores of what searches and contexts make of questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundspark.fixtures import Plant
from groundspark.functions import stats
from groundspark.operators import context, lexical, retrieval
from groundspark.operators.elements import Condition, elements, index_text, linked_assets
from groundspark.session import checkpointed


def ranks(asked: DataFrame, candidates: DataFrame, distractors: DataFrame | None = None) -> DataFrame:
    """tid, rank of the gold signal among the candidates (null if it is none), top1, distractors (how many of them are candidates).

    asked: tid, gold_tag; candidates: tid, eid, pos; distractors: tid, tag.
    """
    c = F.col
    hit = candidates.join(asked.select("tid", c("gold_tag").alias("eid")), ["tid", "eid"]).select("tid", c("pos").alias("rank"))
    out = asked.select("tid").join(hit, "tid", "left")
    if distractors is None:
        near = candidates.limit(0).select("tid", F.lit(0).alias("near"))
    else:
        near = candidates.join(distractors.select("tid", c("tag").alias("eid")), ["tid", "eid"]).groupBy("tid").agg(F.count("*").cast("int").alias("near"))
    return out.join(near, "tid", "left").select("tid", "rank", F.coalesce(c("rank") == 1, F.lit(False)).alias("top1"), F.coalesce("near", F.lit(0)).alias("distractors"))


def rank_scores(rows: DataFrame, *by: str) -> DataFrame:
    """by..., n, top1, mrr, recall, distractors of rows (rank, top1, distractors)."""
    share = lambda x: F.avg(x.cast("double"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), share(F.col("top1")).alias("top1"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), share(F.col("rank").isNotNull()).alias("recall"), F.sum("distractors").alias("distractors"))


def answerable(questions: DataFrame, ordered: DataFrame, plant: Plant, cond: Condition, required: DataFrame, budgets: tuple[int | None, ...] = (context.BUDGET,), audited: bool = False) -> DataFrame:
    """Sufficiency rows of the contexts that an order gives under each budget."""
    packed = checkpointed(context.packed(questions, ordered, plant, cond, budgets))
    return context.sufficiency(packed, context.stated(packed, plant, cond, audited), required)


def membership(questions: DataFrame, ordered: DataFrame, plant: Plant, cond: Condition) -> DataFrame:
    """tid: questions whose context states which asset the gold signal belongs to."""
    packed = checkpointed(context.packed(questions, ordered, plant, cond))
    owner = plant.signals.select(F.col("tag").alias("gold_tag"), "asset_id")
    claim = questions.join(F.broadcast(owner), "gold_tag").select("tid", F.concat(F.lit("sig_of:"), "gold_tag", F.lit("|"), "asset_id").alias("fact"))
    return claim.join(context.stated(packed, plant, cond), ["tid", "fact"], "left_semi").select("tid")


def by_condition(questions: DataFrame, plant: Plant, conds: list[Condition], distractors: DataFrame) -> DataFrame:
    """cond, n, top1, verifiable, mrr, recall, distractors of questions with a gold signal; verifiable: right, and its context proves the signal's asset."""
    asked = questions.where("gold_tag is not null")
    near = checkpointed(retrieval.neighbourhood(asked, plant))
    out = []
    for cond in conds:
        found = checkpointed(retrieval.candidate_signals(asked, plant, cond))
        order = retrieval.lexical_order(asked, plant, cond, k=retrieval.MAX_ELEMENTS) if cond.key in retrieval.FLAT else near
        proven = membership(asked, checkpointed(order), plant, cond).withColumn("proven", F.lit(True))
        rows = ranks(asked, found, distractors).join(proven, "tid", "left").withColumn("ok", F.col("top1") & F.col("proven").isNotNull())
        scores = rank_scores(rows)
        out.append(scores.join(rows.agg(F.avg(F.col("ok").cast("double")).alias("verifiable")), F.lit(True)).withColumn("cond", F.lit(cond.key)))
    return reduce(DataFrame.unionByName, out)


#: A resolver: its name, its condition, and whether it decodes tags.
RESOLVERS = (("C1", "C1", False), ("C1+conv", "C1", True), ("C2+conv", "C2", True), ("C4", "C4", False))


def renamed(plant: Plant, tags: DataFrame) -> Plant:
    """The plant under other names (tag, new_tag): signals and interlocks; nodes, descriptions and relations stay."""
    c = F.col
    node = F.concat(F.lit("ns=3;s="), F.replace("tag", F.lit("_"), F.lit(".")))
    signals = plant.signals.withColumn("node_id", node).join(F.broadcast(tags), "tag").withColumn("tag", c("new_tag")).drop("new_tag")
    guard = tags.select(c("tag").alias("guard_tag"), c("new_tag").alias("new_guard"))
    locks = plant.interlocks.join(F.broadcast(tags), "tag").join(F.broadcast(guard), "guard_tag")
    locks = locks.withColumns({"tag": c("new_tag"), "guard_tag": c("new_guard")}).drop("new_tag", "new_guard").select(plant.interlocks.columns)
    return Plant(plant.spark, **{**plant._replaced, "signals": signals, "interlocks": locks})


def by_scheme(questions: DataFrame, plant: Plant, schemes: dict[str, DataFrame], conds: dict[str, Condition]) -> DataFrame:
    """scheme, resolver, n, top1, low, high, mrr, wrong (something is found, and it is not the gold signal): grounding under naming schemes.

    schemes: name -> tag, new_tag. Every scheme's questions are ranked within that scheme's own corpus, all
    schemes at once. What relations reach does not depend on names, so it is found once.
    """
    c = F.col
    asked = checkpointed(questions.where("gold_tag is not null").select("tid", "question", "gold_tag"))
    reached = checkpointed(retrieval.expand(linked_assets(asked, plant), plant).join(elements(plant).where("etype = 'signal'").select("eid"), "eid", "left_semi").select("tid", "eid"))
    key = lambda scheme, x: F.concat(F.lit(f"{scheme} "), x)
    tags = checkpointed(reduce(DataFrame.unionByName, [checkpointed(t.select(F.lit(name).alias("scheme"), "tag", "new_tag")) for name, t in schemes.items()]))
    every = asked.join(F.broadcast(tags.withColumnRenamed("tag", "gold_tag")), "gold_tag").select("scheme", "tid", F.concat("scheme", F.lit(" "), "tid").alias("asker"), "question", F.concat("scheme", F.lit(" "), "new_tag").alias("gold"))
    every = checkpointed(every)
    terms = checkpointed(lexical.term_counts(every, "asker", "question"))
    out = []
    for resolver, cond_key, decode in RESOLVERS:
        cond, indexes = conds[cond_key], []
        for name in schemes:
            index = index_text(renamed(plant, tags.where(c("scheme") == name).select("tag", "new_tag")), cond)
            text = F.when(c("etype") == "signal", F.concat_ws(" ", "text", retrieval.decoded(c("eid")))).otherwise(c("text")) if decode else c("text")
            indexes.append(checkpointed(index.select(F.lit(name).alias("scheme"), key(name, c("eid")).alias("eid"), "etype", text.alias("text"))))
        index = reduce(DataFrame.unionByName, indexes)
        if cond.key in retrieval.FLAT:
            members = every.select("asker", "scheme").join(F.broadcast(index.select("scheme", "eid")), "scheme").select("asker", "eid")
        else:
            members = reached.join(F.broadcast(tags.withColumnRenamed("tag", "eid")), "eid").select(F.concat("scheme", F.lit(" "), "tid").alias("asker"), F.concat("scheme", F.lit(" "), "new_tag").alias("eid"))
        scores = checkpointed(lexical.rank_within(members, checkpointed(lexical.term_counts(index, "eid", "text")), terms, "asker", "eid"))
        signals = scores.join(F.broadcast(index.where("etype = 'signal'").select("eid")), "eid", "left_semi")
        order = Window.partitionBy("asker").orderBy(F.desc("score"), "eid")
        top = checkpointed(signals.withColumn("pos", F.row_number().over(order)).where("pos <= 5"))
        gold = top.join(every.select("asker", c("gold").alias("eid")), ["asker", "eid"]).select("asker", c("pos").alias("rank"))
        rows = every.join(gold, "asker", "left").join(top.groupBy("asker").agg(F.count("*").alias("found")), "asker", "left")
        right = F.coalesce(c("rank") == 1, F.lit(False))
        n = rows.groupBy("scheme").agg(F.count("*").alias("n"), F.count_if(right).alias("hits"), F.avg(F.coalesce(1.0 / c("rank"), F.lit(0.0))).alias("mrr"), F.avg((~right & c("found").isNotNull()).cast("double")).alias("wrong"))
        low, high = stats.wilson(c("hits"), c("n"))
        out.append(checkpointed(n).select("scheme", F.lit(resolver).alias("resolver"), "n", (c("hits") / c("n")).alias("top1"), low.alias("low"), high.alias("high"), "mrr", "wrong"))
    return reduce(DataFrame.unionByName, out)


def spread(scores: DataFrame) -> DataFrame:
    """resolver, worst, best, spread of its top-1 share over the schemes."""
    return scores.groupBy("resolver").agg(F.min("top1").alias("worst"), F.max("top1").alias("best"), (F.max("top1") - F.min("top1")).alias("spread"))
