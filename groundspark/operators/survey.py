"""The survey's steps after harvest: works, screening, candidates, sheets for coders, and the flow of counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.operators import linkage
from groundspark.operators.joins import small

# Topics of related surveys, what makes a title a survey, and the columns of the sheets.
TOPICS = {
    "llm_agents": r"large language model|\bllms?\b|agentic|\bagents?\b|generative ai",
    "knowledge_graphs": r"knowledge graph|ontolog|semantic web",
    "information_models": r"opc[ -]?ua|asset administration shell|automationml|information model|digital twin",
    "interoperability": r"interoperab|semantic",
    "validation_safety": r"validat|verif|guardrail|safety|trustworth|constraint",
    "industrial": r"industr|manufactur|automation|cyber-physical|production|\bplc",
}
SURVEY_WORD = r"\b(survey|review|overview|state[- ]of[- ]the[- ]art)\b"
RELATED = "R1_related_surveys"
HUMAN = ["r1_decision", "r1_reason", "r2_decision", "r2_reason", "final_decision", "final_reason", "notes", "retrieved", "quality_q1", "quality_q2", "quality_q3", "quality_q4", "quality_q5"]
TITLE_ABSTRACT = ["record_id", "title", "year", "venue", "doi", "peer_reviewed", "sources", "query_families", "abstract", "double_code", "r1_decision", "r1_reason", "r2_decision", "r2_reason", "final_decision", "final_reason", "notes"]
FULL_TEXT = ["record_id", "title", "year", "venue", "doi", "peer_reviewed", "double_code", "retrieved", "r1_decision", "r1_reason", "r2_decision", "r2_reason", "final_decision", "final_reason", "quality_q1", "quality_q2", "quality_q3", "quality_q4", "quality_q5", "notes"]
ABSTRACT_CHARS = 3000


def _matches(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False))


def candidates(works: DataFrame) -> DataFrame:
    """Works found by the family of related surveys, or with a survey's word in the title."""
    return works.where(F.array_contains("query_families", RELATED) | _matches(F.col("title"), SURVEY_WORD))


def shortlist(works: DataFrame) -> DataFrame:
    """Industrial surveys among the candidates: topic_overlap, a flag a topic, year, peer_reviewed, retracted, doi, title, venue; most topics first, then reviewed ones, then the newest."""
    body = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")))
    flags = {name: _matches(body, pattern) for name, pattern in TOPICS.items()}
    rows = works.withColumns(flags).where(F.col("industrial") & _matches(F.col("title"), SURVEY_WORD))
    overlap = sum((F.col(x).cast("int") for x in TOPICS), F.lit(0))
    out = rows.select(overlap.alias("topic_overlap"), *TOPICS, "year", "peer_reviewed", F.when(F.contains(F.lower("title"), F.lit("retracted")), "yes").otherwise("").alias("retracted"), F.coalesce("doi", F.lit("")).alias("doi"), "title", F.coalesce("venue", F.lit("")).alias("venue"))
    return out.orderBy(F.desc("topic_overlap"), F.col("peer_reviewed") != "yes", F.desc(F.coalesce("year", F.lit(0))), "title")


def family_of(files: DataFrame, families: list[str]) -> DataFrame:
    """files (name) with family: the first whose code stands in the name between separators; null if none does."""
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    found = [F.when(_matches(stem, rf"(^|[_\-. ]){re.escape(f.split('_')[0])}([_\-. ]|$)"), f) for f in families]
    return files.withColumn("family", F.coalesce(*found, F.lit(None).cast("string")))


def sampled(rows: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """key of a share of the rows (rounded half to even), drawn by a hash of key and seed, the same in each run."""
    n = round(rows.count() * fraction)
    return rows.select(key).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def _sheet(rows: DataFrame, columns: list[str], double: DataFrame, old: DataFrame | None) -> DataFrame:
    marked = rows.join(small(double.withColumn("double_code", F.lit("yes"))), "record_id", "left").withColumn("double_code", F.coalesce("double_code", F.lit("no")))
    sheet = marked.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in marked.columns else F.lit("").alias(c) for c in columns])
    return sheet if old is None else linkage.kept_decisions(sheet, old, "record_id", [c for c in HUMAN if c in columns])


def title_abstract_sheet(works: DataFrame, fraction: float, seed: int, old: DataFrame | None = None) -> DataFrame:
    """A row a work for two coders; decisions of an older sheet stay."""
    rows = works.select("record_id", "title", "year", "venue", "doi", "peer_reviewed", F.array_join("sources", ";").alias("sources"), F.array_join("query_families", ";").alias("query_families"), F.substring("abstract", 1, ABSTRACT_CHARS).alias("abstract"))
    return _sheet(rows, TITLE_ABSTRACT, sampled(rows, "record_id", fraction, seed), old)


def full_text_sheet(title_abstract: DataFrame, fraction: float, seed: int, old: DataFrame | None = None) -> DataFrame:
    """A row a work that title and abstract did not exclude; its decisions begin anew."""
    rows = title_abstract.where("final_decision in ('include', 'maybe')")
    carried = rows.select([c for c in FULL_TEXT if c in rows.columns and c not in HUMAN and c != "double_code"] + (["notes"] if "notes" in rows.columns else []))
    return _sheet(carried, FULL_TEXT, sampled(carried, "record_id", fraction, seed + 1), old)


def flow(identified: DataFrame, title_abstract: DataFrame, full_text: DataFrame, automation_excluded: int = 0) -> dict:
    """Counts of the flow from records to included works; raises where decisions do not add up. identified: source, n."""
    c = F.col
    by_source = {r["source"]: r["n"] for r in identified.orderBy("source").collect()}  # a row a source
    decided = F.coalesce(F.nullif("final_decision", F.lit("")), F.lit("pending"))
    is_ = lambda *names: F.count_if(decided.isin(*names))
    ta = title_abstract.agg(F.count("*").alias("screened"), is_("exclude").alias("ta_excluded"), is_("pending").alias("ta_pending"), is_("include", "maybe").alias("ft_sought")).first()
    got = F.coalesce(c("retrieved") != "no", F.lit(True))
    rows = full_text.where(got)
    ft = rows.agg(F.count("*").alias("ft_assessed"), is_("exclude").alias("ft_excluded"), is_("pending", "maybe").alias("ft_pending"), is_("include").alias("included")).first()
    reasons = rows.where(c("final_decision") == "exclude").groupBy(F.coalesce(F.nullif("final_reason", F.lit("")), F.lit("unspecified")).alias("reason")).count().orderBy("reason").collect()
    total = sum(by_source.values())
    lost = full_text.where(~got).count()
    out = {"identified_by_source": by_source, "identified": total, "duplicates_removed": total - ta["screened"] - automation_excluded, "automation_excluded": automation_excluded, **ta.asDict(), "ft_not_retrieved": lost, **ft.asDict(), "ft_excluded_by_reason": {r["reason"]: r["count"] for r in reasons}}
    out["complete"] = not out["ta_pending"] and not out["ft_pending"] and out["screened"] > 0 and out["ft_assessed"] + lost == out["ft_sought"]
    if out["duplicates_removed"] < 0:
        raise ValueError("the sheet has more rows than there are records")
    if out["screened"] != out["ta_excluded"] + out["ta_pending"] + out["ft_sought"]:
        raise ValueError("decisions on titles and abstracts do not add up")
    if out["ft_assessed"] != out["ft_excluded"] + out["ft_pending"] + out["included"]:
        raise ValueError("decisions on full texts do not add up")
    return out


def flow_diagram(counts: dict) -> str:
    """The counts as a flow chart in Mermaid."""
    side = ", ".join(f"{k} {v}" for k, v in counts["identified_by_source"].items())
    reasons = "; ".join(f"{k} {v}" for k, v in counts["ft_excluded_by_reason"].items()) or "none"
    return "\n".join(
        [
            "flowchart TD",
            f'  identified["Records identified: {counts["identified"]} ({side})"] --> screened["Screened: {counts["screened"]}"]',
            f'  identified --> duplicates["Duplicates removed: {counts["duplicates_removed"]}; excluded by rules: {counts["automation_excluded"]}"]',
            f'  screened --> sought["Full texts sought: {counts["ft_sought"]}; not retrieved: {counts["ft_not_retrieved"]}"]',
            f'  screened --> excluded["Excluded: {counts["ta_excluded"]}; pending: {counts["ta_pending"]}"]',
            f'  sought --> included["Included: {counts["included"]}; pending: {counts["ft_pending"]}"]',
            f'  sought --> rejected["Excluded on full text: {counts["ft_excluded"]} ({reasons})"]',
        ]
    )


def agreement(codes: DataFrame, first: str, second: str) -> DataFrame:
    """One row: n, agreement (share of equal codes among pairs without a null; null without pairs)."""
    pairs = codes.where(F.col(first).isNotNull() & F.col(second).isNotNull())
    return pairs.agg(F.count("*").alias("n"), F.avg((F.col(first) == F.col(second)).cast("double")).alias("agreement"))


def disagreements(codes: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """key and both codes where they differ and neither is null."""
    return codes.where(F.col(first) != F.col(second)).select(key, first, second)


def run(records: DataFrame, rules: dict[str, str], fraction: float, seed: int, old: DataFrame | None = None) -> dict[str, DataFrame]:
    """All steps from records to the first sheet: works, uncertain, excluded, kept, candidates, shortlist, sheet, identified."""
    works = linkage.merged(records)
    judged = linkage.screened(works, rules)
    kept = judged.where("reason is null").drop("reason")
    found = candidates(kept)
    return {
        "works": works, "uncertain": linkage.uncertain(works), "excluded": judged.where("reason is not null"), "kept": kept, "candidates": found, "shortlist": shortlist(found),
        "sheet": title_abstract_sheet(kept, fraction, seed, old), "identified": records.groupBy("source").agg(F.count("*").alias("n")),
    }
