"""Answers of a model over packed contexts, their aggregates, and audits of archived results."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.operators import grade, interchange

RULE = "-" * 60
ANSWER_CHARS = 500
#: Criteria that together make a technology cover units, behaviour and constraints.
COVERED = ("U3", "U5", "U6")


def prompt(label: Column, tokens: Column, text: Column, question: Column) -> Column:
    """What a model is asked: the context between rules, then the question."""
    return F.concat(F.lit("CONTEXT ("), label, F.lit(", "), tokens.cast("string"), F.lit(f" tokens)\n{RULE}\n"), text, F.lit(f"\n{RULE}\n\nQUESTION: "), question, F.lit("\nANSWER:"))


def completed(prompts: DataFrame, complete: Callable[[str], str]) -> DataFrame:
    """prompts with answer: what a backend says to each prompt. complete is any function of a prompt; there is no network here.

    An answer that a backend fails to give is `error: ` and why.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for p in pdf["prompt"]:
                try:
                    out.append(complete(p))
                except Exception as error:  # a backend's failure is its answer
                    out.append(f"error: {error}")
            yield pdf.assign(answer=pd.Series(out, dtype="object", index=pdf.index))

    return prompts.mapInPandas(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in prompts.schema.fields)}, answer string")


def mock_answers(contexts: DataFrame, tasks: DataFrame) -> DataFrame:
    """Sufficiency rows (tid, tokens, sufficient, missing, ...) with answer and gold: gold where the context suffices, else what it lacks."""
    none = F.array().cast("array<string>")
    joined = contexts.join(tasks.select("tid", "category", "gold"), "tid")
    return joined.withColumn("answer", grade.mock_answer(F.col("missing"), none, F.col("gold")))


def graded(answers: DataFrame) -> DataFrame:
    """answers (answer, gold) with grade, refused, and the answer cut."""
    rows = answers.withColumn("grade", grade.grade(F.col("answer"), F.col("gold")))
    return rows.withColumns({"refused": F.col("grade") == "refused", "answer": F.substring(F.trim("answer"), 1, ANSWER_CHARS)})


def answer_scores(rows: DataFrame, *by: str) -> DataFrame:
    """by..., n, accuracy, refusal, right_when_sufficient, invented (neither refused nor right, of those without a sufficient context); null without such rows."""
    c = F.col
    right = c("grade") == "correct"
    share = lambda x: F.avg(x.cast("double"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), share(right).alias("accuracy"), share(c("grade") == "refused").alias("refusal"), share(F.when(c("sufficient"), right)).alias("right_when_sufficient"), share(F.when(~c("sufficient"), ~c("grade").isin("refused", "correct"))).alias("invented"))


def with_ceilings(scores: DataFrame, ceilings: DataFrame) -> DataFrame:
    """scores (cond) with ceiling; null where there is none."""
    return scores.join(F.broadcast(ceilings.select("cond", "ceiling")), "cond", "left")


def archive_audit(reported: DataFrame, rows: DataFrame) -> DataFrame:
    """cond, reported_n, raw_n, matches: numbers of rows that an archive reports (cond, n) against those it holds (cond)."""
    held = rows.groupBy("cond").agg(F.count("*").alias("raw"))
    joined = reported.select("cond", F.col("n").alias("reported_n")).join(held, "cond", "left").withColumn("raw_n", F.coalesce("raw", F.lit(0)))
    return joined.select("cond", "reported_n", "raw_n", (F.col("reported_n") == F.col("raw_n")).alias("matches"))


def first_class(scores: DataFrame, criteria: list[str]) -> DataFrame:
    """criterion, n: technologies with the full score of 3 in each criterion (columns of scores)."""
    long = scores.select(F.explode(F.array(*[F.struct(F.lit(k).alias("criterion"), F.col(k).cast("int").alias("v")) for k in criteria])).alias("x")).select("x.*")
    return long.groupBy("criterion").agg(F.count_if(F.col("v") == 3).alias("n"))


def covering(scores: DataFrame) -> DataFrame:
    """One row: strong (2 or more in all of COVERED) and full (3 in all) technologies, in order."""
    values = F.array(*[F.col(k).cast("int") for k in COVERED])
    of = lambda least: F.array_sort(F.collect_list(F.when(F.forall(values, lambda v: v >= least), F.col("technology"))))
    return scores.agg(of(2).alias("strong"), of(3).alias("full"))


def export(spark: SparkSession, folder: str) -> DataFrame:
    """Writes the plant in each format to folder/<format>; returns format, bytes, tokens, ratio."""
    texts = interchange.documents(spark)
    for name, df in texts.items():
        df.write.text(f"{folder}/{name}", lineSep="\n")
    return interchange.sizes(texts)
