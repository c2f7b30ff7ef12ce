"""TF-IDF retrieval: weights relative to a corpus, cosine ranking, greedy packing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.functions.text import search_tokens
from groundspark.operators.fold import fold
from groundspark.operators.joins import HOT, SMALL, small
from groundspark.session import checkpointed, stored


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.explode(search_tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def _counted_in_place(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term_counts of keys that come once each: terms in order and where each one's run begins, in the row itself.

    Arrays go through explode, of one each, so that they are made once and not anew for each place of a lambda.
    """
    run = F.expr("filter(sequence(0, size(terms) - 1), i -> i = 0 or terms[i] <> terms[i - 1])")
    rows = docs.select(key, F.explode(F.array(F.sort_array(search_tokens(F.col(text))))).alias("terms")).where("size(terms) > 0")
    rows = rows.select(key, "terms", F.explode(F.array(run)).alias("at"))
    found = F.expr("transform(at, (i, k) -> struct(terms[i] as term, bigint(coalesce(get(at, k + 1), size(terms)) - i) as n))")
    return rows.select(key, F.explode(found).alias("t")).select(key, "t.*")


def document_frequency(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count("*").alias("df"))


def _tf() -> Column:
    return 1 + F.log("n")


def _idf() -> Column:
    return F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1


def rank(docs: DataFrame, doc_key: str, doc_text: str, queries: DataFrame, query_key: str, query_text: str, k: int) -> DataFrame:
    """query, document, score, rank: the k documents of highest cosine, above 0, ties by document.

    A document's terms are counted where it lies, anew for each use, so that no table of all terms of all documents is
    moved or kept; only rows of a key that comes again are brought together. If there are more than SMALL terms, those of more
    than a HOTth of all places are broadcast, and the others meet their frequency by a shuffle. A document's squares
    and products are summed before they move.
    """
    again = docs.groupBy(F.col(doc_key).alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again")
    again, comes_again = small(checkpointed(again)), F.col(doc_key).eqNullSafe(F.col("again"))
    once, more = (docs.select(doc_key, doc_text).join(again, comes_again, how) for how in ("left_anti", "left_semi"))
    counts = _counted_in_place(once, doc_key, doc_text).unionByName(term_counts(more, doc_key, doc_text))
    asked = term_counts(queries, query_key, query_text)
    n_docs = docs.agg(F.count("*").alias("n_docs"))
    frequency = stored(document_frequency(counts).join(F.broadcast(n_docs), F.lit(True)))
    wq = asked.join(frequency, "term", "left").withColumn("rq", _tf() * F.coalesce(_idf(), F.lit(1.0)))
    wq = wq.withColumn("nq", F.sqrt(F.sum(F.col("rq") * F.col("rq")).over(Window.partitionBy(query_key)))).select(query_key, "term", "df", "n_docs", (F.col("rq") / F.col("nq")).alias("wq"))
    wq = small(checkpointed(wq.where("df is not null")))
    terms, total = frequency.agg(F.count("*"), F.sum("df")).first()
    parts = [F.broadcast(frequency)] if terms <= SMALL else [F.broadcast(frequency.where(F.col("df") > total / HOT)), frequency.where(F.col("df") <= total / HOT)]
    squares = [counts.join(part, "term").groupBy(doc_key).agg(F.sum(F.pow(_tf() * _idf(), F.lit(2))).alias("square")) for part in parts]
    norms = reduce(DataFrame.unionByName, squares).groupBy(doc_key).agg(F.sqrt(F.sum("square")).alias("norm"))
    # Places of asked terms move to their document before they meet the queries, so that products, which are many times more, need not move.
    parallel = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = counts.join(small(wq.select("term").distinct()), "term", "left_semi").repartition(parallel, doc_key)
    dots = places.join(wq, "term").groupBy(query_key, doc_key).agg(F.sum(_tf() * _idf() * F.col("wq")).alias("dot"))
    scored = dots.join(norms, doc_key).withColumn("score", F.round(F.col("dot") / F.col("norm"), 9)).where("score > 0")
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), doc_key)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query_key, doc_key, "score", "rank")


def rank_within(members: DataFrame, counts: DataFrame, asked: DataFrame, query_key: str, doc_key: str) -> DataFrame:
    """query, document, score (above 0): cosine of each query with the documents of a corpus of its own.

    members: query and document; counts: document, term, n; asked: query, term, n. Weights are relative to
    each query's corpus, so a corpus is a neighbourhood of some hundred documents, not a table.
    """
    members = checkpointed(members)  # small, and asked again and again
    n_docs = members.groupBy(query_key).agg(F.count("*").alias("n_docs"))
    rows = members.join(counts, doc_key).join(n_docs, query_key)
    rows = rows.withColumn("df", F.count("*").over(Window.partitionBy(query_key, "term"))).withColumn("r", _tf() * _idf())
    rows = checkpointed(rows.withColumn("norm", F.sqrt(F.sum(F.col("r") * F.col("r")).over(Window.partitionBy(query_key, doc_key)))))
    frequency = rows.select(query_key, "term", "df", "n_docs").distinct()
    wq = asked.join(frequency, [query_key, "term"], "left").withColumn("rq", _tf() * F.coalesce(_idf(), F.lit(1.0)))
    wq = wq.withColumn("nq", F.sqrt(F.sum(F.col("rq") * F.col("rq")).over(Window.partitionBy(query_key)))).select(query_key, "term", (F.col("rq") / F.col("nq")).alias("wq"))
    dots = rows.join(wq, [query_key, "term"]).groupBy(query_key, doc_key).agg((F.sum(F.col("r") * F.col("wq")) / F.first("norm")).alias("score"))
    return dots.withColumn("score", F.round("score", 9)).where("score > 0")


def pack_greedily(items: DataFrame, group: str, order: str, cost: str, budget: int) -> DataFrame:
    """group, used, taken (orders, ascending): items in order, each that still fits; those that do not are skipped.

    A fold over a group's items, of which a task holds only those that it has taken.
    """
    return fitted(items, [group], order, cost, F.lit(budget)).select(group, "used", F.array_join("taken", ",").alias("taken"))


def _take(state: tuple, o: int, c: int, most: int | None, _: int) -> tuple[tuple, list]:
    used, taken = state
    if most is None or used + c <= most:
        taken.append(o)
        used += c
    return (used, taken), []


def fitted(items: DataFrame, by: list[str], order: str, cost: str, limit: Column, start: Column | None = None) -> DataFrame:
    """by, used, taken (array of orders): as pack_greedily, with a limit (null: none) and a start cost that are the same for all items of a group."""
    begun = F.coalesce(start, F.lit(0)) if start is not None else F.lit(0)
    rows = items.select(*by, F.col(order).cast("long").alias("_o"), F.col(cost).cast("long").alias("_c"), limit.cast("long").alias("_most"), begun.cast("long").alias("_begun"))
    return fold(rows, by, ["_o", "_c"], ["_o", "_c", "_most", "_begun"], "used bigint, taken array<bigint>", _take, begin=lambda o, c, most, begun: (begun, []), end=lambda state: [state])
