"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its shuffled documents, gone through again when its target asks for more
than it has. A copy's virtual finish time is the number of tokens of its source up to and with it,
divided by the source's target; copies go out in the order of finish times until the total budget is
spent. Only DataFrame functions; running sums are made in two levels (sums by slice, then within a
slice), so neither a hot source nor the global order meets in one task. The place where the budget ends
in the global order is found by histograms of finish times, each within the last one's bin.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.llm.common import held

ROWS_A_SLICE = 8192
BINS = 2048
#: Finish times that are sorted on the driver at most.
MAX_SORTED = 10_000


def shuffle_key(doc_id: Column, size: Column, rest: Column | None = None, seed: str = "mix") -> Column:
    """Pseudo-random, the same in each run: md5 of the id and size as text, and of a hash of other columns; rows of one id spread by the others."""
    parts = [F.coalesce(doc_id.cast("string"), F.lit("null")), size.cast("string"), *([F.xxhash64(rest).cast("string")] if rest is not None else []), F.lit(seed)]
    return F.md5(F.concat_ws("/", *parts))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """source, source_size, target. sizes: source and source_size, one row a source (the only rows that meet in one task).

    Weights go round by the code points of the sources' names, a null name last. Targets share the sum
    of all sizes by weight; none exceeds `most` times its source's size, the excess is shared anew.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    named = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1)).cast("double"))
    # Filled in the order in which growing water reaches the caps: the first source whose share stays below its cap ends it.
    cap = F.col("source_size") * most
    order = Window.orderBy(cap / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    filled = named.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < cap)
    final = F.min(F.when(F.col("open"), F.struct(cap / F.col("weight"), "level"))).over(everything)["level"]
    return filled.withColumn("final", final).select("source", "source_size", F.when(F.col("final").isNull() | (F.col("final") * F.col("weight") >= cap), cap.cast("double")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def queue(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, upto (tokens of its source up to and with it).

    sized: doc_id, source, size, and a struct `rest` to keep. Rows of one id follow by a hash of the others; equal rows are exchangeable.
    """
    rows = sized.withColumn("h", shuffle_key(F.col("doc_id"), F.col("size"), F.col("rest") if "rest" in sized.columns else None))
    digits = max(1, math.ceil(math.log(max(1, sized.count() / ROWS_A_SLICE), 16)))  # slices of the hash; results do not depend on them
    rows = rows.withColumn("slice", F.substring("h", 1, digits))
    by_slice = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    by_slice = by_slice.withColumn("before", F.coalesce(F.sum("slice_size").over(before), F.lit(0)))
    aims = targets(by_slice.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, most).withColumnRenamed("source", "name")
    slices = by_slice.drop("slice_size").join(aims, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumnsRenamed({"source": "name", "slice": "name_slice"})
    within = Window.partitionBy("source", "slice").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("upto", F.sum("size").over(within))
    joined = summed.join(slices, F.col("source").eqNullSafe(F.col("name")) & (F.col("slice") == F.col("name_slice")))
    return joined.withColumn("upto", F.col("before") + F.col("upto")).drop("h", "slice", "name", "name_slice", "before")


def finish(copy: Column) -> Column:
    return (copy * F.col("source_size") + F.col("upto")).cast("double") / F.greatest(F.col("target"), F.lit(1e-9))


def last_within(copies: DataFrame, budget: int) -> float | None:
    """The largest finish time up to which all copies together stay within the budget; None if all copies do.

    copies: finish, size. Copies of one finish time count together. BINS sums or MAX_SORTED values reach the driver at a time.
    """
    low, high, total = copies.agg(F.min("finish"), F.max("finish"), F.sum("size")).first()
    if not total or total <= budget:
        return None
    spent = 0
    while True:
        inside = copies.where((F.col("finish") >= low) & (F.col("finish") <= high))
        width = (high - low) / BINS
        place = F.least(F.floor((F.col("finish") - low) / width), F.lit(BINS - 1)) if low + width > low else (F.col("finish") > low).cast("long")
        bins = inside.groupBy(place.alias("place")).agg(F.sum("size").alias("size"), F.min("finish").alias("low"), F.max("finish").alias("high"), F.count("*").alias("n")).collect()
        for b in sorted(bins, key=lambda b: b["place"]):
            if spent + b["size"] > budget:
                break
            spent += b["size"]
        low, high = b["low"], b["high"]
        if low == high or b["n"] <= MAX_SORTED:
            break
    cut = None
    for r in sorted(copies.where((F.col("finish") >= low) & (F.col("finish") <= high)).groupBy("finish").agg(F.sum("size").alias("size")).collect(), key=lambda r: r["finish"]):
        if spent + r["size"] > budget:
            break
        spent += r["size"]
        cut = r["finish"]
    if cut is None:
        cut = copies.where(F.col("finish") < low).agg(F.max("finish")).first()[0]
    return -1.0 if cut is None else cut


def mix(sized: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Every document with its place in the mix: doc_id, source, size, source_size, target, upto, copies (taken, from 0 to `most`).

    sized: doc_id, source, size (long, null counts as 0), and other columns, which are kept (but for any of the new names). A null source is a source of its own and comes last; empty documents cost nothing and go out with the words around them; a null
    id is an id like others. Rows equal in all columns are exchangeable. The budget is the sum of all
    sizes; copies are taken in the order of finish times as long as they fit, copies of one and the same
    finish time all or none. No rows give no rows.
    """
    own = ("doc_id", "source", "size", "source_size", "target", "upto", "copies")
    rest = [c for c in sized.columns if c not in own]
    packed = [F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] if rest else []
    rows = sized.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size"), *packed)
    queued = held(queue(held(rows), weights, most))
    turns = F.sequence(F.lit(0), F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("int") + 1)) - 1)
    copies = queued.where("size > 0").select("size", F.explode(F.transform(turns, finish)).alias("finish"))
    cut = last_within(copies, queued.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0])
    fits = F.filter(turns, lambda copy: finish(copy) <= F.lit(cut)) if cut is not None else turns
    return queued.select("doc_id", *[F.col("rest")[c].alias(c) for c in rest], *own[1:-1], F.size(fits).alias("copies"))
