"""Edges: transitive closure, components, integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.operators.joins import join_once, small
from groundspark.session import checkpointed, discard, stored

#: Edges from which on nodes with many neighbours are spread.
HUB = 1_000_000
#: Edges that a task joins up at a time.
TOGETHER = 1_000_000


def closure(edges: DataFrame, starts: DataFrame | None = None, zero_hop: bool = False) -> DataFrame:
    """src, dst, hops (fewest): pairs joined by a path of one or more edges; cycles are safe.

    All pairs come by doubling: once all pairs within k hops are known, those of exactly k hops lead to all
    within 2k, so a chain of n takes log n rounds. starts: src values to begin at; then each round extends
    the newest pairs by one edge, so that nothing but pairs from there is made. zero_hop adds each with itself.
    """
    steps = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    first = steps if starts is None else steps.join(starts.select("src").distinct(), "src", "left_semi")
    seen = newest = checkpointed(first.withColumn("hops", F.lit(1)))
    hops, ahead = 1, steps.select(F.col("src").alias("via"), "dst", F.lit(1).alias("more"))
    while not newest.isEmpty():
        far = newest.where(F.col("hops") == hops).select("src", F.col("dst").alias("via"))
        if starts is None:
            ahead = seen.select(F.col("src").alias("via"), "dst", F.col("hops").alias("more"))
        found = far.join(ahead, "via").groupBy("src", "dst").agg((F.min("more") + hops).alias("hops"))
        newest = checkpointed(found.join(seen, ["src", "dst"], "left_anti"))
        seen = seen.unionByName(newest)
        hops = 2 * hops if starts is None else hops + 1
    if zero_hop:
        nodes = (steps.select("src").unionByName(steps.select(F.col("dst").alias("src"))) if starts is None else starts.select("src")).distinct()
        itself = nodes.select("src", F.col("src").alias("dst"), F.lit(0).alias("hops"))
        seen = seen.join(itself, ["src", "dst"], "left_anti").unionByName(itself)
    return seen


def _stars(batches):
    """u, v: each node of an edge with the smallest node that it reaches by edges which lie together; a node may come again."""
    import numpy as np
    import pyarrow as pa

    def told(held):
        u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1))
        nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
        one, other, root = ends[: len(u)], ends[len(u) :], np.arange(len(nodes))
        while (root[one] != root[other]).any():
            x, y = root[one], root[other]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root != root[root]).any():
                root = root[root]
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["u", "v"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= TOGETHER:
            yield told(held)
            held, rows = [], 0
    if rows:
        yield told(held)


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable either way).

    Where nodes are numbers, edges that lie together are joined up first, and only the roots of nodes that lie in several places
    are left to join, so little is moved where most of a component's edges lie together.
    """
    if dict(edges.dtypes)["src"] != "bigint" or dict(edges.dtypes)["dst"] != "bigint":
        return _contracted(edges)
    ends = edges.select(F.coalesce("src", "dst").alias("u"), F.coalesce("dst", "src").alias("v")).where("u is not null")
    stars = stored(ends.mapInArrow(_stars, "u long, v long"))
    least = stored(stars.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("last")))
    met = small(least.where("v <> last").select("u", F.col("v").alias("root")))
    left = stored(stars.join(met, "u").where("v <> root").select(F.col("v").alias("src"), F.col("root").alias("dst")).distinct())
    discard(stars)
    if left.isEmpty():
        return least.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = small(stored(_contracted(left).withColumnRenamed("node", "v")))
    return least.join(roots, "v", "left").select(F.col("u").alias("node"), F.coalesce("root", "v").alias("root"))


def _contracted(edges: DataFrame) -> DataFrame:
    """node, root, by star contraction until nothing changes.

    In a large component all nodes come to know the root, so from HUB edges on, nodes with many neighbours meet
    what they are told by a join that keeps them spread.
    """
    pairs = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    told = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    now = stored(pairs.distinct())
    state = told(now)
    while True:
        meet = join_once if state[0] > HUB else lambda rows, once, keys: rows.join(once.drop("n"), keys)
        both = now.where("u <> v").unionByName(now.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        large = meet(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        few = meet(large, least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, now = now, stored(few.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        discard(before)
        was, state = state, told(now)
        if state == was:
            break
    ends = pairs.select("u").union(pairs.select("v")).distinct()
    return ends.join(now.withColumnRenamed("u", "node"), F.col("u") == F.col("node"), "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("root"))


def unresolved(references: DataFrame, definitions: DataFrame, keys: list[str]) -> DataFrame:
    """References whose target is not defined."""
    return references.join(definitions.select(*keys).distinct(), keys, "left_anti")
