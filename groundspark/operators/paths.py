"""Regular paths over triples: sequences, alternatives, inverses and repetition of predicates.

A path is an automaton whose states are its steps. A pair of nodes is joined by it if the end is reached from the
start in the product of graph and automaton, whose edges are triples that a step allows; how steps follow
each other is a small table that the triples are joined with.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.operators import graph
from groundspark.operators.joins import join_once
from groundspark.session import stored


@dataclass(frozen=True)
class Path:
    """A step along a predicate, or what operators make of paths: a / b (then), a | b (or), ~a (backwards), a.star(), a.plus(), a.maybe()."""

    kind: str
    parts: tuple[Path, ...] = ()
    predicate: str = ""
    back: bool = False

    def __truediv__(self, other: Path) -> Path:
        return Path("then", (self, other))

    def __or__(self, other: Path) -> Path:
        return Path("or", (self, other))

    def __invert__(self) -> Path:
        if self.kind == "step":
            return Path("step", predicate=self.predicate, back=not self.back)
        turned = tuple(~p for p in self.parts)
        return Path(self.kind, turned[::-1] if self.kind == "then" else turned)

    def plus(self) -> Path:
        return Path("plus", (self,))

    def maybe(self) -> Path:
        return Path("maybe", (self,))

    def star(self) -> Path:
        return self.plus().maybe()


def step(predicate: str) -> Path:
    return Path("step", predicate=predicate)


@dataclass
class Automaton:
    """moves: (state, predicate, back, next); state 0 is the start, the others are the path's steps in order."""

    moves: list[tuple[int, str, bool, int]] = field(default_factory=list)
    ends: set[int] = field(default_factory=set)
    empty: bool = False  # whether a path of no steps is one
    loops: bool = False

    @classmethod
    def of(cls, path: Path) -> Automaton:
        labels: list[Path] = []
        follows: set[tuple[int, int]] = set()

        def walk(p: Path) -> tuple[set[int], set[int], bool]:
            """First and last steps of p, and whether it may have none."""
            if p.kind == "step":
                labels.append(p)
                return {len(labels)}, {len(labels)}, False
            if p.kind == "maybe":
                first, last, _ = walk(p.parts[0])
                return first, last, True
            if p.kind == "plus":
                first, last, empty = walk(p.parts[0])
                follows.update((a, b) for a in last for b in first)
                return first, last, empty
            (first, last, empty), (first2, last2, empty2) = walk(p.parts[0]), walk(p.parts[1])
            if p.kind == "or":
                return first | first2, last | last2, empty or empty2
            follows.update((a, b) for a in last for b in first2)
            return first | (first2 if empty else set()), last2 | (last if empty2 else set()), empty and empty2

        first, last, empty = walk(path)
        follows.update((0, b) for b in first)
        moves = [(a, labels[b - 1].predicate, labels[b - 1].back, b) for a, b in sorted(follows)]
        return cls(moves, last, empty, any(a >= b for a, b in follows))


def product(triples: DataFrame, automaton: Automaton) -> DataFrame:
    """src, dst: structs of node and state; a row for each triple that a move allows."""
    moves = triples.sparkSession.createDataFrame(automaton.moves, "state int, p string, back boolean, next int")
    met = triples.select("s", "p", "o").join(F.broadcast(moves), "p")
    end = lambda there, back, state: F.struct(F.when(F.col("back"), F.col(back)).otherwise(F.col(there)).alias("node"), F.col(state).alias("state"))
    return met.select(end("s", "o", "state").alias("src"), end("o", "s", "next").alias("dst"))


def reached(triples: DataFrame, path: Path, starts: DataFrame | None = None) -> DataFrame:
    """src, dst: the distinct pairs of nodes that the path joins.

    triples: s, p, o, of which none may be null; starts: node; all by default. A path that may have no steps joins every
    node with itself: every subject and object, or every start. Paths without repetition take a join a step; with
    repetition, twice as long paths are found in each round, or, from given starts, paths of one step more.
    """
    automaton = Automaton.of(path)
    edges = product(triples, automaton).where("src.node is not null and dst.node is not null").distinct()
    if not automaton.loops:
        pairs = edges.where("src.state = 0")
        pairs = pairs if starts is None else pairs.join(starts.select("node").distinct(), F.col("src.node") == F.col("node"), "left_semi")
        newest, found = pairs, [pairs]
        inner = edges.where("src.state > 0").select(F.col("src").alias("via"), F.col("dst").alias("to"))
        for _ in range(max(b for *_, b in automaton.moves) - 1):
            newest = newest.join(inner, F.col("dst") == F.col("via")).select("src", F.col("to").alias("dst")).distinct()
            found.append(newest)
        pairs = found[0]
        for more in found[1:]:
            pairs = pairs.unionByName(more)
    elif starts is None:
        pairs = graph.closure(edges)
    else:
        pairs = graph.closure(edges, starts.select(F.struct("node", F.lit(0).alias("state")).alias("src")))
    ends = pairs.where((F.col("src.state") == 0) & F.col("dst.state").isin(sorted(automaton.ends))).select(F.col("src.node").alias("src"), F.col("dst.node").alias("dst"))
    if automaton.empty:
        nodes = triples.select(F.explode(F.array("s", "o")).alias("node")) if starts is None else starts.select("node")
        ends = ends.unionByName(nodes.where("node is not null").select(F.col("node").alias("src"), F.col("node").alias("dst")))
    return ends.distinct()


def relation(triples: DataFrame, path: Path, known: dict[Path, DataFrame] | None = None) -> tuple[DataFrame, bool]:
    """src, dst: the distinct pairs that one or more steps of the path join; and whether it may have no steps. known keeps closures for other paths."""
    known = {} if known is None else known
    if path.kind == "step":
        end = ("o", "s") if path.back else ("s", "o")
        one = triples.where(F.col("p") == path.predicate).select(F.col(end[0]).alias("src"), F.col(end[1]).alias("dst"))
        return one.where("src is not null and dst is not null").distinct(), False
    first, empty = relation(triples, path.parts[0], known)
    if path.kind == "maybe":
        return first, True
    if path.kind == "plus":
        if path not in known:
            known[path] = graph.closure(first).select("src", "dst")
        return known[path], empty
    second, empty2 = relation(triples, path.parts[1], known)
    if path.kind == "or":
        return first.unionByName(second).distinct(), empty or empty2
    pairs = first.join(second.select(F.col("src").alias("dst"), F.col("dst").alias("to")), "dst").select("src", F.col("to").alias("dst"))
    pairs = pairs.unionByName(second) if empty else pairs
    pairs = pairs.unionByName(first) if empty2 else pairs
    return pairs.distinct(), empty and empty2


def counted(triples: DataFrame, path: Path, known: dict[Path, DataFrame] | None = None) -> DataFrame:
    """pairs, sources, targets: how many distinct pairs of nodes the path joins (as `reached` finds them), and how many ends of each kind.

    The pairs of a sequence are not written out: from its last part to its first, nodes that lead to the same set of
    targets become one class, and each class keeps its targets once. Equal sets are told by their size and 128 bits
    of hashes. known as in `relation`.
    """
    c, known = F.col, {} if known is None else known
    nodes = lambda: triples.select(F.explode(F.array("s", "o")).alias("src")).where("src is not null").distinct()
    parts, todo = [], [path]
    while todo:
        last = todo.pop()
        if last.kind == "then":
            todo += last.parts
        else:
            parts.append(last)
    members = targets = None
    for part in parts:  # the last one first
        pairs, empty = relation(triples, part, known)
        if members is None:
            leads = pairs.select("src", c("dst").alias("set"))
            itself = nodes().withColumn("set", c("src"))
        else:
            leads = pairs.join(members, c("dst") == c("node")).select("src", "set")
            itself = members.select(c("node").alias("src"), "set")
        leads = leads.unionByName(itself).distinct() if empty else leads.distinct()
        if len(parts) == 1:
            leads = leads.select("src", c("set").alias("dst"))
            by = leads.groupBy("src").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("pairs"), F.count("*").alias("sources"))
            return by.join(leads.select("dst").distinct().agg(F.count("*").alias("targets")), F.lit(True))
        leads = stored(leads)
        told = [F.sum(F.xxhash64("set", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in (0, 1)]
        alike = stored(leads.groupBy("src").agg(F.count("*").alias("size"), *told))
        key = ["size", "h0", "h1"]
        least = alike.groupBy(*key).agg(F.min("src").alias("set"), F.count("*").alias("n"))
        members = stored(join_once(alike, least, key).select(c("src").alias("node"), "set"))
        own = leads.join(members.select("set").distinct(), c("src") == members["set"], "left_semi").select("src", c("set").alias("via"))
        if targets is None:
            targets = stored(own.select(c("src").alias("set"), c("via").alias("dst")))
        else:
            targets = stored(own.join(targets.select(c("set").alias("via"), "dst"), "via").select(c("src").alias("set"), "dst").distinct())
    sizes = members.groupBy("set").agg(F.count("*").alias("n")).join(targets.groupBy("set").agg(F.count("*").alias("m")), "set")
    by = sizes.agg(F.coalesce(F.sum(c("n") * c("m")), F.lit(0)).alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("sources"))
    return by.join(targets.select("dst").distinct().agg(F.count("*").alias("targets")), F.lit(True))
