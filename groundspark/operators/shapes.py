"""Constraints on triples, as data.

A shape says of every node of a class what the values along a path must be: how many, of which datatype or class, from which
list. A test names the values of several paths and gives a condition on them that must not hold. Shapes and tests are
rows; however many there are, all their paths are walked at the same time, each round a join of where walks stand with
the triples they may take, and all shapes are judged in one grouped pass and one join with the classes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.operators.joins import small
from groundspark.operators.paths import Automaton, Path
from groundspark.session import stored

TYPE = "rdf:type"


@dataclass(frozen=True)
class Shape:
    """Values along path of each node of class `of`: at least `least`, at most `most`, all of the datatype, nodes with names (iri), of class `cls`, among `among`."""

    family: str
    of: str
    path: Path
    least: int = 0
    most: int | None = None
    datatype: str | None = None
    iri: bool = False
    cls: str | None = None
    among: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Test:
    """A node of class `of` is at fault if `fault`, a condition of SQL, holds for some values of the paths named in `lets`.

    Values are texts. A name that ends in [] stands for all values of its path, as an array; any other for one of them, null if
    there is none; in the condition both are written without [], so a name is used one way only. With `each`, the paths start at each node that it leads to, and values of different such nodes never meet.
    """

    __test__ = False  # not a test of pytest's

    family: str
    of: str
    lets: dict[str, Path]
    fault: str
    each: Path | None = None


def steps(triples: DataFrame) -> DataFrame:
    """src, p, back, dst, kind, type: each triple as it is and, where its object is a node, backwards."""
    kind = F.when(F.startswith("s", F.lit("_:")), "node").otherwise("iri")
    ahead = triples.select(F.col("s").alias("src"), "p", F.lit(False).alias("back"), F.col("o").alias("dst"), F.col("o_kind").alias("kind"), F.col("o_type").alias("type"))
    back = triples.where("o_kind in ('iri', 'node')").select(F.col("o").alias("src"), "p", F.lit(True).alias("back"), F.col("s").alias("dst"), kind.alias("kind"), F.lit(None).cast("string").alias("type"))
    return ahead.unionByName(back)


def walked(triples: DataFrame, starts: DataFrame, paths: list[Path]) -> DataFrame:
    """id, start, value, kind, type: the distinct values that path number id leads to, and a row without a value for each id and start.

    starts: start (once), ids. Only the first steps are taken from each start, in one join that sees each of its triples once. Where the
    rest of a path leads depends on where the first step came to, so it is walked from each such node once, whatever
    number of starts came there. Rows of a start stay together, so what groups them by start moves nothing.
    """
    spark, c = triples.sparkSession, F.col
    automata = [Automaton.of(p) for p in paths]
    moves = [(i, *m) for i, a in enumerate(automata) for m in a.moves]
    ends = {(i, e) for i, a in enumerate(automata) for e in a.ends}
    later = {(i, state) for i, state, *_ in moves if state}
    edges = stored(steps(triples.where(c("p").isin(sorted({m[2] for m in moves})))).where(_one_of({m[2:4] for m in moves})))
    allowed = F.broadcast(spark.createDataFrame([m for m in moves if m[1]], "id int, state int, p string, back boolean, next int"))
    firsts: dict[tuple[str, bool], list] = {}
    for i, state, p, back, after in moves:
        if not state:
            firsts.setdefault((p, back), []).append((i, after, (i, after) in ends, (i, after) in later))
    # The start itself stands among its triples, under no predicate: for paths of no steps, and so that no start is lost.
    own = [(i, -1, False, False) for i in range(len(paths))] + [(i, 0, True, False) for i, a in enumerate(automata) if a.empty]
    first = F.broadcast(spark.createDataFrame([(*k, v) for k, v in [*firsts.items(), (("", False), own)]], "p string, back boolean, firsts array<struct<id: int, state: int, ends: boolean, goes: boolean>>"))

    came = edges.where(_one_of(set(firsts)) & c("kind").isin("iri", "node")).select("p", "back", "dst", "kind").distinct().join(first, ["p", "back"])
    tails = came.select(F.explode(F.filter("firsts", lambda x: x["goes"])).alias("f"), "dst", "kind").select("f.id", c("f.state").alias("from"), c("dst").alias("tail"), c("kind").alias("tail_kind")).distinct()
    key = ["id", "from", "tail", "tail_kind"]
    seen = newest = stored(tails.select(*key, c("tail").alias("value"), c("tail_kind").alias("kind"), F.lit(None).cast("string").alias("type"), c("from").alias("state"), F.lit(0).alias("steps")))
    while not newest.isEmpty():
        nodes = newest.where("kind in ('iri', 'node')").join(allowed, ["id", "state"]).select(*key, c("value").alias("src"), "p", "back", "next", "steps")
        ahead = nodes.join(edges, ["src", "p", "back"]).select(*key, c("dst").alias("value"), "kind", "type", c("next").alias("state"), (c("steps") + 1).alias("steps")).distinct()
        if any(a.loops for a in automata):
            # A tail itself counts as reached where its first step came to, so it is found there.
            ahead = ahead.join(seen.select(*key, "value", "kind", "state"), [*key, "value", "kind", "state"], "left_anti")
        newest = stored(ahead)
        seen = seen.unionByName(newest)
    done = F.broadcast(spark.createDataFrame(sorted(ends), "id int, state int"))
    led = stored(seen.where("steps > 0").join(done, ["id", "state"]).groupBy(*key).agg(F.collect_set(F.struct("value", "kind", "type")).alias("led")))

    start_kind = F.when(F.startswith("start", F.lit("_:")), "node").otherwise("iri")
    text = F.lit(None).cast("string")
    itself = starts.select(c("start").alias("src"), F.lit("").alias("p"), F.lit(False).alias("back"), c("start").alias("dst"), start_kind.alias("kind"), text.alias("type"))
    met = edges.where(_one_of(set(firsts))).unionByName(itself).join(starts, c("src") == c("start")).join(first, ["p", "back"])
    taken = met.select("start", F.explode(F.filter("firsts", lambda x: F.array_contains("ids", x["id"]))).alias("f"), "dst", "kind", "type")
    taken = taken.select("f.id", "start", c("f.state").alias("from"), c("dst").alias("tail"), c("kind").alias("tail_kind"), "type", "f.ends").join(small(led), key, "left")
    none = F.struct(text.alias("value"), text.alias("kind"), text.alias("type"))
    here = F.when(c("ends"), F.array(F.struct(c("tail").alias("value"), c("tail_kind").alias("kind"), "type"))).when(c("from") < 0, F.array(none)).otherwise(F.array())
    values = taken.select("id", "start", F.explode(F.concat(here, F.coalesce("led", F.array()))).alias("v"))
    return values.select("id", "start", "v.value", "v.kind", "v.type").distinct()


def _one_of(pairs: set[tuple[str, bool]]) -> Column:
    """Whether p and back are such a pair."""
    return F.col("p").isin(sorted(p for p, back in pairs if not back)) & ~F.col("back") | F.col("p").isin(sorted(p for p, back in pairs if back)) & F.col("back")


def _foci(triples: DataFrame, classes: list[str]) -> DataFrame:
    """start, ids: the nodes of the classes, and the places in the list of those that they have."""
    places: dict[str, list[int]] = {}
    for i, of in enumerate(classes):
        places.setdefault(of, []).append(i)
    rules = triples.sparkSession.createDataFrame(list(places.items()), "of string, ids array<int>")
    of_class = triples.where(F.col("p") == TYPE).join(F.broadcast(rules), F.col("o") == F.col("of"))
    return of_class.groupBy(F.col("s").alias("start")).agg(F.array_distinct(F.flatten(F.collect_set("ids"))).alias("ids"))


def shape_faults(triples: DataFrame, shapes: list[Shape]) -> DataFrame:
    """focus, family, rule (place in shapes), n (values), bad (those that are not as they must be): nodes that break a shape."""
    spark = triples.sparkSession
    rows = [(i, s.family, s.least, s.most, s.datatype, s.iri, s.cls, list(s.among) if s.among is not None else None) for i, s in enumerate(shapes)]
    rules = F.broadcast(spark.createDataFrame(rows, "id int, family string, least int, most int, datatype string, iri boolean, cls string, among array<string>"))
    values = walked(triples, _foci(triples, [s.of for s in shapes]), [s.path for s in shapes]).join(rules, "id")
    asked = sorted({s.cls for s in shapes if s.cls is not None})
    classes = triples.where((F.col("p") == TYPE) & F.col("o").isin(asked)).select(F.col("s").alias("value"), F.col("o").alias("cls"), F.lit(True).alias("is")).distinct()
    c = F.col
    bad = (
        (c("datatype").isNotNull() & ~((c("kind") == "typed") & c("type").eqNullSafe(c("datatype"))))
        | (c("iri") & (c("kind") != "iri"))
        | (c("cls").isNotNull() & c("is").isNull())
        | (c("among").isNotNull() & ~F.array_contains("among", c("value")))
    )
    judged = values.join(small(classes), ["value", "cls"], "left").withColumn("bad", bad & c("value").isNotNull())
    counted = judged.groupBy("id", "start").agg(F.count("value").alias("n"), F.count_if("bad").alias("bad")).join(rules, "id")
    return counted.where("n < least or n > most or bad > 0").select(c("start").alias("focus"), "family", F.col("id").alias("rule"), "n", "bad")


def test_faults(triples: DataFrame, tests: list[Test]) -> DataFrame:
    """focus, family, rule (place in tests): nodes for which a test's condition holds."""
    whole = [i for i, t in enumerate(tests) if t.each is None]
    parts = [i for i in range(len(tests)) if i not in whole]
    found = []
    if whole:
        foci = _foci(triples, [tests[i].of for i in whole])
        found.append(_at_fault(triples, foci, [tests[i] for i in whole], whole).withColumnRenamed("start", "focus"))
    if parts:
        led = walked(triples, _foci(triples, [tests[i].of for i in parts]), [tests[i].each for i in parts]).where("kind in ('iri', 'node')")
        led = stored(led.select("id", F.col("start").alias("focus"), F.col("value").alias("start")))
        faulty = _at_fault(triples, led.groupBy("start").agg(F.collect_set("id").alias("ids")), [tests[i] for i in parts], parts)
        places = F.create_map(*[F.lit(x) for at, i in enumerate(parts) for x in (at, i)])
        found.append(led.select(places[F.col("id")].alias("rule"), "focus", "start").join(small(faulty), ["rule", "start"]).select("focus", "family", "rule"))
    every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return every.select("focus", "family", "rule").distinct()


def _at_fault(triples: DataFrame, starts: DataFrame, tests: list[Test], rules: list[int]) -> DataFrame:
    """start, family, rule (that of the test's place): starts from which the condition holds. starts: start, ids (places in tests)."""
    lets = [(at, name, path) for at, t in enumerate(tests) for name, path in t.lets.items()]
    named = triples.sparkSession.createDataFrame([(test, at, name) for at, (test, name, _) in enumerate(lets)], "test int, id int, name string")
    ids_of = F.create_map(*[F.lit(x) if isinstance(x, int) else F.array(*map(F.lit, x)) for test in range(len(tests)) for x in (test, [at for at, (t, *_) in enumerate(lets) if t == test])])
    asked = starts.select("start", F.flatten(F.transform("ids", lambda x: ids_of[x])).alias("ids"))
    values = walked(triples, asked, [path for *_, path in lets]).join(F.broadcast(named), "id")
    names = sorted({name for _, name, _ in lets})
    rows = values.groupBy("test", "start").agg(*[F.collect_set(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in names])
    for name in names:
        if name.endswith("[]"):
            rows = rows.withColumnRenamed(name, name.removesuffix("[]"))
        else:  # each value on its own
            rows = rows.select(*[f"`{x}`" for x in rows.columns if x != name], F.explode_outer(f"`{name}`").alias(name))
    fault = F.expr("CASE test " + " ".join(f"WHEN {i} THEN ({t.fault})" for i, t in enumerate(tests)) + " END")
    about = lambda of: F.create_map(*[F.lit(x) for i, t in enumerate(tests) for x in (i, of(i, t))])[F.col("test")]
    return rows.where(F.coalesce(fault, F.lit(False))).select("start", about(lambda i, t: t.family).alias("family"), about(lambda i, t: rules[i]).alias("rule")).distinct()


test_faults.__test__ = False


def faults(triples: DataFrame, shapes: list[Shape], tests: list[Test]) -> DataFrame:
    """focus, families (ascending): what is at fault with each node that is. triples: s, p, o, o_kind, o_type; none of the first four null."""
    found = []
    if shapes:
        found.append(shape_faults(triples, shapes).select("focus", "family"))
    if tests:
        found.append(test_faults(triples, tests).select("focus", "family"))
    every = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return every.groupBy("focus").agg(F.array_sort(F.collect_set("family")).alias("families"))
