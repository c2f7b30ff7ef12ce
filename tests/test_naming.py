"""Counters and names told apart, against loops; state machines of one's own."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from groundspark.operators import fsm, naming


def test_counters_without_gaps(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None]), i) for i in rng.sample(range(10_000), 3000)]
    got = naming.numbered(spark.createDataFrame(rows, "k string, i int"), ["k"], ["i"]).collect()
    seen, want = Counter(), {}
    for k, i in sorted(rows, key=lambda r: r[1]):
        seen[k] += 1
        want[i] = seen[k]
    assert {r.i: r.n for r in got} == want
    assert naming.numbered(spark.createDataFrame([], "k string, i int"), ["k"], ["i"]).count() == 0


def test_names_told_apart(spark):
    """Some rows' own names look like others' with a suffix."""
    rng = random.Random(2)
    names = [rng.choice(["a", "a#1", "a#2", "a#1#1", "b", "b#3"]) for _ in range(60)]
    got = naming.told_apart(spark.createDataFrame(list(enumerate(names)), "i int, name string"), "name", ["i"]).collect()
    assert len(got) == 60 and len({r.new_name for r in got}) == 60
    groups = defaultdict(list)
    for r in sorted(got, key=lambda r: r.i):
        groups[r.name].append(r.new_name)
    assert all(x[0] == name and all(y.startswith(f"{name}#") for y in x[1:]) for name, x in groups.items())
    plain = naming.told_apart(spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, "x")], "i int, name string"), "name", ["i"]).collect()
    assert {r.i: r.new_name for r in plain} == {1: "x", 2: "x#1", 3: "y", 4: "x#2"}


def test_a_machine_of_ones_own(spark):
    moves = spark.createDataFrame([("off", "start", "starting", "on"), ("on", "stop", "off", "off"), ("on", "fail", "broken", "broken"), ("broken", "reset", "off", "off")], "state string, command string, next_state string, settled string")
    asked = spark.createDataFrame([("off", "start"), ("off", "stop"), ("off", "jump"), ("lost", "stop"), ("starting", "stop")], "state string, command string")
    got = {(r.state, r.command): (r.allowed, r.settled, r.reason) for r in fsm.step(asked, moves, ("stop",)).collect()}
    assert got == {
        ("off", "start"): (True, "on", "off --start--> starting"), ("off", "stop"): (False, None, "stop is not accepted in state off"), ("off", "jump"): (False, None, "unknown PackML command 'jump'"),
        ("lost", "stop"): (False, None, "unknown state 'lost'"), ("starting", "stop"): (False, None, "stop is not accepted in state starting"),
    }
    plans = {(r.start, r.goal): r.plan for r in fsm.plans(spark, moves).collect()}
    assert plans[("broken", "on")] == "reset,start" and plans[("off", "broken")] == "start,fail" and plans[("on", "on")] == ""
    assert {r.state: r.commands for r in fsm.legal(spark, moves).collect()}["on"] == "fail,stop"
