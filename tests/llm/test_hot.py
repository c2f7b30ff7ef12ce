"""Keys that hold a third of all rows: same results, and no task that gathers them."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from groundspark.llm import linedup, secrets, simhash
from groundspark.llm.common import join_once


def test_join_once_spreads_a_hot_key(spark):
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        rows = spark.range(30000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"))
        once = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("most")).where("key <> 7")
        joined = join_once(rows, once, ["key"])
        assert joined.columns == ["id", "key", "most"]
        assert sorted(map(tuple, joined.collect())) == sorted((i, k, 29997 if k == 0 else i) for i in range(30000) for k in [0 if i % 3 == 0 else i] if k != 7)
        tasks = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(tasks) > 2 and max(tasks) < 2 * 30000 / len(tasks)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_window_of_all_documents(spark):
    docs = spark.createDataFrame([(i, f"own {i}\nsame\nsame again\nsame still\nend {i}") for i in range(300)], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.text) for r in linedup.dedup_lines(docs).collect()}
    assert got == {i: (3, f"own {i}\nend {i}") if i else (0, "own 0\nsame\nsame again\nsame still\nend 0") for i in range(300)}


def links_of(pairs, items):
    root = {x: x for x in items}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return {x: top(x) for x in items}


def test_large_groups_are_dealt_out_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 20)
    monkeypatch.setattr(simhash, "DEAL", 2)
    rng = random.Random(9)
    hub = rng.getrandbits(62)
    values = {hub ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for _ in range(250)}
    values |= {(hub >> 30 << 30) ^ rng.getrandbits(30) for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    distinct = spark.createDataFrame([(v,) for v in values], "fp long")
    got = [(r.u, r.v) for r in simhash.links(distinct).collect()]
    near = [(a, b) for a, b in combinations(values, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 4 for a, b in got)
    want = links_of(near, values)
    assert links_of(got, values) == want and len(set(want.values())) < len(values)
    parts = {r.node: r.root for r in simhash.components(simhash.links(distinct)).collect()}
    assert parts == {v: r for v, r in want.items() if list(want.values()).count(r) > 1}


def test_a_third_of_all_documents_hold_one_secret(spark):
    rows = [(i, "password=aK39dkQlw0Zx" if i % 3 == 0 else f"token: k{i:03d}Zq8Rw2LmXbTyVp", "hot", f"r{i}") for i in range(300)]
    rows += [(301, "secret=aaaaaaaaaaaa1", "b", "x"), (302, "password=your_password_here", "b", "x"), (303, "api_key=Gt5Hy7Ju8Ki9Lo", "b", "x"), (304, "api_key=Gt5Hy7Ju8Ki9Lo", "b", "y"), (305, "it is Gt5Hy7Ju8Ki9Lo, aaaaaaaaaaaa1 or aK39dkQlw0Zx", "c", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, repo string")
    got = {r.doc_id: r for r in secrets.scan(docs, repository="repo").select("doc_id", "n_live", "n_copied", "n_plain", secrets.written(F.col("spans")).alias("spans")).collect()}
    assert all((got[i].n_live, got[i].n_copied, got[i].n_plain) == ((0, 1, 0) if i % 3 == 0 else (1, 0, 0)) for i in range(300))
    assert [(got[i].n_live, got[i].n_plain) for i in (301, 302, 303, 304)] == [(0, 1), (0, 1), (1, 0), (1, 0)]
    assert got[305].spans == "owned:6:20"


def test_join_once_broadcasts_only_where_a_key_is_hot(spark):
    from groundspark.operators.joins import FEW

    rows = spark.range(200).select((F.col("id") % 50).alias("key"), "id")
    was = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for more in (0, FEW):
            both = rows.unionByName(spark.range(more).select(F.lit(7).cast("long").alias("key"), (F.col("id") + 1000).alias("id")))
            once = both.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("n"))
            joined = join_once(both, once, ["key"])
            assert joined.columns == ["key", "id", "least"]
            assert sorted(map(tuple, joined.collect())) == sorted((r.key, r.id, r.key) for r in both.collect())
            assert ("BroadcastExchange" in joined._jdf.queryExecution().toString()) == bool(more)
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
