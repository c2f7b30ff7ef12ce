"""Machines on tables and streams against a loop, and folds against groups in memory."""

import random
from datetime import datetime, timezone
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from groundspark.operators.fold import fold
from groundspark.streaming import machine as m

MACHINE = m.Machine({("off", "start"): "on", ("on", "stop"): "off", ("on", "fail"): "broken", ("broken", "reset"): "off"}, "off", 100)


def made(n=200, keys=9):
    rng = random.Random(3)
    return sorted((rng.randrange(keys), rng.randrange(4000) * m.MICROS + 7, rng.choice(["start", "stop", "fail", "reset", None])) for _ in range(n))


def expected(rows, until=None):
    out = []
    for key, own in groupby(sorted((k, t, c is not None, c or "") for k, t, c in rows), key=lambda r: r[0]):
        state, last = "off", None
        for _, t, _, c in own:
            if last is not None and t - last > 100 * m.MICROS:
                out.append((key, last + 100 * m.MICROS, None, state, "off", "stale"))
                state = "off"
            after = MACHINE.moves.get((state, c))
            out.append((key, t, c or None, state, after or state, "moved" if after else "refused"))
            state, last = after or state, t
        if until is not None and until > last + 100 * m.MICROS:
            out.append((key, last + 100 * m.MICROS, None, state, "off", "stale"))
    return sorted(out, key=repr)


@pytest.mark.parametrize("until", [None, 3950 * m.MICROS])
def test_batch(spark, until):
    df = spark.createDataFrame([*made(), (None, 5, "start"), (3, None, "start")], "key long, at long, command string").repartition(5)
    assert sorted(map(tuple, m.run_batch(df, MACHINE, until).collect()), key=repr) == expected(made(), until)


def test_stream_equals_batch(spark, tmp_path):
    """Four batches in order of time; the last event moves the watermark, so that machines at rest grow stale by timer."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = sorted(made(), key=lambda r: r[1]) + [(99, 5000 * m.MICROS, "start")]
    at = lambda t: datetime.fromtimestamp(t / m.MICROS, timezone.utc)
    for i in range(4):
        part = rows[i * len(rows) // 4 : (i + 1) * len(rows) // 4]
        spark.createDataFrame([(k, at(t), c) for k, t, c in part], "key long, ts timestamp, command string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key long, ts timestamp, command string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = m.run_stream(stream, MACHINE).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)
    assert got == expected(rows, 5000 * m.MICROS)


def test_fold_holds_no_group(spark):
    """Running sums of a key with all rows."""
    rows = spark.range(20_000).select(F.lit(1).alias("k"), (F.col("id") * 7919 % 20_011).alias("o"), F.col("id").alias("v"))
    step = lambda s, v: (s + v, [(s + v,)] if (s + v) % 1000 == 0 else [])
    got = fold(rows, ["k"], ["o"], ["v"], "total bigint", step, begin=lambda v: 0, end=lambda s: [(-s,)]).collect()
    total, want = 0, []
    for v in sorted(range(20_000), key=lambda i: i * 7919 % 20_011):
        total += v
        want += [total] if total % 1000 == 0 else []
    assert [r.total for r in got] == [*want, -total]


def test_fold_of_nothing(spark):
    assert m.run_batch(spark.createDataFrame([], "key long, at long, command string"), MACHINE).collect() == []
