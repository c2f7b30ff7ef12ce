"""Joins in time and kept state, bound to the events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from groundspark.operators import fsm, intervals
from groundspark.plans.registry import query, table
from groundspark.session import shared_folder
from groundspark.streaming import machine

HALF_DAY = 12 * 3600 * 1_000_000


def timed_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", intervals.micros("ts").alias("at"))


@query("""SELECT a.event_id, b.event_id AS other_id, epoch_us(a.ts) - epoch_us(b.ts) AS age FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 12 HOUR AND a.ts AND a.event_id <> b.event_id""")
def t_events_half_a_day_before(spark, sf_dir):
    """Each event with every other one of its user in the half day before."""
    e = timed_events(spark, sf_dir)
    met = intervals.within(e.select("event_id", "user_id", "at"), e.select(F.col("event_id").alias("other_id"), "user_id", F.col("at").alias("other_at")), ["user_id"], "at", "other_at", HALF_DAY)
    return met.where("event_id <> other.other_id").select("event_id", "other.other_id", (F.col("at") - F.col("other.other_at")).alias("age"))


@query("""SELECT e.event_id, p.event_id AS purchase_id, epoch_us(e.ts) - epoch_us(p.ts) AS age, coalesce(e.ts - p.ts <= INTERVAL 1 DAY, FALSE) AS fresh
FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts > p.ts""")
def t_last_purchase_before(spark, sf_dir):
    """Each event with its user's last purchase before it, as evidence that is fresh for a day."""
    e = timed_events(spark, sf_dir)
    bought = e.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("at").alias("bought_at"))
    found = intervals.as_of(e.select("event_id", "user_id", "at"), bought, ["user_id"], "at", "bought_at", ["purchase_id"], strictly=True)
    age = F.col("at") - F.col("other.bought_at")
    return found.select("event_id", "other.purchase_id", age.alias("age"), F.coalesce(age <= 2 * HALF_DAY, F.lit(False)).alias("fresh"))


#: What users do, as a machine; a day without an event and it is idle again.
VISITS = machine.Machine({
    ("idle", "view"): "browsing", ("idle", "signup"): "browsing", ("browsing", "click"): "browsing", ("browsing", "purchase"): "buying", ("browsing", "error"): "failed",
    ("buying", "view"): "browsing", ("buying", "error"): "failed", ("failed", "signup"): "idle", ("failed", "click"): "browsing",
}, "idle", 24 * 3600)


def _visits_sql() -> str:
    moves = ", ".join(f"('{s}', '{c}', '{to}')" for (s, c), to in VISITS.moves.items())
    day = VISITS.patience * machine.MICROS
    return f"""WITH RECURSIVE moves(state, command, next) AS (VALUES {moves}),
e AS (SELECT user_id, epoch_us(ts) AS t, event_type AS command, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type) AS i, max(epoch_us(ts)) OVER () AS until FROM events),
run(user_id, i, t, command, before, after, stale, lost) AS (SELECT user_id, i, t, e.command, 'idle', coalesce(next, 'idle'), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM e LEFT JOIN moves m ON m.state = 'idle' AND m.command = e.command WHERE i = 1
UNION ALL SELECT e.user_id, e.i, e.t, e.command, CASE WHEN e.t > run.t + {day} THEN 'idle' ELSE run.after END, coalesce(next, CASE WHEN e.t > run.t + {day} THEN 'idle' ELSE run.after END), CASE WHEN e.t > run.t + {day} THEN run.t + {day} END, run.after
FROM run JOIN e ON e.user_id = run.user_id AND e.i = run.i + 1 LEFT JOIN moves m ON m.state = CASE WHEN e.t > run.t + {day} THEN 'idle' ELSE run.after END AND m.command = e.command)
SELECT user_id AS key, t AS "at", command, before, after, CASE WHEN EXISTS (SELECT 1 FROM moves m WHERE m.state = before AND m.command = run.command) THEN 'moved' ELSE 'refused' END AS outcome FROM run
UNION ALL SELECT user_id, stale, NULL, lost, 'idle', 'stale' FROM run WHERE stale IS NOT NULL
UNION ALL SELECT user_id, t + {day}, NULL, after, 'idle', 'stale' FROM run JOIN (SELECT user_id, max(i) AS i, any_value(until) AS until FROM e GROUP BY 1) USING (user_id, i) WHERE until > t + {day}"""


@query(_visits_sql)
def t_visits(spark, sf_dir):
    """Each user's events through the machine VISITS, and when it grew stale; by a fold over the table."""
    e = timed_events(spark, sf_dir).select(F.col("user_id").alias("key"), "at", F.col("event_type").alias("command"))
    until = e.agg(F.max("at")).first()[0]
    return machine.run_batch(e, VISITS, until)


@query(_visits_sql)
def t_visits_stream(spark, sf_dir, slices: int = 5):
    """The same rows from a stream: the table comes in slices of time, machines are kept between them, and timers tell which grew stale."""
    e = timed_events(spark, sf_dir).select(F.col("user_id").alias("key"), F.timestamp_micros("at").alias("ts"), F.col("event_type").alias("command"), "at")
    low, high = e.agg(F.min("at"), F.max("at")).first()
    folder = f"{shared_folder(spark)}/visits-{uuid.uuid4().hex}"
    for i in range(slices if low is not None else 0):
        slice_ = e.where(F.floor((F.col("at") - low) * slices / (high - low + 1)) == i).drop("at")
        slice_.coalesce(1).write.mode("append").parquet(f"{folder}/in")  # one file a batch
    if low is None:
        return spark.createDataFrame([], f"key bigint, {machine.OUT}")
    provider = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # timers need it
    try:
        stream = spark.readStream.schema("key bigint, ts timestamp, command string").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        run = machine.run_stream(stream, VISITS).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(provider, was) if was else spark.conf.unset(provider)
    return spark.read.parquet(f"{folder}/out")


def transitions(spark):
    """VISITS as a table of transitions; every state is settled."""
    return spark.createDataFrame([(s, c, to, to) for (s, c), to in VISITS.moves.items()], "state string, command string, next_state string, settled string")


def _steps_sql() -> str:
    moves = ", ".join(f"('{s}', '{c}', '{to}')" for (s, c), to in VISITS.moves.items())
    return f"""WITH moves(state, command, next) AS (VALUES {moves}), legal AS (SELECT state, string_agg(command, ', ' ORDER BY command) AS commands FROM moves GROUP BY 1),
asked AS (SELECT event_id, (['idle', 'browsing', 'buying', 'failed', 'lost'])[1 + user_id % 5] AS state, event_type AS command FROM events)
SELECT event_id, state, command, next IS NOT NULL AS allowed, next AS next_state, next AS settled, CASE WHEN commands IS NULL THEN 'unknown state ''' || state || '''' WHEN next IS NOT NULL THEN state || ' --' || command || '--> ' || next
WHEN command = 'error' THEN command || ' is not accepted in state ' || state ELSE command || ' is illegal in state ' || state || '; legal commands are ' || commands END AS reason FROM asked LEFT JOIN moves USING (state, command) LEFT JOIN legal USING (state)"""


@query(_steps_sql)
def t_event_steps(spark, sf_dir):
    """Each event as a command to a machine in some state: whether it is taken, where it leads, and why not."""
    state = F.get(F.array(*map(F.lit, ("idle", "browsing", "buying", "failed", "lost"))), (F.col("user_id") % 5).cast("int"))
    asked = table(spark, sf_dir, "events").select("event_id", state.alias("state"), F.col("event_type").alias("command"))
    return fsm.step(asked, transitions(spark), ("error",)).select("event_id", "state", "command", "allowed", "next_state", "settled", "reason")
