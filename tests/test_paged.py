"""Pages by cursor, retries, failures and streams of a service of the tests' own."""

import json
import os

from pyspark.sql import functions as F

from groundspark.sources import paged

SERVICE = '''
import os
from groundspark.sources.paged import Busy, Page

def fetch(options, query, cursor):
    n = int(cursor or 0)
    if query == "broken" and n == 2:
        raise ValueError("no such page")
    if query == "circle":
        return Page([str(n)], str(n % 3 + 1))
    if query == "busy" and n == 1:
        mark = os.path.join(options["marks"], f"busy-{len(os.listdir(options['marks']))}")
        open(mark, "w").close()
        if len(os.listdir(options["marks"])) < 3:
            raise Busy("503")
    if query == "down":
        raise Busy("503")
    return Page([f"{query}/{n}/{i}" for i in range(3)], str(n + 1) if n < 4 else None)
'''


def load(spark, tmp_path, monkeypatch, **options):
    (tmp_path / "marks").mkdir(exist_ok=True)
    (tmp_path / "paged_service.py").write_text(SERVICE)
    spark.sparkContext.addPyFile(str(tmp_path / "paged_service.py"))
    spark.dataSource.register(paged.PagedSource)
    return spark.read.format("paged").options(fetch="paged_service:fetch", marks=str(tmp_path / "marks"), wait="0.01", **options).load()


def test_cursors_retries_and_failures(spark, tmp_path, monkeypatch):
    names = ["plain", "busy", "broken", "down", "circle"]
    rows = load(spark, tmp_path, monkeypatch, queries=json.dumps(names)).collect()
    of = lambda q: sorted([r for r in rows if r["query"] == q], key=lambda r: (r.page, r.position or 0))
    assert [r.record for r in of("plain")] == [f"plain/{n}/{i}" for n in range(5) for i in range(3)]
    assert [r.record for r in of("busy")] == [f"busy/{n}/{i}" for n in range(5) for i in range(3)]
    assert {r.attempts for r in of("busy") if r.page == 1} == {3} and {r.attempts for r in of("plain")} == {1}
    assert [(r.page, r.status) for r in of("broken")][-1] == (2, "failed: no such page") and len(of("broken")) == 7
    assert [(r.record, r.status, r.attempts) for r in of("down")] == [(None, "busy: 503", 4)]
    assert [r.record for r in of("circle")] == ["0", "1", "2", "3", None] and of("circle")[-1].status == "failed: the cursor comes again"


def test_at_most_so_many_records(spark, tmp_path, monkeypatch):
    rows = load(spark, tmp_path, monkeypatch, queries='["plain"]', most="7").collect()
    assert sorted((r.page, r.position) for r in rows) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0)]


def records(spark, first, n):
    return spark.range(first, first + n).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("q"), F.col("id") % 3)).alias("q"), F.col("id"), F.concat(F.lit("text ü "), "id").alias("t"))


def test_saved_pages_come_back(spark, tmp_path):
    folder = str(tmp_path / "pages")
    table = records(spark, 0, 100)
    paged.write_pages(table, "q", ["id"], 8, folder)
    spark.dataSource.register(paged.PagedSource)
    options = {"fetch": "groundspark.sources.paged:saved_page", "folder": folder, "queries": '["q0", "q1", "q2", "none"]'}
    want = sorted((r.q or "none", r.id, r.t) for r in table.collect())
    for more in ({}, {"cursors": "groundspark.sources.paged:saved_cursors", "together": "2"}):
        got = spark.read.format("paged").options(**options, **more).load().select("query", F.from_json("record", "id long, t string").alias("r"))
        assert sorted((r["query"], r.r.id, r.r.t) for r in got.collect()) == want


def test_a_stream_takes_up_pages_that_come_later(spark, tmp_path):
    folder, out = str(tmp_path / "pages"), str(tmp_path / "out")
    paged.write_pages(records(spark, 0, 60).where("q = 'q1'"), "q", ["id"], 5, folder)
    spark.dataSource.register(paged.PagedSource)
    options = {"fetch": "groundspark.sources.paged:saved_page", "cursors": "groundspark.sources.paged:saved_cursors", "folder": folder, "queries": '["q1", "q2"]'}

    def until_all_is_read():
        run = spark.readStream.format("paged").options(**options).load().writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).start()
        run.processAllAvailable()
        run.stop()
        return sorted(json.loads(r.record)["id"] for r in spark.read.parquet(out).collect())

    first = sorted(r.id for r in records(spark, 0, 60).where("q = 'q1'").collect())
    assert until_all_is_read() == first
    later = str(tmp_path / "later")
    paged.write_pages(records(spark, 1000, 40).where("q = 'q2'"), "q", ["id"], 5, later)
    os.rename(f"{later}/query=q2", f"{folder}/query=q2")
    assert until_all_is_read() == sorted(first + [r.id for r in records(spark, 1000, 40).where("q = 'q2'").collect()])
