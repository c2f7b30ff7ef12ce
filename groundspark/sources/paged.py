"""Services that answer in pages, as a data source: cursors, retries, and streams of pages as they come.

A service is a function of a query and a cursor (null at first) that gives a page: its records, as JSON texts, and the next
cursor, null at the end. A chain of cursors can only be followed one after the other, so each query is a
partition of its own; where a service can say beforehand which cursors a query has, its pages are dealt out instead.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from groundspark.operators import naming

SCHEMA = "query string, page int, position int, cursor string, record string, status string, attempts int"
#: Attempts at a page, and seconds before the second one, which double each time.
ATTEMPTS, WAIT = 4, 0.5


class Busy(Exception):
    """A page that may come if it is asked for again."""


@dataclass
class Page:
    records: list[str]
    following: str | None


def _function(name: str | None) -> Callable | None:
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class _Service:
    """What the options say. They name functions as module:function; a function gets all options besides.

    fetch(options, query, cursor) -> Page; cursors(options, query) -> list of cursors known beforehand;
    queries: a JSON list of names; most: records of a query at most; attempts, wait: of retries; together: pages of a partition.
    """

    def __init__(self, options: dict):
        self.options = dict(options)
        self.queries: list[str] = json.loads(options["queries"])
        self.most = int(options["most"]) if options.get("most") else None
        self.attempts, self.wait = int(options.get("attempts", ATTEMPTS)), float(options.get("wait", WAIT))
        self.together = int(options.get("together", 100))

    def cursors(self, query: str) -> list[str | None] | None:
        known = _function(self.options.get("cursors"))
        return known(self.options, query) if known else None

    def page(self, query: str, cursor: str | None) -> tuple[Page | None, str, int]:
        """The page or null, its status (`ok` or what went wrong), and how often it was asked for."""
        fetch, wait = _function(self.options["fetch"]), self.wait
        for attempt in range(1, self.attempts + 1):
            try:
                return fetch(self.options, query, cursor), "ok", attempt
            except Busy as error:
                status = f"busy: {error}"
                if attempt < self.attempts:
                    time.sleep(wait)
                    wait *= 2
            except Exception as error:  # the query's failure; others go on
                return None, f"failed: {error}", attempt
        return None, status, self.attempts

    def rows(self, query: str, page: int, cursor: str | None, left: int | None = None) -> tuple[list[tuple], str | None]:
        found, status, attempts = self.page(query, cursor)
        if found is None:
            return [(query, page, None, cursor, None, status, attempts)], None
        records = found.records if left is None else found.records[:left]
        rows = [(query, page, i, cursor, r, status, attempts) for i, r in enumerate(records)]
        return rows, found.following

    def chain(self, query: str) -> Iterator[tuple]:
        """All pages of a query, one after the other."""
        page, cursor, left, seen = 0, None, self.most, set()
        while left is None or left > 0:
            rows, following = self.rows(query, page, cursor, left)
            yield from rows
            left = None if left is None else left - sum(r[4] is not None for r in rows)
            if following is None:
                return
            if following in seen:  # a service that goes in circles never ends
                yield (query, page + 1, None, following, None, "failed: the cursor comes again", 0)
                return
            seen.add(following)
            page, cursor = page + 1, following


class _Part(InputPartition):
    def __init__(self, query: str, first: int = 0, cursors: list[str | None] | None = None):
        self.query, self.first, self.cursors = query, first, cursors


class _Reader(DataSourceReader):
    def __init__(self, service: _Service):
        self.service = service

    def partitions(self) -> list[InputPartition]:
        parts = []
        for query in self.service.queries:
            known = self.service.cursors(query) if self.service.most is None else None
            step = self.service.together
            parts += [_Part(query)] if known is None else [_Part(query, i, known[i : i + step]) for i in range(0, len(known), step)]
        return parts

    def read(self, partition: _Part) -> Iterator[tuple]:
        if partition.cursors is None:
            yield from self.service.chain(partition.query)
            return
        for i, cursor in enumerate(partition.cursors):
            yield from self.service.rows(partition.query, partition.first + i, cursor)[0]


class _StreamReader(DataSourceStreamReader):
    """Offsets are numbers of pages by query; a service must know its cursors, and only ever add to them."""

    def __init__(self, service: _Service):
        self.service = service

    def initialOffset(self) -> dict:
        return dict.fromkeys(self.service.queries, 0)

    def latestOffset(self) -> dict:
        return {q: len(self.service.cursors(q)) for q in self.service.queries}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        parts, step = [], self.service.together
        for query, to in end.items():
            cursors = self.service.cursors(query)[:to]
            parts += [_Part(query, i, cursors[i : i + step]) for i in range(start.get(query, 0), to, step)]
        return parts

    def read(self, partition: _Part) -> Iterator[tuple]:
        for i, cursor in enumerate(partition.cursors):
            yield from self.service.rows(partition.query, partition.first + i, cursor)[0]


class PagedSource(DataSource):
    """spark.dataSource.register(PagedSource); spark.read.format("paged").options(fetch=..., queries=...).load().

    A row a record; a page that failed has a row without a record that says why, and ends its query's chain.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_Service(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(_Service(self.options))


def _saved(options: dict, query: str, cursor: str | None) -> str:
    return f"{options['folder'].rstrip('/')}/query={query}/page={cursor or 0}"


def saved_page(options: dict, query: str, cursor: str | None) -> Page:
    """A page that `write_pages` wrote into the folder named in the options."""
    from pyarrow import fs

    uri = _saved(options, query, cursor)
    system, path = fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")
    files = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".txt")]
    body = json.loads(system.open_input_stream(files[0]).read())
    return Page([json.dumps(r) for r in body["items"]], body.get("next"))


def saved_cursors(options: dict, query: str) -> list[str | None]:
    from pyarrow import fs

    uri = f"{options['folder'].rstrip('/')}/query={query}"
    system, path = fs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")
    n = sum(f.base_name.startswith("page=") for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)))
    return [None, *map(str, range(1, n))] if n else []


def write_pages(records: DataFrame, query: str, order: list[str], size: int, folder: str) -> None:
    """Records as pages of `size` in order, each a file that names the next one; records without a query are those of `none`."""
    numbered = naming.numbered(records.withColumn(query, F.coalesce(query, F.lit("none"))), [query], order, "_n")
    paged = numbered.withColumn("page", F.floor((F.col("_n") - 1) / size).cast("int"))
    last = paged.groupBy(F.col(query).alias("_q")).agg(F.max("page").alias("_last"))
    body = paged.groupBy(F.col(query).alias("query"), "page").agg(F.array_sort(F.collect_list(F.struct("_n", F.struct(*records.columns).alias("r")))).alias("_rows"))  # `size` at most
    following = F.when(F.col("page") < F.col("_last"), (F.col("page") + 1).cast("string"))
    text = F.to_json(F.struct(F.transform("_rows", lambda x: x["r"]).alias("items"), following.alias("next")))
    body.join(F.broadcast(last), F.col("query") == F.col("_q")).select("query", "page", text.alias("value")).repartition("query", "page").write.partitionBy("query", "page").text(folder)
