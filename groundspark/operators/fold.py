"""Folds over the rows of a key in order, of which a task holds one at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that go out together.
ROWS = 4096


class _Fold:
    def __init__(self, keys: int, begin: Callable, step: Callable, end: Callable, schema: pa.Schema):
        self.keys, self.begin, self.step, self.end, self.schema = keys, begin, step, end, schema

    def rows(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        key, state, began = None, None, False
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not began or row[: self.keys] != key:
                    if began:
                        yield from (key + out for out in self.end(state))
                    key, state, began = row[: self.keys], self.begin(*row[self.keys :]), True
                state, found = self.step(state, *row[self.keys :])
                yield from (key + out for out in found)
        if began:
            yield from (key + out for out in self.end(state))

    def __call__(self, batches):
        out = []
        for row in self.rows(batches):
            out.append(row)
            if len(out) == ROWS:
                yield self.batch(out)
                out = []
        if out:
            yield self.batch(out)

    def batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.schema, strict=True)], schema=self.schema)


def fold(
    rows: DataFrame, by: list[str], order: list[str], values: list[str], out: str,
    step: Callable[..., tuple[Any, list[tuple]]], begin: Callable[..., Any] = lambda *_: None, end: Callable[[Any], list[tuple]] = lambda _: [],
) -> DataFrame:
    """The keys `by` and columns of `out` (a schema) for whatever step and end give.

    Rows of a key come in order (nulls first); rows that order does not part come in that of their values. begin(*values of the first row) is the
    first state, step(state, *values) gives the next state and rows, end(state) more rows. Spark sorts, on disk if need be; a
    task keeps a key's state and no rows, so a key may be of any length. One key is one task's work, one after the other, as a fold is.
    """
    later = [c for c in values if c not in order]
    ordered = rows.repartition(*by).sortWithinPartitions(*by, *order, *later).select(*by, *values)
    schema = StructType([*ordered.select(*by).schema.fields, *StructType.fromDDL(out).fields])
    arrow = to_arrow_schema(schema)
    return ordered.mapInArrow(_Fold(len(by), begin, step, end, arrow), schema)
