"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

A bin is filled greedily with the longest piece that fits, again and again; then its smallest piece
gives way to the two unpacked pieces that fill the widened gap best, if they fill it better than it
did. Two pieces of equal length are exchangeable, so the packer works on the number of pieces of each
length: one pattern of lengths is found once and repeated as long as the same choices would be made.
The state is one number a length (`capacity` at most) whatever the corpus, the result that of packing
all pieces together; no partition is packed on its own.

Pieces then find their place by their rank among the pieces of their length. Ranks come from counts
by input partition, so no task gathers a length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundspark.llm.common import held
from groundspark.llm.tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, nth long"
BATCH = 64


def best_pair(lengths: list[int], left: dict[int, int], room: int) -> tuple[int, int] | None:
    """The two available lengths (ascending list) with the largest sum up to room; of ties the one with the longest piece."""
    best, low = None, 0
    for hi in range(bisect_right(lengths, room) - 1, -1, -1):
        a = lengths[hi]
        if best and 2 * a <= sum(best):
            break
        while low < len(lengths) and lengths[low] <= min(a, room - a):
            low += 1
        j = min(low, hi + 1) - 1
        if j == hi and left[a] < 2:
            j -= 1
        if j >= 0 and lengths[j] + a <= room and (best is None or lengths[j] + a > sum(best)):
            best = (a, lengths[j])
            if sum(best) == room:
                break
    return best


def pack_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns [(bins, [(length, copies in each bin), ...])] that hold all pieces; counts: pieces of each length (1..capacity)."""
    left = {k: v for k, v in counts.items() if v > 0}
    lengths = sorted(left)
    patterns = []
    while lengths:
        taken: Counter = Counter()
        gap = capacity

        def pick(room: int, at_most: int | None = None) -> int:
            i = bisect_right(lengths, room) - 1
            while i >= 0 and left[lengths[i]] <= taken[lengths[i]]:
                i -= 1
            return lengths[i] if i >= 0 else 0

        while gap and (longest := pick(gap)):
            n = min(gap // longest, left[longest] - taken[longest])
            taken[longest] += n
            gap -= n * longest
        needed = Counter(taken)
        if gap:
            smallest = min(taken)
            free = {k: v - taken[k] for k, v in left.items() if v > taken[k]}
            pair = best_pair([k for k in lengths if k in free], free, gap + smallest)
            if pair and sum(pair) > smallest:
                taken[smallest] -= 1
                taken.update(pair)
                needed.update(pair)
        taken = +taken
        bins = min((left[k] - needed[k]) // n + 1 for k, n in taken.items())
        patterns.append((bins, sorted(taken.items(), reverse=True)))
        for k, n in taken.items():
            left[k] -= n * bins
        lengths = [k for k in lengths if left[k]]
    return patterns


def places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, copies in a bin, first bin, offset), ascending by rank."""
    rows: dict[int, list] = {}
    ranks: Counter = Counter()
    first = 0
    for bins, items in patterns:
        offset = 0
        for length, copies in items:
            rows.setdefault(length, []).append((ranks[length], copies, first, offset))
            ranks[length] += copies * bins
            offset += copies * length
        first += bins
    return {k: np.array(v, "i8") for k, v in rows.items()}


class _Cut:
    """Tokenizes and cuts; `nth` counts the pieces of a length within the input partition."""

    def __init__(self, path: str, kind: str, capacity: int, end: int):
        self.path, self.kind, self.capacity, self.end = path, kind, capacity, np.array([end], "<u4").tobytes()

    def __call__(self, batches):
        enc, seen, part = encoder(self.path, self.kind), Counter(), TaskContext.get().partitionId()
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), *((x, pa.int64()) for x in ("start", "length", "ids_crc32", "part", "nth"))])
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                out = []
                ids, texts = (c.to_pylist() for c in batch.slice(i, BATCH).columns)
                for doc_id, raw in zip(ids, enc.encode(texts), strict=True):
                    raw += self.end
                    n = len(raw) // 4
                    start, take = 0, (n - 1) % self.capacity + 1  # the first piece may be shorter
                    for piece in range(-(-n // self.capacity)):
                        out.append((doc_id, piece, start, take, zlib.crc32(raw[4 * start : 4 * (start + take)]), part, seen[take]))
                        seen[take] += 1
                        start, take = start + take, self.capacity
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


class _Place:
    def __init__(self, table):
        self.table = table

    def __call__(self, batches):
        table = self.table.value
        for batch in batches:
            length, rank = (batch.column(x).to_numpy() for x in ("length", "rank"))
            bins, offsets = np.empty(len(rank), "i8"), np.empty(len(rank), "i8")
            for k in np.unique(length).tolist():
                at, rows = np.flatnonzero(length == k), table[k]
                first_rank, copies, first_bin, offset = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1].T
                bins[at] = first_bin + (rank[at] - first_rank) // copies
                offsets[at] = offset + (rank[at] - first_rank) % copies * k
            yield pa.RecordBatch.from_arrays(
                [batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(bins), pa.array(offsets)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )


def best_two_fit(docs: DataFrame, tokenizer: str, kind: str = "byte", capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pieces of all documents and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    docs: doc_id (long) and text; other columns are ignored. A null text counts as empty and still
    has its end id; a null doc_id stays null; repeated rows are packed as often as they come; ties
    (pieces of equal length) take places in the order of input partitions. No rows give no rows.
    Only documents longer than `capacity` are cut, into pieces of `capacity`, the first of the rest.
    """
    spark = docs.sparkSession
    pieces = held(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_Cut(tokenizer, kind, capacity, end_id), PIECES))
    by_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_part.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    table = spark.sparkContext.broadcast(places(pack_counts(counts, capacity)))
    ranked = pieces.join(offsets, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(_Place(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
