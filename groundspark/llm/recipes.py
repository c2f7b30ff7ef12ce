"""Exact dedup by content-defined chunk recipes.

A text, with A-Z in lower case, is cut where a rolling hash of its last WINDOW bytes says so; equal texts are
therefore cut alike. Each chunk is named by a digest, and a text's recipe is the ordered list of its
chunks' names. That a name stands for one content is verified, not assumed: distinct contents of all
chunks are gathered once, each task's repeats summed up before they move, and if any name has two
contents, all names are given anew, longer and from other seeds. Texts are then equal exactly if their
recipes are, and from there on only recipes move, 16 bytes for some 2,000 of text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.llm.common import held, join_once

#: Bytes that the rolling hash sees; a cut is where its BITS highest bits are zero.
WINDOW, BITS = 32, 11
#: Least and greatest length of a chunk but the last one, in bytes.
LEAST, MOST = 512, 8192
#: Bytes hashed at a time, and bytes of chunks handed on at a time.
STEP, BATCH = 1 << 20, 8 << 20
#: Bytes of a chunk's name at first.
WIDTH = 16
_GEAR = np.random.default_rng(13).integers(0, 1 << 63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def candidates(data: bytes):
    """Ends of possible chunks in order: lengths of the prefixes after which the rolling hash asks for a cut."""
    every = np.frombuffer(data, "u1")
    for at in range(0, len(data), STEP):
        first = max(0, at - WINDOW + 1)
        h = _GEAR[every[first : at + STEP]]
        span = 1
        while span < WINDOW:  # h[i] covers the last `span` bytes up to i
            h[span:] = h[span:] + (h[:-span] << np.uint64(span)) if span < len(h) else h[span:]
            span *= 2
        cuts = np.flatnonzero(h[at - first :] >> np.uint64(64 - BITS) == 0)
        yield from (cuts + at + 1).tolist()


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of data; they depend on nothing but its bytes."""
    ends, start = [], 0
    for end in [*(candidates(data) if len(data) > LEAST else ()), len(data)]:
        while end - start > MOST:
            start += MOST
            ends.append(start)
        if end - start >= LEAST or end == len(data) > start:
            ends.append(end)
            start = end
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = chunk_ends(data)
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def name(chunk: bytes, width: int) -> bytes:
    """`width` bytes; hashes of as many seeds as they take. Another width has other seeds."""
    return b"".join(xxhash.xxh3_128_digest(chunk, width + k) for k in range(0, width, 16))[:width]


def _texts(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("doc_id")[i].as_py(), (batch.column("text")[i].as_py() or b"").translate(_LOWER)


def _recipes(width: int):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                rows = [(d, b"".join(name(c, width) for c in chunks(t)), hashlib.sha256(t).digest()) for d, t in _texts([batch.slice(i, 256)])]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["doc_id", "recipe", "sha256"])

    return run


def _contents(width: int):
    def run(batches):
        found, size = [], 0
        for _, text in _texts(batches):
            for c in chunks(text):
                found.append(c)
                size += len(c)
                if size >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array([name(x, width) for x in found], pa.binary()), pa.array(found, pa.binary())], names=["name", "chunk"])
                    found, size = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([name(x, width) for x in found], pa.binary()), pa.array(found, pa.binary())], names=["name", "chunk"])

    return run


def stored(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """name, chunk: each distinct content of a chunk of the texts of docs once."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_contents(width), "name binary, chunk binary").dropDuplicates(["name", "chunk"])


def recipes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Every row's doc_id, recipe and sha256 of its lower-cased text; a name in a recipe stands for one content only."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    while not stored(docs, width).groupBy("name").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        width *= 2
    return rows.mapInArrow(_recipes(width), "doc_id long, recipe binary, sha256 binary")


def exact_groups(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Every row's doc_id, keep_id, group_size, kept and text_sha256.

    docs: doc_id (long) and text; other columns are ignored. Texts are equal if they are after A-Z are
    lower-cased; a null text counts as empty, and all empty texts are one group. The row with the largest id stays, a
    null id is smaller than any other; of rows of one id one stays, whichever. No rows give no rows.
    """
    # The lists are compared as they are; a joint key, checked to be one list's own, then takes their place.
    rows = held(recipes(docs, width).withColumn("key", F.unhex(F.sha2("recipe", 256)))).withColumn("row", F.monotonically_increasing_id())
    last = F.max(F.struct(F.col("doc_id"), (-F.col("row")).alias("row")))
    groups = rows.groupBy("key", "recipe").agg(last.alias("last"), F.count("*").alias("group_size"))
    groups = held(groups.select("key", F.col("last.doc_id").alias("keep_id"), (-F.col("last.row")).alias("keep_row"), "group_size", F.col("group_size").alias("n")))
    if not groups.groupBy("key").agg(F.count("*").alias("lists")).where("lists > 1").isEmpty():
        raise ValueError("two recipes share a SHA-256")
    joined = join_once(rows.select("doc_id", "sha256", "key", "row"), groups, ["key"], spread=False)
    return joined.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha256")).alias("text_sha256"))
