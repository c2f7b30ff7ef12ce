"""Document fingerprints: one-permutation MinHash with optimal densification and b-bit storage.

Each word shingle is hashed once; the hash's top bits name a bin, the smallest hash of a bin is its
value. An empty bin takes the value of a bin drawn by a universal hash of its own number and the
attempt, until that one is not empty. Of each bin the low eight bits are stored, and likenesses are
corrected for those that agree by chance.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.llm.common import held

BINS = 256
BITS = 8
WORDS = 5
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], "u8")
#: Attempt -> bin -> the bin drawn, for so many attempts at a time.
ATTEMPTS = 512


def _final(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ h >> np.uint64(33)


def draws(block: int) -> np.ndarray:
    attempt = np.arange(block * ATTEMPTS, (block + 1) * ATTEMPTS, dtype="u8")
    return (_final(np.arange(BINS, dtype="u8")[None, :] * _MIX[0] + (attempt[:, None] + np.uint64(1)) * _MIX[1]) % np.uint64(BINS)).astype("i2")


_DRAWS = draws(0)


def word_hashes(text: str) -> np.ndarray:
    words = _WORD.findall(text.encode("utf-8", "surrogatepass"))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), "u8", len(words))


def signature(words: np.ndarray, n: int = WORDS) -> np.ndarray | None:
    """Stored low bits of each bin; None without words. Fewer words than n: their whole sequence is the only shingle."""
    if not len(words):
        return None
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        h = np.zeros(len(words) - n + 1, "u8")
        for k in range(n):
            h += words[k : len(words) - n + 1 + k] * _MIX[k]
        h = _final(h + np.uint64(n))
    bins = (h >> np.uint64(56)).astype("i8")  # BINS of them
    values = np.full(BINS, np.iinfo("u8").max, "u8")
    np.minimum.at(values, bins, h)
    full = np.zeros(BINS, bool)
    full[bins] = True
    empty, block = np.flatnonzero(~full), 0
    while len(empty):
        to = (_DRAWS if not block else draws(block))[:, empty]
        hits = full[to]
        found = hits.any(0)
        values[empty[found]] = values[to[hits.argmax(0), np.arange(len(empty))][found]]
        empty, block = empty[~found], block + 1
    return (values & np.uint64((1 << BITS) - 1)).astype("u1")


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimate of the shingle sets' Jaccard similarity, 0 to 1; two texts without words are alike, one is unlike any other."""
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 2.0**-BITS
    return float(min(1.0, max(0.0, ((a == b).mean() - chance) / (1 - chance))))


def packed(s: np.ndarray | None) -> bytes:
    """A byte a bin; nothing for a text without words."""
    return b"" if s is None else s.tobytes()


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, edge int, text string, part int"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((x, pa.binary()) for x in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edge", pa.int32()), ("text", pa.string()), ("part", pa.int32())])


def compare(doc_id, text: str, own, following: str, theirs):
    changed = edited(text, following)
    other = signature(word_hashes(changed))
    return (doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).digest(), packed(own), packed(other), likeness(own, other), likeness(own, theirs))


def _walk(batches):
    """Compares neighbours within a partition; its first and last rows come out as they are, with edge 1 and 2 (3: both)."""
    from pyspark import TaskContext

    part, before, start = TaskContext.get().partitionId(), None, None
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            out = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.slice(i, 256).columns[:2]), strict=True):
                text = text or ""
                own = signature(word_hashes(text))
                if before is None:
                    start = (doc_id, text)
                else:
                    out.append((*compare(*before, text, own), 0, None, part))
                before = (doc_id, text, own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)
    if before is not None:
        none = (None,) * 6
        out = [(start[0], *none, 1, start[1], part), (before[0], *none, 2, before[1], part)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _edges(batches):
    """Last rows of partitions, each with the first row of the next one that has rows."""
    fields = list(_ARROW)[:7]
    for batch in batches:
        for i in range(batch.num_rows):
            (r,) = batch.slice(i, 1).to_pylist()
            own, theirs = (signature(word_hashes(r[x])) for x in ("text", "following"))
            out = compare(r["doc_id"], r["text"], own, r["following"], theirs)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(out, fields, strict=True)], schema=pa.schema(fields))


def fingerprint_chain(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Every row's fingerprint and that of its edited text, whose second half comes from the next row in descending order of ids.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    docs: doc_id (long) and text; other columns are ignored. The row after the last is the first, so a
    single row follows itself. A null text counts as empty and has the fingerprint ''; null ids come
    last; rows of equal id follow by a hash of their texts. No rows give no rows.
    """
    spark = docs.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("doc_id"), F.desc("h"), F.desc("row")]  # the last one parts equal rows
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    walked = held(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(_walk, SCHEMA))
    own = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    parts_used = sorted(r["part"] for r in walked.where("edge = 1").select("part").collect())  # numbers of partitions, not rows
    turn = spark.createDataFrame(list(zip(parts_used, parts_used[1:] + parts_used[:1], strict=True)), "part int, next int")
    firsts = walked.where("edge = 1").select(F.col("part").alias("next"), F.col("text").alias("following"))
    lasts = walked.where("edge = 2").select("doc_id", "text", "part").join(F.broadcast(turn), "part").join(firsts, "next")
    ends = lasts.select("doc_id", "text", "following").mapInArrow(_edges, SCHEMA.split(", edge")[0])
    as_hex = {c: F.lower(F.hex(c)) for c in own[2:5]}  # stored as bytes, shown as text
    return walked.where("edge = 0").select(own).unionByName(ends).withColumns(as_hex)
