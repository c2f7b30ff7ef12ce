"""Conversation prefix trie by chained digests.

Each turn is digested, and digests are chained along a conversation, so that one digest names a whole
prefix. Every prefix is a row; rows of one depth and digest are a node.

For sums over subtrees, nodes are told their ancestors by the prefixes of their smallest member. The nodes
that have the same smallest member lie on one path (a child that keeps the member has it as its
smallest, too), so the trie is cut into such paths, and what is exploded is each path to all paths above
it, with the depth at which it hangs there. A path that changes above a conversation does so at most
once a turn: there are never more such rows than turns, where nodes times ancestors would grow with the
square of a conversation's length. Along a path, running sums from its end upwards do the rest.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from groundspark.llm.common import held, join_once, text_or_empty

#: Rows that go out of a pass together, and ids that one piece of a node's list holds.
ROWS, IDS = 4096, 4096
ROOT = bytes(32)
PREFIXES = "conv_id long, depth long, digest binary, n_bytes long, ends boolean"
_ARROW = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("n_bytes", pa.int64()), ("ends", pa.bool_())])


def borrowed(conv_id: int, most: int) -> int:
    """Number of turns that a conversation takes from the first one of its block."""
    return zlib.crc32(str(conv_id).encode()) % (most + 1)


def turn_digest(role: Column, text: Column) -> Column:
    """32 bytes; the role's length keeps role and text apart."""
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def _chain(most: int | None):
    """Prefixes of each conversation. Rows come by block, first its first conversation, then by conversation and turn.

    What is kept is one digest, and the first turns of the block's first conversation.
    """

    def run(batches):
        out, heads, block, conv = [], [], None, None
        last = skip = depth = rank = 0
        for batch in batches:
            for b, c, digest, n_bytes in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != conv:
                    if conv is not None:
                        out.append((*last, True))
                    if b != block:
                        block, heads = b, []
                    conv, depth, rank, last = c, 0, 0, (c, 0, ROOT, 0)
                    skip = borrowed(c, most) if most is not None and c != b else 0
                    for head, size in heads[:skip]:
                        out.append((*last, False))
                        depth += 1
                        last = (c, depth, hashlib.sha256(last[2] + head).digest(), size)
                if most is not None and c == b and len(heads) < most:
                    heads.append((digest, n_bytes))
                rank += 1
                if rank > skip:
                    out.append((*last, False))
                    depth += 1
                    last = (c, depth, hashlib.sha256(last[2] + digest).digest(), n_bytes)
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)
                    out = []
        if conv is not None:
            out.append((*last, True))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return run


def prefixes(conversations: DataFrame, block: int | None = None, most: int = 8) -> DataFrame:
    """conv_id, depth, digest, n_bytes (of the last text), ends: a row for each prefix of each conversation, the empty one too.

    conversations: conv_id (long), turn, role, text. Turns are ordered by turn (null first), those of one
    number by a digest of what they say. With a block, a conversation c takes some of the first turns of
    conversation c - c % block, `most` at most, in place of as many of its own.
    """
    role, text = text_or_empty("role"), text_or_empty("text")
    conv = F.col("conv_id").cast("long")
    first = conv if block is None else conv - conv % F.lit(block)
    rows = conversations.where("conv_id is not null").select(first.alias("block"), conv.alias("conv_id"), F.col("turn").alias("turn"), turn_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    order = ["block", F.col("conv_id") != F.col("block"), "conv_id", F.asc_nulls_first("turn"), "digest"]
    ordered = rows.repartition("block").sortWithinPartitions(*order).select("block", "conv_id", "digest", "n_bytes")
    return ordered.mapInArrow(_chain(None if block is None else most), PREFIXES)


def _pieces(batches):
    """digest, first, ids: runs of ids of one digest, joined by commas, IDS at most."""
    key, ids, out = None, [], []
    for batch in batches:
        for digest, conv in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if digest != key or len(ids) >= IDS:
                if ids:
                    out.append((key, ids[0], ",".join(map(str, ids))))
                key, ids = digest, []
            ids.append(conv)
        if len(out) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["digest", "first", "ids"])
            out = []
    if ids:
        out.append((key, ids[0], ",".join(map(str, ids))))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["digest", "first", "ids"])


def _hashes(batches):
    """digest, ends_sha256 of the pieces of each digest, one after the other."""
    key, state, out = None, None, []
    for batch in batches:
        for digest, _, ids in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if digest != key:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = digest, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if len(out) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.string()), strict=True)], names=["digest", "ends_sha256"])
            out = []
    if key is not None:
        out.append((key, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.string()), strict=True)], names=["digest", "ends_sha256"])


def ends_hashes(rows: DataFrame) -> DataFrame:
    """digest, ends_sha256 of the conversations that end at each node, in numerical order.

    A node that many end at is cut by ranges of ids first; one task then hashes its pieces, a row for IDS ids.
    """
    ends = rows.where("ends").select("digest", "conv_id")
    pieces = ends.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(_pieces, "digest binary, first long, ids string")
    return pieces.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(_hashes, "digest binary, ends_sha256 string")


def nodes(rows: DataFrame) -> DataFrame:
    """The nodes of the trie of prefixes: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    n_leaves and saved_tokens are of the whole subtree, the node included; a node saves the bytes of its last text once
    for each member but one. rows: as `prefixes` returns them; computed once.
    """
    rows = held(rows)
    saves = (F.col("n_convs") - 1) * F.col("n_bytes")
    grouped = rows.groupBy("depth", "digest").agg(F.min("conv_id").alias("path"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"))
    named = held(grouped.select("depth", "digest", "path", "n_convs", saves.alias("saves")))
    paths = named.groupBy("path").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum("saves").alias("saves"))
    # The prefixes of a conversation say which paths stand above its own, and where it leaves them.
    passed = join_once(rows.select("conv_id", "depth", "digest"), named.select("depth", "digest", "path", F.col("n_convs").alias("n")), ["depth", "digest"], spread=False)
    above = passed.where("path <> conv_id").groupBy("conv_id", F.col("path").alias("above")).agg(F.max("depth").alias("at"))
    hangs = held(above.join(paths, F.col("conv_id") == F.col("path")).select("path", "above", "at", "bottom", "saves", (F.col("at") == F.col("top") - 1).alias("direct")))
    branches = hangs.where("direct").groupBy(F.col("above").alias("path"), F.col("at").alias("bottom")).agg(F.count("*").alias("branches"))
    leaf = held(paths.join(branches, ["path", "bottom"], "left").select("path", "bottom", F.col("branches").isNull().cast("long").alias("leaf")))
    none = F.lit(0).cast("long")
    below = hangs.join(leaf.select("path", "leaf"), "path").select(F.col("above").alias("path"), F.col("at").alias("depth"), F.col("direct").cast("long").alias("children"), "leaf", "saves")
    below = below.unionByName(leaf.select("path", F.col("bottom").alias("depth"), none.alias("children"), "leaf", none.alias("saves")))
    summed = below.groupBy("path", "depth").agg(*[F.sum(c).alias(f"{c}_below") for c in ("children", "leaf", "saves")])
    upwards = Window.partitionBy("path").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    with_sums = named.join(summed, ["path", "depth"], "left").select(
        "path", "depth", "digest", "n_convs",
        (zero("children_below") + (F.max("depth").over(upwards) > F.col("depth")).cast("long")).alias("n_children"),
        F.sum(zero("leaf_below")).over(upwards).alias("n_leaves"),
        F.sum(F.col("saves") + zero("saves_below")).over(upwards).alias("saved_tokens"),
    )
    tops = hangs.where("direct").select("path", (F.col("at") + 1).alias("depth"), "above")
    parent = F.when(F.col("depth") > 0, F.coalesce("above", "path"))
    found = with_sums.join(tops, ["path", "depth"], "left").join(ends_hashes(rows), "digest", "left")
    return found.select(
        F.col("path").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame, block: int | None = None, most: int = 8) -> DataFrame:
    """The nodes of the trie of conversations, see `prefixes` and `nodes`.

    A null role or text counts as empty; rows without conv_id belong to no conversation and go; equal
    rows are turns of their own. A conversation that has no turns left ends at the root. No rows give no nodes,
    not even the root. Other columns are ignored. One conversation is chained by one task, which keeps no turns.
    """
    return nodes(prefixes(conversations, block, most))
