"""The trie against one built by nested loops."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from groundspark.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def expected(rows, block, most=8):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    # Turns of one number stand by the digest of what they say.
    said = lambda t: hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()
    own = {c: [t[2:] for t in sorted(x, key=lambda t: (t[0], t[1], said(t)))] for c, x in own.items()}
    built = dict(own)
    if block:
        for c in own:
            h = zlib.crc32(str(c).encode()) % (most + 1)
            built[c] = own.get(c - c % block, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []
    for p, ids in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(ids) if len(built[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out.append((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(children[p]), sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def found(spark, rows, block):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit("own").alias(c) for c in ("depth", "digest", "path", "block", "n_bytes", "ends")])
    return sorted(tuple(r[c] for c in COLUMNS) for r in trie.conversation_trie(df.repartition(3), block).collect())


def made(seed, convs=40, words="ab"):
    rng = random.Random(seed)
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice([*words, "ü", None])) for c in rng.sample(range(100), convs) for t in range(rng.randint(0, 7))]
    return [*rows, (None, 1, "user", "nobody's"), (5, None, "user", "null first"), (5, 1, "user", "b"), (5, 1, "user", "a"), (6, 3, "user", "again"), (6, 3, "user", "again")]


@pytest.mark.parametrize("seed,block", [(1, 5), (2, 5), (3, None)])
def test_nodes(spark, seed, block):
    rows = made(seed)
    assert found(spark, rows, block) == expected(rows, block)


def test_turnless_conversations_end_at_the_root(spark):
    alone = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 == 3)
    rows = [(alone, 0, "user", "one"), (alone, 1, "user", "two")]
    got = found(spark, rows, 5)
    assert got == expected(rows, 5) == [(alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())]


def test_copies_and_prefixes_of_one_conversation(spark):
    """Every conversation is a prefix of the longest one, and a third are one and the same."""
    rows = [(c, t, "user", f"turn {t}") for c in range(60) for t in range(20 if c % 3 == 0 else c % 20)]
    assert found(spark, rows, None) == expected(rows, None)


def test_rows_above_grow_with_the_turns(spark):
    """Two copies of a long conversation share each prefix, but their nodes are one path."""
    rows = spark.createDataFrame([(c, t, "user", f"turn {t}") for c in (1, 2) for t in range(3000)] + [(3, 0, "user", "turn 0")], "conv_id long, turn long, role string, text string")
    got = trie.conversation_trie(rows).collect()
    assert len(got) == 3001 and {r.n_leaves for r in got} == {1}
    assert next(r for r in got if r.depth == 0).saved_tokens == sum(len(f"turn {t}") for t in range(3000)) + len("turn 0")


def test_many_ends_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 7)
    rows = [(c, 0, "user", "same") for c in range(-20, 300)]
    assert found(spark, rows, None) == expected(rows, None)


def test_no_rows(spark):
    assert found(spark, [], 5) == []
