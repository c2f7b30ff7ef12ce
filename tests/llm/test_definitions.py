"""Fingerprints and the quality classifier by their definitions, one value at a time; and rows that are odd for every operator."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from groundspark.llm import langid, minhash, quality, secrets

M64 = (1 << 64) - 1


def mixed(h):
    h = (h ^ h >> 33) * 0xFF51AFD7ED558CCD & M64
    h = (h ^ h >> 33) * 0xC4CEB9FE1A85EC53 & M64
    return h ^ h >> 33


def bins_of(text):
    """256 bins by the top byte of each shingle's hash, the least hash of each; an empty bin takes that of the first full one that is drawn for it; low bytes."""
    words = [xxhash.xxh3_64_intdigest(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    if not words:
        return None
    n, mix = min(5, len(words)), [int(x) for x in minhash._MIX]
    least = {}
    for k in range(len(words) - n + 1):
        h = mixed((sum(words[k + i] * mix[i] for i in range(n)) + n) & M64)
        least[h >> 56] = min(least.get(h >> 56, M64), h)
    out = []
    for b in range(256):
        at, attempt = b, 0
        while at not in least:
            at = mixed((b * mix[0] + (attempt + 1) * mix[1]) & M64) % 256
            attempt += 1
        out.append(least[at] & 255)
    return out


def like(a, b):
    if a is None or b is None:
        return float(a is None and b is None)
    agree = sum(x == y for x, y in zip(a, b)) / 256
    return min(1.0, max(0.0, (agree - 1 / 256) / (1 - 1 / 256)))


@pytest.mark.parametrize("parts", [1, 5])
def test_fingerprints_and_likenesses_by_definition(spark, rows, parts):
    table = [(k, t) for k, (_, t, *_) in enumerate(rows)]  # ids of their own, so the order is known
    docs = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in minhash.fingerprint_chain(docs, parts).collect()}
    order = sorted((k for k, _ in table), reverse=True)
    text = {k: t or "" for k, t in table}
    for k, after in zip(order, order[1:] + order[:1]):
        mine, half = text[k], len(text[k]) // 2
        edited = mine[: len(mine) - half] + text[after][:half]
        own, changed, theirs = bins_of(mine), bins_of(edited), bins_of(text[after])
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(mine), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == (bytes(own).hex() if own else "") and r.edited_fingerprint == (bytes(changed).hex() if changed else "")
        assert math.isclose(r.near_edited, like(own, changed), abs_tol=1e-12) and math.isclose(r.near_next, like(own, theirs), abs_tol=1e-12)


def test_repeated_ids_all_have_a_fingerprint(docs, rows):
    got = Counter((r.doc_id, r.fingerprint) for r in minhash.fingerprint_chain(docs, 3).collect())
    want = Counter((i, bytes(b).hex() if b else "") for i, t, *_ in rows for b in [bins_of(t or "")])
    assert got == want


def grams(text):
    tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^\x00-\x200-9A-Za-z\x80-\xff]+", (text or "").encode())
    h = [xxhash.xxh3_64_intdigest(t) for t in tokens]
    pairs = [(a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) & M64 for a, b in zip(h, h[1:])]
    pairs = [p ^ p >> 29 for p in pairs]
    fours = [(a * 0x165667B19E3779F9 + b) & M64 for a, b in zip(pairs, pairs[2:])]
    n = Counter(x % quality.BUCKETS for x in h + pairs)
    same, new = sum(a == b for a, b in zip(h, h[1:])), len(set(fours))
    rest = (same, max(0, len(h) - 1 - same), len(fours) - new, new)
    return n + Counter({quality.BUCKETS + k: v for k, v in enumerate(rest) if v})


def test_importance_resampling_by_definition(spark):
    rng = np.random.default_rng(5)
    words = ["river", "stone", "winter", "letter", "garden", "BUY!!", "now", "x1"]
    table = [(k, " ".join(rng.choice(words, rng.integers(1, 60), p=[0.2, 0.2, 0.2, 0.15, 0.1, 0.05, 0.05, 0.05] if k % 3 else [0.02, 0.02, 0.02, 0.02, 0.02, 0.4, 0.4, 0.1]))) for k in range(150)]
    table += [(500, None), (501, ""), (502, "winter " * 20_000), (503, table[0][1]), (503, table[0][1]), (None, "stone river")]  # ties, repeats, a long text
    labels = [(k, 1 if k % 3 else 0) for k in range(0, 60)]
    fit = quality.Classifier(spark.createDataFrame(table, "doc_id long, text string").withColumn("key", F.lit("own")), spark.createDataFrame(labels, "doc_id long, quality int"))
    good = dict(labels)
    counts = [grams(t) for _, t in table]
    families = [range(quality.BUCKETS), range(quality.BUCKETS, quality.BUCKETS + 2), range(quality.BUCKETS + 2, quality.BUCKETS + 4)]
    raw, target = Counter(), Counter()
    for (k, _), n in zip(table, counts):
        raw.update(n)
        if good.get(k):
            target.update(n)

    def weight(n, mine):
        total = 0.0
        for f in families:
            size = len(f)
            whole, aim = sum(raw[b] for b in f), sum(target[b] - mine[b] for b in f)
            for b in f:
                if n[b]:
                    total += n[b] * (math.log((target[b] - mine[b] + 1) / (aim + size)) - math.log((raw[b] + 1) / (whole + size)))
        return total

    none = Counter()
    want = [(k, weight(n, n if good.get(k) else none)) for (k, _), n in zip(table, counts)]
    rows = fit.decisions().collect()
    assert np.allclose(sorted(r.log_weight for r in rows), sorted(w for _, w in want), rtol=1e-6, atol=1e-6)
    by = {r.doc_id: r for r in rows}
    for k, w in want:
        assert math.isclose(by[k].log_weight, w, rel_tol=1e-6, abs_tol=1e-6)
        u = (xxhash.xxh3_64_intdigest(str(k).encode(), 7) + 0.5) / 2.0**64
        assert math.isclose(by[k].key - by[k].log_weight, -math.log(-math.log(u)), rel_tol=1e-6, abs_tol=1e-6)
    labelled = sorted((by[k].log_weight, g) for k, g in labels)

    def value(cut):
        return 4 * sum(g and w >= cut for w, g in labelled) / sum(g for _, g in labelled) + sum(not g and w < cut for w, g in labelled) / sum(not g for _, g in labelled)

    assert math.isclose(value(fit.threshold), max(value(w) for w, _ in labelled), rel_tol=1e-9)
    k = sum(r.log_weight >= fit.threshold for r in rows)
    keys = sorted((r.key for r in rows), reverse=True)
    assert fit.k == k and {r.kept for r in rows} == {True, False} and all(r.kept == (r.key >= keys[k - 1]) for r in rows)
    assert len({r.kept for r in rows if r.doc_id == 503}) == 1


def test_language_of_odd_rows(spark):
    train = spark.createDataFrame([("en", "the cat sat on the mat"), ("de", "die katze saß auf der matte")] * 3, "lang string, text string")
    model = langid.train(train)
    long = "the cat sat " * 60_000
    asked = [(1, long, True, "x"), (1, long, True, "x"), (None, "die katze", False, "x"), (3, "1 2 3", None, "x"), (4, "ßßß", True, "x"), (5, "\ud7ff z", True, "x")]
    got = langid.predict(spark.createDataFrame(asked, "doc_id long, text string, held_out boolean, score string"), model)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = Counter((r.doc_id, r.held_out, r.lang_pred) for r in got.collect())
    assert rows[1, True, "en"] == 2 and rows[None, False, "de"] == 1 and rows[3, None, "und"] == 1 and rows[4, True, "de"] == 1 and sum(rows.values()) == 6
    assert all(0 <= r.score <= 1 for r in got.collect())
    tied = langid.train(spark.createDataFrame([("b", "same"), ("a", "same")], "lang string, text string"))
    assert {r.lang_pred for r in langid.predict(spark.createDataFrame([(1, "same", True)], "doc_id long, text string, held_out boolean"), tied).collect()} == {"a"}


def test_secrets_of_odd_rows(spark):
    text = "token=Zx9kLm3Qw8Rt " + "z" * 50_000 + " secret: Zx9kLm3Qw8Rt"
    rows = [(1, text, "s", "own"), (1, text, "s", "own"), (None, "see Zx9kLm3Qw8Rt", None, "own"), (2, "", "s", "own"), (3, None, "s", "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row string").selectExpr("*", "row AS owner", "row AS repository", "row AS base", "row AS value", "row AS n", "row AS live")
    got = [(r.doc_id, r.n_live, r.spans) for r in secrets.scan(docs).select("doc_id", "n_live", secrets.written(F.col("spans")).alias("spans")).collect()]
    at = len(text) - len("secret: Zx9kLm3Qw8Rt")
    both = f"assign:0:18,assign:{at}:{len(text)}"
    assert sorted(got, key=str) == sorted([(1, 2, both), (1, 2, both), (None, 0, "owned:4:16"), (2, 0, ""), (3, 0, "")], key=str)
