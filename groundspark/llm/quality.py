"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of target text (rows labelled good) and one of raw
text (all rows), give each document a log importance weight, the sum of its n-grams' log ratios. The
kept ones are the top k by weight plus Gumbel noise, which draws without replacement in proportion to
the weights. k is the number of documents whose weight reaches the threshold that parts good and bad
labelled rows best.

N-grams are tokens, pairs of tokens, and two kinds that stand for repetition: whether a token equals
the one before it, and whether a run of four tokens has come before in the document.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.llm.common import held

BUCKETS = 1 << 14
#: Families of n-grams with a distribution of their own: tokens and pairs, equality, novelty.
FAMILIES = (slice(0, BUCKETS), slice(BUCKETS, BUCKETS + 2), slice(BUCKETS + 2, BUCKETS + 4))
SIZE = BUCKETS + 4
#: Most labelled rows that the target model and the threshold are fitted on; the raw model counts all rows.
MAX_LABELLED = 50_000
#: Keys that are sorted on the driver at most.
MAX_SORTED = 10_000
GOOD = 4
_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\x00-\x200-9A-Za-z\x80-\xff]+")
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and how often they come in a text; none for an empty one."""
    tokens = _TOKEN.findall(text.encode("utf-8", "surrogatepass")) if text else []
    if not tokens:
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), "u8", len(tokens))
    with np.errstate(over="ignore"):
        pairs = h[:-1] * _A + h[1:] * _B
        pairs ^= pairs >> np.uint64(29)
        fours = pairs[:-2] * _C + pairs[2:]
    where, n = np.unique(np.concatenate([h % np.uint64(BUCKETS), pairs % np.uint64(BUCKETS)]).astype("i8"), return_counts=True)
    same, new = int((h[1:] == h[:-1]).sum()), len(np.unique(fours))
    rest = np.array([same, len(h) - 1 - same, len(fours) - new, new])
    return np.concatenate([where, np.arange(BUCKETS, SIZE)]), np.concatenate([n, rest])


class _Count:
    def __init__(self, labels):
        self.labels = labels

    def __call__(self, batches):
        good, raw, target = self.labels.value, np.zeros(SIZE, "i8"), np.zeros(SIZE, "i8")
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                where, n = ngram_counts(text)
                raw[where] += n
                if good.get(doc_id):
                    target[where] += n
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])


class Ratios:
    """Log of target over raw probability of each bucket, each family smoothed by one count a bucket."""

    def __init__(self, raw: np.ndarray, target: np.ndarray):
        self.target = target
        self.usable = bool(target.sum() > 0)
        self.log_raw = np.zeros(SIZE)
        for f in FAMILIES:
            self.log_raw[f] = np.log((raw[f] + 1) / (raw[f].sum() + len(raw[f])))
        self.all = self._ratios(np.arange(SIZE), np.zeros(SIZE)) if self.usable else np.zeros(SIZE)

    def _ratios(self, where: np.ndarray, less: np.ndarray) -> np.ndarray:
        out = np.log(self.target[where] - less + 1) - self.log_raw[where]
        for f in FAMILIES:
            inside = (where >= f.start) & (where < f.stop)
            out[inside] -= np.log(self.target[f].sum() - less[inside].sum() + f.stop - f.start)
        return out

    def weight(self, text: str | None, in_target: bool) -> float:
        """A document that is part of the target is judged by the others of it alone, as one without a label is."""
        where, n = ngram_counts(text)
        if in_target and self.usable and len(where):
            return float(self._ratios(where, n.astype("f8")) @ n)
        return float(self.all[where] @ n)


class _Score:
    """log_weight and key of each row; or, given a cut, the rows whose key reaches it."""

    def __init__(self, ratios, labels, seed: int, cut: float | None = None):
        self.ratios, self.labels, self.seed, self.cut = ratios, labels, seed, cut

    def gumbel(self, doc_id) -> float:
        u = (xxhash.xxh3_64_intdigest(str(doc_id).encode(), self.seed) + 0.5) / 2.0**64
        return float(-np.log(-np.log(u)))

    def __call__(self, batches):
        ratios, good = self.ratios.value, self.labels.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            weights = [ratios.weight(text, good.get(i, False)) for i, text in zip(ids, batch.column("text").to_pylist(), strict=True)]
            keys = [w + self.gumbel(i) for w, i in zip(weights, ids, strict=True)]
            if self.cut is None:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(weights, pa.float64()), pa.array(keys, pa.float64())], names=["doc_id", "log_weight", "key"])
            else:
                yield batch.filter(pa.array([k >= self.cut for k in keys], pa.bool_()))


def best_threshold(weights: np.ndarray, good: np.ndarray) -> float:
    """The middle of the widest gap among the best cuts; the rate of good rows kept counts GOOD times that of bad ones dropped."""
    if not good.any() or good.all():
        return float("-inf")
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    kept_good = g[::-1].cumsum()[::-1] / g.sum()  # if the cut is just below this row
    dropped_bad = np.concatenate([[0], (~g).cumsum()[:-1]]) / (~g).sum()
    value = GOOD * kept_good + dropped_bad
    value[1:][w[1:] == w[:-1]] = -1
    gap = np.diff(w, prepend=w[0] - 1)
    i = max(np.flatnonzero(value >= value.max() - 1e-12), key=lambda i: gap[i])
    return float(w[i] - gap[i] / 2)


def kth_largest(keys: DataFrame, k: int) -> float:
    """The value that k rows of `key` reach (more, if it comes more often); histograms narrow it down, MAX_SORTED values are sorted at most."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k >= n:
        return float("-inf")
    if k <= 0:
        return float("inf")
    above = 0
    inside = n
    while inside > MAX_SORTED and high > low:
        width = (high - low) / 1024
        if low + width == low:
            break
        at = F.least(F.floor((F.col("key") - low) / width), F.lit(1023)).alias("bin")
        bins = keys.where((F.col("key") >= low) & (F.col("key") <= high)).groupBy(at).agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()
        for b in sorted(bins, key=lambda b: -b["bin"]):
            if above + b["n"] >= k:
                low, high, inside = b["low"], b["high"], b["n"]
                break
            above += b["n"]
    if high == low:
        return low
    values = sorted((r["key"] for r in keys.where((F.col("key") >= low) & (F.col("key") <= high)).select("key").collect()), reverse=True)
    return values[k - above - 1]


class Classifier:
    def __init__(self, docs: DataFrame, labels: DataFrame, seed: int = 7):
        """docs: doc_id (long) and text; labels: doc_id and quality (1 good, 0 bad; null is no label; of several the smallest)."""
        spark = docs.sparkSession
        rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        some = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED).collect()
        known = {int(r["doc_id"]): r["quality"] == 1 for r in some}
        self.labels = spark.sparkContext.broadcast(known)
        counted = rows.mapInArrow(_Count(self.labels), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        raw, target = np.zeros(SIZE), np.zeros(SIZE)
        for r in counted.collect():  # SIZE rows at most
            raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
        usable = target.sum() > 0
        self.seed, self.ratios = seed, spark.sparkContext.broadcast(Ratios(raw, target))
        self.scored = held(rows.mapInArrow(_Score(self.ratios, self.labels, seed), "doc_id long, log_weight double, key double"))
        ids = spark.createDataFrame([(k,) for k in known], "labelled long")
        # A labelled id counts once, however often it comes: by the least weight of its rows.
        once = self.scored.join(F.broadcast(ids), F.col("doc_id") == F.col("labelled")).groupBy("doc_id").agg(F.min("log_weight").alias("log_weight"))
        pairs = once.orderBy("doc_id").collect() if known and usable else []
        weights, good = np.array([r["log_weight"] for r in pairs]), np.array([known[r["doc_id"]] for r in pairs], bool)
        self.threshold = best_threshold(weights, good) if len(pairs) else float("-inf")
        self.k = self.scored.where(F.col("log_weight") >= self.threshold).count()
        self.cut = kth_largest(self.scored, self.k)

    def decisions(self) -> DataFrame:
        """Every row: doc_id, log_weight, key, kept."""
        return self.scored.withColumn("kept", F.col("key") >= self.cut)

    def keep(self, docs: DataFrame) -> DataFrame:
        """The rows of docs, all columns, that are kept."""
        return docs.mapInArrow(_Score(self.ratios, self.labels, self.seed, self.cut), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, log_weight, key, kept of every row.

    Null and empty texts have weight 0. Rows of equal id and text have equal keys and share their fate; rows
    without an id share one draw, so beyond their weights they stay or go together. A labelled id that comes several times counts once. Of equal keys at the cut all stay. Without labels, or without good ones, all weights are 0 and every
    row is kept. No rows give no rows. Other columns are ignored.
    """
    return Classifier(docs, labels, seed).decisions()
