"""Vector code compression by Lloyd's algorithm with heaps.

A vector is cut into parts; each position of a part has a codebook, and a vector's code names each part's
nearest entry. Codebooks come from rounds of Lloyd's algorithm over integers, so all results are exact.

When a part is scanned, the gap between its distance to the second nearest entry (lower bound) and to its
own (upper bound) is kept, less what entries may since eat of it: each round moves a part's own entry and the one
that moves most of the others, and the sum of both, cumulated over rounds, is the entry's drift. In every
batch of rows each entry has a heap of its parts by that gap; only those whose gap the drift has
used up are popped and scanned again, all others keep their entry unseen. Gaps travel with the rows between rounds.

A round is one pass over the rows without a shuffle; what meets is the change of each entry's sums.
"""

from __future__ import annotations

import hashlib
import heapq
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.llm.common import held, join_once, new_folder

#: Widens what floating point may round, in parts of a distance.
ROUNDING = 1e-12
#: Rows of a batch, which is what heaps are built over.
ROWS = 8192
STATE = "vec_id long, label long, x binary, code binary, gap binary, sums binary"
_ARROW = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), *((c, pa.binary()) for c in ("x", "code", "gap", "sums"))])


def integers(vectors: pa.ListArray, scale: int, parts: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Length -> positions and floor(scale * component) of the vectors of that length that are whole: not null, no null, NaN or infinite component, as many components in each part."""
    lengths = np.asarray(vectors.value_lengths().fill_null(0))
    flat = vectors.flatten()
    values = np.asarray(flat.cast(pa.float64()).fill_null(np.nan))
    starts = np.cumsum(lengths) - lengths
    found = {}
    for n in np.unique(lengths[(lengths > 0) & (lengths % parts == 0)]).tolist():
        at = np.flatnonzero(lengths == n)
        x = values[starts[at, None] + np.arange(n)]
        whole = np.isfinite(x).all(1)
        most = isqrt((1 << 61) // n)  # beyond, squared distances would not fit a long
        with np.errstate(over="ignore"):
            found[n] = at[whole], np.clip(np.floor(x[whole] * scale), -most, most).astype("i8")
    return found


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all of x to all entries, exact."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if 4 * x.shape[1] * int(most) ** 2 < 1 << 53:  # exact in floating point
        a, b = x.astype("f8"), entries.astype("f8")
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1)


def scanned(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row (the first of equally near ones), and how much nearer it is than the second, rounded down."""
    d = distances(x, entries)
    own = d.argmin(1)
    upper = np.sqrt(d[np.arange(len(d)), own].astype("f8"))
    d = d.astype("f8")
    d[np.arange(len(d)), own] = np.inf
    return own, np.sqrt(d.min(1)) * (1 - ROUNDING) - upper * (1 + ROUNDING)


def violated(code: np.ndarray, gap: np.ndarray, drift: np.ndarray) -> list[int]:
    """Rows whose gap their entry's drift has used up, popped from a heap of each entry."""
    order = np.argsort(code, kind="stable")
    ends = np.cumsum(np.bincount(code, minlength=len(drift)))
    found = []
    for entry, (start, end) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
        rows = order[start:end]
        heap = list(zip(gap[rows].tolist(), rows.tolist(), strict=True))
        heapq.heapify(heap)
        while heap and heap[0][0] <= drift[entry]:
            found.append(heapq.heappop(heap)[1])
    return found


class _Round:
    """A pass over batches: codes under `books`, gaps, and a row with the change of sums for each batch.

    books: a codebook (entries x length of a part) for each position of a part; drift: the same entries' drift.
    """

    def __init__(self, shared):
        self.shared = shared

    def assign(self, x: np.ndarray, code: np.ndarray | None, gap: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        books, drift = self.shared.value
        parts, (k, width) = len(books), books[0].shape
        was = code
        code = np.zeros((len(x), parts), "u1") if code is None else code.copy()
        gap = np.full((len(x), parts), -np.inf) if gap is None else gap.copy()
        sums = np.zeros((parts, k, width + 1), "i8")
        for p in range(parts):
            mine = x[:, p * width : (p + 1) * width]
            again = np.arange(len(x)) if was is None else np.array(violated(code[:, p], gap[:, p], drift[p]), "i8")
            if not len(again):
                continue
            own, apart = scanned(mine[again], books[p])
            counted = np.concatenate([mine[again], np.ones((len(again), 1), "i8")], axis=1)
            moved = np.ones(len(again), bool) if was is None else own != code[again, p]
            np.add.at(sums[p], own[moved], counted[moved])
            if was is not None:
                np.subtract.at(sums[p], code[again, p][moved], counted[moved])
            code[again, p], gap[again, p] = own, apart + drift[p][own]
        return code, gap, sums

    def rows(self, ids, labels, x, code, gap):
        """Batches of rows and, last, one with their sums."""
        for i in range(0, len(x), ROWS):
            part = slice(i, i + ROWS)
            some = x[part]
            codes, gaps, sums = self.assign(some, None if code is None else code[part], None if gap is None else gap[part])
            n = len(some)
            binary = [pa.array([r.tobytes() for r in c], pa.binary()) for c in (some.astype("<i4"), codes, gaps)]
            yield pa.RecordBatch.from_arrays([ids.slice(i, n), labels.slice(i, n), *binary, pa.nulls(n, pa.binary())], schema=_ARROW)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in list(_ARROW)[:5]] + [pa.array([sums.tobytes()], pa.binary())], schema=_ARROW)


class _First(_Round):
    def __init__(self, shared, scale: int, parts: int, length: int):
        super().__init__(shared)
        self.scale, self.parts, self.length = scale, parts, length

    def __call__(self, batches):
        for batch in batches:
            at, x = integers(batch.column("embedding"), self.scale, self.parts).get(self.length, (None, None))
            if x is not None:
                yield from self.rows(batch.column("vec_id").take(pa.array(at)), batch.column("label").take(pa.array(at)), x, None, None)


def _of(batch, column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), kind).reshape(batch.num_rows, -1)


class _Later(_Round):
    def __call__(self, batches):
        for batch in batches:
            if batch.num_rows:
                yield from self.rows(batch.column("vec_id"), batch.column("label"), _of(batch, "x", "<i4").astype("i8"), _of(batch, "code", "u1"), _of(batch, "gap", "<f8"))


class _Smallest:
    """The first `entries` whole vectors of each batch, by id (null last), then components."""

    def __init__(self, scale: int, parts: int, entries: int):
        self.scale, self.parts, self.entries = scale, parts, entries

    def __call__(self, batches):
        for batch in batches:
            ids = batch.column("vec_id").to_pylist()
            rows = [(ids[i] is None, ids[i], x.tolist()) for at, xs in integers(batch.column("embedding"), self.scale, self.parts).values() for i, x in zip(at.tolist(), xs, strict=True)]
            rows = heapq.nsmallest(self.entries, rows, key=lambda r: (r[0], r[1] or 0, r[2]))
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], names=["vec_id", "x"])


class _Codes:
    """vec_id, label, code and error of rows of a round, whose books are these."""

    def __init__(self, shared):
        self.shared = shared

    def __call__(self, batches):
        for batch in batches:
            if batch.num_rows:
                x, code, books = _of(batch, "x", "<i4").astype("i8"), _of(batch, "code", "u1"), self.shared.value[0]
                near = np.concatenate([b[code[:, p]] for p, b in enumerate(books)], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code]), pa.array(((x - near) ** 2).sum(1))], names=["vec_id", "label", "code", "error"])


def _slots(batches):
    """slot, change: what the sums of a task come to, where it is not zero."""
    total = 0
    for batch in batches:
        for sums in batch.column("sums").to_pylist():
            total = total + np.frombuffer(sums, "<i8")
    if not isinstance(total, int):
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["slot", "change"])


def moves(old: list[np.ndarray], new: list[np.ndarray]) -> list[np.ndarray]:
    """For each entry how far it moved and how far the one of the others moved that moved most, rounded up."""
    found = []
    for a, b in zip(old, new, strict=True):
        far = np.sqrt(((a - b) ** 2).sum(1).astype("f8")) * (1 + ROUNDING)
        others = np.full(len(far), far.max(initial=0))
        if len(far):
            others[far.argmax()] = np.delete(far, far.argmax()).max(initial=0)
        found.append(far + others)
    return found


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every whole vector.

    vectors: vec_id (long), embedding (array of numbers), label (long); other columns are ignored. Rows
    whose vector is null, empty, holds a null, a NaN or an infinite component, or cannot be cut into equal parts go, and
    so do those of another length than the first of the rest. Components are clamped to +-sqrt(2**61 / length), so
    that errors fit a long; a label's sum that does not is null. The codebooks start as the parts of the `entries` smallest ids (null
    last; of one id by components); if there are fewer vectors, so are there entries. Equal ids are rows
    of their own, null labels are one label. No rows give no rows. entries: 256 at most.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    first = rows.select("vec_id", "embedding").mapInArrow(_Smallest(scale, parts, entries), "vec_id long, x array<bigint>")
    order = [F.asc_nulls_last("vec_id"), "x"]
    one = first.orderBy(*order).first()
    length = len(one["x"]) if one else parts
    start = first.where(F.size("x") == length).orderBy(*order).limit(entries).collect()
    width, k = length // parts, len(start)
    books = [np.array([r["x"][p * width : (p + 1) * width] for r in start], "i8").reshape(k, width) for p in range(parts)]
    drift = [np.zeros(k) for _ in range(parts)]
    sums: dict[int, int] = {}
    folder = None
    for n in range(rounds + 1):
        shared = spark.sparkContext.broadcast((books, drift))
        was, folder = folder, new_folder(spark, f"codes-{n}")
        if was is None:
            done = rows.mapInArrow(_First(shared, scale, parts, length), STATE)
        else:
            done = spark.read.parquet(was).where("sums is null").mapInArrow(_Later(shared), STATE)
        done.write.parquet(folder)
        if was is not None:
            _remove(spark, was)
        if n == rounds:
            break
        changed = spark.read.parquet(folder).where("sums is not null").select("sums").mapInArrow(_slots, "slot int, change long")
        for r in changed.groupBy("slot").agg(F.sum(F.col("change").cast("decimal(38,0)")).alias("change")).collect():  # parts x entries x (width + 1) at most
            sums[r["slot"]] = sums.get(r["slot"], 0) + int(r["change"])
        new = [b.copy() for b in books]
        for p in range(parts):
            for e in range(k):
                at = (p * k + e) * (width + 1)
                if count := sums.get(at + width, 0):
                    new[p][e] = [sums.get(at + i, 0) // count for i in range(width)]
        drift = [d + m for d, m in zip(drift, moves(books, new), strict=True)]
        books = new
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    coded = held(spark.read.parquet(folder).where("sums is null").select("vec_id", "label", "x", "code").mapInArrow(_Codes(shared), "vec_id long, label long, code string, error long"))
    _remove(spark, folder)
    coded = coded.withColumn("named", F.coalesce("label", F.lit(0))).withColumn("nameless", F.col("label").isNull())
    by_label = coded.groupBy("named", "nameless").agg(F.expr("try_cast(sum(cast(error as decimal(38,0))) as bigint)").alias("label_error"), F.count("*").alias("n"))
    joined = join_once(coded.select("vec_id", "code", "error", "named", "nameless"), by_label, ["named", "nameless"], spread=False)
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
