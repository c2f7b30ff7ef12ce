"""SimHash near-dedup by a binary trie self-join.

Distinct fingerprints are joined to themselves: two nodes of a binary trie at the same depth are
visited together with the number of bits in which their paths differ, and a pair of nodes is left as
soon as that number exceeds the error budget. To deal the work out, the bits are cut into blocks, more
than the budget: two fingerprints within the budget agree in all but so many blocks, so they meet in
the group of one choice of blocks. A group that many share is dealt out again, by blocks of the bits that
are still free; one that stays large is cut into chunks by a hash, and each pair of chunks is a trie join
of its own. Joins report links of a spanning forest of what they have linked, never all pairs of a group.

Components come from rounds of star contraction over those links, each a pair of aggregations.

Few differing bits mean near-equal texts only; where a likeness of shingle sets is asked for, texts
that share a band of MinHash values are candidates too, and each such link is confirmed by the exact
Jaccard similarity of the two sets.
"""

from __future__ import annotations

import re
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.llm.common import held, join_once, small

BITS = 64
CHUNK = 1000
#: Groups of more chunks are dealt out again.
DEAL = 16
#: Nodes of so few values are compared outright.
LEAF = 4
#: MinHash bands and values a band: of pairs with Jaccard 0.8 all but 1 - (1 - 0.8 ** 5) ** 32, some 3 in a million, share a band.
BANDS, BAND_ROWS = 32, 5
_ODD = np.random.default_rng(8).integers(0, 1 << 63, (2, BANDS * BAND_ROWS, 1), dtype="u8") * np.uint64(2) + np.uint64(1)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of so many words, joined by spaces; of all words if they are fewer; nothing without words."""
    found = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not found:
        return np.zeros(0, "u8")
    joined = b" ".join(found)
    lengths = np.fromiter(map(len, found), "i8", len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(found) - words + 1)
    ends = ends[min(words, len(found)) - 1 :]
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    return np.fromiter((digest(view[a:b], seed) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)), "u8", n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    counts = np.zeros(BITS, "i8")
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].astype(">u8").view("u1").reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype="i8")
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def bands(distinct: np.ndarray) -> list[int]:
    """A hash of each band of MinHash values of a set of shingle hashes; nothing for the empty set."""
    if not len(distinct):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo("u8").max, "u8")
    for i in range(0, len(distinct), 1 << 12):
        np.minimum(least, (distinct[i : i + (1 << 12)] * _ODD[0] + _ODD[1]).min(1), out=least)
    return [xxhash.xxh64_intdigest(b.tobytes()) - (1 << 63) for b in least.reshape(BANDS, BAND_ROWS)]


def _set_of(distinct: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(distinct.tobytes()) - (1 << 63)


class _Fingerprints:
    def __init__(self, words: int, banded: bool):
        self.words, self.banded = words, banded

    def __call__(self, batches):
        for batch in batches:
            hashes = [shingle_hashes(t, self.words) for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            rest = [(n, c) for k, (n, c) in enumerate(zip(batch.schema.names, batch.columns, strict=True)) if k != at]
            rest.append(("fp", pa.array(np.array([fingerprint(h) for h in hashes], "u8").view("i8"))))
            if self.banded:
                sets = [np.unique(h) for h in hashes]
                rest += [("set", pa.array([_set_of(x) for x in sets], pa.int64())), ("bands", pa.array([bands(x) for x in sets], pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([c for _, c in rest], names=[n for n, _ in rest])


def fingerprints(docs: DataFrame, words: int = 4, banded: bool = False) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint's 64 bits as a long) of every row; null and wordless texts have 0. Banded: also set and bands."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string"))
    return rows.mapInArrow(_Fingerprints(words, banded), "doc_id long, text_hash long, fp long" + (", set long, bands array<long>" if banded else ""))


class Links:
    """Union-find over the positions of one task's fingerprints, and the links that joined two sets."""

    def __init__(self, n: int):
        self.root, self.found = list(range(n)), []

    def top(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.top(i), self.top(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)
            self.found.append((i, j))


def trie_join(left: np.ndarray, right: np.ndarray | None, errors: int) -> list[tuple[int, int]]:
    """Links (values) of a spanning forest of pairs within `errors` bits; right None: of left with itself. Values are distinct u8."""
    both = left if right is None else np.concatenate([left, right])
    order = np.argsort(both, kind="stable")
    values = both[order]
    side = order >= len(left)
    links = Links(len(values))
    # A node is a range of the sorted values and a depth; pairs of nodes carry the bits in which they differ.
    stack = [(0, len(values), 0, len(values), BITS - 1, 0)] if len(values) else []
    while stack:
        a0, a1, b0, b1, bit, spent = stack.pop()
        same = a0 == b0
        if right is not None and (not (side[a0:a1].any() and not side[b0:b1].all() or not side[a0:a1].all() and side[b0:b1].any())):
            continue
        if same and a1 - a0 < 2:
            continue
        if spent + bit + 1 <= errors and same:  # whatever bits follow, the budget holds
            for i in range(a0 + 1, a1):
                links.join(a0, i)
            continue
        if (a1 - a0) * (b1 - b0) <= LEAF * LEAF or bit < 0:
            if len({links.top(i) for i in (*range(a0, a1), *range(b0, b1))}) == 1:
                continue  # all linked already
            d = np.bitwise_count(values[a0:a1, None] ^ values[None, b0:b1]) <= errors
            for i, j in zip(*(x.tolist() for x in np.nonzero(d)), strict=True):
                if a0 + i != b0 + j:
                    links.join(a0 + i, b0 + j)
            continue
        half = np.uint64(1 << bit)

        def split(lo: int, hi: int) -> int:
            head = values[lo] >> np.uint64(bit + 1) << np.uint64(bit + 1) if bit < BITS - 1 else np.uint64(0)
            return lo + int(np.searchsorted(values[lo:hi], head | half))

        am = split(a0, a1)
        bm = am if same else split(b0, b1)
        pairs = [(a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1)] + ([] if same else [(am, a1, b0, bm, 1)])
        stack += [(w, x, y, z, bit - 1, spent + e) for w, x, y, z, e in pairs if w < x and y < z and spent + e <= errors]
    return [(int(values[i]), int(values[j])) for i, j in links.found]


def _join_chunks(errors: int):
    def run(key, table):
        chunk_a, chunk_b = key[2].as_py(), key[3].as_py()
        chunk, fp = table.column("chunk").to_numpy(), table.column("fp").to_numpy().view("u8")
        other = None if chunk_a == chunk_b else fp[chunk == chunk_b]
        pairs = np.array(trie_join(fp[chunk == chunk_a], other, errors), "u8").reshape(-1, 2).view("i8")
        return pa.table({"u": pairs[:, 0], "v": pairs[:, 1]})

    return run


def _long(mask: int) -> int:
    return mask - (1 << BITS) if mask >> BITS - 1 else mask


def choices(taken: int, blocks: int, errors: int) -> list[int]:
    """Masks of `taken` and all but `errors` blocks of the other bits: in one of them any two values that agree in taken and are within the budget agree."""
    free = [1 << b for b in range(BITS) if not taken >> b & 1]
    ends = [len(free) * i // blocks for i in range(blocks + 1)]
    parts = [sum(free[a:z]) for a, z in zip(ends, ends[1:])]
    return [taken | sum(c) for c in combinations(parts, blocks - errors)]


def block_masks(n: int, errors: int) -> list[int]:
    """Masks, as longs, of the choices of blocks in one of which any two values within the budget agree.

    The more values, the more blocks and the more bits a choice holds, so that groups stay about as large.
    """
    blocks = errors + 1
    while n > CHUNK * 2 ** (BITS * (blocks - errors) // blocks - 2) and comb(blocks + 1, errors) <= 100:
        blocks += 1
    return [_long(m) for m in choices(0, blocks, errors)]


def _grouped(rows: DataFrame) -> DataFrame:
    """rows (fp, mask, ...) with head, n and chunks of their group of one mask and head; groups of one are left out."""
    headed = rows.withColumn("head", F.col("fp").bitwiseAND(F.col("mask")))
    sizes = headed.groupBy("mask", "head").agg(F.count("*").alias("n")).where("n > 1")
    return held(join_once(headed, sizes.select("*", F.col("n").alias("size"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), ["mask", "head"]))


def links(distinct: DataFrame, errors: int = 4) -> DataFrame:
    """u, v: links that connect whatever fingerprints within `errors` bits connect. distinct: fp (long), each once.

    A group of more than DEAL chunks is dealt out again if its parts then make fewer rows than its pairs of
    chunks do; near copies of one text agree in almost all bits, so no bits divide them.
    """
    spark = distinct.sparkSession
    masks = block_masks(distinct.count(), errors)
    groups = _grouped(distinct.select("fp", F.explode(F.array(*map(F.lit, masks))).alias("mask")))
    large = groups.where(F.col("chunks") > DEAL)
    tasks = groups.select("mask", "head", "fp", "chunks")
    if not large.isEmpty():
        finer = spark.createDataFrame([(m, _long(x)) for m in masks for x in choices(m & (1 << BITS) - 1, errors + 2, errors)], "its_mask long, finer long")
        again = large.select("fp", F.col("mask").alias("of_mask"), F.col("head").alias("of_head")).join(F.broadcast(finer), F.col("of_mask") == F.col("its_mask")).select("fp", "of_mask", "of_head", F.col("finer").alias("mask"))
        parts = _grouped(again)
        cost = parts.groupBy("of_mask", "of_head").agg(F.sum("chunks").alias("parts"))
        whole = large.groupBy("mask", "head").agg(F.sum("chunks").alias("whole"))
        # A group's rows are its fingerprints times its chunks, before and after.
        divided = held(whole.join(cost, (F.col("mask") == F.col("of_mask")) & (F.col("head") == F.col("of_head")), "left").where(F.coalesce("parts", F.lit(0)) < F.col("whole")).select(F.col("mask").alias("d_mask"), F.col("head").alias("d_head")))
        few = small(divided)  # groups of more than DEAL * CHUNK of all fingerprints, a mask each
        kept = tasks.join(few, (F.col("mask") == F.col("d_mask")) & (F.col("head") == F.col("d_head")), "left_anti")
        tasks = kept.unionByName(parts.join(few, (F.col("of_mask") == F.col("d_mask")) & (F.col("of_head") == F.col("d_head")), "left_semi").select("mask", "head", "fp", "chunks"))
    tasks = tasks.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    # A chunk goes to each pair of chunks that it is in.
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(k, F.col("chunk")).alias("a"), F.greatest(k, F.col("chunk")).alias("b")))
    dealt = tasks.select("mask", "head", "fp", "chunk", F.explode(pairs).alias("p")).select("mask", "head", "p.a", "p.b", "fp", "chunk")
    return dealt.groupBy("mask", "head", "a", "b").applyInArrow(_join_chunks(errors), "u long, v long")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sets, each sorted and without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def set_join(left: list[np.ndarray], right: list[np.ndarray] | None, least: float) -> list[tuple[int, int]]:
    """Links (positions, right after left) of a spanning forest of the pairs with Jaccard >= least; right None: of left with itself."""
    sets = left + (right or [])
    links = Links(len(sets))
    groups: list[list[int]] = []  # what is linked; a set is tried on each group until one member is alike
    for i, x in enumerate(sets):
        apart, mine = [], [i]
        for group in groups:
            for j in group:
                y = sets[j]
                if (right is None or (j < len(left)) != (i < len(left))) and min(len(x), len(y)) >= least * max(len(x), len(y)) and jaccard(x, y) >= least:
                    links.join(j, i)
                    mine = group + mine
                    break
            else:
                apart.append(group)
        groups = [*apart, mine]
    return links.found


def _join_sets(least: float):
    def run(key, table):
        chunk_a, chunk_b = key[2].as_py(), key[3].as_py()
        chunk, fp = table.column("chunk").to_numpy(), table.column("fp").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), "u8") for x in table.column("hashes")]
        one, other = np.flatnonzero(chunk == chunk_a).tolist(), np.flatnonzero(chunk == chunk_b).tolist()
        pairs = set_join([sets[i] for i in one], None if chunk_a == chunk_b else [sets[i] for i in other], least)
        at = one if chunk_a == chunk_b else one + other
        return pa.table({"u": pa.array([int(fp[at[i]]) for i, _ in pairs], pa.int64()), "v": pa.array([int(fp[at[j]]) for _, j in pairs], pa.int64())})

    return run


def _shingle_sets(words: int):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                sets = [np.unique(shingle_hashes(t, words)) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_set_of(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["set", "hashes"])

    return run


def alike(docs: DataFrame, prints: DataFrame, words: int, least: float) -> DataFrame:
    """u, v: links between fingerprints of texts whose shingle sets have Jaccard >= least.

    prints: the banded fingerprints of docs. Equal sets are linked at once; unlike ones are compared where
    they share a band, each bucket in chunks as in `links`. Buckets of the same sets are compared once.
    """
    sets = prints.where(F.size("bands") > 0).groupBy("set").agg(F.min("fp").alias("fp"), F.min("text_hash").alias("text_hash"), F.any_value("bands").alias("bands"))
    sets = held(sets)
    equal = prints.select("set", F.col("fp").alias("v")).distinct().join(sets.select("set", F.col("fp").alias("u")), "set").where("u <> v").select("u", "v")
    keyed = sets.select("set", "fp", F.posexplode("bands").alias("i", "head"))
    sizes = keyed.groupBy("i", "head").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("set")).alias("members")).where("n > 1")
    once = sizes.groupBy("n", "members").agg(F.min(F.struct("i", "head")).alias("b")).select("b.i", "b.head", "n", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    chunked = held(join_once(keyed, once, ["i", "head"]).withColumn("chunk", F.pmod(F.xxhash64("fp", "set"), F.col("chunks")).cast("int")))
    asked = chunked.select("set").distinct().join(sets, "set").select(F.col("text_hash").alias("its_hash")).distinct()
    texts = docs.select(F.xxhash64("text").alias("its_hash"), F.col("text").cast("string").alias("text")).join(asked, "its_hash", "left_semi").dropDuplicates(["its_hash"])
    hashes = texts.select("text").mapInArrow(_shingle_sets(words), "set long, hashes binary")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(k, F.col("chunk")).alias("a"), F.greatest(k, F.col("chunk")).alias("b")))
    tasks = chunked.select("i", "head", "fp", "set", "chunk", F.explode(pairs).alias("p")).select("i", "head", "p.a", "p.b", "fp", "set", "chunk").join(hashes, "set")
    return equal.unionByName(tasks.groupBy("i", "head", "a", "b").applyInArrow(_join_sets(least), "u long, v long"))


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of u-v edges: root is the smallest node reachable.

    Rounds of large and small stars until nothing changes; each node's smallest neighbour comes from a
    pre-aggregated minimum and goes back to its edges by `join_once`, so a node with many edges is no task
    of its own.
    """
    now = held(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        large = held(join_once(both.where("v > u"), least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_once(large, least, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = held(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        was, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == was:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select("v", "v").distinct().toDF("node", "root"))


def near_rows(docs: DataFrame, words: int = 4, errors: int = 4, least: float | None = None) -> DataFrame:
    """Every row: doc_id, text_hash, fp, root (one value a group), component_id as near_groups says.

    least: rows whose shingle sets have at least that Jaccard similarity are linked too.
    """
    prints = held(fingerprints(docs, words, least is not None))
    distinct = held(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")))
    found = links(distinct.select("fp"), errors)
    if least is not None:
        found = found.unionByName(alike(docs, prints, words, least))
    roots = held(components(found))
    labelled = held(distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rows", "least", F.coalesce("root", "fp").alias("root")))
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    by_fp = join_once(labelled.select("fp", "rows", "root"), smallest, ["root"])
    return join_once(prints.select("doc_id", "text_hash", "fp"), by_fp.select("fp", "root", "component_id", F.col("rows").alias("n")), ["fp"])


def near_groups(docs: DataFrame, words: int = 4, errors: int = 4) -> DataFrame:
    """Every row: doc_id, fp, component_id (the smallest id of the rows reachable by links, itself included).

    docs: doc_id (long) and text; other columns are ignored. Null, empty and wordless texts have the
    fingerprint 0 and link like any other; a null id counts only where a group has no other (then the
    component is null); repeated rows stay. No rows give no rows.
    """
    return near_rows(docs, words, errors).select("doc_id", "fp", "component_id")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
