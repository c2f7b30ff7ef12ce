"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order: blocks of entries whose keys share prefixes with the
entry before, then a sparse index (the first key of each block), a Bloom filter over the ids and a
footer. A lookup reads the footer, asks the filter, bisects the index and scans one block.

    block    crc32 of the rest (u32) | zlib of entries; an entry: shared, rest, length (varints), key rest, value
    value    0 and u16 ids, or 1 and u32 ids (little-endian)
    index    for each block: key (13 bytes), offset u64, size u32, entries u32
    filter   u32 number of probes, then bits
    footer   offsets of index and filter u64 each, documents u64, ids u64, blocks u32, magic

A key is one byte (0: null id), the id as a sortable big-endian number, and a running number that
tells equal ids apart. Files are written through pyarrow's file systems, so that any URI they know
works; a task writes under a name of its own and the manifest lists those of finished tasks only. The
caller removes a folder that is no longer needed.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundspark.llm.common import file_system
from groundspark.llm.tokens import encoder

MAGIC = b"GSSST001"
FOOTER = struct.Struct("<QQQQI8s")
INDEX = struct.Struct("<13sQII")
BLOCK_BYTES = 1 << 16
BITS_A_KEY, PROBES = 10, 7
BATCH = 64
#: Bytes of text and documents a shard, about.
SHARD_BYTES, SHARD_DOCS = 1 << 28, 1 << 22
MANIFEST = "shard string, first_id long, last_id long, docs long, ids long"


def key_of(doc_id: int | None, nth: int = 0) -> bytes:
    return struct.pack(">BQI", doc_id is not None, (doc_id or 0) + (1 << 63), nth)


def id_of(key: bytes) -> int | None:
    known, value, _ = struct.unpack(">BQI", key)
    return value - (1 << 63) if known else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _hash(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key[:9])


def _probes(hashes: bytes, bits: int) -> np.ndarray:
    """Places in a filter of so many bits, a row a hash."""
    low, step = np.frombuffer(hashes, "<u8").reshape(-1, 2).T
    return (low[:, None] + np.arange(PROBES, dtype="u8") * (step[:, None] | np.uint64(1))) % np.uint64(bits)


class Writer:
    """Takes documents in ascending key order; memory is one block, the index, 16 bytes a document and the filter."""

    def __init__(self, out):
        self.out, self.at, self.blocks, self.hashes, self.docs, self.ids = out, 0, [], bytearray(), 0, 0
        self._entries, self._size, self._first, self._last, self._n = [], 0, b"", b"", 0

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian u32."""
        wide = np.frombuffer(ids, "<u4")
        narrow = not len(wide) or wide.max() < 1 << 16
        value = b"\0" + wide.astype("<u2").tobytes() if narrow else b"\1" + ids
        shared = 0
        if self._entries:
            while shared < len(key) and key[shared] == self._last[shared]:
                shared += 1
        else:
            self._first = key
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self._entries.append(entry)
        self._size += len(entry)
        self._last = key
        self._n += 1
        self.hashes += _hash(key)
        self.docs += 1
        self.ids += len(wide)
        if self._size >= BLOCK_BYTES:
            self._flush()

    def _write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def _flush(self) -> None:
        if self._entries:
            raw = zlib.compress(b"".join(self._entries), 1)
            raw = struct.pack("<I", zlib.crc32(raw)) + raw
            self.blocks.append((self._first, self.at, len(raw), self._n))
            self._write(raw)
            self._entries, self._size, self._n = [], 0, 0

    def close(self) -> None:
        self._flush()
        index_at = self.at
        self._write(b"".join(INDEX.pack(*b) for b in self.blocks))
        filter_at = self.at
        bits = max(64, BITS_A_KEY * self.docs + 7 & ~7)
        field = np.zeros(bits >> 3, "u1")
        for i in range(0, len(self.hashes), 1 << 20):
            at = _probes(bytes(self.hashes[i : i + (1 << 20)]), bits).ravel()
            np.bitwise_or.at(field, at >> np.uint64(3), np.uint8(128) >> (at & np.uint64(7)).astype("u1"))
        self._write(struct.pack("<I", PROBES) + field.tobytes())
        self._write(FOOTER.pack(index_at, filter_at, self.docs, self.ids, len(self.blocks), MAGIC))


class Reader:
    def __init__(self, source, size: int):
        self.source = source
        self.index_at, self.filter_at, self.docs, self.ids, blocks, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format, or a cut one")
        self.end = size - FOOTER.size
        self.blocks = list(INDEX.iter_unpack(self._at(self.index_at, blocks * INDEX.size)))

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def block(self, i: int):
        """(key, ids as little-endian u32) of one block."""
        _, offset, size, n = self.blocks[i]
        raw = self._at(offset, size)
        if struct.unpack("<I", raw[:4])[0] != zlib.crc32(raw[4:]):
            raise ValueError(f"block {i} is damaged")
        raw, at, key = zlib.decompress(raw[4:]), 0, b""
        for _ in range(n):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            length, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            value = raw[at : at + length]
            at += length
            yield key, value[1:] if value[0] else np.frombuffer(value, "<u2", offset=1).astype("<u4").tobytes()

    def __iter__(self):
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def may_hold(self, doc_id: int | None) -> bool:
        raw = self._at(self.filter_at + 4, self.end - self.filter_at - 4)
        return all(raw[p >> 3] >> (7 - p % 8) & 1 for p in _probes(_hash(key_of(doc_id)), 8 * len(raw))[0].tolist())

    def get(self, doc_id: int | None) -> list[bytes]:
        """ids of the documents with this id; none if there is none."""
        if not self.blocks or not self.may_hold(doc_id):
            return []
        low, found = key_of(doc_id), []
        for i in range(max(0, bisect_right([b[0] for b in self.blocks], low) - 1), len(self.blocks)):
            if self.blocks[i][0][:9] > low[:9]:
                break
            found += [ids for key, ids in self.block(i) if key[:9] == low[:9]]
        return found


def open_shard(uri: str) -> Reader:
    system, path = file_system(uri)
    source = system.open_input_file(path)
    return Reader(source, source.size())


class _Write:
    def __init__(self, folder: str, tokenizer: str, kind: str, end: int):
        self.folder, self.tokenizer, self.kind, self.end = folder, tokenizer, kind, np.array([end], "<u4").tobytes()

    def __call__(self, batches):
        enc, writer, last, nth = encoder(self.tokenizer, self.kind), None, None, 0
        system, folder = file_system(self.folder)
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                ids, texts = (c.to_pylist() for c in batch.slice(i, BATCH).columns[:2])
                for doc_id, raw in zip(ids, enc.encode(texts), strict=True):
                    if writer is None:
                        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.sst"  # in the order of ids
                        out = system.open_output_stream(f"{folder}/{name}")
                        writer, first = Writer(out), doc_id
                    nth = nth + 1 if writer.docs and doc_id == last else 0
                    last = doc_id
                    writer.add(key_of(doc_id, nth), raw + self.end)
        if writer:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [name], "first_id": pa.array([first], pa.int64()), "last_id": pa.array([last], pa.int64()), "docs": [writer.docs], "ids": [writer.ids]})


class _Footers:
    """The manifest's rows, whose counts must be those of the files."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, batches):
        for batch in batches:
            for name, docs, ids in zip(*(batch.column(x).to_pylist() for x in ("shard", "docs", "ids")), strict=True):
                reader = open_shard(f"{self.folder}/{name}")
                reader.source.close()
                if (reader.docs, reader.ids) != (docs, ids):
                    raise ValueError(f"{name} has {reader.docs} documents and {reader.ids} ids, the manifest {docs} and {ids}")
                yield pa.RecordBatch.from_pydict({"shard": [name], "ids": [reader.ids]})


class _Read:
    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, batches):
        for batch in batches:
            for name, start in zip(*(batch.column(x).to_pylist() for x in ("shard", "before")), strict=True):
                reader, docs, end = open_shard(f"{self.folder}/{name}"), 0, start
                end += reader.ids
                for i in range(len(reader.blocks)):
                    out = []
                    for key, raw in reader.block(i):
                        out.append((id_of(key), start, len(raw) // 4, zlib.crc32(raw)))
                        start += len(raw) // 4
                    docs += len(out)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                reader.source.close()
                if (docs, start) != (reader.docs, end):
                    raise ValueError(f"{name} does not hold what its footer says")


def write_shards(docs: DataFrame, folder: str, tokenizer: str, kind: str = "word", end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Writes shards and their manifest to folder (a URI); returns the manifest: shard, first_id, last_id, docs, ids.

    docs: doc_id (long) and text; other columns are ignored. A null text counts as empty; null ids come
    first; rows of equal id all stay, in an order fixed by their texts. No rows give no shard. Documents
    are dealt by ranges of the id and a hash of the text, so even one id with a third of all rows is spread.
    """
    spark = docs.sparkSession
    system, path = file_system(folder)
    system.create_dir(path)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("h", F.xxhash64("text"))
    if not shards:  # as many as the texts ask for, and no fewer than there are tasks
        count, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // SHARD_DOCS), -(-size // SHARD_BYTES))
    n = shards
    order = [F.asc("doc_id"), F.asc("h"), F.asc("row")]  # the last one parts equal rows
    ordered = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = ordered.mapInArrow(_Write(folder, tokenizer, kind, end_id), MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """From the files: doc_id, start (ids before it in all shards, by their footers), n_tokens, ids_crc32; one task a few shards."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    footers = manifest.mapInArrow(_Footers(folder), "shard string, ids long")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    starts = footers.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return starts.repartition(n).mapInArrow(_Read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, folder: str, doc_id: int | None) -> list[bytes]:
    """ids of the documents with this id, reading one block of each shard whose range and filter admit it."""
    m = spark.read.parquet(f"{folder}/manifest")
    hit = m.where(F.col("first_id").isNull()) if doc_id is None else m.where((F.coalesce(F.col("first_id"), F.lit(-(1 << 63))) <= doc_id) & (F.col("last_id") >= doc_id))
    return [ids for r in hit.collect() for ids in open_shard(f"{folder}/{r['shard']}").get(doc_id)]
