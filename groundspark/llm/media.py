"""Media columns: bytes stored as lossless WebP, and images decoded to pixel arrays."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.llm import webp

ROW = 192
#: Output rows a batch of pixel arrays; each pixel takes four bytes.
PIXEL_ROWS = 16


def payload_of(text: str | None) -> bytes:
    """UTF-8 of a text, filled with spaces to a positive multiple of ROW; None counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % ROW if raw else ROW)


def features(images: list[tuple[int, int, np.ndarray]], size: int) -> str:
    """Of the green samples of all images, the first `size` of them: mean, deviation, roughness along rows, eight-bin histogram; whole numbers."""
    return features_of(samples(images, size))


def samples(images: list[tuple[int, int, np.ndarray]], size: int) -> np.ndarray:
    """The green samples (u1) of all images, the first `size` of them."""
    return np.concatenate([np.zeros(0, "u1"), *((argb >> 8).astype("u1") for _, _, argb in images)])[:size]


def features_of(v: np.ndarray) -> str:
    counts, values, n = np.bincount(v, minlength=256), np.arange(256), max(1, len(v))
    mean = int(counts @ values) * 1000 // n
    spread = int(counts @ (values * values)) * 1000 // n - mean * mean // 1000
    rough = int(np.abs(np.diff(v.astype("i2"))).sum(dtype="i8")) * 1000 // n
    return ",".join(map(str, [mean, spread, rough, *counts.reshape(8, 32).sum(1).tolist()]))


def _store(batches):
    for batch in batches:
        for i in range(0, batch.num_rows, 128):
            ids, texts = batch.slice(i, 128).columns
            sizes, payloads = [], []
            for t in texts.to_pylist():
                payloads.append(payload_of(t))
                sizes.append(len(t.encode("utf-8", "surrogatepass")) if t else 0)
            media = webp.encode_many(payloads, ROW)
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array([len(p) for p in payloads], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "payload_bytes", "media"])


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Writes a media table to folder and returns it: doc_id, n_bytes, payload_bytes, media (WebP files, one after the other where one cannot hold a text).

    docs: doc_id (long) and text; other columns are ignored. A null text counts as empty; rows of equal
    text get equal media; repeated rows and null ids stay. No rows give an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows.mapInArrow(_store, "doc_id long, n_bytes long, payload_bytes long, media binary").write.parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def _decoded(raw: bytes | None):
    """Images of a value, or why there are none."""
    try:
        return (webp.decode(raw) if raw else []), None
    except (ValueError, IndexError, OverflowError, struct.error) as error:
        return None, f"{type(error).__name__}: {error}"


def _pixels(batches):
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
    for batch in batches:
        for i in range(0, batch.num_rows, PIXEL_ROWS):
            part, out = batch.slice(i, PIXEL_ROWS), []
            for k, raw in zip(part.column("doc_id").to_pylist(), part.column("media").to_pylist(), strict=True):
                images, error = _decoded(raw)
                out += [(k, None, None, None, None, error)] if error else [(k, n, w, h, argb.astype("<u4").tobytes(), None) for n, (w, h, argb) in enumerate(images)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "image", "width", "height", "argb", "error"])


def pixel_arrays(media: DataFrame) -> DataFrame:
    """Decoded images: doc_id, image (from 0 in its row), width, height, argb (little-endian u32 a pixel, row by row), error.

    media: doc_id and media (any lossless WebP files); other columns are ignored. A null or empty value has
    no image; a damaged one, or one of another kind, has one row without an image that says what is wrong.
    """
    return media.select("doc_id", "media").mapInArrow(_pixels, "doc_id long, image int, width int, height int, argb binary, error string")


def _digest(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    for batch in batches:
        out = []
        for doc_id, n, size, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            images, error = _decoded(raw)
            if error:
                out.append((doc_id, n, None, None, None, len(raw), hashlib.sha256(raw).hexdigest(), None))
                continue
            green = samples(images, size)
            got = green.tobytes()
            out.append((doc_id, n, len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-16:]), len(raw), hashlib.sha256(raw).hexdigest(), features_of(green)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def digests(media: DataFrame) -> DataFrame:
    """Of a media table's images, decoded: the payload's size, hash and tail, the stored form's size and hash, and features; of a damaged value only the stored form's."""
    return media.select("doc_id", "n_bytes", "payload_bytes", "media").mapInArrow(_digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
