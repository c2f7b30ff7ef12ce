"""Language identification by prediction by partial matching over bytes.

For each language, counts of the bytes that follow contexts of up to ORDER bytes are gathered from
all labelled training rows and then frozen. The code length of a byte is that of the longest context
known, or an escape from it and the code length under the next shorter one, from which the bytes that
the longer one knows are excluded, down to equal shares of what is left; so after any context the shares
of all bytes sum to one. The language under which a text is shortest is its language. All contexts and
all languages are kept, so the model grows with what the corpus holds; it lies in the shared folder, and
tasks map its files.
"""

from __future__ import annotations

import io
import re
import shutil
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.llm.common import file_system, new_folder

ORDER = 3
#: A size's tables: grams and their counts; contexts, how often they come, how many bytes follow them, and both for
#: the next shorter context without the bytes that follow this one.
NAMES = ("grams", "counts", "contexts", "total", "kinds", "left_total", "left_kinds")
#: The bytes of a gram that belong to a context of each size and the byte after it.
MASKS = (0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF)
#: Cells of a table that the driver works on at a time.
CELLS = 1 << 21
_LETTER = re.compile(r"[^\W\d_]")
PAD = b"\n" * ORDER


def grams(data: np.ndarray) -> np.ndarray:
    """Each byte with the three before it, as numbers; data begins with PAD."""
    d = data.astype("u4")
    return d[:-3] << 24 | d[1:-2] << 16 | d[2:-1] << 8 | d[3:]


def _count(batches):
    """Counts of a partition, by language; merged whenever they have doubled."""
    have: dict[str, list] = {}

    def merged(parts):
        keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return [(keys, np.bincount(where, np.concatenate([n for _, n in parts])).astype("i8"))]

    for batch in batches:
        langs, texts = (c.to_pylist() for c in batch.columns[:2])
        for i in range(0, len(texts), 512):
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(langs[i : i + 512], texts[i : i + 512], strict=True):
                by.setdefault(lang, []).append(PAD + text.encode("utf-8", "surrogatepass"))
            for lang, raws in by.items():
                keys, n = np.unique(np.concatenate([grams(np.frombuffer(r, "u1")) for r in raws]), return_counts=True)
                parts = have.setdefault(lang, [])
                parts.append((keys, n))
                if len(parts) > 8:
                    have[lang] = merged(parts)
    for lang, parts in have.items():
        keys, n = merged(parts)[0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype("i8")), pa.array(n)], names=["lang", "gram", "n"])


def _rows(table: np.ndarray, keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """table's rows of the asked keys (ascending), zeros for those that are not among them."""
    out = np.zeros((len(asked), table.shape[1]))
    if len(keys):
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        hit = keys[at] == asked
        out[hit] = table[at[hit]]
    return out


def code_lengths(tables: list[dict[str, np.ndarray]], asked: np.ndarray, width: int) -> np.ndarray:
    """Bits of each asked gram's last byte after the bytes before it, gram x language."""
    bits, done = np.zeros((len(asked), width)), np.zeros((len(asked), width), bool)
    above = np.zeros((len(asked), width), bool)  # a longer context is known, so its bytes are excluded
    left_total = left_kinds = np.zeros((len(asked), width))
    left = 256.0 * np.ones((len(asked), width))  # bytes that no known context excludes
    for size in range(ORDER, -1, -1):
        t, gram = tables[size], asked & np.uint32(MASKS[size])
        n, whole, follow = _rows(t["counts"], t["grams"], gram), _rows(t["total"], t["contexts"], gram >> 8), _rows(t["kinds"], t["contexts"], gram >> 8)
        total, kinds = np.where(above, left_total, whole), np.where(above, left_kinds, follow)
        escape = np.where(follow < 256, kinds, 0)  # from a context that all bytes follow there is no escape
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = ~done & (n > 0)
            bits += np.where(hit, np.log2(total + escape) - np.log2(n), 0.0)
            bits += np.where(~done & ~hit & (escape > 0), np.log2(total + escape) - np.log2(escape), 0.0)
        done |= hit
        above |= whole > 0
        left = np.where(whole > 0, 256 - follow, left)
        if size:
            left_total, left_kinds = _rows(t["left_total"], t["contexts"], gram >> 8), _rows(t["left_kinds"], t["contexts"], gram >> 8)
            # Where this context is not known, the next one is entered as a whole.
    with np.errstate(divide="ignore"):
        return bits + np.where(done, 0.0, np.log2(left))


class Model:
    """The tables of each size of context, 0 to ORDER, and the code lengths of all whole grams known, in a shared folder; tasks map the files."""

    def __init__(self, langs: list[str], folder: str):
        self.langs, self.folder, self.tables, self.known = langs, folder, None, None

    def __getstate__(self):
        return {"langs": self.langs, "folder": self.folder, "tables": None, "known": None}

    def _load(self, name: str) -> np.ndarray:
        system, path = file_system(f"{self.folder}/{name}.npy")
        if isinstance(system, fs.LocalFileSystem):
            return np.asarray(np.load(path, mmap_mode="r"))
        with system.open_input_file(path) as f:
            return np.load(io.BytesIO(f.read()))

    def score(self, raw: bytes) -> np.ndarray:
        """Bits of a text under each language."""
        if self.tables is None:
            self.tables = [{name: self._load(f"{name}-{size}") for name in NAMES} for size in range(ORDER + 1)]
            self.known = self.tables[ORDER]["grams"], self._load("lengths")
        known, lengths = self.known
        d = np.frombuffer(PAD + raw, "u1")
        total = np.zeros(len(self.langs))
        for i in range(0, len(d) - ORDER, 1 << 14):
            asked = np.sort(grams(d[i : i + (1 << 14) + ORDER]))
            at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            hit = known[at] == asked
            total += lengths[at[hit]].sum(0, dtype="f8")
            if not hit.all():
                total += code_lengths(self.tables, asked[~hit], len(self.langs)).sum(0)
        return total


def _tables_of(size: int, keys: np.ndarray, column: np.ndarray, n: np.ndarray, width: int, shorter: dict | None, local: str) -> dict[str, np.ndarray]:
    """A size's tables as files, some contexts at a time."""
    pairs, where = np.unique((keys & np.uint32(MASKS[size])).astype("i8") * width + column, return_inverse=True)
    counts = np.bincount(where, n)
    gram, lang = pairs // width, pairs % width
    known, contexts = np.unique(gram), np.unique(gram >> 8)
    shape = {"counts": len(known), **dict.fromkeys(("total", "kinds", "left_total", "left_kinds"), len(contexts))}
    t = {name: np.lib.format.open_memmap(f"{local}/{name}-{size}.npy", "w+", "f4" if "kinds" in name else "f8", (rows, width)) for name, rows in shape.items()}
    step = max(1, CELLS // (width * 256))
    for c in range(0, len(contexts), step):
        some = contexts[c : c + step]
        g0, g1 = np.searchsorted(known, [some[0] << 8, (some[-1] << 8) + 256])
        p0, p1 = np.searchsorted(gram, [some[0] << 8, (some[-1] << 8) + 256])
        have = np.zeros((g1 - g0, width))
        have[np.searchsorted(known[g0:g1], gram[p0:p1]), lang[p0:p1]] = counts[p0:p1]
        starts = np.searchsorted(known[g0:g1] >> 8, some)
        t["counts"][g0:g1] = have
        t["total"][c : c + step], t["kinds"][c : c + step] = np.add.reduceat(have, starts), np.add.reduceat((have > 0).astype("f8"), starts)
        if shorter:
            below = _rows(shorter["counts"], shorter["grams"], known[g0:g1] & MASKS[size - 1])
            of = some & (MASKS[size - 1] >> 8)
            t["left_total"][c : c + step] = _rows(shorter["total"], shorter["contexts"], of) - np.add.reduceat(np.where(have > 0, below, 0), starts)
            t["left_kinds"][c : c + step] = _rows(shorter["kinds"], shorter["contexts"], of) - t["kinds"][c : c + step]
    t |= {"grams": known.astype("u4"), "contexts": contexts.astype("u4")}
    for name in ("grams", "contexts"):
        np.save(f"{local}/{name}-{size}.npy", t[name])
    return t


def fit_tables(langs: list[str], keys: np.ndarray, column: np.ndarray, n: np.ndarray, folder: str) -> Model:
    """keys: grams (u4), column: positions in langs, n: counts. Writes the model's files; tables are built on disk, some contexts at a time."""
    system, path = file_system(folder)
    system.create_dir(path)
    width = len(langs)
    with tempfile.TemporaryDirectory() as local:
        tables: list[dict] = []
        for size in range(ORDER + 1):
            tables.append(_tables_of(size, keys, column, n, width, tables[-1] if tables else None, local))
        known = tables[ORDER]["grams"]
        lengths = np.lib.format.open_memmap(f"{local}/lengths.npy", "w+", "f4", (len(known), width))
        step = max(1, CELLS // (8 * width))
        for i in range(0, len(known), step):
            lengths[i : i + step] = code_lengths(tables, known[i : i + step], width)
        lengths.flush()
        for name in ["lengths", *(f"{x}-{size}" for size in range(ORDER + 1) for x in NAMES)]:
            with open(f"{local}/{name}.npy", "rb") as f, system.open_output_stream(f"{path}/{name}.npy") as out:
                shutil.copyfileobj(f, out, 1 << 20)
    return Model(langs, folder)


def train(rows: DataFrame) -> Model | None:
    """rows: lang and text, both without nulls. None if there is none."""
    spark = rows.sparkSession
    folder = new_folder(spark, "grams")
    rows.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).write.parquet(folder)
    system, path = file_system(folder)
    table = pq.read_table(path, filesystem=system)  # a row a gram and language, however many rows were read
    if not table.num_rows:
        return None
    coded = table.column("lang").combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    langs = sorted(names)
    place = {x: i for i, x in enumerate(langs)}
    column = np.array([place[x] for x in names], "i8")[coded.indices.to_numpy()]
    return fit_tables(langs, table.column("gram").to_numpy().astype("u4"), column, table.column("n").to_numpy(), new_folder(spark, "model"))


class _Predict:
    def __init__(self, model):
        self.model = model

    def __call__(self, batches):
        model = self.model.value
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                if not text or model is None or not _LETTER.search(text):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                bits = model.score(text.encode("utf-8", "surrogatepass"))
                best = int(bits.argmin())
                langs.append(model.langs[best])
                scores.append(float(1 / np.exp2(np.clip(bits[best] - bits, -1000, 0)).sum()))
            at = batch.schema.get_field_index("text")
            rest = [(n, c) for k, (n, c) in enumerate(zip(batch.schema.names, batch.columns, strict=True)) if k != at]
            yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[n for n, _ in rest] + ["lang_pred", "score"])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the language's share of the probability) of every row.

    docs: doc_id (long), text, held_out (boolean). `und` with score 0 for texts that are null or have no
    letter, and for all if there was nothing to learn from. Ties go to the first language by name; repeated
    rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text", "held_out").mapInArrow(_Predict(shared), "doc_id long, held_out boolean, lang_pred string, score double")


def held_out_accuracy(spark: SparkSession, predicted: DataFrame, docs: DataFrame) -> float:
    joined = predicted.where("held_out").join(docs.where("lang is not null").select("doc_id", "lang"), "doc_id")
    return joined.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
