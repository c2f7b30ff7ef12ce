"""Line dedup by overlapping windows of three lines.

Every three consecutive lines of a document make a window. A window that occurs again, anywhere in
the corpus, is a repeat of its first occurrence (smallest id, then first position); the lines that
repeats cover, merged, are removed. Only DataFrame functions. Windows are compared by two 64-bit
hashes of their lines together; the first occurrence comes from a pre-aggregated minimum, and a window
that many documents share meets it by a broadcast bounded in rows, so it is no task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundspark.llm.common import held, join_once, small

LINES = 3


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, also where f uses it in a lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _hashes(lines: Column, n: int = LINES) -> Column:
    """array<struct<a, b>>: two hashes of each window of n lines; none for shorter texts."""

    def windows(own: Column) -> Column:
        part = lambda i: [F.element_at(own, (i + k).cast("int")) for k in range(n)]
        hashes = lambda i: F.struct(F.xxhash64(*part(i)).alias("a"), F.xxhash64(F.lit("second"), *part(i)).alias("b"))
        return F.when(F.size(own) >= n, F.transform(F.sequence(F.lit(1), F.size(own) - n + 1), hashes))

    return _let(lines, windows)


def repeated_lines(docs: DataFrame, n: int = LINES) -> DataFrame:
    """doc_id, text_hash, covered (ascending positions from 0 of the lines to remove): documents with any.

    docs: doc_id, text. Lines end at \\n; texts of fewer than n lines and null texts have no window. A
    null id comes first. Rows of equal id and text count as one occurrence. Within a document a later
    window that overlaps its own first occurrence is a repeat like others.
    """
    own = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(_hashes(F.split("text", "\n"), n)).alias("at", "w"))
    windows = own.select("doc_id", "text_hash", "at", "w.a", "w.b")
    first = windows.groupBy("a", "b").agg(F.min(F.struct("doc_id", "text_hash", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = join_once(windows, first, ["a", "b"], spread=False).where(F.struct("doc_id", "text_hash", "at") != F.col("first"))
    starts = later.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("starts"))  # at most a document's lines
    cover = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + n - 1)))))
    return starts.select("doc_id", "text_hash", cover.alias("covered"))


def dedup_lines(docs: DataFrame, n: int = LINES) -> DataFrame:
    """docs with the text left and two more columns, n_lines and n_removed; every row stays, also with an empty text.

    docs: doc_id, text and any other columns, which are kept (but for any of the two new names). A null
    text stays null with no lines.
    """
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # Other columns travel in one struct, so their names cannot clash with those used here.
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("rest"))
    covered = small(held(repeated_lines(rows, n))).withColumnsRenamed({"doc_id": "c_id", "text_hash": "c_hash"})
    joined = rows.join(covered, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_hash") == F.col("c_hash")), "left")
    lines = F.split("text", "\n")
    # covered is ascending and without repeats, so lines keep their order under array_except of positions.
    left = _let(lines, lambda own: F.transform(F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("covered")), lambda i: F.element_at(own, i + 1)))
    text = F.when(F.col("covered").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")).alias("text")
    return joined.select(
        *[text if c == "text" else F.col("rest")[c].alias(c) for c in kept],
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"),
    )
