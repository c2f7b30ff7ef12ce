"""The corpus pipeline: documents that the quality classifier rejects go, repeated lines go, one document
of each near-duplicate group stays, sources are mixed to their weights, and what is left is packed.

Each stage takes (spark, docs, sf_dir) and works on all of docs; all but the last return the columns of
documents. Rows of the stages that keep documents are judged by each operator's own rules for nulls,
empty texts and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.llm import linedup, mixing, packing, quality, simhash
from groundspark.llm.common import documents, held, n_words, new_folder, text_or_empty
from groundspark.llm.queries import BYTE_BPE

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts whose sets of five-word shingles have this Jaccard similarity or more are near copies.
LIKENESS = 0.8


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier, fitted to docs and the labels table, rejects."""
    return quality.Classifier(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).keep(docs.select(COLUMNS))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; a document of which nothing is left goes, one that was empty before stays."""
    left = linedup.dedup_lines(docs.select(COLUMNS)).where("n_removed = 0 or text <> ''")
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group: the one with the smallest id (null last), then the smallest hash of its text.

    A group is what links of texts within four bits, or with Jaccard LIKENESS of their shingles, connect.
    Ids need not be unique: rows of one id in different groups each stay, of rows of one id and text one does.
    """
    groups = simhash.near_rows(docs, words=5, least=LIKENESS)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_hash"))
    first = groups.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n")).groupBy("root").agg(F.min_by(F.struct("doc_id", "text_hash", "n"), key).alias("k"))
    kept = held(first.select(F.col("k.doc_id").alias("its_id"), F.col("k.text_hash").alias("its_hash"), F.col("k.n").alias("n")))
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))
    left = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("text_hash") == F.col("its_hash")), "left_semi")
    return (left.dropDuplicates(["doc_id", "text_hash"]) if kept.where("n > 1").limit(1).count() else left).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; rows of equal id and text as often as the one taken most."""
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("text_hash"))
    mixed = mixing.mix(rows.select("doc_id", "source", "text_hash", n_words(text_or_empty()).alias("size")))
    times = mixed.groupBy(F.col("doc_id").alias("its_id"), F.col("text_hash").alias("its_hash")).agg(F.max("copies").alias("copies")).where("copies > 0")
    joined = rows.join(times, F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("text_hash") == F.col("its_hash")))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_two_fit(docs, BYTE_BPE)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: Fingerprints, a fitted classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            folder = new_folder(spark, f"stage-{i}")
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
    return docs
