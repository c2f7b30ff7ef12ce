"""The queries opN_<name>: production parameters, whole tables, the columns that their contracts name."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundspark.llm import langid, linedup, lloyd, media, minhash, mixing, packing, quality, recipes, secrets, simhash, sstable, trie
from groundspark.llm.common import documents, n_words, new_folder, text_or_empty

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "shards")
    sstable.write_shards(documents(spark, sf_dir), folder, WORD_BPE)
    return sstable.read_shards(spark, folder)


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_two_fit(documents(spark, sf_dir), BYTE_BPE)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op4_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.store(documents(spark, sf_dir), new_folder(spark, "media")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir)).select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256")
    return found.select("doc_id", *map(count, secrets.KINDS), base, secrets.written(F.col("spans")).alias("spans"), "n_live", "n_copied", "n_plain")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = documents(spark, sf_dir).select("doc_id", "source", n_words(text_or_empty()).alias("size"))
    return mixing.mix(sized).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprint_chain(documents(spark, sf_dir))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", held_out.alias("held_out"))
    model = langid.train(docs.where("not held_out and lang is not null and text is not null"))
    return langid.predict(docs, model).select("doc_id", "held_out", "lang_pred", "score")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), block=5, most=8)


def op13_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recipes.exact_groups(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
