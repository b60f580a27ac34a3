"""The registered queries of this subpackage: each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, language_id, license_scan, lm_bloom, mixing, simhash, substring_dedup, toxicity, url_filter
from .oracle import ORACLE_SQL as ORACLE_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(m: int) -> Column:
    """crc32(doc_id as text) mod m; null ids are in no fold that is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(m)), F.lit(-1))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.learn(docs.where(fold_of(4) != 2))
    held = docs.select("doc_id", "text", (fold_of(4) == 2).alias("held_out"))
    return language_id.identify(held, model, ["doc_id", "held_out"])


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold_of(5) == 0).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where(fold_of(5) != 0).select("doc_id", "toxic")
    model = toxicity.learn(docs.where(~F.col("held_out")).join(toxicity.bounded(labels), "doc_id"))
    scored = toxicity.score(docs, model, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits")


def op1_lm_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold_of(5) == 1).alias("held_out"))
    model, rest = lm_bloom.learn(docs.where(~F.col("held_out")))
    return lm_bloom.score(docs, model, rest, ["doc_id", "held_out"])


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("posterior")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = simhash.groups(table(spark, sf_dir, "documents"))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return judged.select("doc_id", "n_words", "n_hit", "n_items", digest, (F.col("n_items") >= 2).alias("contaminated"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {
    "op1_lm_bloom": op1_lm_bloom,
    "op2_toxicity": op2_toxicity,
    "op3_fingerprint": op3_fingerprint,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_license_scan": op6_license_scan,
    "op7_mixing": op7_mixing,
    "op8_url_filter": op8_url_filter,
    "op9_simhash": op9_simhash,
    "op10_language_id": op10_language_id,
}
