"""The corpus pipeline: documents from raw to mixed, one operator at a time.

Each stage gets what its predecessor kept and returns a DataFrame; run() writes
each result as Parquet below the shared checkpoint folder and reads it again
for the next stage, which cuts lineage and lets a lost executor cost one stage
at most.  All stages but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm import decontaminate, language_id, mixing, near_copies, substring_dedup
from gleanspark.session import shared_folder

#: Words of a window in substring dedup.
REPEAT = 50


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that are in no language: without a text or a letter, or with bits outside the code's radius and no language
    of half the likelihood.  The languages are learnt from the documents' own; if none has one, documents with a letter stay."""
    model = language_id.learn(docs)
    if not model.languages:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    rest = [c for c in docs.columns if c != "text"]
    told = language_id.identify(docs.select(F.struct(*rest).alias("rest"), "text"), model, ["rest", "text"])
    told = told.where((F.col("lang_pred") != language_id.UNKNOWN) & ~(F.col("far") & (F.col("score") < 0.5)))
    return told.select(*["text" if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest doc_id stays, null ids
    last; of rows with that id and text the first by all columns.  Empty texts are copies of one another."""
    gone = near_copies.leaving(docs).checkpoint()
    gone = decontaminate.few(gone, gone.count())
    row = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_key"))
    left = row.join(gone, F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_key") == F.col("gone_key")), "left_anti")
    return once(left).select("row.*")


def once(rows: DataFrame) -> DataFrame:
    """rows: row, own_id, own_key.  Of rows with equal id and key the first, in the order of their JSON.  Only rows that do repeat are
    brought together, and combine before that."""
    again = rows.groupBy("own_id", "own_key").count().where("count > 1").select(F.col("own_id").alias("again_id"), F.col("own_key").alias("again_key")).checkpoint()
    n = again.count()
    if not n:
        return rows
    same = F.col("own_id").eqNullSafe(F.col("again_id")) & (F.col("own_key") == F.col("again_key"))
    again = decontaminate.few(again, n)
    first = rows.join(again, same, "left_semi").groupBy("own_id", "own_key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rows.join(again, same, "left_anti").unionByName(first)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that an earlier document has are cut; a document that loses nothing keeps its text as it is, one that
    loses every word goes."""
    rest = [c for c in docs.columns if c != "text"]
    packed = docs.select(F.struct(*rest).alias("rest"), "doc_id", "text")
    cut = substring_dedup.dedup(packed, REPEAT, ["rest"], verbatim=True)
    cut = cut.where((F.col("n_removed") < F.col("n_words")) | (F.col("n_removed") == 0))
    return cut.select(*[F.col("kept").alias("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontaminate.matches(docs, items).select(F.col("doc_id").alias("hit_id"), F.col("text_key").alias("hit_key")).distinct().checkpoint()
    hit = decontaminate.few(hit, hit.count())
    return docs.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.xxhash64("text") == F.col("hit_key")), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: text, source, size (words), target (words of the source) and taken (words of the document,
    repeats counted).  Rows of equal id, text and source become one, the first by all columns, with their words together; an
    empty text takes nothing and is not in the mix."""
    taken = mixing.mix(docs).groupBy("doc_id", "text_key", "source").agg(F.max("target").alias("target"), F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    taken = taken.where("taken > 0").select(F.col("doc_id").alias("mix_id"), F.col("text_key").alias("mix_key"), F.col("source").alias("mix_source"), "size", "target", "taken")
    row = docs.select(F.struct("doc_id", "text", "lang", "source").alias("row"), F.struct("doc_id", F.col("source").cast("string").alias("source")).alias("own_id"), F.xxhash64("text").alias("own_key"))
    same = F.col("row.doc_id").eqNullSafe(F.col("mix_id")) & (F.col("own_key") == F.col("mix_key")) & F.col("own_id.source").eqNullSafe(F.col("mix_source"))
    return once(row).join(taken, same).select("row.*", "size", "target", "taken")


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_near_copies),
    ("substring_dedup", without_repeats),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
]
#: Language ID and SimHash groups can't be written in SQL; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
