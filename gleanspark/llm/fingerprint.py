"""Document fingerprints: canonical exact digests, in DataFrame operations only.

The canonical text is Unicode-normalised (NFKC) and case-folded by the ICU
library that Spark ships with (called through the SQL function reflect), its
whitespace runs become one space and its ends are trimmed.  The digest is two
64-bit xxhashes of it, the second over a salted text.  Rows of equal digest are
then compared byte by byte; should different canonical texts meet in one
bucket, all but the least of them get a numbered digest, so fingerprints are
equal exactly if canonical texts are.

Edge cases: a null text is empty; empty texts share a fingerprint; repeated
rows each give their row; rows of one doc_id are ordered by their digest, a
null doc_id comes last; a single row is followed by itself; an empty table
gives an empty result.  Other columns are ignored.  A very long text is
handled as one value in the JVM (Spark's limit of 2 GB), a few copies at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shards import shared_checkpoints
from .decontaminate import few

#: Rows of one block of neighbouring ids, about.
BLOCK = 1024
#: A block is split at quantiles of its own ids into at most FANOUT; LEVELS times at most, so blocks grow beyond FANOUT ** LEVELS * BLOCK rows.
FANOUT, LEVELS = 64, 3


def canonical(text: Column) -> Column:
    """NFKC, full case folding, NFKC again (folding may denormalise), whitespace folded."""
    nfkc = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """128 bits of xxhash as 32 hex digits."""
    one = lambda c: F.lower(F.lpad(F.hex(F.xxhash64(c)), 16, "0"))
    return F.concat(one(canon), one(F.concat(F.lit("\u0001"), canon)))


def in_blocks(own: DataFrame) -> DataFrame:
    """own (order: the id, null for none; text_key) with block.  Blocks rise with the id and rows of one id share a block; null ids
    come last, in blocks that rise with the text's key.  Bounds are quantiles, taken again inside blocks that are still too
    large, so neither clustered ids nor a far one fill a block; they are written tables, so a lost task finds the same blocks."""
    known = F.col("order").isNotNull()
    total, nulls = own.agg(F.count("order"), F.count(F.when(~known, F.lit(1)))).first()
    placed, blocks = own.withColumn("block", F.lit(0).cast("long")), 1
    for _ in range(LEVELS):
        parts = min(FANOUT, -(-total // (BLOCK * blocks)))
        if parts < 2:
            break
        cuts = placed.where(known).groupBy("block").agg(F.percentile_approx("order", [i / parts for i in range(1, parts)], 20 * parts).alias("cuts")).checkpoint()
        # at most FANOUT ** (LEVELS - 1) rows of as many longs as parts
        inside = F.size(F.filter("cuts", lambda c: c <= F.col("order")))
        placed = placed.join(F.broadcast(cuts), "block", "left").withColumn("block", F.col("block") * parts + F.when(known, inside).otherwise(0)).drop("cuts")
        blocks *= parts
    more = min(FANOUT**LEVELS, max(1, -(-nulls // BLOCK)))
    by_key = F.least(F.floor((F.col("text_key").cast("double") / 2.0**64 + 0.5) * more), F.lit(more - 1))
    return placed.withColumn("block", F.when(known, F.col("block")).otherwise(blocks + by_key))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, text_key, n_chars, and next (struct of id, key and text of the next document by id), without a window
    over the whole table: rows are windowed inside blocks of neighbouring ids; a block's last row takes the first row of
    the next block, the very last the very first."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("order"))
    placed = in_blocks(own.withColumn("text_key", F.xxhash64("text")))
    row = F.struct(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "text")
    inside = placed.withColumn("following", F.lead(row).over(Window.partitionBy("block").orderBy("order", "text_key")))
    heads = placed.groupBy("block").agg(F.min_by(row, F.struct("order", "text_key")).alias("first"))
    # one row for each block: twice FANOUT ** LEVELS at most
    turn = heads.select("block").withColumn("next_block", F.lead("block").over(Window.orderBy("block")))
    turn = turn.withColumn("next_block", F.coalesce("next_block", F.min("block").over(Window.partitionBy(F.lit(0)))))
    bridge = turn.join(heads.select(F.col("block").alias("next_block"), "first"), "next_block").select("block", "first")
    return inside.join(bridge, "block").select("doc_id", "text", "text_key", F.length("text").cast("long").alias("n_chars"), F.coalesce("following", "first").alias("next"))


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the code points replaced by the first as many (or all) of the following text."""
    quarter = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - quarter), F.substring(following, F.lit(1), quarter))


def fingerprints(docs: DataFrame, digest_of=digest) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, and near_edited and near_next: 1 where the fingerprints
    (so, the canonical texts) are equal, else 0."""
    shared_checkpoints(docs.sparkSession)
    pairs = with_next(docs).withColumn("edited", edited(F.col("text"), F.col("next.text")))
    pairs = pairs.select("*", canonical(F.col("text")).alias("canon"), canonical(F.col("edited")).alias("edited_canon"), canonical(F.col("next.text")).alias("next_canon"))
    slim = pairs.select(
        "doc_id", "text_key", "n_chars", F.col("next.id").alias("next_id"), F.col("next.key").alias("next_key"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest_of(F.col("canon")).alias("fingerprint"), digest_of(F.col("edited_canon")).alias("edited_fingerprint"),
        (F.col("canon") == F.col("edited_canon")).cast("double").alias("near_edited"), (F.col("canon") == F.col("next_canon")).cast("double").alias("near_next"),
    ).checkpoint()
    members = compared(docs, slim)
    fixed = numbered(members)
    out = slim
    if fixed is not None:
        for kind, column in ((0, "fingerprint"), (1, "edited_fingerprint")):
            new = fixed.where(F.col("kind") == kind).select(F.col("doc_id").alias("i"), F.col("text_key").alias("k"), F.col("next_key").alias("nk"), "number").distinct()
            same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")) & (F.lit(kind == 0) | (F.col("next_key") == F.col("nk")))
            out = out.join(new, same, "left").withColumn(column, F.concat(column, F.when(F.col("number") > 1, F.concat(F.lit("-"), "number")).otherwise(""))).drop("i", "k", "nk", "number")
        # an edited text whose canonical text is the row's own has the row's own fingerprint
        out = out.withColumn("edited_fingerprint", F.when(F.col("near_edited") == 1, F.col("fingerprint")).otherwise(F.col("edited_fingerprint")))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def compared(docs: DataFrame, slim: DataFrame) -> DataFrame:
    """Canonical texts of all rows whose digest another row has too: kind (0 own, 1 edited), doc_id, text_key, next_key, fp, canon."""
    own = slim.select(F.lit(0).alias("kind"), "doc_id", "text_key", "next_id", "next_key", F.col("fingerprint").alias("fp"))
    changed = slim.where("near_edited = 0").select(F.lit(1).alias("kind"), "doc_id", "text_key", "next_id", "next_key", F.col("edited_fingerprint").alias("fp"))
    every = own.unionByName(changed)
    shared = every.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp")
    # equal rows (same id, text and next text) are compared once
    asked = every.join(shared, "fp").distinct().checkpoint()
    rows = asked.count()
    texts = docs.select(F.col("doc_id").alias("i"), F.coalesce("text", F.lit("")).alias("text")).withColumn("k", F.xxhash64("text"))
    is_own, is_next = F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")), F.col("next_id").eqNullSafe(F.col("i")) & (F.col("next_key") == F.col("k"))
    first = few(asked.where("kind = 0"), rows).join(texts, is_own).select("kind", "doc_id", "text_key", "next_key", "fp", canonical(F.col("text")).alias("canon"))
    later = asked.where("kind = 1")
    heads = few(later, rows).join(texts, is_own).select("doc_id", "text_key", "next_key", "fp", F.col("text").alias("head")).distinct()
    tails = few(later, rows).join(texts, is_next).select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), F.col("next_key").alias("n"), F.col("text").alias("tail")).distinct()
    whole = heads.join(tails, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")) & (F.col("next_key") == F.col("n")))
    second = whole.select(F.lit(1).alias("kind"), "doc_id", "text_key", "next_key", "fp", canonical(edited(F.col("head"), F.col("tail"))).alias("canon"))
    return first.unionByName(second)


def numbered(members: DataFrame) -> DataFrame | None:
    """kind, doc_id, text_key, next_key and number (1 for the least canonical text) of rows in buckets that hold different
    canonical texts; None if there is no such bucket.  Copies combine before the shuffle."""
    mixed = members.groupBy("fp", "canon").agg(F.lit(1).alias("one")).groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fp").checkpoint()
    n = mixed.count()
    if not n:
        return None
    kept = members.join(few(mixed, n), "fp")
    ranks = kept.select("fp", "canon").distinct().withColumn("number", F.row_number().over(Window.partitionBy("fp").orderBy("canon")))
    return kept.join(ranks, ["fp", "canon"]).select("kind", "doc_id", "text_key", "next_key", "number")
