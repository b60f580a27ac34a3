"""Mixing sources to target weights by a low-discrepancy schedule.

Sources share ``share`` of all words by weight; a target stops at ``most``
times its source's size and the excess goes to the others by weight.  Slots of
equally many words are dealt to sources by golden-ratio points mapped through
the cumulative targets, and a source's slots are ranked.  Within a source the
documents, in hashed order, form a stream that repeats; it is cut into equal
blocks, and the k-th slot takes block k.  How many slots a source is dealt
decides what it takes; only the block that crosses its target is trimmed (so
nothing exceeds ``most`` times its size).  Slots join blocks, and blocks join the
parts of documents in them, which gives each document's words, its first slot
in the schedule and its number of slots.

A slot is small against every source (``LEAST`` slots for the smallest target)
unless that needs over ``MOST_SLOTS`` slots in all; then a source below LEAST /
MOST_SLOTS of the mix comes within a slot or two of its target only.

No task sees a whole source: a source's documents are ordered in groups by
hash, and running sums are taken in a group and over the groups' totals; slots
likewise.  Windows over the sources themselves see a row for each source.

Edge cases: a null or empty text has size 0 and nothing taken; a null source
is a source of its own, after all others; repeated rows each have their place
in the stream; a very long text is counted where it lies and spans many blocks;
if all sizes are 0, targets are 0; an empty table gives an empty result; extra
columns are ignored.  Reruns agree, as only hashes of id and text order anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shards import shared_checkpoints
from .decontaminate import few

WEIGHTS = (3, 1, 2)
#: Slots of the schedule, about; slots of the smallest target, at least; slots at most.
SLOTS, LEAST, MOST_SLOTS = 1 << 17, 256, 1 << 26
#: Documents or slots in one group of a running sum, about (of many, as many as there are groups).
GROUP = 4096
GOLDEN = 0.6180339887498949
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_key, size (words) and hash (by which a source's documents are ordered)."""
    order = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))).cast("binary"))
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("text_key"), size.alias("size"), order.alias("hash"))


def targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source_no (from 0, by code point, null last), source, n, source_size, weight, target; one row for each source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("source_no", F.row_number().over(by_name) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, F.col("source_no") % len(weights) + 1)).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    # the level at which caps and weights fill the whole is the greatest of those with the k least capped first
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    whole = F.sum("source_size").over(everything) * F.lit(float(share))
    left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    per = per.withColumn("level", (whole - F.coalesce(F.sum("cap").over(order), F.lit(0.0))) / left)
    per = per.withColumn("level", F.max("level").over(everything))
    return per.select("source_no", "source", "n", "source_size", "weight", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def running(df: DataFrame, by: str, order: list[str], groups: Column, value: str, name: str) -> DataFrame:
    """Sum of value over the rows before, by ``by``, in the order of ``groups`` and then ``order``."""
    df = df.withColumn("g", groups)
    inside = Window.partitionBy(by, "g").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(F.col(by)).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(by, "g").agg(F.sum(value).alias("t")).withColumn("t", F.coalesce(F.sum("t").over(before), F.lit(0)))
    df = df.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return df.join(totals, [by, "g"]).withColumn(name, F.col(name) + F.col("t")).drop("g", "t")


def slot_words(total: float, smallest: float) -> int:
    """Words of a slot."""
    return max(1, int(min(total // SLOTS, smallest // LEAST)), int(-(-total // MOST_SLOTS)))


def schedule(sources: DataFrame, words: int, step: float = GOLDEN) -> DataFrame:
    """slot (the order in which to read), source_no and rank (from 0 in its source) of all slots of so many words each."""
    spark = sources.sparkSession
    cut = sources.where("target > 0").select("source_no", "target").checkpoint()
    total, count = cut.agg(F.sum("target"), F.count(F.lit(1))).first()
    if not count:
        return spark.range(0).select(F.col("id").alias("slot"), F.lit(0).alias("source_no"), F.col("id").alias("rank"))
    order = Window.orderBy("source_no")
    cut = cut.withColumn("high", F.sum("target").over(order) / total).withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0)))
    cut = cut.withColumn("high", F.when(F.lead("source_no").over(order).isNull(), 1.0).otherwise(F.col("high")))
    # each source's interval is split over the cells of a grid, so that points find it by an equal join
    cells = 4 * count
    spread = cut.select("*", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))).alias("cell"))
    slots = spark.range(int(-(-total // words))).withColumn("point", (F.col("id") * F.lit(step)) % 1.0).withColumn("cell", F.floor(F.col("point") * cells))
    dealt = slots.join(few(spread, cells + count), "cell").where("low <= point and point < high").select("id", "source_no", F.lit(1).alias("one"))
    return running(dealt, "source_no", ["id"], F.floor(F.col("id") / GROUP), "one", "rank").select(F.col("id").alias("slot"), "source_no", "rank")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, step: float = GOLDEN) -> DataFrame:
    """doc_id, text_key, source, size, source_size, target, taken, first_slot and n_slots of every document (first_slot is -1
    where no slot takes of it)."""
    shared_checkpoints(docs.sparkSession)
    sized = sizes(docs).checkpoint()
    sources = targets(sized, weights, share, most).checkpoint()
    n_sources, total, smallest = sources.agg(F.count(F.lit(1)), F.sum("target"), F.min(F.when(F.col("target") > 0, F.col("target")))).first()
    words = slot_words(total or 0, smallest or 0)
    info = few(sources.select(F.col("source").alias("s"), "source_no", "source_size", "target", "n"), n_sources)
    placed = sized.join(info, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    groups = F.ceil(F.col("n") / F.greatest(F.lit(float(GROUP)), F.sqrt("n")))
    place = F.conv(F.substring("hash", 1, 8), 16, 10).cast("long")
    stream = running(placed, "source_no", ["hash"], F.floor(place * groups / F.lit(float(1 << 32))), "size", "begin")
    # a document lies in the stream once a turn: the blocks of each turn, and which part of each is the document's
    turns = F.explode(F.sequence(F.lit(0), F.ceil(F.lit(float(most))).cast("int") - 1)).alias("turn")
    laps = stream.where("size > 0").select("source_no", "begin", "size", "target", "source_size", turns)
    laps = laps.withColumn("from", F.col("begin") + F.col("turn") * F.col("source_size")).withColumn("to", F.least(F.col("from") + F.col("size"), F.floor("target"))).where("from < to")
    pieces = laps.select("source_no", "begin", "from", "to", F.explode(F.sequence(F.floor(F.col("from") / words), F.floor((F.col("to") - 1) / words))).alias("rank"))
    got = F.least("to", (F.col("rank") + 1) * words) - F.greatest("from", F.col("rank") * words)
    sums = pieces.join(schedule(sources, words, step), ["source_no", "rank"]).groupBy("source_no", "begin")
    sums = sums.agg(F.sum(got).alias("taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n_slots"))
    out = stream.join(sums, ["source_no", "begin"], "left")
    own = lambda c: F.when(F.col("size") > 0, F.col(c))  # noqa: E731  an empty text stands where the next document begins
    return out.select(
        "doc_id", "text_key", "source", "size", "source_size", "target", F.coalesce(own("taken"), F.lit(0)).cast("long").alias("taken"),
        F.coalesce(own("first_slot"), F.lit(-1)).alias("first_slot"), F.coalesce(own("n_slots"), F.lit(0)).cast("long").alias("n_slots"),
    )
