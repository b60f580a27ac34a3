"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

Test items are cut into windows of consecutive words.  Over the whole corpus
the words of the test are counted; a window with a word that the corpus lacks
is out, and each other window is looked for by its two rarest words.  The
stored index has the postings (position lists) of those words only, by
document.  The rarest word's list, moved by the word's place in the window,
gives candidate starts; those stay whose other list, moved likewise, has the
same start; the remaining words are compared with the document itself.

The test's words and windows are broadcast only while they are few (checked);
beyond that the same joins shuffle.

Edge cases: a null or empty text has no words and no hits; an item without
words is ignored, a short one is a single window; repeated items hit
separately; rows of the same doc_id are judged each by its own text; a null
doc_id is a document like any other; empty tables give no hits or no rows.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shards import shared_checkpoints

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of a side that may be broadcast, and of texts' keys.
FEW = 500_000


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) runs of letters, digits and non-ASCII characters; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df


def windows_of(items: DataFrame, size: int) -> DataFrame:
    """item_id and window (an array of words), each pair once."""
    w = items.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    return w.select("item_id", "w", F.explode(starts).alias("at")).select("item_id", F.slice("w", F.col("at"), F.lit(size)).alias("window")).distinct()


def key_of(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (rows of equal key and id have the same text) and words."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))


class Index:
    """Postings of some words, by document: doc_id, text_key, postings (array of word_id and position, sorted)."""

    def __init__(self, docs: DataFrame, terms: DataFrame, n_terms: int):
        """terms: word and word_id, distinct."""
        placed = key_of(docs).select("doc_id", "text_key", F.posexplode("words").alias("pos", "word"))
        found = placed.join(few(terms, n_terms), "word").select("doc_id", "text_key", F.struct("word_id", "pos").alias("p"))
        # equal rows of the corpus would list a position twice
        self.rows = found.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("p")).alias("postings")).checkpoint()

    def phrases(self, windows: DataFrame, n_windows: int) -> DataFrame:
        """windows: window_id, id0, at0 and id1, at1 (the two rarest words and their places; id1 null for a lone word).
        doc_id, text_key, window_id and start where the offset-adjusted lists meet."""
        at = self.rows.select("doc_id", "text_key", "postings", F.explode("postings").alias("p"))
        at = at.join(few(windows, n_windows), F.col("p.word_id") == F.col("id0")).withColumn("start", F.col("p.pos") - F.col("at0"))
        other = F.struct(F.col("id1").alias("word_id"), (F.col("start") + F.col("at1")).alias("pos"))
        return at.where((F.col("start") >= 0) & (F.col("id1").isNull() | F.array_contains("postings", other))).select("doc_id", "text_key", "window_id", "start")

    def near(self, pairs: DataFrame, n_pairs: int, distance: int) -> DataFrame:
        """pairs: pair_id, id0, id1.  Places where both words stand at most distance words apart: doc_id, text_key, pair_id, pos0, pos1."""
        at = self.rows.select("doc_id", "text_key", "postings", F.explode("postings").alias("p"))
        at = at.join(few(pairs, n_pairs), F.col("p.word_id") == F.col("id0"))
        close = F.filter("postings", lambda q: (q["word_id"] == F.col("id1")) & (F.abs(q["pos"] - F.col("p.pos")) <= distance) & (q["pos"] != F.col("p.pos")))
        return at.select("doc_id", "text_key", "pair_id", F.col("p.pos").alias("pos0"), F.explode(close).alias("q")).select("doc_id", "text_key", "pair_id", "pos0", F.col("q.pos").alias("pos1"))


def prepared(docs: DataFrame, items: DataFrame, size: int) -> tuple[DataFrame, int, DataFrame, DataFrame, int]:
    """Windows with their two rarest words (and how many windows), item to window, the words to index (and how many)."""
    pairs = windows_of(items, size).withColumn("window_id", F.xxhash64("window")).checkpoint()
    wins = pairs.select("window_id", "window").distinct()
    vocabulary = wins.select(F.explode("window").alias("word")).distinct().checkpoint()
    seen = key_of(docs).select(F.explode("words").alias("word")).join(few(vocabulary, vocabulary.count()), "word")
    counts = seen.groupBy("word").agg(F.count(F.lit(1)).alias("c")).withColumn("word_id", F.xxhash64("word")).checkpoint()
    placed = wins.select("window_id", "window", F.posexplode("window").alias("at", "word")).join(counts, "word")
    ranked = placed.groupBy("window_id", "window").agg(F.sort_array(F.collect_list(F.struct("c", "at", "word", "word_id"))).alias("r"))
    ranked = ranked.where(F.size("r") == F.size("window"))  # every word occurs somewhere
    second = F.try_element_at("r", F.lit(2))
    chosen = ranked.select("window_id", "window", F.col("r")[0]["word_id"].alias("id0"), F.col("r")[0]["at"].alias("at0"), second["word_id"].alias("id1"), second["at"].alias("at1")).checkpoint()
    terms = chosen.select(F.explode(F.array("id0", "id1")).alias("word_id")).where("word_id is not null").distinct().join(counts.select("word", "word_id"), "word_id").checkpoint()
    return chosen, chosen.count(), pairs.select("item_id", "window_id"), terms, terms.count()


def matches(docs: DataFrame, items: DataFrame, size: int = 8) -> DataFrame:
    """Exact occurrences: doc_id, text_key, window_id, start (first word, from 0), n (words)."""
    shared_checkpoints(docs.sparkSession)
    chosen, n_windows, _, terms, n_terms = prepared(docs, items, size)
    return verified(docs, Index(docs, terms, n_terms), chosen, n_windows)


def verified(docs: DataFrame, index: Index, chosen: DataFrame, n_windows: int) -> DataFrame:
    met = index.phrases(chosen.drop("window"), n_windows).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("window_id", "start")).alias("met")).checkpoint()
    places = met.agg(F.sum(F.size("met") + 1)).first()[0] or 0  # a document has as many hits as its text allows: the bound counts them
    met = met.select(F.col("doc_id").alias("met_id"), F.col("text_key").alias("met_key"), "met")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    texts = keyed.join(few(met, places), F.col("doc_id").eqNullSafe(F.col("met_id")) & (F.col("text_key") == F.col("met_key")))
    texts = texts.select("doc_id", "text_key", words_of(F.col("text")).alias("words"), F.explode("met").alias("m"))
    same = F.slice("words", F.col("m.start") + 1, F.size("window")) == F.col("window")
    hits = texts.join(few(chosen.select("window_id", "window"), n_windows), F.col("m.window_id") == F.col("window_id")).where(same)
    return hits.select("doc_id", "text_key", "window_id", F.col("m.start").alias("start"), F.size("window").alias("n")).distinct()


def judge(docs: DataFrame, items: DataFrame, size: int = 8) -> DataFrame:
    """doc_id, n_words, n_hit (words inside any occurrence), n_items (items with an occurring window) and items (sorted as
    strings) of every document."""
    shared_checkpoints(docs.sparkSession)
    chosen, n_windows, item_windows, terms, n_terms = prepared(docs, items, size)
    hits = verified(docs, Index(docs, terms, n_terms), chosen, n_windows).checkpoint()
    inside = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("start", "n")), lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1))))
    places = hits.groupBy("doc_id", "text_key").agg(F.size(inside).alias("n_hit"))
    named = hits.select("doc_id", "text_key", "window_id").distinct().join(item_windows, "window_id").groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    found = places.join(named, places["doc_id"].eqNullSafe(named["doc_id"]) & (places["text_key"] == named["text_key"])).select(places["doc_id"].alias("hit_id"), places["text_key"].alias("hit_key"), "n_hit", "items")
    every = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    out = every.join(found, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_key") == F.col("hit_key")), "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "text_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"))
