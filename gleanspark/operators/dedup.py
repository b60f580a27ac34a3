"""Deduplication of bibliographic records by several identifiers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bibliography import norm_doi, norm_title
from ..functions.values import strip
from ..session import shared_checkpoints, unsent
from .components import components

KEYS = ["k_doi", "k_pmid", "k_pmcid", "k_title", "k_url"]


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c.cast("string")), F.lit(""))


def staged(records: DataFrame, order: str = "seq") -> DataFrame:
    """Keep the first record of each DOI, then PMID, PMCID, title, URL and record_id.  After each pass records without the key
    follow those with it, which decides who is first in the next pass."""
    keys = {
        "k_doi": norm_doi(F.col("doi")), "k_pmid": blank_to_null(F.col("pmid")), "k_pmcid": blank_to_null(F.col("pmcid")),
        "k_title": F.nullif(norm_title(F.col("title")), F.lit("")), "k_url": F.nullif(F.col("url"), F.lit("")),
    }
    df = records.withColumns(keys).withColumn("_ord", F.array(F.col(order).cast("long")))
    df = df.withColumn("k_url", F.when(strip(F.col("k_url")) != "", F.col("k_url")))
    for key in [*KEYS, "record_id"]:
        # records without the key are spread over parts, so they don't meet in one task
        spread = F.coalesce(F.col(key), F.concat(F.lit("\u0000"), F.col(order).cast("string")))
        first = Window.partitionBy(spread).orderBy("_ord")
        df = df.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
        if key != "record_id":
            df = df.withColumn("_ord", F.concat(F.array(F.col(key).isNull().cast("long")), F.col("_ord")))
    return df.drop("_ord", *KEYS)


def connected(shared: DataFrame) -> DataFrame:
    """shared: node, key.  node and component (the least node that shared keys lead to); each key is a star around its least node."""
    heads = shared.groupBy("key").agg(F.min("node").alias("a"))
    roots = components(shared.join(heads, "key").select("a", F.col("node").alias("b")))
    return roots.select("node", F.col("root").alias("component"))


def fold(rows: pd.DataFrame) -> pd.DataFrame:
    """The sequential rule inside one component, rows in order: a record that shares a key with a kept slot replaces it if at
    least as rich, without adding its other keys; any other record opens a slot and adds its keys."""
    rows = rows.sort_values("seq")
    seen: dict[tuple[str, str], int] = {}
    slots: list[tuple[int, int, tuple]] = []
    for r in rows.itertuples(index=False):
        own = [(k, v) for k in KEYS if isinstance(v := getattr(r, k), str) and v]
        rich = (r.has_doi, r.has_pmid, r.has_pmcid, r.abstract_len, r.title_len)
        if (slot := next((seen[k] for k in own if k in seen), None)) is None:
            seen |= {k: len(slots) for k in own}
            slots.append((r.seq, r.seq, rich))
        elif rich >= slots[slot][2]:
            slots[slot] = (slots[slot][0], r.seq, rich)
    return pd.DataFrame([(a, b) for a, b, _ in slots], columns=["slot_seq", "seq"])


def greedy(records: DataFrame, order: str = "seq") -> DataFrame:
    """One pass in order: DOI, PMID, PMCID, title, URL are looked up among registered keys, the richer record (later on ties)
    takes the slot.  A record's fate depends only on records it is connected to by keys, so the pass runs by connected
    component; slot_seq is the place in the output.  Records that share no key need no pass at all."""
    shared_checkpoints(records.sparkSession)
    low = lambda c: F.nullif(F.lower(strip(F.col(c))), F.lit(""))
    keyed = records.select(
        F.col(order).cast("long").alias("seq"), low("doi").alias("k_doi"), blank_to_null(F.col("pmid")).alias("k_pmid"), blank_to_null(F.col("pmcid")).alias("k_pmcid"),
        F.nullif(norm_title(F.col("title")), F.lit("")).alias("k_title"), low("url").alias("k_url"),
        *[(F.coalesce(F.col(c), F.lit("")) != "").cast("int").alias(f"has_{c}") for c in ("doi", "pmid", "pmcid")],
        F.coalesce(F.char_length("abstract_or_summary"), F.lit(0)).alias("abstract_len"), F.coalesce(F.char_length("title"), F.lit(0)).alias("title_len"),
    )
    edges = keyed.select(F.col("seq").alias("node"), F.explode(F.array(*[F.concat(F.lit(f"{k}:"), F.col(k)) for k in KEYS])).alias("key")).where("key is not null")
    shared = edges.join(edges.groupBy("key").count().where("count > 1").select("key"), "key")
    joined = connected(shared.select("node", "key").checkpoint())
    parts = keyed.join(unsent(joined.withColumnRenamed("node", "seq")), "seq", "left")
    alone = parts.where("component is null").select(F.col("seq").alias("slot_seq"), "seq")

    def one(rows: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        return fold(rows)

    kept = parts.where("component is not null").groupBy("component").applyInPandas(one, "slot_seq long, seq long").unionByName(alone)
    return records.join(unsent(kept.withColumnRenamed("seq", "_seq")), F.col(order).cast("long") == F.col("_seq")).drop("_seq")


def append(warehouse: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows after the warehouse's, in one order column seq."""
    a = warehouse.withColumn("_part", F.lit(0)).unionByName(rows.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    return a.withColumn("seq", F.col("seq") + F.col("_part").cast("long") * (1 << 40)).drop("_part")
