"""Provenance audit: is each gold record in the warehouse, and does its abstract still match?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bibliography import candidate_dois, crosscheck_status, norm_doi, norm_title, parse_record_id, present


def parse_ids(gold: DataFrame) -> DataFrame:
    p = gold.select("record_id", parse_record_id(F.col("record_id")).alias("p"))
    at = lambda i: F.coalesce(F.try_element_at("p.doi_candidates", F.lit(i)), F.lit(""))
    return p.select("record_id", "p.source", "p.encoded_tail", at(1).alias("doi_candidate_dash"), at(2).alias("doi_candidate_dot"), F.coalesce("p.primary_doi", F.lit("")).alias("primary_doi"), "p.notes")


def containment(parsed: DataFrame, gold: DataFrame, warehouse: DataFrame, order: str = "seq") -> DataFrame:
    """Each gold record by its first DOI candidate that the warehouse has, else by its title; the first such warehouse row."""
    titles = gold.select("record_id", F.coalesce("title", F.lit("")).alias("title"))
    asked = parsed.join(titles, "record_id").withColumn("t", norm_title(F.col("title")))
    rows = warehouse.select("record_id", F.col(order).alias("o"), norm_doi(F.col("doi")).alias("doi"), norm_title(F.col("title")).alias("title"))
    by_doi = rows.where("doi is not null").groupBy("doi").agg(F.min_by("record_id", "o").alias("doi_record"))
    by_title = rows.where("title <> ''").groupBy("title").agg(F.min_by(F.struct("record_id", "doi"), "o").alias("hit"))
    tries = asked.select("record_id", F.posexplode(candidate_dois(F.col("doi_candidate_dash"), F.col("doi_candidate_dot"), F.col("primary_doi"))).alias("pos", "doi"))
    first = tries.join(by_doi, "doi").groupBy("record_id").agg(F.min_by(F.struct("doi", "doi_record"), "pos").alias("d"))
    out = asked.join(first, "record_id", "left").join(by_title.withColumnRenamed("title", "t"), "t", "left")
    how = F.when(F.col("d").isNotNull(), "doi").when(F.col("hit").isNotNull(), "normalized_title").otherwise("")
    return out.select(
        "record_id", "source", "primary_doi", "doi_candidate_dash", "doi_candidate_dot", F.substring("title", 1, 40).alias("title_first40"), (how != "").alias("matched"), how.alias("matched_by"),
        F.coalesce("d.doi", "hit.doi", F.lit("")).alias("matched_doi"), F.coalesce("d.doi_record", "hit.record_id", F.lit("")).alias("matched_warehouse_record_id"),
    )


def resolve(missing: DataFrame, landed: DataFrame) -> DataFrame:
    """missing: record_id, source, candidates (DOIs); landed: api, doi and what that API returned.  The first answer with a title:
    the record's own source is asked first, then the others in their order, each with all candidates."""
    order = F.array(*[F.lit(s) for s in ("PubMed", "OpenAlex", "EuropePMC")])
    tries = missing.select("record_id", "source", F.posexplode("candidates").alias("pos", "doi"))
    rank = F.when(F.col("api") == F.col("source"), 0).otherwise(F.array_position(order, F.col("api")))
    meta = F.struct(*[c for c in landed.columns if c != "doi"], "doi")
    hits = tries.join(landed.where(F.coalesce("title", F.lit("")) != ""), "doi").withColumn("meta", meta)
    best = hits.groupBy("record_id").agg(F.min_by("meta", F.struct(rank.alias("r"), F.col("pos"))).alias("meta"))
    return missing.select("record_id").join(best, "record_id", "left").select("record_id", F.col("meta").isNotNull().alias("ok"), "meta.*")


def crosscheck(gold: DataFrame, fetched: DataFrame, contained: DataFrame, warehouse: DataFrame) -> DataFrame:
    """Gold abstracts against the re-fetched ones, else against the warehouse row that contains the record."""

    def unique(df: DataFrame, key: str) -> DataFrame:
        """The last row of each key by seq; without that column, by all columns."""
        at = F.col("seq") if "seq" in df.columns else F.to_json(F.struct("*"))
        return df.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct("*"), at).alias("_row")).select("_row.*")

    f = unique(fetched, "record_id").select("record_id", F.coalesce("abstract_or_summary", F.lit("")).alias("re"), F.lit(True).alias("again"))
    w = unique(warehouse, "record_id").select(F.col("record_id").alias("matched_warehouse_record_id"), F.col("abstract_or_summary").alias("wh"))
    c = contained.select("record_id", "matched_warehouse_record_id")
    g = gold.select("record_id", F.coalesce("abstract_or_summary", F.lit("")).alias("gold"))
    both = g.join(f, "record_id", "left").join(c, "record_id", "left").join(w, "matched_warehouse_record_id", "left")
    both = both.withColumn("source", F.when(F.col("again"), F.col("re")).otherwise(F.coalesce("wh", F.lit(""))))
    return both.select(
        "record_id", F.when(F.col("again"), "refetched").otherwise("warehouse_existing").alias("origin"), crosscheck_status(F.col("gold"), F.col("source")).alias("status"),
        F.char_length("gold").alias("gold_abstract_len"), F.char_length("source").alias("refetched_abstract_len"),
        F.substring("gold", 1, 120).alias("gold_first120"), F.substring("source", 1, 120).alias("refetched_first120"),
    )


def warehouse_rows(gold: DataFrame, fetched: DataFrame) -> DataFrame:
    """Rows to append for re-fetched gold records; the annotators' abstract is kept, other columns come from the source first."""
    g, f = gold.alias("g"), fetched.alias("f")
    text = lambda c: F.col(c).cast("string")
    pick: dict[str, Column] = {
        "source_api": present(text("f.api")), "source_id": present(text("f.openalex_id"), text("f.pmid"), text("f.europepmc_id")), "title": present(text("f.title"), text("g.title")),
        "authors": F.lit(""), "year": present(text("f.year"), text("g.year")), "journal_or_venue": present(text("f.journal_or_venue"), text("g.journal_or_venue")),
        "doi": F.lower(present(text("f.doi"))), "pmid": present(text("f.pmid")), "pmcid": present(text("f.pmcid")), "url": present(text("f.url")),
        "abstract_or_summary": present(text("g.abstract_or_summary"), text("f.abstract_or_summary")), "citation_count": F.lit(""),
        "document_type": present(text("f.document_type"), text("g.document_type")), "query_family": F.lit("gold_hard_refetch"),
    }
    return g.join(f, F.col("g.record_id") == F.col("f.record_id")).select(F.col("g.record_id").alias("record_id"), *[v.alias(k) for k, v in pick.items()])


def summary(before: DataFrame, after: DataFrame, checked: DataFrame) -> DataFrame:
    """One row: containment before and after, and the statuses."""
    count = lambda df, tag: df.agg(F.count_if("matched").alias(f"contained_{tag}"), F.count(F.lit(1)).alias(f"records_{tag}"), F.array_sort(F.collect_list(F.when(~F.col("matched"), F.col("record_id")))).alias(f"missing_{tag}"))
    status = [F.count_if(F.col("status") == s).alias(s) for s in ("verbatim_match", "normalized_match", "refetch_failed", "no_gold_abstract", "source_side_revision_or_mismatch")]
    # three one-row aggregates side by side
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(count(before, "before")).join(one(count(after, "after")), "_k").join(one(checked.agg(*status)), "_k").drop("_k")
