"""The registered queries of the engine's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bibliography as bib
from ..functions import model_output as mo
from ..functions import values as v
from ..operators import characterize, dedup, evaluate, extract, frames, reconcile, recover, sampling
from ..sources import harvest
from . import inputs as i

PLACES = 9


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, PLACES).alias(c) if t == "double" else c for c, t in df.dtypes])


def both(spark, sf_dir):
    return i.frame(spark, sf_dir, i.GOLD), i.frame(spark, sf_dir, i.PRED)


def eval_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred = both(spark, sf_dir)
    return rounded(evaluate.evaluate(gold, pred))


def eval_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred = both(spark, sf_dir)
    return rounded(evaluate.evaluate_by_slice(gold, pred.drop("label"), ["label"]))


def quote_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.quote_check(i.long(spark, sf_dir, i.PRED)).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if("dropped").alias("dropped"))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred = both(spark, sf_dir)
    return rounded(evaluate.bootstrap(gold, pred))


def canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = i.long(spark, sf_dir, i.GOLD).withColumn("c", v.to_canonical(F.col("value"), F.col("unit"), F.col("field")))
    return rounded(c.select("record_id", "field", F.col("c.value").alias("canonical_value"), F.col("c.unit").alias("canonical_unit")))


def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return i.long(spark, sf_dir, i.PRED).select("record_id", "field", v.parse_number(F.col("value")).alias("number"), v.normalise_unit(F.col("unit")).alias("unit"), v.is_nr(F.col("value")).alias("nr"))


def number_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = i.orders(spark, sf_dir)
    return o.select("o_orderkey", v.number_string(F.col("o_totalprice")).alias("price"), v.number_string(F.col("o_totalprice") / 100000000).alias("small"), v.number_string((F.col("o_orderkey") % 97).cast("double")).alias("whole"))


def char_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, pred = both(spark, sf_dir)
    pairs = evaluate.paired(gold.drop("label"), pred.drop("label"), evaluate.MatchPolicy())
    return rounded(pairs.groupBy("field").agg(F.avg("iou").alias("mean_iou"), F.count("iou").alias("n_iou"), F.count_if("same").alias("n_same")))


def ae_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.ae_consistency(i.long(spark, sf_dir, i.PRED), ["field"]))


def regex_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.predict_cells(i.derived(spark, sf_dir, i.ABSTRACTS, "part"), extract.RegexExtractor())


def regex_then_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = i.derived(spark, sf_dir, i.ABSTRACTS, "part")
    pred = extract.predict_cells(texts, extract.RegexExtractor())
    gold = pred.withColumn("value", F.when(F.col("record_id").cast("long") % 5 == 0, "NOT_REPORTED").otherwise(F.col("value")))
    return evaluate.evaluate(gold, pred).select("field", "n", "n_emit_gold", "n_emit_pred", "n_nr_gold", F.round("acal_f1", PLACES).alias("acal_f1"))


def annotators(spark, sf_dir):
    gold, pred = both(spark, sf_dir)
    return reconcile.reconcile(gold.drop("label"), pred.drop("label"), "ann", "bob")


def reconcile_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(annotators(spark, sf_dir).stats)


def reconcile_agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotators(spark, sf_dir).agreements


def reconcile_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotators(spark, sf_dir).disagreements


def pool(spark, sf_dir):
    return i.derived(spark, sf_dir, i.POOL, "documents")


def pins(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id % 9 = 0").select(F.col("doc_id").alias("record_id"))


def splits(spark, sf_dir):
    return sampling.build_splits(pool(spark, sf_dir), pins(spark, sf_dir))


def strat_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pool(spark, sf_dir).withColumn("document_type", F.coalesce("document_type", F.lit("unknown")))
    return sampling.proportional_quotas(p, ["source_api", "document_type"], 101)


def strat_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pool(spark, sf_dir).select("record_id", "source_api")
    quotas = p.groupBy("source_api").count().select("source_api", (F.col("count") / 10).cast("int").alias("quota"))
    return sampling.quota_sample(p, ["source_api"], 1, quotas)


def splits_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits(spark, sf_dir).groupBy("split", "in_iaa").agg(F.count(F.lit(1)).alias("n"))


def split_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool(spark, sf_dir).select("record_id", bib.year_bucket(F.col("year")).alias("year_bucket"), bib.application_bucket(F.col("application_category")).alias("application_bucket"))


def slice_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.slice_summary(splits(spark, sf_dir)).select("slice", "value", "total", "iaa", "dev", "test")


def leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.leakage(splits(spark, sf_dir), pins(spark, sf_dir))


def splits_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.splits_payload(splits(spark, sf_dir))


def warehouse(spark, sf_dir):
    return i.derived(spark, sf_dir, i.WAREHOUSE, "part")


def dedup_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.staged(warehouse(spark, sf_dir)).select("seq", "record_id")


def dedup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.greedy(warehouse(spark, sf_dir)).select("slot_seq", "seq", "record_id")


def title_doi_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warehouse(spark, sf_dir).select("seq", bib.norm_title(F.col("title")).alias("title_key"), bib.norm_doi(F.col("doi")).alias("doi_key"))


def audit(spark, sf_dir):
    return i.derived(spark, sf_dir, i.AUDIT, "customer")


def id_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = audit(spark, sf_dir).select("k", bib.parse_record_id(F.col("id_text")).alias("p"))
    return a.select("k", "p.source", "p.encoded_tail", F.coalesce(F.try_element_at("p.doi_candidates", F.lit(2)), F.lit("")).alias("dot"), F.coalesce("p.primary_doi", F.lit("")).alias("dash"), "p.notes")


def containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = audit(spark, sf_dir).groupBy(F.col("id_text").alias("record_id")).agg(F.min_by("title", "k").alias("title"), F.min_by("abstract_or_summary", "k").alias("abstract_or_summary"))
    return recover.containment(recover.parse_ids(gold), gold, warehouse(spark, sf_dir))


def crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = audit(spark, sf_dir)
    other = F.when(F.col("k") % 3 == 0, F.col("abstract_or_summary")).when(F.col("k") % 3 == 1, F.upper(F.replace(F.col("abstract_or_summary"), F.lit("  "), F.lit(" ")))).otherwise(F.when(F.col("k") % 2 == 0, "").otherwise("another text"))
    status = a.select("k", bib.crosscheck_status(F.col("abstract_or_summary"), other).alias("status"))
    return status


def crosscheck_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return characterize.status_counts(crosscheck(spark, sf_dir), "status")


def llm_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = i.derived(spark, sf_dir, i.ANSWERS, "part").withColumn("r", mo.parse_llm_json(F.col("raw")))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), mo.to_prediction(F.col("r")[f]).alias("c")) for f in ("size", "stability", "payload")])
    return a.select("k", F.inline(cells)).select("k", "field", "c.*")


def numeric_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = i.derived(spark, sf_dir, i.ABSTRACTS, "part").withColumn("c", mo.numeric_span(F.col("abstract_or_summary")))
    return t.select("record_id", F.col("c.value").alias("value"), F.col("c.unit").alias("unit"))


def qa_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    half = F.floor(F.size("embedding") / 2).cast("int")
    start, end = F.slice("embedding", F.lit(1), half), F.slice("embedding", half + 1, half)
    best = mo.qa_span(start, end, F.transform(start, lambda x, k: k > 4))
    return e.select("vec_id", best.alias("s")).select("vec_id", "s.first", "s.last", F.round("s.confidence", 12).alias("confidence"))


def inverted_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = i.spread(spark.read.parquet(f"{sf_dir}/conversations.parquet")).select("conv_id", "turn", F.array_remove(F.split("text", "[ \n]+"), "").alias("w"))
    places = F.transform(F.array_distinct("w"), lambda x: F.struct(x.alias("k"), F.filter(F.transform(F.col("w"), lambda y, n: F.when(y == x, n)), lambda n: n.isNotNull()).alias("v")))
    return t.select("conv_id", "turn", bib.inverted_index_text(F.map_from_entries(places)).alias("text"))


def year_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return characterize.year_histogram(pool(spark, sf_dir))


def year_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return characterize.year_bins(pool(spark, sf_dir))


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return characterize.coverage(i.long(spark, sf_dir, i.GOLD))


def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return characterize.cooccurrence(i.long(spark, sf_dir, i.GOLD))


def source_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(characterize.distribution(pool(spark, sf_dir), "document_type"))


def top_venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return characterize.top_venues(pool(spark, sf_dir), 10, "source_api")


def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return characterize.quality(warehouse(spark, sf_dir), ["doi", "pmid", "pmcid", "title", "url"])


def corpus_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = warehouse(spark, sf_dir)
    return characterize.compare(w, w.where("seq % 10 = 0"))


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return characterize.tier(warehouse(spark, sf_dir), ["widget"], ["bolt", "brass"]).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = i.frame(spark, sf_dir, i.GOLD)
    quote = frames.verbatim(F.col("size_evidence_quote"), F.concat(F.lit("it has "), F.col("size_evidence_quote")))
    return w.select("record_id", frames.is_complete(i.FIELDS).alias("complete"), quote.alias("verbatim"))


def task_view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = i.long(spark, sf_dir, i.GOLD).drop("label")
    one = lambda name: characterize.task_view(cells, name).groupBy(F.lit(name).alias("view")).agg(F.count(F.lit(1)).alias("n"))
    return one("all").unionByName(one("numeric")).unionByName(one("evidence"))


def parse_openalex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harvest.parse_openalex(i.derived(spark, sf_dir, i.HARVESTED, "part"))


def append_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = warehouse(spark, sf_dir)
    return dedup.append(w.where("seq % 2 = 0"), w.where("seq % 2 = 1").drop("url")).select("seq", "record_id", "url")


def resolve_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = i.derived(spark, sf_dir, i.MISSING, "customer").select("record_id", "source", F.array("first_doi", "second_doi").alias("candidates"))
    return recover.resolve(missing, i.derived(spark, sf_dir, i.LANDED, "supplier"))


def crosscheck_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = audit(spark, sf_dir).select(F.col("k").cast("string").alias("record_id"), "abstract_or_summary", "k")
    held = F.when(F.col("k") % 4 == 0, "").otherwise(F.concat(F.lit("rec_"), F.col("k").cast("string")))
    contained = gold.select("record_id", held.alias("matched_warehouse_record_id"))
    return recover.crosscheck(gold, i.derived(spark, sf_dir, i.FETCHED, "customer"), contained, warehouse(spark, sf_dir))


def other_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pool(spark, sf_dir).select("record_id", "year", "document_type")
    by_time = sampling.temporal_split(p, 2015).withColumnRenamed("split", "by_year")
    return sampling.holdout_split(by_time, "document_type", ["review", "unknown"]).withColumnRenamed("split", "by_type")


def splits_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = sampling.splits_meta(splits(spark, sf_dir))
    return m.select(*[F.array_join(c, "|").alias(c) if t.startswith("array") else c for c, t in m.dtypes])


QUERIES = {
    f.__name__: f
    for f in (
        eval_headline, eval_by_slice, quote_check, bootstrap_ci, canonical_values, parse_numbers, number_strings, char_overlap, ae_consistency,
        regex_extract, regex_then_eval, reconcile_stats, reconcile_agreements, reconcile_disagreements, strat_quotas, strat_sample, splits_rows, split_buckets,
        slice_totals, leakage, splits_payload, dedup_staged, dedup_greedy, title_doi_keys, id_parse, containment, crosscheck, crosscheck_counts, llm_json, numeric_spans,
        qa_spans, inverted_index, year_hist, year_bins, coverage, cooccurrence, source_shares, top_venues, missing_values, corpus_compare, tiers, completeness, task_view_counts,
        parse_openalex, append_rows, resolve_sources, crosscheck_records, other_splits, splits_meta,
    )
}
