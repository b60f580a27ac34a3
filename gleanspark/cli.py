"""Command line: build-iaa-subset, build-splits, evaluate, reconcile, quote-check, recover, harvest."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import dedup, evaluate, frames, reconcile, recover, sampling
from .schema import IAA_FRONT, annotation_columns
from .session import shared_checkpoints
from .sources import harvest


def build_iaa_subset(spark: SparkSession, a: argparse.Namespace) -> None:
    sample = sampling.iaa_subset(frames.read_csv(spark, a.gold), a.n, a.min_abstract_chars, a.seed).cache()
    frames.write_csv(sample.select(*IAA_FRONT, *[F.lit("").alias(c) for c in [*annotation_columns(), "ambiguity_flag", "annotator_notes"]]), f"{a.out}/iaa_subset")
    frames.write_csv(sample.select("record_id", "nb_label", "doc_label", "year"), f"{a.out}/iaa_subset_keys")
    sample.groupBy("nb_label", "doc_label").count().show(truncate=False)


def build_splits(spark: SparkSession, a: argparse.Namespace) -> None:
    keys = frames.read_csv(spark, a.iaa_keys, ["record_id"])
    splits = sampling.build_splits(frames.read_csv(spark, a.gold), keys).cache()
    sampling.splits_payload(splits).write.mode("overwrite").json(f"{a.out}/splits")
    out = Path(a.out)
    out.mkdir(parents=True, exist_ok=True)
    (out / "splits_meta.json").write_text(sampling.splits_meta(splits).toJSON().first())
    table = lambda rows, cols: "\n".join(["| " + " | ".join(cols) + " |", "|" + "---|" * len(cols), *("| " + " | ".join(str(r[c]) for c in cols) + " |" for r in rows)])
    (out / "slice_summary.md").write_text(table(sampling.slice_summary(splits).orderBy("slice", "value").collect(), ["slice", "value", "total", "dev", "test", "iaa"]))
    (out / "leakage_report.md").write_text(table(sampling.leakage(splits, keys).collect(), ["check", "ok", "found", "of"]))


def run_evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    gold, pred = (frames.to_long(frames.validate(frames.read_csv(spark, p))) for p in (a.gold, a.pred))
    rows = evaluate.evaluate(gold, pred).orderBy("field_ord").drop("field_ord")
    frames.write_csv(rows.coalesce(1), a.out) if a.out else rows.show(truncate=False)


def run_reconcile(spark: SparkSession, a: argparse.Namespace) -> None:
    one, two = (frames.to_long(frames.validate(frames.read_csv(spark, p))) for p in (a.a, a.b))
    report = reconcile.reconcile(one, two, *reconcile.labels_of(a.a, a.b))
    report.write(a.out)
    Path(a.out, "report.md").write_text(report.markdown())


def quote_check(spark: SparkSession, a: argparse.Namespace) -> None:
    checked = evaluate.quote_check(frames.to_long(frames.validate(frames.read_csv(spark, a.pred))))
    frames.write_csv(frames.to_wide(checked), a.out)
    evaluate.with_macro(evaluate.field_metrics(frames.to_long(frames.read_csv(spark, a.gold)), checked)).orderBy("field_ord").show(truncate=False)


def run_recover(spark: SparkSession, a: argparse.Namespace) -> None:
    """Without network: what was landed before stands for the sources' answers."""
    gold, warehouse = (frames.read_csv(spark, p) for p in (a.gold, a.warehouse))
    warehouse = warehouse.withColumn("seq", F.monotonically_increasing_id())
    parsed = recover.parse_ids(gold)
    before = recover.containment(parsed, gold, warehouse)
    frames.write_csv(parsed, f"{a.out}/identifier_parse")
    frames.write_csv(before, f"{a.out}/containment_before")
    if a.landed:
        dois = F.array("doi_candidate_dash", "doi_candidate_dot")
        missing = before.where("not matched").select("record_id", "source", dois.alias("candidates"))
        fetched = recover.resolve(missing, frames.read_csv(spark, a.landed)).where("ok")
        merged = dedup.staged(dedup.append(warehouse, recover.warehouse_rows(gold, fetched).withColumn("seq", F.monotonically_increasing_id())))
        after = recover.containment(parsed, gold, merged)
        checked = recover.crosscheck(gold, fetched, before, merged)
        frames.write_csv(after, f"{a.out}/containment_after")
        frames.write_csv(checked, f"{a.out}/crosscheck")
        Path(a.out, "summary.json").write_text(json.dumps(recover.summary(before, after, checked).first().asDict()))
        if a.write_warehouse:
            frames.write_csv(merged.drop("seq"), a.write_warehouse)


def call(url: str, params: dict) -> tuple[int, object]:
    """One HTTP request: status, and the parsed JSON or the text."""
    import urllib.error
    import urllib.parse
    import urllib.request

    try:
        with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params)}", timeout=30) as r:
            text = r.read().decode()
            return r.status, json.loads(text) if "json" in r.headers.get("Content-Type", "") else text
    except urllib.error.HTTPError as e:
        return e.code, None


def make_source(api: str) -> harvest.Source:
    return {"OpenAlex": harvest.OpenAlex, "PubMed": harvest.PubMed}[api](call)


def run_harvest(spark: SparkSession, a: argparse.Namespace) -> None:
    families = {k: v for k, v in harvest.QUERY_FAMILIES.items() if a.family in (None, k)}
    work = harvest.work_table(spark, [a.source] if a.source else ["OpenAlex", "PubMed"], families)
    harvest.land(harvest.harvest(work, make_source, a.per_query_cap), f"{a.out}/raw")  # each request once: what follows reads what landed
    raw = spark.read.schema("query_family string, query string, raw string, error string, api string").json(f"{a.out}/raw")
    frames.write_csv(harvest.harvest_log(raw), f"{a.out}/log")
    rows = harvest.parse_openalex(raw).unionByName(harvest.parse_pubmed(raw)).withColumn("seq", F.monotonically_increasing_id()).checkpoint()
    frames.write_csv(dedup.greedy(rows).drop("slot_seq", "seq"), f"{a.out}/warehouse")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gleanspark")
    sub = p.add_subparsers(required=True)

    def command(name, run, *required, **optional):
        c = sub.add_parser(name)
        for r in required:
            c.add_argument(f"--{r}", required=True)
        for k, v in optional.items():
            c.add_argument(f"--{k.replace('_', '-')}", default=v, type=type(v) if v is not None else str)
        c.set_defaults(run=run)

    command("build-iaa-subset", build_iaa_subset, "gold", "out", n=40, min_abstract_chars=200, seed=42)
    command("build-splits", build_splits, "gold", "iaa-keys", "out")
    command("evaluate", run_evaluate, "gold", "pred", out=None)
    command("reconcile", run_reconcile, "a", "b", "out")
    command("quote-check", quote_check, "gold", "pred", "out")
    command("harvest", run_harvest, "out", per_query_cap=200, family=None, source=None)
    command("recover", run_recover, "gold", "warehouse", "out", landed=None, write_warehouse=None)
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    shared_checkpoints(spark)
    a.run(spark, a)


if __name__ == "__main__":
    main()
