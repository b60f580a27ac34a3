import json

from pyspark.sql import functions as F

from gleanspark import cli
from gleanspark.operators import frames
from gleanspark.schema import HEADLINE, NR, annotation_schema
from gleanspark.streaming import seen


def write(spark, path, value):
    rows = [(f"r{i}", *[p for f in HEADLINE for p in ((value, "nm", f"{value} nm") if f == "size" else (NR, NR, NR))], "", "") for i in range(3)]
    frames.write_csv(spark.createDataFrame(rows, annotation_schema()).coalesce(1), path)


def test_evaluate_and_reconcile(spark, tmp_path):
    write(spark, f"{tmp_path}/gold_ann", "200")
    write(spark, f"{tmp_path}/gold_bob", "201")
    cli.main(["evaluate", "--gold", f"{tmp_path}/gold_ann", "--pred", f"{tmp_path}/gold_bob", "--out", f"{tmp_path}/scores"])
    rows = frames.read_csv(spark, f"{tmp_path}/scores").collect()
    assert [r["field"] for r in rows] == [*HEADLINE, "MACRO"] and float(rows[0]["acal_f1"]) == 0.5
    cli.main(["reconcile", "--a", f"{tmp_path}/gold_ann", "--b", f"{tmp_path}/gold_bob", "--out", f"{tmp_path}/rec"])
    assert "| size | 3 |" in (tmp_path / "rec" / "report.md").read_text() and spark.read.option("header", True).csv(f"{tmp_path}/rec/agreements").count() == 18
    cli.main(["quote-check", "--gold", f"{tmp_path}/gold_ann", "--pred", f"{tmp_path}/gold_bob", "--out", f"{tmp_path}/checked"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/checked").where("size_value = '201'").count() == 3


def test_subset_and_splits(spark, tmp_path):
    rows = [(f"r{i}", f"t{i}", str(2000 + i % 25), "j", ["original", "review"][i % 2], ["nanobubble", "nanoparticle", "micro/nanobubble", None][i % 4], "water", "x" * (150 + i), "s") for i in range(200)]
    pool = spark.createDataFrame(rows, "record_id string, title string, year string, journal_or_venue string, document_type string, nanobubble_vs_nanoparticle string, application_category string, abstract_or_summary string, source_api string")
    frames.write_csv(pool.coalesce(1), f"{tmp_path}/pool")
    cli.main(["build-iaa-subset", "--gold", f"{tmp_path}/pool", "--out", str(tmp_path)])
    keys = frames.read_csv(spark, f"{tmp_path}/iaa_subset_keys")
    assert keys.count() == 40 and frames.read_csv(spark, f"{tmp_path}/iaa_subset").where(F.length("abstract_or_summary") < 200).count() == 0
    cli.main(["build-splits", "--gold", f"{tmp_path}/pool", "--iaa-keys", f"{tmp_path}/iaa_subset_keys", "--out", f"{tmp_path}/splits"])
    meta = json.loads((tmp_path / "splits" / "splits_meta.json").read_text())
    assert (meta["n_total"], meta["n_dev"], meta["n_iaa"]) == (200, 20, 40) and "PASS" not in (tmp_path / "splits" / "leakage_report.md").read_text()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "record_id string, doi string, ts timestamp"
    lines = [{"record_id": "a", "doi": "10.1/X", "ts": "2024-01-01T00:00:00"}, {"record_id": "b", "doi": "https://doi.org/10.1/x", "ts": "2024-01-01T01:00:00"}, {"record_id": "c", "doi": None, "ts": "2024-01-01T01:00:00"}]
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, lines)))
    from pyspark.sql.types import StructType

    got = []

    def run():
        stream = seen.landed(spark, f"{tmp_path}/in", StructType.fromDDL(schema))
        seen.into_batches(seen.first_by_doi(stream, "ts"), lambda df, n: got.extend(r["record_id"] for r in df.collect()), f"{tmp_path}/ck").awaitTermination()

    run()
    assert len(got) == 2 and "c" in got
    (tmp_path / "in" / "2.json").write_text(json.dumps(lines[0] | {"record_id": "d"}))
    run()  # goes on with the new file; its DOI was seen
    assert len(got) == 2
