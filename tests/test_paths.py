from gleanspark import paths
from gleanspark.operators import sampling


def test_paths(tmp_path):
    (tmp_path / "pyproject.toml").write_text("")
    p = paths.Paths.discover(tmp_path)
    p.make()
    assert p.predictions("regex-v1").parent.name == "regex" and p.predictions("biobert").parent.name == "encoder" and p.predictions("some-7b").parent.name == "llm"
    assert p.metrics("x").parent.is_dir() and p.slices("x").name == "x.csv"


def test_pools_and_other_splits(spark):
    df = spark.createDataFrame([(str(i), "ab"[i % 2], str(2000 + i), float(i)) for i in range(20)] + [("x", "b", None, -1.0)], "record_id string, kind string, year string, score double")
    pool = sampling.candidate_pool(df, ["kind"], 6, "score").collect()
    assert sorted(r["record_id"] for r in pool) == sorted(["18", "16", "14", "19", "17", "15"])
    assert sampling.temporal_split(df, 2010).where("split = 'dev'").count() == 10
    assert sampling.holdout_split(df, "kind", ["a"]).where("split = 'test'").count() == 10
