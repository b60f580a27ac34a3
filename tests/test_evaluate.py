import math

import pytest
from pyspark.sql import functions as F

from gleanspark.operators import evaluate, frames, reconcile
from gleanspark.plans import queries
from gleanspark.schema import HEADLINE, NR, annotation_columns, annotation_schema

GOLD = {
    ("r1", "size"): ("200", "nm", "200 nm particles"), ("r1", "zeta_potential"): ("-12.5", "mV", "zeta -12.5 mV"), ("r1", "payload"): ("doxorubicin", "", "loaded with doxorubicin"),
    ("r1", "loading_efficiency"): ("80", "%", "80% encapsulation"), ("r2", "size"): ("500", "nm", "diameter 500 nm"), ("r2", "stability"): ("48", "h", "stable for 48 h"),
    ("r4", "size"): ("0.5", "um", "0.5 um diameter"), ("r4", "loading_efficiency"): ("0.72", "", "loading 0.72"), ("r4", "payload"): ("paclitaxel", "", "paclitaxel-loaded"),
    ("r5", "size"): ("180", "nm", "180 nm"), ("r5", "release_profile"): ("sustained 72 h", NR, "sustained release over 72 h"),
}
GUESS = {"size": ("100", "nm"), "zeta_potential": ("-20", "mV"), "stability": ("24", "h"), "payload": ("drug", ""), "loading_efficiency": ("70", "%"), "release_profile": ("sustained", "")}


def frame(spark, cells):
    rows = []
    for r in ("r1", "r2", "r3", "r4", "r5", "r6"):
        rows.append((r, *[p for f in HEADLINE for p in cells.get((r, f), (NR, NR, NR))], "", ""))
    return frames.validate(spark.createDataFrame(rows, annotation_schema()))


@pytest.fixture(scope="module")
def long(spark):
    good = GOLD | {("r1", "size"): ("205", "nm", "200 nm particles"), ("r4", "size"): ("500", "nm", "0.5 um diameter"), ("r4", "loading_efficiency"): ("72", "%", "loading 0.72")}
    bad = {(r, f): GOLD.get((r, f), (*GUESS[f], "guessed")) for r in ("r1", "r2", "r3", "r4", "r5", "r6") for f in HEADLINE}
    return {k: frames.to_long(frame(spark, c)).cache() for k, c in (("gold", GOLD), ("good", good), ("bad", bad))}


def test_good_predictions(long):
    rows = {r["field"]: r for r in evaluate.evaluate(long["gold"], long["good"]).collect()}
    assert all(rows[f]["acal_f1"] == 1 and rows[f]["naive_f1"] == 1 and rows[f]["nr_f1"] == 1 for f in [*HEADLINE, "MACRO"])
    ae = {"size": 0.5, "zeta_potential": 1, "stability": 1, "payload": 1, "loading_efficiency": 1, "release_profile": 0, "MACRO": 0.75}
    assert {f: r["ae_consistency"] for f, r in rows.items()} == ae
    s = rows["size"]
    assert (s["n"], s["n_emit_gold"], s["n_emit_pred"], s["n_nr_gold"], s["num_match"], s["n_num_evaluable"]) == (6, 4, 4, 2, 1, 4)
    assert rows["loading_efficiency"]["n_unit_evaluable"] == 1 and rows["payload"]["num_match"] is None and rows["MACRO"]["n_emit_gold"] is None


def test_hallucinated_predictions(long):
    rows = {r["field"]: r for r in evaluate.evaluate(long["gold"], long["bad"]).collect()}
    assert rows["MACRO"]["naive_f1"] == pytest.approx(93 / 210) and rows["MACRO"]["nr_f1"] == 0 and rows["MACRO"]["ae_consistency"] == pytest.approx(5 / 18)
    assert rows["size"]["naive_f1"] == pytest.approx(0.8) and rows["zeta_potential"]["naive_f1"] == pytest.approx(2 / 7)
    assert sorted(r["field_ord"] for r in rows.values())[-1] == 99


def test_reconcile(spark, long):
    same = reconcile.reconcile(long["gold"], long["good"])
    assert {r["kappa_NR_vs_emit"] for r in same.stats.collect()} == {1.0}
    assert (same.agreements.count(), same.disagreements.count()) == (36, 0)
    r = reconcile.reconcile(long["gold"], long["bad"], "gold", "hall")
    assert {x["kappa_NR_vs_emit"] for x in r.stats.collect()} == {0.0}
    assert r.agreements.count() == 11 and {x[0] for x in r.disagreements.select("disagreement_type").collect()} == {"hall_emit_gold_NR"} and r.disagreements.count() == 25
    both = reconcile.reconcile(long["bad"], long["bad"])
    assert all(math.isnan(x["kappa_NR_vs_emit"]) for x in both.stats.collect())
    assert "size" in r.markdown() and reconcile.labels_of("x_ann.csv", "y_bob.csv") == ("ann", "bob") and reconcile.labels_of("a_x.csv", "b_x.csv") == ("A", "B")
    with pytest.raises(ValueError):
        reconcile.reconcile(long["gold"], long["gold"].where("false"))


def test_quote_check_and_bootstrap(long):
    checked = evaluate.quote_check(long["bad"])
    assert checked.where("dropped").count() == 25 + 1  # the guesses, and "sustained 72 h", which "sustained release over 72 h" does not hold
    row = evaluate.bootstrap(long["gold"], long["bad"], rounds=50).first()
    assert row["rounds"] == 50 and row["low"] <= row["mean"] <= row["high"]


def test_wide_frames_score_like_long_ones(spark, long):
    guesses = {(r, f): GOLD.get((r, f), (*GUESS[f], "guessed")) for r in ("r1", "r2", "r3", "r4", "r5", "r6") for f in HEADLINE}
    gold, bad = frame(spark, GOLD), frame(spark, guesses)
    fewer = gold.where("record_id <> 'r3'")  # r3 is predicted only: it counts for ae_consistency alone
    want = evaluate.evaluate(frames.to_long(fewer), long["bad"]).collect()
    assert sorted(evaluate.evaluate(fewer, bad).collect()) == sorted(want) == sorted(evaluate.evaluate(fewer, long["bad"]).collect())
    assert next(r for r in want if r["field"] == "size")["n"] == 5
    sliced = fewer.withColumn("half", F.col("record_id") < "r4")
    by_long = evaluate.evaluate_by_slice(frames.to_long(sliced, keep=["half"]), long["bad"], ["half"], 1)
    assert sorted(evaluate.evaluate_by_slice(sliced, bad, ["half"], 1).collect()) == sorted(by_long.collect())
    assert reconcile.reconcile(gold, bad).disagreements.count() == 25
    assert evaluate.evaluate(gold.where("false"), bad).where("field <> 'MACRO'").count() == 0


def test_cells_are_not_broadcast(spark):
    wide = frames.empty(spark.range(9).select(F.col("id").alias("record_id")))  # the planner knows that it is small
    cells = frames.to_long(wide)
    for a, b in ((wide, wide), (cells, cells), (wide, cells)):
        plan = evaluate.evaluate(a, b)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_bootstrap_query_draws_the_default_rounds(long, monkeypatch):
    monkeypatch.setattr(queries, "both", lambda spark, sf_dir: (long["gold"], long["bad"]))
    assert queries.bootstrap_ci(None, "").first()["rounds"] == 1000


def test_bootstrap_draws_a_record_once_for_all_its_cells(spark, long):
    out = evaluate.bootstrap(long["gold"], long["bad"], rounds=11)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode") < plan.index("collect_list")  # drawn above the step that makes one row of a record's cells
    u = F.pmod(F.xxhash64(F.lit(42), F.col("round"), F.col("r")), F.lit(1_000_003)) / 1_000_003
    ids = spark.createDataFrame([(f"r{i}",) for i in range(1, 7)], "r string").withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(11))))
    below = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(8)]
    times = {(x["r"], x["round"]): sum(x["u"] >= b for b in below) for x in ids.withColumn("u", u).collect()}
    scores = []
    for n in range(1, 12):
        w = lambda f, want: sum(times[r, n] for r in ("r1", "r2", "r3", "r4", "r5", "r6") if ((r, f) in GOLD) == want)  # noqa: B023, E731
        scores.append(sum(2 * w(f, True) / (2 * w(f, True) + w(f, False)) / 2 if w(f, True) else 0 for f in HEADLINE) / 6)  # all is told, so nothing is rightly abstained
    assert out.first()["mean"] == pytest.approx(sum(scores) / 11)


def test_frames(spark, tmp_path):
    with pytest.raises(ValueError):
        frames.validate(spark.createDataFrame([("r1",)], "record_id string"))
    f = frame(spark, GOLD)
    with pytest.raises(ValueError):
        frames.validate(f.union(f))
    frames.write_csv(f.coalesce(1), str(tmp_path / "f"))
    back = frames.read_csv(spark, str(tmp_path / "f"))
    assert back.columns == f.columns and frames.cell(frames.to_long(back), "r1", "size")["value"] == "200"
    (tmp_path / "d.csv").write_text('a,a,b\n1,2,"x, ""y""\nz"\n')
    assert [tuple(r) for r in frames.read_csv(spark, str(tmp_path / "d.csv")).collect()] == [("1", 'x, "y"\nz')]
    with pytest.raises(KeyError):
        frames.cell(frames.to_long(f), "r9", "size")
    blank = frames.empty(f.select("record_id"))
    assert set(annotation_columns()) < set(blank.columns) and blank.where(frames.is_complete()).count() == 0
    assert frames.to_long(blank, blank_is_emit=True).where("value = 'nan'").count() == 36
    assert frames.to_wide(frames.to_long(f)).where("size_value = '200'").count() == 1
    assert f.select(F.count_if(frames.is_complete())).first()[0] == 6
