"""Agreement of two annotators, and the cells to adjudicate."""

from __future__ import annotations

from pathlib import PurePath
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import near
from .evaluate import MatchPolicy, ordinal, paired


class Report(NamedTuple):
    stats: DataFrame
    agreements: DataFrame
    disagreements: DataFrame
    label_a: str
    label_b: str

    def write(self, folder: str) -> None:
        for name in ("stats", "agreements", "disagreements"):
            getattr(self, name).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")

    def markdown(self) -> str:
        """The statistics (a row for each field) as a table."""
        columns = ["field", "n", "kappa_NR_vs_emit", "raw_NR_vs_emit_agreement", "value_match_rate_among_both_emit", "num_match_canonical", "mean_span_iou_among_both_emit"]
        show = lambda x: "—" if x is None or x != x else f"{x:.3f}" if isinstance(x, float) else str(x)
        rows = self.stats.orderBy(ordinal(F.col("field"))).select(*columns).collect()
        lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
        return "\n".join([*lines, *("| " + " | ".join(show(x) for x in r) + " |" for r in rows)])


def labels_of(path_a: str, path_b: str) -> tuple[str, str]:
    """Annotators' names from the file names' last parts; A and B if they are the same."""
    a, b = (PurePath(p).stem.split("_")[-1] for p in (path_a, path_b))
    return ("A", "B") if a == b else (a, b)


def reconcile(a: DataFrame, b: DataFrame, label_a: str = "A", label_b: str = "B", policy: MatchPolicy = MatchPolicy()) -> Report:
    """a, b: long or wide frames.  Numbers match relative to annotator A."""
    pairs = paired(a, b, policy)
    x, y, same, n = F.col("a_emit"), F.col("b_emit"), F.col("same"), F.count_if
    c = pairs.groupBy("field").agg(
        F.count(F.lit(1)).alias("n"), n(x & y).alias("n11"), n(~x & ~y).alias("n00"), n(x & ~y).alias("n10"), n(~x & y).alias("n01"), n(same).alias("n_match"),
        n("num").alias("n_num_evaluable"), n(F.col("num") & near(F.col("a_x.value"), F.col("b_x.value"), policy.tolerance)).alias("num_ok"),
        F.avg("iou").alias("mean_span_iou_among_both_emit"), F.count("iou").alias("n_iou_evaluable"),
    )
    if a.select("record_id").join(b.select("record_id"), "record_id", "left_semi").isEmpty():  # ids only: nothing is compared twice
        raise ValueError("the annotators have no record in common")
    total = F.col("n").cast("double")
    po = (F.col("n11") + F.col("n00")) / total
    pe = ((F.col("n11") + F.col("n10")) / total) * ((F.col("n11") + F.col("n01")) / total) + ((F.col("n00") + F.col("n01")) / total) * ((F.col("n00") + F.col("n10")) / total)
    stats = c.select(
        "field", "n", F.coalesce(F.try_divide(po - pe, 1 - pe), F.lit(float("nan"))).alias("kappa_NR_vs_emit"), po.alias("raw_NR_vs_emit_agreement"),
        F.col("n11").alias("n_emit_both"), F.try_divide("n_match", "n11").alias("value_match_rate_among_both_emit"),
        F.try_divide("num_ok", "n_num_evaluable").alias("num_match_canonical"), "n_num_evaluable", "mean_span_iou_among_both_emit", "n_iou_evaluable",
    )
    sides = [F.col(f"{s}_{p}").alias(f"{label}_{p}") for s, label in (("a", label_a), ("b", label_b)) for p in ("value", "unit", "evidence_quote")]
    agreed = same | (~x & ~y)
    kind = F.when(x & y, "value_mismatch").when(x, f"{label_a}_emit_{label_b}_NR").otherwise(f"{label_b}_emit_{label_a}_NR")
    resolved = [F.col(f"a_{p}").alias(f"resolved_{p}") for p in ("value", "unit", "evidence_quote")]
    blank = [F.lit("").alias(f"adjudicated_{p}") for p in ("value", "unit", "evidence_quote")]
    return Report(
        stats, pairs.where(agreed).select("record_id", "field", *sides, *resolved),
        pairs.where(~agreed).select("record_id", "field", *sides, kind.alias("disagreement_type"), *blank), label_a, label_b,
    )
