"""Scores of predicted against gold cells: one join and one aggregation for all fields.

Frames are long (a row for each cell) or wide (a row for each record); wide ones are cheaper, as records are joined
before they become cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import canonical_amount, canonical_text, char_iou, either_contains, is_nr, near, normalise_unit, numeric_match, parse_number, supported
from ..schema import HEADLINE, NR, NUMERIC, PARTS
from ..session import unsent
from .frames import side_by_side, to_long

METRICS = ["naive_f1", "nr_f1", "acal_f1", "span_iou", "num_match", "unit_accuracy", "ae_consistency"]
COUNTS = ["n_emit_gold", "n_emit_pred", "n_nr_gold", "n_iou_evaluable", "n_num_evaluable", "n_unit_evaluable"]


@dataclass(frozen=True)
class MatchPolicy:
    """When two emitted values agree; subclass to change it."""

    tolerance: float = 0.05

    def match(self, field: Column, gold_text: Column, other_text: Column, gold_x: Column, other_x: Column) -> Column:
        """From the values' canonical texts and canonical amounts (null if unknown)."""
        return F.when(field.isin(NUMERIC), numeric_match(gold_text, other_text, gold_x, other_x, self.tolerance)).otherwise(either_contains(gold_text, other_text))


def ordinal(field: Column) -> Column:
    """Place of a field in results."""
    return F.array_position(F.array(*map(F.lit, HEADLINE)), field).cast("int")


def is_wide(frame: DataFrame) -> bool:
    return "field" not in frame.columns


def joined(a: DataFrame, b: DataFrame, keep: list[str], how: str) -> DataFrame:
    if is_wide(a) and is_wide(b):
        return side_by_side(a, b, keep, how)
    a, b = (to_long(x, keep=k) if is_wide(x) else x for x, k in ((a, list(keep)), (b, [])))
    left = a.select(*keep, "record_id", "field", F.lit(True).alias("aligned"), *[F.col(p).alias(f"a_{p}") for p in PARTS])
    right = b.select("record_id", "field", *[F.col(p).alias(f"b_{p}") for p in PARTS])
    return left.join(unsent(right), ["record_id", "field"], how).withColumn("aligned", F.coalesce("aligned", F.lit(False)))


def paired(a: DataFrame, b: DataFrame, policy: MatchPolicy, keep: list[str] = (), how: str = "inner") -> DataFrame:
    """Cells of both frames side by side, each compared once: emits, canonical amounts, match and character overlap of quotes.  After
    a right join the cells that only b has are not aligned."""
    both = joined(a, b, keep, how)
    # in steps, so that each text is normalised once; and what is asked of a text more than once has a column, as the steps become one
    # generated method, and the JVM compiles none of over 8,000 bytes (evaluate's still has 8,340)
    told, steps = {}, {}
    for s in "ab":
        nr = {p: f"{s}_no_{p}" for p in PARTS}
        told |= {nr[p]: is_nr(F.col(f"{s}_{p}")) for p in PARTS}
        col = lambda p, s=s, nr=nr: (F.col(f"{s}_{p}"), F.col(nr[p]))
        steps |= {f"{s}_emit": ~F.col(nr["value"]), f"{s}_n": parse_number(*col("value")), f"{s}_u": normalise_unit(*col("unit"))}
        steps |= {f"{s}_t": canonical_text(*col("value")), f"{s}_q": canonical_text(*col("evidence_quote"))}
    both = both.withColumns(told)
    both = both.withColumns(steps).withColumns({f"{s}_x": canonical_amount(F.col(f"{s}_n"), F.col(f"{s}_u"), F.col("field")) for s in "ab"})
    emit = F.col("a_emit") & F.col("b_emit")
    return both.withColumns(
        {
            "emit": emit,
            "same": emit & policy.match(F.col("field"), F.col("a_t"), F.col("b_t"), F.col("a_x.value"), F.col("b_x.value")),
            "iou": F.when(emit & (F.col("a_q") != "") & (F.col("b_q") != ""), char_iou(F.col("a_q"), F.col("b_q"))),
            "num": emit & F.col("a_x.value").isNotNull() & F.col("b_x.value").isNotNull(),
        }
    )


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp > 0, 2.0 * tp / (2.0 * tp + fp + fn)).otherwise(0.0)


def counted(pairs: DataFrame, by: list[str], tolerance: float) -> DataFrame:
    """Everything a group's scores need, as counts and sums.  Only ae_consistency asks for cells that aren't aligned."""
    n = lambda c: F.count(F.when(F.col("aligned") & (F.col(c) if isinstance(c, str) else c), 1))  # noqa: E731 (count_if would become a column before)
    told = supported(F.col("b_n"), F.col("b_t"), F.col("b_q"), F.col("field"))
    g, p, same = F.col("a_emit"), F.col("b_emit"), F.col("same")
    units = F.col("num") & ~F.col("a_no_unit") & ~F.col("b_no_unit")
    return pairs.groupBy(*by).agg(
        n(F.lit(True)).alias("n"), F.avg(F.when(p, told.cast("double"))).alias("ae_consistency"), n(same).alias("tp"), n(p & ~same).alias("fp"), n(g & ~p).alias("fn"),
        n(~g & ~p).alias("nr_tp"), n(g & ~p).alias("nr_fp"), n(~g & p).alias("nr_fn"),
        F.avg("iou").alias("span_iou"), F.count("iou").alias("n_iou_evaluable"),
        n(F.col("num") & near(F.col("a_x.value"), F.col("b_x.value"), tolerance)).alias("num_ok"), n("num").alias("n_num_evaluable"),
        n(units & (F.col("a_x.unit") == F.col("b_x.unit"))).alias("unit_ok"), n(units).alias("n_unit_evaluable"),
    )


def with_support(cells: DataFrame) -> DataFrame:
    """Adds _n, _t, _e (number, canonical value and evidence) and _ok: the evidence supports the answer."""
    steps = {"_n": parse_number(F.col("value")), "_t": canonical_text(F.col("value")), "_e": canonical_text(F.col("evidence_quote"))}
    return cells.withColumns(steps).withColumn("_ok", supported(F.col("_n"), F.col("_t"), F.col("_e"), F.col("field")))


def ae_consistency(pred: DataFrame, by: list[str]) -> DataFrame:
    """Over all predicted cells, aligned or not: the share of emitted ones that their evidence supports."""
    return with_support(pred.where(~is_nr(F.col("value")))).groupBy(*by).agg(F.avg(F.col("_ok").cast("double")).alias("ae_consistency"))


def field_metrics(gold: DataFrame, pred: DataFrame, policy: MatchPolicy = MatchPolicy(), rel_tol: float = 0.05, by: list[str] = ()) -> DataFrame:
    """by, field and all scores.  The recall of values counts only gold cells without any prediction as missed; a wrong value
    is a false positive alone.  Without by, all predicted cells count for ae_consistency, aligned or not; with it, those of gold's records."""
    counts = counted(paired(gold, pred, policy, list(by), "inner" if by else "right"), [*by, "field"], rel_tol).where("n > 0")
    rows = counts.select(
        *by, "field", "n", f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("naive_f1"), f1(F.col("nr_tp"), F.col("nr_fp"), F.col("nr_fn")).alias("nr_f1"),
        (F.col("tp") + F.col("fn")).alias("n_emit_gold"), (F.col("tp") + F.col("fp")).alias("n_emit_pred"), (F.col("nr_tp") + F.col("nr_fn")).alias("n_nr_gold"),
        "span_iou", "n_iou_evaluable", F.try_divide("num_ok", "n_num_evaluable").alias("num_match"), "n_num_evaluable",
        F.try_divide("unit_ok", "n_unit_evaluable").alias("unit_accuracy"), "n_unit_evaluable", "ae_consistency",
    )
    rows = rows.withColumn("acal_f1", (F.col("naive_f1") + F.col("nr_f1")) / 2)
    if by and not (is_wide(gold) and is_wide(pred)):  # a long frame may lack a field of a record that has a slice
        ids = gold.select("record_id", *by).distinct()
        cells = to_long(pred) if is_wide(pred) else pred
        rows = rows.drop("ae_consistency").join(ae_consistency(cells.join(unsent(ids), "record_id"), [*by, "field"]), [*by, "field"], "left")
    return rows.select(*by, "field", "n", *METRICS, *COUNTS)


def with_macro(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """The rows and their means over fields (nulls left out), with field_ord for the order: the mean comes last."""
    # each row counts for its field and for the mean, so the scores are computed once
    twice = rows.withColumn("_of", F.explode(F.array("field", F.lit("MACRO")))).groupBy(*by, F.col("_of").alias("field"))
    out = twice.agg(F.max("n").alias("n"), *[F.avg(m).alias(m) for m in METRICS], *[F.max(c).alias(c) for c in COUNTS])
    single = F.col("field") != "MACRO"
    return out.select(*by, "field", "n", *METRICS, *[F.when(single, F.col(c)).alias(c) for c in COUNTS], F.when(single, ordinal(F.col("field"))).otherwise(99).alias("field_ord"))


def evaluate(gold: DataFrame, pred: DataFrame, policy: MatchPolicy = MatchPolicy(), rel_tol: float = 0.05) -> DataFrame:
    return with_macro(field_metrics(gold, pred, policy, rel_tol))


def evaluate_by_slice(gold: DataFrame, pred: DataFrame, by: list[str], least: int = 4) -> DataFrame:
    """Mean scores by slice; slices of fewer than ``least`` records show none."""
    rows = with_macro(field_metrics(gold, pred, by=by), by).where("field = 'MACRO'")
    return rows.select(*by, "n", *[F.when(F.col("n") >= least, F.col(m)).alias(m) for m in METRICS])


def quote_check(pred: DataFrame) -> DataFrame:
    """Emitted cells that their evidence doesn't support become "not reported"; dropped says which."""
    steps = with_support(pred)
    kept = F.col("_ok") | ((F.col("_e") != NR) & F.col("_e").contains(F.col("_t")))  # a number may also stand there as written
    marked = steps.withColumn("dropped", (F.col("_t") != NR) & ~kept).drop("_n", "_t", "_e", "_ok")
    return marked.withColumns({p: F.when(F.col("dropped"), F.lit(NR)).otherwise(F.col(p)) for p in ("value", "unit", "evidence_quote")})


#: Rounds that are drawn together, so that a group is looked up once for all of them; more would make a method that the JVM does not compile.
AT_ONCE = 8


def at_least(share: float, of: int = 1_000_003) -> int:
    """The least m with m / of >= share."""
    m = int(share * of) - 2
    while m / of < share:
        m += 1
    return m


def bootstrap(gold: DataFrame, pred: DataFrame, rounds: int = 1000, seed: int = 42, policy: MatchPolicy = MatchPolicy()) -> DataFrame:
    """Mean and 95 % interval of the macro acal_f1 when records are drawn anew: each record counts a Poisson(1) number of times
    in each round, from a hash of seed, round and record_id; so a round needs no shuffle of records.  A record is drawn once for all its
    cells, and records whose cells came out alike are added up together."""
    pairs = paired(gold, pred, policy)
    g, p, same = F.col("a_emit"), F.col("b_emit"), F.col("same")
    kind = F.when(same, "t").when(g & p & ~same, "w").when(~g & p, "e").when(g & ~p, "m").when(~g & ~p, "a").otherwise("-")
    counts = {"tp": "t", "fp": "we", "fn": "m", "nr_tp": "a", "nr_fp": "m", "nr_fn": "e"}
    alike = pairs.groupBy("record_id").agg(F.array_join(F.sort_array(F.collect_list(F.concat(kind, "field"))), "\u0001").alias("cells"))
    drawn = alike.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit((rounds - 1) // AT_ONCE))))
    bounds, mass, below = [], 0.36787944117144233, 0.0
    for k in range(8):  # the inverse of the Poisson distribution function
        below += mass
        mass /= k + 1
        bounds.append(at_least(below))
    names = [f"n{j}" for j in range(AT_ONCE)]
    draw = {n: F.pmod(F.xxhash64(F.lit(seed), F.col("turn") * AT_ONCE + (j + 1), F.col("record_id")), F.lit(1_000_003)) for j, n in enumerate(names)}
    times = {n: sum(((F.col(n) >= b).cast("int") for b in bounds[1:]), (F.col(n) >= bounds[0]).cast("int")) for n in names}
    added = drawn.withColumns(draw).withColumns(times).groupBy("cells", "turn").agg(*[F.sum(n).alias(n) for n in names])
    cells = added.withColumn("cell", F.explode(F.split("cells", "\u0001"))).groupBy("turn", "cell").agg(*[F.sum(n).alias(n) for n in names])
    each = F.array(*[F.struct((F.col("turn") * AT_ONCE + (j + 1)).alias("round"), F.col(n).alias("n")) for j, n in enumerate(names)])
    flat = cells.select(F.substr("cell", F.lit(1), F.lit(1)).alias("kind"), F.substr("cell", F.lit(2)).alias("field"), F.inline(each)).where(F.col("round") <= rounds)
    sums = flat.groupBy("round", "field").agg(*[F.sum(F.when(F.col("kind").isin(*k), F.col("n")).otherwise(0)).alias(c) for c, k in counts.items()])
    score = (f1(F.col("tp"), F.col("fp"), F.col("fn")) + f1(F.col("nr_tp"), F.col("nr_fp"), F.col("nr_fn"))) / 2
    macro = sums.groupBy("round").agg(F.avg(score).alias("acal_f1"))
    return macro.agg(F.count(F.lit(1)).alias("rounds"), F.avg("acal_f1").alias("mean"), F.percentile("acal_f1", F.lit(0.025)).alias("low"), F.percentile("acal_f1", F.lit(0.975)).alias("high"))
