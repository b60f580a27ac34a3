"""Stratified samples and splits, deterministic by a hash of seed and id.

Ranks inside a stratum come from the hash.  A stratum may be large and its quota
too, so rows are counted by the first digits of the hash: running sums over these
few counts say which rows are in and which are out, and only rows of the one
group in which the quota ends are ordered.  No task orders a whole stratum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bibliography import application_bucket, year_bucket

# Records of the agreement subset by label and document type.
IAA_QUOTAS = [
    ("nanobubble", "original", 14),
    ("nanobubble", "review", 4),
    ("nanoparticle", "original", 12),
    ("nanoparticle", "review", 4),
    ("microbubble-adjacent", "original", 3),
    ("micro/nanobubble", "original", 3),
]
SLICES = ["year_bucket", "source_api", "document_type", "nb_label", "application_bucket"]
#: First hex digits of the draw by which a stratum is counted.
DIGITS = 3


def draw(seed: int, record_id: str = "record_id") -> Column:
    """The order of a draw; md5 so that other engines can repeat it."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(record_id).cast("string")))


def taken(df: DataFrame, by: list[str], limit: str, order: list[Column], coarse: list[Column]) -> DataFrame:
    """The first rows of each group, as many as the column limit says, without ordering a whole group in one task.  coarse:
    values that rise with the order; rows of equal values are ordered among themselves only where the limit falls on them."""
    names = [f"_c{k}" for k in range(len(coarse))]
    df = df.withColumns(dict(zip(names, coarse)))
    counts = df.groupBy(*by, *names).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*by).orderBy(*names)) - F.col("_n"))
    keys = [*by, *names]
    counts = counts.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    met = df.join(counts, same).where(F.col("_before") < F.col(limit))
    whole, last = F.col("_before") + F.col("_n") <= F.col(limit), Window.partitionBy(*keys).orderBy(*order)
    cut = met.where(~whole).withColumn("_rank", F.row_number().over(last)).where(F.col("_rank") <= F.col(limit) - F.col("_before")).drop("_rank")
    return met.where(whole).unionByName(cut).drop(*names, *[f"_k{i}" for i in range(len(keys))], "_n", "_before")


def quota_sample(df: DataFrame, by: list[str], n: int, quotas: DataFrame, seed: int = 42) -> DataFrame:
    """quotas: by and quota.  As many rows of each stratum as its quota (or all it has), topped up to n from the others; more
    than n if the quotas say so.  Rows come in the order of the draw."""
    pool = df.withColumn("_draw", draw(seed))
    picked = taken(pool.join(quotas.where("quota > 0"), by), by, "quota", [F.col("_draw")], [F.substring("_draw", 1, DIGITS)]).drop("quota")
    missing = n - picked.count()
    if missing > 0:
        rest = pool.join(picked.select("record_id"), "record_id", "left_anti").orderBy("_draw").limit(missing)
        picked = picked.unionByName(rest.select(*picked.columns))
    return picked.orderBy("_draw").drop("_draw")


def proportional_quotas(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """by and quota: shares of n rounded half to even, and what is left over or missing settled by one each, largest strata
    first (smallest first if too many), within 0 and the stratum's size.  Ties of size go by name.  One row for each stratum."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("size"))
    for c in by:
        sizes = sizes.where(F.col(c).isNotNull())
    everything = Window.partitionBy(F.lit(0))
    q = sizes.withColumn("quota", F.bround(F.col("size") / F.sum("size").over(everything) * n).cast("long"))
    q = q.withColumn("diff", F.lit(n) - F.sum("quota").over(everything))
    step = F.signum("diff").cast("long")
    can = ((F.col("quota") + step >= 0) & (F.col("quota") + step <= F.col("size")) & (step != 0)).cast("int")
    order = [F.when(F.col("diff") < 0, F.col("size")).otherwise(-F.col("size")), *by]
    q = q.withColumn("turn", F.sum(can).over(everything.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return q.select(*by, F.when((can == 1) & (F.col("turn") <= F.abs("diff")), F.col("quota") + step).otherwise(F.col("quota")).alias("quota"))


def iaa_subset(gold: DataFrame, n: int = 40, least_chars: int = 200, seed: int = 42) -> DataFrame:
    """The agreement subset: records with a long enough abstract, sampled by fixed quotas; with nb_label and doc_label."""
    able = gold.where(F.char_length("abstract_or_summary") >= least_chars)
    able = able.withColumns({"nb_label": F.coalesce("nanobubble_vs_nanoparticle", F.lit("unknown")), "doc_label": F.coalesce("document_type", F.lit("unknown"))})
    quotas = gold.sparkSession.createDataFrame(IAA_QUOTAS, "nb_label string, doc_label string, quota int")
    return quota_sample(able, ["nb_label", "doc_label"], n, quotas, seed)


def half_even(x: float) -> int:
    return round(x)


def build_splits(gold: DataFrame, pinned: DataFrame, dev_fraction: float = 0.10, seed: int = 42, strata: list[str] = ("nb_label", "document_type")) -> DataFrame:
    """gold with year_bucket, application_bucket, nb_label, in_iaa and split: a proportional sample of the records that are not
    pinned (record_id) is dev, all else test."""
    unknown = lambda c: F.coalesce(F.col(c), F.lit("unknown"))
    df = gold.withColumns(
        {
            "record_id": F.col("record_id").cast("string"),
            "year_bucket": year_bucket(F.col("year").cast("string")),
            "source_api": unknown("source_api"),
            "document_type": unknown("document_type"),
            "nb_label": unknown("nanobubble_vs_nanoparticle"),
            "application_bucket": application_bucket(F.col("application_category")),
        }
    )
    marks = pinned.select(F.col("record_id").cast("string").alias("record_id")).distinct().withColumn("in_iaa", F.lit(True))
    df = df.join(marks, "record_id", "left").withColumn("in_iaa", F.coalesce("in_iaa", F.lit(False)))
    free = df.where(~F.col("in_iaa"))
    n = half_even(df.count() * dev_fraction)
    dev = quota_sample(free, list(strata), n, proportional_quotas(free, list(strata), n), seed).select("record_id").distinct().withColumn("split", F.lit("dev"))
    return df.join(dev, "record_id", "left").withColumn("split", F.coalesce("split", F.lit("test")))


def slice_summary(splits: DataFrame) -> DataFrame:
    """slice, value, total, dev, test, iaa for every value of every slice, in one aggregation."""
    long = splits.select("split", "in_iaa", F.inline(F.array(*[F.struct(F.lit(s).alias("slice"), F.col(s).cast("string").alias("value")) for s in SLICES])))
    return long.groupBy("slice", "value").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("split") == "dev").alias("dev"), F.count_if(F.col("split") == "test").alias("test"), F.count_if("in_iaa").alias("iaa")
    )


def leakage(splits: DataFrame, pinned: DataFrame, pinned_to: str = "test") -> DataFrame:
    """check, ok, found, of: the six integrity checks, as rows."""
    one = splits.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n"), F.max((F.col("split") == "dev").cast("int")).alias("d"), F.max((F.col("split") == "test").cast("int")).alias("t"),
        F.count_if("in_iaa").alias("i"), F.count_if(F.col("in_iaa") & (F.col("split") == "test")).alias("it"),
        F.count_if(F.col("year").isNull()).alias("y"), F.count_if(F.col("abstract_or_summary").isNull()).alias("a"),
    )
    ids = pinned.select(F.col("record_id").cast("string").alias("record_id")).distinct().withColumn("pin", F.lit(1))
    sums = one.join(ids, "record_id", "full_outer").agg(
        F.sum(F.col("n") - 1).alias("dup"), F.count_if((F.col("d") == 1) & (F.col("t") == 1)).alias("both"), F.sum("i").alias("iaa"), F.sum("it").alias("iaa_test"),
        F.sum("y").alias("no_year"), F.sum("a").alias("no_abstract"), F.count("pin").alias("pins"), F.count_if(F.col("pin").isNotNull() & F.col("n").isNotNull()).alias("present"),
    )
    z, c = F.lit(0).cast("long"), lambda k: F.coalesce(F.col(k), F.lit(0)).cast("long")
    row = lambda name, found, of, ok: F.struct(F.lit(name).alias("check"), ok.alias("ok"), found.alias("found"), of.alias("of"))
    return sums.select(
        F.inline(
            F.array(
                row("no duplicate record_id", c("dup"), z, c("dup") == 0),
                row("dev and test are disjoint", c("both"), z, c("both") == 0),
                row(f"pinned records are in {pinned_to}", c("iaa_test"), c("iaa"), c("iaa_test") == c("iaa")),
                row("year present", c("no_year"), z, c("no_year") == 0),
                row("abstract present", c("no_abstract"), z, c("no_abstract") == 0),
                row("pinned records exist", c("present"), c("pins"), c("present") == c("pins")),
            )
        )
    )


def splits_payload(splits: DataFrame) -> DataFrame:
    """record_id and a JSON object of its split and slices, a line for each record."""
    return splits.select("record_id", F.to_json(F.struct("split", "in_iaa", *SLICES)).alias("json"))


def splits_meta(splits: DataFrame, seed: int = 42, dev_fraction: float = 0.10) -> DataFrame:
    """One row: counts, and the sorted distinct values of each slice."""
    return splits.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("split") == "dev").alias("n_dev"), F.count_if(F.col("split") == "test").alias("n_test"), F.count_if("in_iaa").alias("n_iaa"),
        F.lit(seed).alias("seed"), F.lit(dev_fraction).alias("dev_fraction"), *[F.sort_array(F.collect_set(s)).alias(s) for s in SLICES],
    )


def candidate_pool(df: DataFrame, by: list[str], n: int, score: str) -> DataFrame:
    """About n rows, balanced over the strata: each gives its rows with the highest score, as many as an equal share."""
    groups = df.select(*by).distinct()
    share = -(-n // max(1, groups.count()))
    pool = df.withColumn("_share", F.lit(share)).withColumn("_draw", draw(42))
    return taken(pool, by, "_share", [F.desc(score), F.col("_draw")], [-F.col(score), F.substring("_draw", 1, DIGITS)]).drop("_share", "_draw")


def temporal_split(df: DataFrame, first_test_year: int, year: str = "year") -> DataFrame:
    """dev before the year, test from it on; records without a year are test."""
    y = F.col(year).cast("string").try_cast("int")
    return df.withColumn("split", F.when(y < first_test_year, "dev").otherwise("test"))


def holdout_split(df: DataFrame, column: str, held_out: list[str]) -> DataFrame:
    """test for records with one of the values (a source, a document type), dev for the others."""
    return df.withColumn("split", F.when(F.coalesce(F.col(column), F.lit("unknown")).isin(held_out), "test").otherwise("dev"))
