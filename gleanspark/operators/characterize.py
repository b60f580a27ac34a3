"""What a corpus holds: years, coverage, co-occurrence, venues, tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import is_nr
from ..schema import HEADLINE


def year_histogram(df: DataFrame, first: int = 2000, last: int = 2025, year: str = "year") -> DataFrame:
    return df.select(F.col(year).cast("string").try_cast("double").try_cast("int").alias("year")).where(F.col("year").between(first, last)).groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def year_bins(df: DataFrame, year: str = "year") -> DataFrame:
    y = F.col(year).cast("string").try_cast("int")
    label = F.when(y.isNull(), "NOT_REPORTED").when(y <= 2010, "<=2010").when(y <= 2014, "2011-2014").when(y <= 2018, "2015-2018").when(y <= 2021, "2019-2021").when(y <= 2024, "2022-2024").otherwise("2025+")
    return df.groupBy(label.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def coverage(cells: DataFrame) -> DataFrame:
    """By field: records, and those whose value is reported."""
    return cells.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if(~is_nr(F.col("value"))).alias("reported"))


def cooccurrence(cells: DataFrame, fields: list[str] = HEADLINE) -> DataFrame:
    """field_a, field_b, n: records that report both (the diagonal counts the field), as sums over one row for each record."""
    flags = cells.groupBy("record_id").agg(*[F.max(((F.col("field") == f) & ~is_nr(F.col("value"))).cast("int")).alias(f) for f in fields])
    sums = flags.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}|{b}") for a in fields for b in fields])
    return sums.select(F.inline(F.array(*[F.struct(F.lit(a).alias("field_a"), F.lit(b).alias("field_b"), F.coalesce(F.col(f"{a}|{b}"), F.lit(0)).alias("n")) for a in fields for b in fields])))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """value, n and share of a column (null is unknown)."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def top_venues(df: DataFrame, k: int = 10, venue: str = "journal_or_venue") -> DataFrame:
    named = df.where(F.coalesce(F.col(venue), F.lit("")) != "")
    return named.groupBy(F.col(venue).alias("venue")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "venue").limit(k)


def quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, missing: null or empty values, in one pass."""
    missing = df.agg(*[F.count_if(F.coalesce(F.col(c).cast("string"), F.lit("")) == "").alias(c) for c in columns])
    return missing.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in columns])))


def compare(warehouse: DataFrame, subset: DataFrame) -> DataFrame:
    """measure, warehouse, subset."""
    def measures(df: DataFrame, name: str) -> DataFrame:
        m = df.agg(F.count(F.lit(1)).cast("double").alias("records"), F.count_if(F.coalesce("abstract_or_summary", F.lit("")) != "").cast("double").alias("with_abstract"), F.count_if(F.coalesce("doi", F.lit("")) != "").cast("double").alias("with_doi"))
        return m.select(F.inline(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias(name)) for k in ("records", "with_abstract", "with_doi")])))

    return measures(warehouse, "warehouse").join(measures(subset, "subset"), "measure")


def status_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def tier(df: DataFrame, core: list[str], near: list[str]) -> DataFrame:
    """Adds tier: A1 a core word in the title, A2 in the abstract, B a related word, else C."""
    text = lambda c, words: F.lower(F.coalesce(F.col(c), F.lit(""))).rlike("|".join(words))
    label = F.when(text("title", core), "A1").when(text("abstract_or_summary", core), "A2").when(text("title", near) | text("abstract_or_summary", near), "B").otherwise("C")
    return df.withColumn("tier", label)


def task_view(cells: DataFrame, view: str) -> DataFrame:
    """all: every cell; numeric: values and units of numeric fields; evidence: quotes of emitted cells."""
    from ..schema import NUMERIC

    if view == "numeric":
        return cells.where(F.col("field").isin(NUMERIC)).select("record_id", "field", "value", "unit")
    if view == "evidence":
        return cells.where(~is_nr(F.col("value"))).select("record_id", "field", "value", "evidence_quote")
    return cells
