"""Annotation frames: wide at the edges, one row for each (record_id, field) inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import is_nr, strip
from ..schema import HEADLINE, PARTS, annotation_columns, strings
from ..session import unsent


def required_columns(fields: list[str] = HEADLINE) -> list[str]:
    return ["record_id", *annotation_columns(fields)]


def without_repeats(columns: list[str]) -> list[str]:
    """Column names, each once, in order."""
    return list(dict.fromkeys(columns))


def validate(frame: DataFrame, fields: list[str] = HEADLINE) -> DataFrame:
    """Fails for missing columns (no job) and for repeated record_ids (one aggregation); record_id becomes a string after that."""
    missing = [c for c in required_columns(fields) if c not in frame.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if repeated := frame.groupBy("record_id").count().where("count > 1").limit(5).collect():
        raise ValueError(f"repeated record_id: {[r['record_id'] for r in repeated]}")
    return frame.withColumn("record_id", F.col("record_id").cast("string"))


def empty(ids: DataFrame, fields: list[str] = HEADLINE) -> DataFrame:
    """A blank template for the given record_ids."""
    blank = [F.lit("").alias(c) for c in [*annotation_columns(fields), "ambiguity_flag", "annotator_notes"]]
    return ids.select(F.col("record_id").cast("string").alias("record_id"), *blank)


def to_long(frame: DataFrame, fields: list[str] = HEADLINE, keep: list[str] = (), blank_is_emit: bool = False) -> DataFrame:
    """keep, record_id, field, value, unit, evidence_quote.  Blanks and nulls are "not reported"; with blank_is_emit they are
    the string "nan", as readers that infer types have it."""
    text = lambda c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("nan")) if blank_is_emit else F.coalesce(F.col(c).cast("string"), F.lit(""))
    cells = [F.struct(F.lit(f).alias("field"), *[text(f"{f}_{p}").alias(p) for p in PARTS]) for f in fields]
    return frame.select(*keep, "record_id", F.inline(F.array(*cells)))


def side_by_side(a: DataFrame, b: DataFrame, keep: list[str] = (), how: str = "inner", fields: list[str] = HEADLINE) -> DataFrame:
    """The cells of two wide frames: keep (of a), record_id, aligned (a has the record), field and a_… and b_… of each part.  Records
    are joined before they become cells, so a shuffle moves and sorts one row for each record."""
    text = lambda f, p: F.coalesce(F.col(f"{f}_{p}").cast("string"), F.lit(""))
    parts = [(f, p) for f in fields for p in PARTS]
    left = a.select(*keep, "record_id", F.lit(True).alias("aligned"), *[text(f, p).alias(f"a_{f}_{p}") for f, p in parts])
    right = b.select("record_id", *[text(f, p).alias(f"b_{f}_{p}") for f, p in parts])
    cells = [F.struct(F.lit(f).alias("field"), *[F.col(f"{s}_{f}_{p}").alias(f"{s}_{p}") for s in "ab" for p in PARTS]) for f in fields]
    return left.join(unsent(right), "record_id", how).select(*keep, "record_id", F.coalesce("aligned", F.lit(False)).alias("aligned"), F.inline(F.array(*cells)))


def to_wide(cells: DataFrame, fields: list[str] = HEADLINE) -> DataFrame:
    parts = [F.max(F.when(F.col("field") == f, F.col(p))).alias(f"{f}_{p}") for f in fields for p in PARTS]
    return cells.groupBy("record_id").agg(*parts)


def cell(cells: DataFrame, record_id: str, field: str) -> dict[str, str]:
    """One cell; KeyError if there is no such field or record."""
    row = cells.where((F.col("record_id") == record_id) & (F.col("field") == field)).select(*PARTS).first()
    if row is None:
        raise KeyError((record_id, field))
    return row.asDict()


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All columns as strings; of repeated column names the first stays."""
    reader = spark.read.option("multiLine", True).option("quote", '"').option("escape", '"')
    header = reader.option("header", False).csv(path).first()
    names = [str(x) for x in header]
    df = reader.option("header", True).schema(strings(*[f"c{i}" for i in range(len(names))])).option("enforceSchema", True).csv(path)
    chosen = [(i, n) for i, n in enumerate(names) if names.index(n) == i and (columns is None or n in columns)]
    return df.select(*[F.col(f"c{i}").alias(n) for i, n in chosen])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def is_complete(fields: list[str] = HEADLINE) -> Column:
    """All value cells filled in (an abstention counts as filled in)."""
    out = F.lit(True)
    for f in fields:
        out = out & (strip(F.coalesce(F.col(f"{f}_value").cast("string"), F.lit(""))) != "")
    return out


def verbatim(quote: Column, abstract: Column) -> Column:
    """The quote stands in the abstract exactly as it is."""
    return is_nr(quote) | abstract.contains(quote)
