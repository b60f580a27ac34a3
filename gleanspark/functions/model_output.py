"""What models return, as Column expressions: JSON of language models, spans of question answering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import HEADLINE, NR, NUMERIC
from .values import number_string, parse_number, strip

# Unit words after a number, longer ones first.
UNIT_WORDS = [
    "nanometers", "nanometres", "nanometer", "nanometre", "micrometer", "micrometre", "micron", "microns",
    "millimeter", "millimetre", "hours", "hour", "days", "day", "weeks", "week", "minutes", "minute", "seconds",
    "second", "months", "month", "years", "year", "percent", "nm", "um", "μm", "mm", "mV", "V", "hrs", "hr", "wk",
    "min", "sec", "mo", "yr", "h", "d", "s",
]
NUMBER_UNIT = r"(?iuU)(-?\d+(?:\.\d+)?)\s*(%|(?:" + "|".join(UNIT_WORDS) + r")\b)"
CELL = "struct<value:string,unit:string,evidence_quote:string>"
RECORD = "struct<" + ",".join(f"{f}:{CELL}" for f in HEADLINE) + ">"


def nr_cell() -> Column:
    return F.struct(*[F.lit(NR).alias(p) for p in ("value", "unit", "evidence_quote")])


def cell(value: Column, unit: Column, evidence: Column) -> Column:
    return F.struct(value.alias("value"), unit.alias("unit"), evidence.alias("evidence_quote"))


def json_block(raw: Column) -> Column:
    """From the first opening to the last closing brace; null without one."""
    return F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit(""))


def repaired(block: Column) -> Column:
    """Without code fences and trailing commas, straight quotes."""
    bare = F.regexp_replace(F.regexp_replace(block, r"```(?:json)?\s*", ""), r"\s*```\s*$", "")
    return F.translate(F.regexp_replace(bare, r",\s*([}\]])", "$1"), "“”‘’", "\"\"''")


def parse_llm_json(raw: Column) -> Column:
    """The record in a model's answer: strictly read, else repaired and read again; null where neither works.  Text after the
    object, as in two objects in a row, fails as it does in a strict parser."""
    options = {"allowSingleQuotes": "false", "mode": "PERMISSIVE"}

    def read(text: Column) -> Column:
        # a reader that stops after the first object would take '{..} {..}': such text has depth 0 before its end
        bare = F.regexp_replace(text, r'(?s)"(?:[^"\\]++|\\.)*+"', '""')  # braces inside strings don't count
        whole = F.try_parse_json(text).isNotNull() & ~bare.rlike(r"(?s)\}\s*\{")
        return F.when(whole, F.from_json(text, RECORD, options))

    block = json_block(raw)
    return F.coalesce(read(block), read(repaired(block)))


def to_prediction(entry: Column) -> Column:
    """A field's entry with defaults for what is missing; a field that isn't an object is all not reported."""
    part = lambda name, default: F.coalesce(F.nullif(strip(entry[name]), F.lit("")), F.lit(default))
    return F.when(entry.isNull(), nr_cell()).otherwise(cell(part("value", NR), part("unit", ""), part("evidence_quote", NR)))


def numeric_span(span: Column) -> Column:
    """Number and unit of an answer span; a bare number has no unit, no number is not reported."""
    value, unit = F.regexp_extract(span, NUMBER_UNIT, 1), F.regexp_extract(span, NUMBER_UNIT, 2)
    bare = parse_number(span)
    return (
        F.when(span.isNull() | (strip(span) == ""), nr_cell())
        .when(value != "", cell(value, unit, strip(span)))
        .when(bare.isNotNull(), cell(number_string(bare), F.lit(NR), strip(span)))
        .otherwise(nr_cell())
    )


def text_span(span: Column) -> Column:
    return F.when(span.isNull() | (strip(span) == ""), nr_cell()).otherwise(cell(strip(span), F.lit(""), strip(span)))


def span_cell(span: Column, score: Column, field: str, threshold: float = 0.20) -> Column:
    """A question's answer as a cell; below the confidence threshold it is not reported."""
    parsed = numeric_span(span) if field in NUMERIC else text_span(span)
    return F.when((score < threshold) | score.isNull(), nr_cell()).otherwise(parsed)


def qa_span(start: Column, end: Column, in_context: Column, top: int = 20, longest: int = 64) -> Column:
    """struct(first, last, confidence) of the best answer span given logits of all positions (0 stands for no answer) and
    which of them lie in the context; null if no answer is as good as the best span or no span is allowed."""
    ranked = lambda logits: F.slice(F.array_sort(F.transform(logits, lambda x, i: F.struct((-x).alias("x"), i.alias("i")))), 1, top)
    allowed = lambda tops: F.filter(tops, lambda t: (t["i"] > 0) & F.element_at(in_context, t["i"] + 1))
    spans = F.flatten(
        F.transform(
            allowed(ranked(start)),
            lambda s: F.transform(
                F.filter(allowed(ranked(end)), lambda e: (e["i"] >= s["i"]) & (e["i"] - s["i"] + 1 <= longest)),
                lambda e: F.struct((s["x"] + e["x"]).alias("cost"), s["i"].alias("first"), e["i"].alias("last")),
            ),
        )
    )
    best = F.array_min(spans)
    total = lambda logits: F.aggregate(F.transform(logits, lambda x: F.exp((x - F.array_max(logits)).cast("double"))), F.lit(0.0), lambda a, x: a + x)
    share = lambda logits, i: F.exp((F.element_at(logits, i + 1) - F.array_max(logits)).cast("double")) / total(logits)
    confidence = share(start, best["first"]) * share(end, best["last"])
    beats = best.isNotNull() & (-(F.element_at(start, 1) + F.element_at(end, 1)) > best["cost"])
    return F.when(beats, F.struct(best["first"].alias("first"), best["last"].alias("last"), confidence.alias("confidence")))
