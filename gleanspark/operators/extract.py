"""Extractors: from an abstract to a cell for each field.

An extractor has a name and cells(record_id, abstract), a map from field to a
struct column (value, unit, evidence_quote); fields it leaves out are not
reported.  Model-backed ones get their answers first, in batches of whole
partitions by an injected function, and parse them with built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.model_output import cell, nr_cell, parse_llm_json, span_cell, to_prediction
from ..functions.values import strip
from ..schema import HEADLINE, PARTS

# For each field patterns with value (1) and unit (2); the first place that matches counts.
PATTERNS = {
    "size": [r"(\d+(?:\.\d+)?)\s*(?:[±\+\-/]+\s*\d+(?:\.\d+)?\s*)?(nm|um|μm|micrometer|micron)\b"],
    "zeta_potential": [r"zeta\s*(?:potential)?[^\d\-+]{0,20}([+\-]?\s*\d+(?:\.\d+)?)\s*(mV|V)\b"],
    "stability": [r"(?:stable\s*for|stability\s*(?:of|over)?)\s*(\d+(?:\.\d+)?)\s*(h|hr|hrs|hour|hours|d|day|days|wk|week|weeks|min|minute|minutes)\b"],
    "loading_efficiency": [r"(?:loading|encapsulation|drug\s*loading)\s*(?:efficiency)?[^\d]{0,15}(\d+(?:\.\d+)?)\s*(%)"],
}
QUESTIONS = {
    "size": "How large are the particles or bubbles?",
    "zeta_potential": "What is the zeta potential?",
    "stability": "For how long is it stable?",
    "payload": "What is loaded?",
    "loading_efficiency": "How much is loaded or encapsulated?",
    "release_profile": "How is the load released?",
}
PROMPT = (
    "From the abstract below report size (nm), zeta_potential (mV), stability (h), payload, loading_efficiency (%) and release_profile. "
    "Answer with one JSON object that has a key for each of the six, each an object with value, unit and evidence_quote. "
    'Write "NOT_REPORTED" for whatever the abstract does not say. Quotes must be copied from the abstract letter by letter.\n\nAbstract:\n'
)


class Extractor(Protocol):
    name: str

    def prepare(self, df: DataFrame, abstract: str) -> DataFrame: ...

    def cells(self, abstract: Column) -> dict[str, Column]: ...


class Base:
    """Checks that an extractor has a name; prepare() adds nothing."""

    name = ""

    def __init__(self) -> None:
        if not self.name:
            raise TypeError(f"{type(self).__name__} needs a name")

    def prepare(self, df: DataFrame, abstract: str) -> DataFrame:
        return df

    def cells(self, abstract: Column) -> dict[str, Column]:
        raise NotImplementedError


class RegexExtractor(Base):
    """Patterns for numeric fields; built-in expressions only."""

    name = "regex"

    def __init__(self, patterns: dict[str, list[str]] = PATTERNS):
        super().__init__()
        self.patterns = patterns

    def cells(self, abstract: Column) -> dict[str, Column]:
        out = {}
        for field, patterns in self.patterns.items():
            tries = []
            for p in patterns:
                part = lambda g, p=p: F.regexp_extract(abstract, f"(?iuU){p}", g)
                tries.append(F.when(part(0) != "", cell(F.regexp_replace(part(1), r"(?U)\s+", ""), part(2), strip(part(0)))))
            out[field] = F.coalesce(*tries, nr_cell())
        return out


def answered(df: DataFrame, column: str, kind: str, answer: Callable[[list[str]], list], load: Callable[[], object] | None, abstract: str) -> DataFrame:
    """Adds what the model says of each abstract; the model is loaded once in a worker, where a batch fails its texts
    are asked one by one, and only those that fail alone say null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load() if load else None
        def ask(texts: list[str]) -> list:
            try:
                return list(answer(model, texts) if load else answer(texts))
            except Exception:
                return [None] if len(texts) == 1 else [x for t in texts for x in ask([t])]

        for b in batches:
            texts = b[abstract].fillna("").tolist()
            said = ask(texts) if texts else []
            yield b.assign(**{column: said})

    from pyspark.sql.types import StructType

    return df.mapInPandas(run, StructType([*df.schema.fields, *StructType.fromDDL(f"`{column}` {kind}").fields]))


class QAExtractor(Base):
    """Six questions to an injected model: answer(texts) gives for each text a list of (span, score) in the order of fields."""

    name = "encoder"

    def __init__(self, answer: Callable, load: Callable[[], object] | None = None, threshold: float = 0.20):
        super().__init__()
        self.answer, self.load, self.threshold = answer, load, threshold

    def prepare(self, df: DataFrame, abstract: str) -> DataFrame:
        return answered(df, "_spans", "array<struct<span:string,score:double>>", self.answer, self.load, abstract)

    def cells(self, abstract: Column) -> dict[str, Column]:
        said = lambda i: F.try_element_at(F.col("_spans"), F.lit(i + 1))
        return {f: F.when(strip(F.coalesce(abstract, F.lit(""))) == "", nr_cell()).otherwise(span_cell(said(i)["span"], said(i)["score"], f, self.threshold)) for i, f in enumerate(HEADLINE)}


class LLMExtractor(Base):
    """A prompt to an injected model: generate(prompts) gives texts that hold a JSON object."""

    name = "llm"

    def __init__(self, generate: Callable, load: Callable[[], object] | None = None):
        super().__init__()
        self.generate, self.load = generate, load

    def prepare(self, df: DataFrame, abstract: str) -> DataFrame:
        asked = df.withColumn("_prompt", prompt(F.col(abstract)))
        return answered(asked, "_raw", "string", self.generate, self.load, "_prompt").withColumn("_record", parse_llm_json(F.col("_raw")))

    def cells(self, abstract: Column) -> dict[str, Column]:
        return {f: to_prediction(F.col("_record")[f]) for f in HEADLINE}


def prompt(abstract: Column) -> Column:
    return F.concat(F.lit(PROMPT), F.coalesce(abstract, F.lit("")))


def predict(df: DataFrame, extractor: Extractor, abstract: str = "abstract_or_summary") -> DataFrame:
    """df with the extractor's answers in its annotation columns."""
    if abstract not in df.columns:
        raise KeyError(abstract)
    ready = extractor.prepare(df, abstract)
    found = extractor.cells(F.col(abstract))
    whole = ready.withColumn("_cells", F.struct(*[found.get(f, nr_cell()).alias(f) for f in HEADLINE]))
    return whole.select(*[c for c in df.columns if c not in {f"{f}_{p}" for f in HEADLINE for p in PARTS}], *[F.col(f"_cells.{f}.{p}").alias(f"{f}_{p}") for f in HEADLINE for p in PARTS])


def predict_cells(df: DataFrame, extractor: Extractor, abstract: str = "abstract_or_summary") -> DataFrame:
    """The answers in long form."""
    if abstract not in df.columns:
        raise KeyError(abstract)
    ready, found = extractor.prepare(df, abstract), extractor.cells(F.col(abstract))
    rows = F.array(*[F.struct(F.lit(f).alias("field"), found.get(f, nr_cell()).alias("c")) for f in HEADLINE])
    return ready.select("record_id", F.inline(rows)).select("record_id", "field", "c.*")
