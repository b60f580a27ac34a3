"""Identifiers, titles, years and audit texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import strip

# Keywords of each application, asked in this order.
APPLICATIONS = [
    ("biomedical", ["biomed", "translational", "clinical", "drug", "delivery", "therap", "imaging", "diagnost"]),
    ("environmental", ["environ", "water", "wastewater", "agri", "aquacult", "flotation"]),
    ("fundamental", ["fundament", "physic", "stab", "characteriz"]),
    ("industrial", ["industrial", "process", "engin"]),
]
# Sources whose names stand in record ids.
ID_SOURCES = ["PubMed", "OpenAlex", "EuropePMC"]


def year_bucket(year: Column) -> Column:
    y = year.try_cast("int")
    return F.when(y.isNull(), "unknown").when(y <= 2014, "pre_2015").when(y <= 2020, "y2015_2020").otherwise("post_2020")


def application_bucket(category: Column) -> Column:
    out = F.when(category.isNull() | (category == ""), "unknown")
    for name, words in APPLICATIONS:
        out = out.when(F.lower(category).rlike("|".join(words)), name)
    return out.otherwise("other")


def norm_title(title: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " ")), F.lit(""))


def norm_doi(doi: Column) -> Column:
    """Lower-cased without resolver prefix; null if nothing is left."""
    bare = F.regexp_replace(F.lower(strip(doi)), r"^(https?://(dx\.)?doi\.org/|doi:)", "")
    return F.nullif(strip(bare), F.lit(""))


def doi_candidates(tail: Column) -> Column:
    """An encoded tail 10_<registrant>_<suffix> as DOIs with dashes and with dots."""
    registrant, suffix = F.regexp_extract(tail, r"^10_(\d{4,7})_(.+)$", 1), F.regexp_extract(tail, r"(?s)^10_(\d{4,7})_(.+)$", 2)
    doi = lambda sign: F.concat(F.lit("10."), registrant, F.lit("/"), F.translate(suffix, "_", sign))
    return F.when(suffix != "", F.array(doi("-"), doi("."))).otherwise(F.array().cast("array<string>"))


def parse_record_id(record_id: Column) -> Column:
    """struct(source, encoded_tail, doi_candidates, primary_doi, notes) of API_<source>_<tail>."""
    shape = rf"(?s)^API_({'|'.join(ID_SOURCES)})_(.*)$"
    source, tail = F.regexp_extract(record_id, shape, 1), F.regexp_extract(record_id, shape, 2)
    known = F.coalesce(source != "", F.lit(False))
    found = F.when(known, doi_candidates(tail)).otherwise(F.array().cast("array<string>"))
    notes = (
        F.when(record_id.isNull(), "non-string record_id")
        .when(~record_id.startswith("API_"), "missing API_ prefix")
        .when(~known, F.concat(F.lit("unknown source slug; rest='"), F.substring(record_id, 5, 30), F.lit("'")))
        .otherwise("")
    )
    return F.struct(
        F.when(known, source).otherwise("").alias("source"), F.when(known, tail).otherwise("").alias("encoded_tail"),
        found.alias("doi_candidates"), F.try_element_at(found, F.lit(1)).alias("primary_doi"), notes.alias("notes"),
    )


def candidate_dois(*dois: Column) -> Column:
    """Distinct lower-cased non-empty DOIs in their order."""
    return F.array_distinct(F.filter(F.array(*[F.coalesce(F.lower(strip(d)), F.lit("")) for d in dois]), lambda d: d != ""))


def demojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 is repaired; other text stays."""
    latin = text.rlike(r"^[\x{00}-\x{FF}]*$")
    return F.when(latin, F.coalesce(F.try_validate_utf8(F.encode(F.when(latin, text), "ISO-8859-1").cast("string")), text)).otherwise(text)


def nfkc(text: Column) -> Column:
    """NFKC by the ICU library that Spark ships with."""
    return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))


def norm_text(text: Column) -> Column:
    """Repaired, NFKC, without control and format characters, single spaces, lower-cased."""
    clean = F.regexp_replace(nfkc(demojibake(F.coalesce(text, F.lit("")))), r"\p{C}", "")
    return F.lower(strip(F.regexp_replace(clean, r"(?U)\s+", " ")))


def crosscheck_status(gold: Column, source: Column) -> Column:
    """How a gold abstract relates to the re-fetched one; the order of the cases matters."""
    g, s = F.coalesce(gold, F.lit("")), F.coalesce(source, F.lit(""))
    same = (g != "") & (s != "") & (norm_text(gold) == norm_text(source))
    return (
        F.when((g == s) & (g != ""), "verbatim_match").when(same, "normalized_match").when(s == "", "refetch_failed")
        .when(g == "", "no_gold_abstract").otherwise("source_side_revision_or_mismatch")
    )


def present(*columns: Column) -> Column:
    """The first that is neither null nor empty, else empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def inverted_index_text(index: Column) -> Column:
    """Text of a map from token to positions."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("tok")))))
    return F.coalesce(F.array_join(F.transform(F.array_sort(places), lambda x: x["tok"]), " "), F.lit(""))


def predictions_family(name: Column) -> Column:
    """Which family of extractors a run's name belongs to."""
    n = F.lower(name)
    out = F.when(n.contains("regex"), "regex")
    out = out.when(n.rlike("bert|encoder|qa"), "encoder")
    return out.otherwise("llm")
