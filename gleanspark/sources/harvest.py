"""Bibliographic sources: connectors, parsers of what they return, and the harvest over query families.

Parsers are Column expressions over landed JSON and XML, so a landing folder
can be read again at any time.  Connectors fetch pages through an injected
``fetch`` with a minimal delay between requests and exponential backoff; each
(query family, query, source) is a row of a work table that executors take.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bibliography import inverted_index_text
from ..functions.values import strip

# Queries by family.
QUERY_FAMILIES = {
    "nanobubble_core": [
        "nanobubble", "bulk nanobubble", "ultrafine bubble", "micro nanobubble", "oxygen nanobubble", "nanobubble stability",
        "nanobubble characterization", "nanobubble generation", "nanobubble cavitation", "nanobubble imaging", "nanobubble therapy",
        "nanobubble drug delivery",
    ],
    "ultrasound_imaging": [
        "ultrasound contrast agent", "gas-filled liposome", "acoustic nanocarrier", "targeted ultrasound imaging",
        "molecular ultrasound imaging", "ultrasound-triggered drug delivery", "sonodynamic therapy nanocarrier",
        "theranostic ultrasound nanoparticle",
    ],
    "delivery_release": [
        "nanoparticle payload", "loading efficiency", "encapsulation efficiency", "release profile", "controlled release nanoparticle",
        "sustained release nanocarrier", "drug loading nanoparticle", "carrier stability", "colloidal stability",
        "particle size zeta potential",
    ],
    "biomedical_nanocarriers": [
        "lipid nanoparticle drug delivery", "polymer nanoparticle delivery", "liposome drug loading", "cubosome drug delivery",
        "niosome drug delivery", "exosome-coated nanocarrier", "PLGA nanoparticle release", "targeted cancer nanocarrier", "nanomedicine",
        "nanocarrier", "drug delivery system", "controlled release", "biomedical nanocarrier",
    ],
    "environmental_water_agriculture": [
        "nanobubble water treatment", "micro nanobubble irrigation", "oxygen nanobubble aquaculture", "nanobubble flotation",
        "nanobubble biofilm removal", "nanobubble wastewater treatment", "nanobubble agriculture",
    ],
}
# Answers worth another try.
RETRY = {429, 500, 502, 503, 504}

WORK = (
    "id string, doi string, title string, display_name string, type string, publication_year int, cited_by_count int, "
    "authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string>>, "
    "ids struct<pmid:string,pmcid:string>, abstract_inverted_index map<string,array<int>>"
)
TEXT_NODE = "struct<_VALUE:string,_Label:string>"
ARTICLE = (
    "MedlineCitation struct<PMID:struct<_VALUE:string>,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<" + TEXT_NODE + ">>,"
    "Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>,"
    "AuthorList:struct<Author:array<struct<LastName:string,ForeName:string,Initials:string>>>,"
    "PublicationTypeList:struct<PublicationType:array<struct<_VALUE:string>>>>>, "
    "PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_VALUE:string,_IdType:string>>>>"
)


def read_openalex(spark: SparkSession, path: str) -> DataFrame:
    """Landed works, one JSON object on a line, as warehouse rows."""
    return openalex_rows(spark.read.schema(WORK).json(path))


def openalex_rows(works: DataFrame, keep: list[str] = ()) -> DataFrame:
    oid = F.substring_index(F.coalesce("id", F.lit("")), "/", -1)
    names = F.filter(F.transform(F.coalesce("authorships", F.array()), lambda a: a["author"]["display_name"]), lambda n: F.coalesce(n, F.lit("")) != "")
    bare = lambda c: F.regexp_replace(c, r"^https?://(www\.)?(pubmed\.)?ncbi\.nlm\.nih\.gov/(pubmed/|pmc/articles/)?|/$", "")
    return works.select(
        F.concat(F.lit("OpenAlex_"), oid).alias("record_id"), F.lit("OpenAlex").alias("source_api"), oid.alias("source_id"),
        F.coalesce(F.nullif("title", F.lit("")), "display_name", F.lit("")).alias("title"), F.array_join(names, "; ").alias("authors"), F.col("publication_year").alias("year"),
        F.coalesce("primary_location.source.display_name", F.lit("")).alias("journal_or_venue"), F.regexp_replace("doi", "^https://doi.org/", "").alias("doi"),
        bare(F.col("ids.pmid")).alias("pmid"), bare(F.col("ids.pmcid")).alias("pmcid"), F.coalesce(F.nullif("doi", F.lit("")), "id").alias("url"),
        inverted_index_text(F.col("abstract_inverted_index")).alias("abstract_or_summary"), F.col("cited_by_count").alias("citation_count"),
        F.when(F.lower("type").isin("review", "review-article"), "review").otherwise("original").alias("document_type"), *keep,
    )


def read_pubmed(spark: SparkSession, path: str) -> DataFrame:
    """Landed article sets as warehouse rows."""
    return pubmed_rows(spark.read.format("xml").option("rowTag", "PubmedArticle").schema(ARTICLE).load(path))


def pubmed_rows(articles: DataFrame, keep: list[str] = ()) -> DataFrame:
    """The DOI and PMC id of a record are the last of their kind; labelled parts of an abstract keep their labels."""
    art, pmid = "MedlineCitation.Article", F.coalesce(strip(F.col("MedlineCitation.PMID._VALUE")), F.lit(""))
    parts = F.transform(F.coalesce(f"{art}.Abstract.AbstractText", F.array()), lambda p: F.struct(F.coalesce(p["_Label"], F.lit("")).alias("l"), strip(F.coalesce(p["_VALUE"], F.lit(""))).alias("v")))
    pieces = F.filter(F.transform(parts, lambda p: F.when(p["l"] != "", F.concat(p["l"], F.lit(": "), p["v"])).otherwise(p["v"])), lambda s: s != "")
    date = F.coalesce(F.nullif(strip(F.col(f"{art}.Journal.JournalIssue.PubDate.Year")), F.lit("")), strip(F.col(f"{art}.Journal.JournalIssue.PubDate.MedlineDate")))
    year = F.try_element_at(F.filter(F.transform(F.split(date, r"\s+"), lambda t: F.when(t.rlike("^[0-9]+$"), t.try_cast("int"))), lambda y: y.between(1900, 2100)), F.lit(1))
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    people = F.transform(
        F.filter(F.coalesce(f"{art}.AuthorList.Author", F.array()), lambda a: text(a["LastName"]) != ""),
        lambda a: strip(F.concat_ws(" ", F.coalesce(F.nullif(text(a["ForeName"]), F.lit("")), text(a["Initials"])), text(a["LastName"]))),
    )
    ids = lambda kind: strip(F.try_element_at(F.filter(F.coalesce("PubmedData.ArticleIdList.ArticleId", F.array()), lambda i: i["_IdType"] == kind), F.lit(-1))["_VALUE"])
    review = F.exists(F.coalesce(f"{art}.PublicationTypeList.PublicationType", F.array()), lambda t: F.lower(t["_VALUE"]).contains("review"))
    return articles.select(
        F.concat(F.lit("PubMed_"), pmid).alias("record_id"), F.lit("PubMed").alias("source_api"), pmid.alias("source_id"), text(F.col(f"{art}.ArticleTitle")).alias("title"),
        F.array_join(people, "; ").alias("authors"), year.alias("year"), text(F.col(f"{art}.Journal.Title")).alias("journal_or_venue"), ids("doi").alias("doi"), pmid.alias("pmid"),
        ids("pmc").alias("pmcid"), F.when(pmid != "", F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), pmid, F.lit("/"))).alias("url"), F.array_join(pieces, " ").alias("abstract_or_summary"),
        F.lit(None).cast("int").alias("citation_count"), F.when(review, "review").otherwise("original").alias("document_type"), *keep,
    )


@dataclass
class Polite:
    """Calls with a least delay between them; answers in RETRY wait 2^n times the pause and try again, others give up."""

    call: Callable[[str, dict], tuple[int, object]]
    delay: float
    tries: int = 3
    pause: float = 1.0
    last: float = 0.0

    def __call__(self, url: str, params: dict) -> object | None:
        for n in range(self.tries):
            time.sleep(max(0.0, self.last + self.delay - time.monotonic()))
            self.last = time.monotonic()
            status, body = self.call(url, params)
            if status == 200:
                return body
            if status not in RETRY:
                return None
            time.sleep(self.pause * 2**n)
        return None


class Source:
    """A connector: pages(query, cap) yields raw records (JSON or XML texts)."""

    api_name = ""
    delay = 0.1

    def __init__(self, call: Callable[[str, dict], tuple[int, object]], delay: float | None = None):
        if not self.api_name:
            raise TypeError(f"{type(self).__name__} needs an api_name")
        self.fetch = Polite(call, self.delay if delay is None else delay)

    def search(self, query: str, cap: int) -> Iterator[str]:
        raise NotImplementedError

    def search_many(self, queries: list[str], cap: int) -> Iterator[tuple[str, str]]:
        for q in queries:
            for r in self.search(q, cap):
                yield q, r


class OpenAlex(Source):
    """Works by cursor, at most 100 on a page, until the cap or no cursor is left."""

    api_name, delay = "OpenAlex", 0.10

    def search(self, query: str, cap: int) -> Iterator[str]:
        import json

        cursor, got = "*", 0
        while cursor and got < cap:
            body = self.fetch("https://api.openalex.org/works", {"search": query, "per-page": min(100, cap - got), "cursor": cursor})
            works = (body or {}).get("results") or []
            for w in works:
                yield json.dumps(w)
            got += len(works)
            cursor = ((body or {}).get("meta") or {}).get("next_cursor") if works else None


class PubMed(Source):
    """Ids first, then the articles of each hundred."""

    api_name, delay = "PubMed", 0.34

    def search(self, query: str, cap: int) -> Iterator[str]:
        base = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils"
        found = self.fetch(f"{base}/esearch.fcgi", {"db": "pubmed", "term": query, "retmax": cap, "retmode": "json"}) or {}
        ids = (found.get("esearchresult") or {}).get("idlist") or []
        for i in range(0, len(ids), 100):
            if body := self.fetch(f"{base}/efetch.fcgi", {"db": "pubmed", "id": ",".join(ids[i : i + 100]), "retmode": "xml"}):
                yield str(body)


def work_table(spark: SparkSession, sources: list[str], families: dict[str, list[str]] = QUERY_FAMILIES) -> DataFrame:
    """query_family, query, api: one row for each request to make."""
    return spark.createDataFrame([(f, q, s) for f, queries in families.items() for s in sources for q in queries], "query_family string, query string, api string")


def harvest(work: DataFrame, make: Callable[[str], Source], cap: int = 200) -> DataFrame:
    """query_family, query, api, raw, error: raw records of every request; a failed request is one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: dict[str, Source] = {}
        for b in batches:
            for r in b.itertuples(index=False):
                rows = []
                try:
                    source = made.setdefault(r.api, None) or make(r.api)
                    made[r.api] = source
                    rows = [(r.query_family, r.query, r.api, x, None) for x in source.search(r.query, cap)]
                except Exception as e:
                    rows.append((r.query_family, r.query, r.api, None, str(e)))
                yield pd.DataFrame(rows, columns=["query_family", "query", "api", "raw", "error"])

    return work.repartition("api").mapInPandas(run, "query_family string, query string, api string, raw string, error string")


def land(raw: DataFrame, path: str) -> None:
    """Raw records, a folder for each source."""
    raw.write.mode("overwrite").partitionBy("api").json(path)


def parse_openalex(raw: DataFrame) -> DataFrame:
    """Harvested OpenAlex records as warehouse rows with their query_family."""
    works = raw.where("api = 'OpenAlex' and raw is not null").select("query_family", F.from_json("raw", WORK).alias("w")).select("query_family", "w.*")
    return openalex_rows(works, ["query_family"])


def parse_pubmed(raw: DataFrame) -> DataFrame:
    """Harvested PubMed article sets as warehouse rows with their query_family."""
    sets = raw.where("api = 'PubMed' and raw is not null")
    article = F.explode(F.regexp_extract_all("raw", F.lit(r"(?s)(<PubmedArticle>.*?</PubmedArticle>)"), 1))
    parsed = sets.select("query_family", article.alias("x")).select("query_family", F.from_xml("x", ARTICLE).alias("a")).select("query_family", "a.*")
    return pubmed_rows(parsed, ["query_family"])


def harvest_log(raw: DataFrame) -> DataFrame:
    """By source and query: records, errors."""
    return raw.groupBy("api", "query_family", "query").agg(F.count("raw").alias("records"), F.max("error").alias("error"))


def file_metadata(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes and SHA-256 of every file, for a dataset's machine-readable description."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def description(name: str, files: list[dict], fields: list[tuple[str, str]]) -> dict:
    """A JSON-LD description of a dataset's files and one record set."""
    return {
        "@context": {"@vocab": "https://schema.org/", "cr": "http://mlcommons.org/croissant/", "sc": "https://schema.org/"},
        "@type": "sc:Dataset",
        "name": name,
        "distribution": [{"@type": "cr:FileObject", "@id": f["name"], "name": f["name"], "contentSize": f"{f['bytes']} B", "sha256": f["sha256"]} for f in files],
        "recordSet": [{"@type": "cr:RecordSet", "@id": "records", "field": [{"@type": "cr:Field", "@id": f"records/{n}", "name": n, "dataType": t} for n, t in fields]}],
    }
