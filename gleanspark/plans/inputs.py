"""Domain-shaped inputs derived from the driver's tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import frames

S = "CAST({} AS STRING)".format

#: One annotator's and one system's wide frames, by order (k).
GOLD = {
    "size": ("CASE WHEN k % 5 = 0 THEN 'NOT_REPORTED' WHEN k % 11 = 0 THEN '' ELSE CAST(k % 400 + 20 AS STRING) END", "CASE k % 4 WHEN 0 THEN 'nm' WHEN 1 THEN 'um' WHEN 2 THEN 'Nano meter' ELSE 'micron' END", "'a diameter of ' || CAST(k % 400 + 20 AS STRING) || ' nm'"),
    "zeta_potential": ("CASE WHEN k % 3 = 0 THEN 'not_reported' ELSE '-' || CAST(k % 60 AS STRING) || '.5' END", "CASE WHEN k % 8 = 0 THEN 'V' ELSE 'mV' END", "'zeta  potential -' || CAST(k % 60 AS STRING) || '.5 mV'"),
    "stability": ("CASE WHEN k % 4 = 0 THEN ' ' ELSE CAST(k % 72 AS STRING) END", "CASE k % 5 WHEN 0 THEN 'days' WHEN 1 THEN 'h' WHEN 2 THEN 'weeks' WHEN 3 THEN 'min' ELSE 'parsec' END", "'stable for ' || CAST(k % 72 AS STRING) || ' h'"),
    "payload": ("CASE WHEN k % 6 = 0 THEN 'NOT_REPORTED' WHEN k % 3 = 1 THEN 'doxorubicin' ELSE 'Dye  X' END", "''", "'loaded with doxorubicin or dye x'"),
    "loading_efficiency": ("CASE WHEN k % 7 = 0 THEN 'NOT_REPORTED' WHEN k % 2 = 0 THEN '0.' || CAST(k % 90 + 10 AS STRING) ELSE CAST(k % 100 AS STRING) END", "CASE WHEN k % 2 = 0 THEN '' ELSE '%' END", "'an efficiency of ' || CAST(k % 100 AS STRING) || ' %'"),
    "release_profile": ("CASE WHEN k % 2 = 0 THEN 'NOT_REPORTED' ELSE 'sustained ' || CAST(k % 48 AS STRING) || ' h' END", "'NOT_REPORTED'", "CASE WHEN k % 9 = 0 THEN 'NOT_REPORTED' ELSE 'sustained release, ' || CAST(k % 48 AS STRING) || ' h' END"),
}
PRED = {
    "size": ("CASE WHEN k % 7 = 0 THEN 'NOT_REPORTED' WHEN k % 9 = 0 THEN '150-250' WHEN k % 6 = 0 THEN CAST(k % 400 + 24 AS STRING) ELSE CAST(k % 400 + 20 AS STRING) END", "CASE k % 4 WHEN 0 THEN 'nm' WHEN 1 THEN 'micrometer' WHEN 2 THEN 'nanometer' ELSE 'um' END", "'diameter ' || CAST(k % 400 + 20 AS STRING) || 'nm'"),
    "zeta_potential": ("CASE WHEN k % 4 = 0 THEN 'NOT_REPORTED' WHEN k % 5 = 0 THEN '-12.5' ELSE '-' || CAST(k % 60 AS STRING) || '.5' END", "'mV'", "'Zeta potential -' || CAST(k % 60 AS STRING) || '.5 mV'"),
    "stability": ("CASE WHEN k % 6 = 0 THEN 'NOT_REPORTED' WHEN k % 10 = 1 THEN '<5' ELSE CAST(k % 72 AS STRING) END", "CASE k % 5 WHEN 0 THEN 'd' WHEN 1 THEN 'hours' WHEN 2 THEN 'days' WHEN 3 THEN 'minutes' ELSE 'h' END", "CASE WHEN k % 13 = 0 THEN '' ELSE 'stable over ' || CAST(k % 72 AS STRING) || ' h' END"),
    "payload": ("CASE WHEN k % 5 = 0 THEN 'NOT_REPORTED' WHEN k % 3 = 1 THEN 'Doxorubicin hydrochloride' ELSE 'dye x' END", "''", "'with doxorubicin hydrochloride'"),
    "loading_efficiency": ("CASE WHEN k % 8 = 0 THEN 'NOT_REPORTED' WHEN k % 2 = 0 THEN CAST(k % 90 + 10 AS STRING) ELSE CAST(k % 100 + 1 AS STRING) END", "'percent'", "'efficiency ' || CAST(k % 100 AS STRING) || '%'"),
    "release_profile": ("CASE WHEN k % 3 = 0 THEN 'NOT_REPORTED' WHEN k % 5 = 0 THEN 'burst' ELSE 'Sustained ' || CAST(k % 48 AS STRING) || ' h' END", "''", "'sustained ' || CAST(k % 48 AS STRING) || ' h'"),
}
FIELDS = list(GOLD)


def wide(cells: dict, table: str) -> str:
    columns = ", ".join(f"{x} AS {f}_{p}" for f, parts in cells.items() for p, x in zip(("value", "unit", "evidence_quote"), parts))
    return f"SELECT CAST(k AS STRING) AS record_id, CASE k % 3 WHEN 0 THEN 'bubble' WHEN 1 THEN 'particle' ELSE 'other' END AS label, {columns} FROM (SELECT o_orderkey AS k FROM {table}) o"


def long_sql(cells: dict) -> str:
    """The same frame in long form, for DuckDB."""
    one = "SELECT record_id, label, '{0}' AS field, {0}_value AS value, {0}_unit AS unit, {0}_evidence_quote AS evidence_quote FROM w"
    return f"WITH w AS ({wide(cells, 'orders')}) " + " UNION ALL ".join(one.format(f) for f in cells)


def spread(table: DataFrame) -> DataFrame:
    """A table in fewer files than there are cores is dealt to all of them: one file with one row group is one task, and what is
    derived from a narrow row here costs far more than to move it."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if len(table.inputFiles()) < cores else table


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/orders.parquet"))


def frame(spark: SparkSession, sf_dir: str, cells: dict) -> DataFrame:
    """The wide frame."""
    return spark.sql(wide(cells, "{orders}"), orders=orders(spark, sf_dir))


def long(spark: SparkSession, sf_dir: str, cells: dict) -> DataFrame:
    return frames.to_long(frame(spark, sf_dir, cells), FIELDS, ["label"])


#: Bibliographic rows from parts, with shared identifiers; seq is unique.
WAREHOUSE = """
SELECT p_partkey AS seq, 'rec_' || CAST(p_partkey % 1900 AS STRING) AS record_id,
       CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 'https://doi.org/10.1000/AB-' || CAST(p_partkey % 600 AS STRING) ELSE '10.1000/ab-' || CAST(p_partkey % 600 AS STRING) END AS doi,
       CASE WHEN p_partkey % 4 = 0 THEN CAST(p_partkey % 500 AS STRING) ELSE '' END AS pmid,
       CASE WHEN p_partkey % 9 = 0 THEN 'PMC' || CAST(p_partkey % 300 AS STRING) ELSE NULL END AS pmcid,
       CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name || ': No. ' || CAST(p_partkey % 700 AS STRING) || '!' END AS title,
       CASE WHEN p_partkey % 7 = 0 THEN 'https://host/' || CAST(p_partkey % 250 AS STRING) ELSE NULL END AS url,
       CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_type || ' ' || p_brand END AS abstract_or_summary
FROM {part}
"""
#: Gold records from suppliers and customers.
AUDIT = """
SELECT CASE c_custkey % 7 WHEN 0 THEN 'API_PubMed_10_1000_ab_' || CAST(c_custkey % 600 AS STRING) WHEN 1 THEN 'API_OpenAlex_10_12_x' WHEN 2 THEN 'API_Other_10_1000_z' WHEN 3 THEN 'local_' || CAST(c_custkey AS STRING)
            WHEN 4 THEN 'API_EuropePMC_12345' ELSE 'API_OpenAlex_10_10000_s1_' || CAST(c_custkey AS STRING) END || CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '' END AS id_text,
       c_custkey AS k, c_mktsegment || ': ' || c_name AS title, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name || '  ' || c_mktsegment END AS abstract_or_summary
FROM {customer}
"""
#: Texts with numbers and units.
ABSTRACTS = """
SELECT CAST(p_partkey AS STRING) AS record_id,
       CASE p_partkey % 6
         WHEN 0 THEN 'Lipid particles of ' || CAST(p_size AS STRING) || ' nm in diameter; ' || p_name
         WHEN 1 THEN 'Zeta potential of -' || CAST(p_size AS STRING) || '.5 mV and loading efficiency ' || CAST(p_size AS STRING) || ' %'
         WHEN 2 THEN 'stable for ' || CAST(p_size AS STRING) || ' days, 0.5 um bubbles'
         WHEN 3 THEN 'ENCAPSULATION EFFICIENCY of 81.2% with 200 +/- 22 nm'
         WHEN 4 THEN 'We review ' || p_type
         ELSE 'stability of ' || CAST(p_size AS STRING) || ' h; zeta 12 mV; size 7 micron' END AS abstract_or_summary
FROM {part}
"""
#: Answers of a language model.
ANSWERS = """
SELECT p_partkey AS k,
       CASE p_partkey % 6
         WHEN 0 THEN '{{"size": {{"value": "' || CAST(p_size AS STRING) || '", "unit": "nm", "evidence_quote": " a quote "}}}}'
         WHEN 1 THEN 'Here: {{"size": {{"value": "12", "unit": null,}}, "payload": {{"value": "  ", "evidence_quote": "x"}},}} done'
         WHEN 2 THEN '```json {{"payload": {{"value": "dye", "unit": "", "evidence_quote": "dye"}}}} ```'
         WHEN 3 THEN 'no object here'
         WHEN 4 THEN ''
         ELSE '{{"size": "a string", "stability": {{"value": "7"}}}}' END AS raw
FROM {part}
"""
#: A pool of documents with labels for splits.
POOL = """
SELECT CAST(doc_id AS STRING) AS record_id, CASE WHEN doc_id % 13 = 0 THEN NULL ELSE CAST(1990 + doc_id % 36 AS STRING) END AS year, source AS source_api,
       CASE doc_id % 4 WHEN 0 THEN 'review' WHEN 1 THEN NULL ELSE 'original' END AS document_type, lang AS nanobubble_vs_nanoparticle,
       CASE doc_id % 7 WHEN 0 THEN 'Water treatment' WHEN 1 THEN 'drug delivery in water' WHEN 2 THEN 'process engineering' WHEN 3 THEN '' WHEN 4 THEN 'Physics' WHEN 5 THEN 'misc' ELSE NULL END AS application_category,
       text AS abstract_or_summary
FROM {documents}
"""
#: Harvested works of one API as it sends them.
HARVESTED = """
SELECT 'OpenAlex' AS api, 'family ' || CAST(p_partkey % 5 AS STRING) AS query_family,
       '{{"id": "https://openalex.org/W' || CAST(p_partkey AS STRING) || '", "doi": ' || CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE '"https://doi.org/10.1000/' || CAST(p_partkey AS STRING) || '"' END
       || ', "title": ' || CASE WHEN p_partkey % 7 = 0 THEN 'null' WHEN p_partkey % 7 = 1 THEN '""' ELSE '"' || p_name || '"' END || ', "display_name": "' || p_type || '", "type": "' || CASE p_partkey % 4 WHEN 0 THEN 'Review' WHEN 1 THEN 'review-article' ELSE 'article' END
       || '", "publication_year": ' || CASE WHEN p_partkey % 8 = 0 THEN 'null' ELSE CAST(1970 + p_size AS STRING) END || ', "cited_by_count": ' || CAST(p_partkey % 100 AS STRING)
       || ', "authorships": [{{"author": {{"display_name": "' || p_brand || '"}}}}, {{"author": {{"display_name": ""}}}}, {{"author": {{"display_name": "A. ' || p_brand || '"}}}}]'
       || ', "primary_location": ' || CASE WHEN p_partkey % 5 = 0 THEN 'null' ELSE '{{"source": {{"display_name": "Journal ' || CAST(p_size AS STRING) || '"}}}}' END
       || ', "ids": {{"pmid": "https://pubmed.ncbi.nlm.nih.gov/' || CAST(p_partkey AS STRING) || '", "pmcid": "https://www.ncbi.nlm.nih.gov/pmc/articles/' || CAST(p_partkey % 90 AS STRING) || '/"}}'
       || ', "abstract_inverted_index": ' || CASE WHEN p_partkey % 6 = 0 THEN 'null' ELSE '{{"' || p_brand || '": [1, 3], "the": [0, 2]}}' END || '}}' AS raw
FROM {part}
"""
#: What APIs answered for DOIs, and records that look for theirs.
LANDED = """
SELECT CASE s_suppkey % 3 WHEN 0 THEN 'PubMed' WHEN 1 THEN 'OpenAlex' ELSE 'EuropePMC' END AS api, '10.1000/' || CAST(s_suppkey % 37 AS STRING) AS doi, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE 'A work' END AS title
FROM {supplier} WHERE s_suppkey <= 111
"""
MISSING = """
SELECT CAST(c_custkey AS STRING) AS record_id, CASE c_custkey % 4 WHEN 0 THEN 'PubMed' WHEN 1 THEN 'OpenAlex' WHEN 2 THEN 'EuropePMC' ELSE '' END AS source, '10.1000/' || CAST(c_custkey % 41 AS STRING) AS first_doi, '10.1000/' || CAST(c_custkey % 53 AS STRING) AS second_doi
FROM {customer}
"""
#: Abstracts fetched again, twice for some records, and the warehouse rows that hold the others.
FETCHED = """
SELECT CAST(c_custkey AS STRING) AS record_id, c_custkey * 2 + t AS seq, CASE WHEN t = 0 THEN 'an older text' WHEN c_custkey % 2 = 0 THEN upper(c_name) || ' ' || c_mktsegment WHEN c_custkey % 5 = 0 THEN '' ELSE c_name || '  ' || c_mktsegment END AS abstract_or_summary
FROM {customer}, (SELECT 0 AS t UNION ALL SELECT 1) x WHERE c_custkey % 3 = 0
"""


def derived(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def duck(sql: str, *tables: str) -> str:
    """The same text for DuckDB."""
    return sql.format(**{t: t for t in tables})
