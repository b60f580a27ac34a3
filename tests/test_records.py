import random

import pytest
from pyspark.sql import functions as F

from gleanspark.functions import bibliography as bib
from gleanspark.functions import model_output as mo
from gleanspark.operators import dedup, extract, recover, sampling
from gleanspark.schema import HEADLINE, NR
from gleanspark.sources import harvest

COLUMNS = "seq long, record_id string, doi string, pmid string, pmcid string, title string, url string, abstract_or_summary string"


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr.alias("x")).first()["x"]


def test_identifiers(spark):
    p = one(spark, bib.parse_record_id(F.col("v")), "API_OpenAlex_10_1111_iwj_12873")
    assert (p["source"], p["doi_candidates"], p["primary_doi"], p["notes"]) == ("OpenAlex", ["10.1111/iwj-12873", "10.1111/iwj.12873"], "10.1111/iwj-12873", "")
    assert one(spark, bib.parse_record_id(F.col("v")), "PubMed_1")["notes"] == "missing API_ prefix"
    assert one(spark, bib.norm_doi(F.col("v")), " https://dx.doi.org/10.1/A ") == "10.1/a" and one(spark, bib.norm_doi(F.col("v")), " ") is None
    assert one(spark, bib.norm_title(F.col("v")), "Some Title!") == "some title"


def test_texts(spark):
    assert one(spark, bib.demojibake(F.col("v")), "Î¼m".encode().decode()) == "μm" and one(spark, bib.demojibake(F.col("v")), "μm é") == "μm é"
    assert one(spark, bib.norm_text(F.col("v")), "A\nb  ﬁ X") == "ab fi x"
    assert one(spark, bib.crosscheck_status(F.col("v"), F.lit("TEXT  a")), "text a") == "normalized_match"
    assert one(spark, bib.inverted_index_text(F.col("v")), {"a": [0, 2], "b": [1]}, "map<string,array<int>>") == "a b a"
    assert one(spark, bib.inverted_index_text(F.col("v")), {}, "map<string,array<int>>") == ""
    for y, want in (("2014", "pre_2015"), ("2015", "y2015_2020"), ("2021", "post_2020"), ("n.d.", "unknown"), ("2015.0", "unknown"), (None, "unknown")):
        assert one(spark, bib.year_bucket(F.col("v")), y) == want
    for c, want in (("water treatment", "environmental"), ("drug delivery in water", "biomedical"), ("process engineering", "industrial"), ("", "unknown"), ("misc", "other")):
        assert one(spark, bib.application_bucket(F.col("v")), c) == want


GOOD = '{"size": {"value": 200, "unit": "nm", "evidence_quote": "q"}}'


@pytest.mark.parametrize("raw, ok", [(GOOD, True), (f"```json\n{GOOD}\n```", True), (GOOD.replace("}}", "},}"), True), (GOOD.replace('"', "“"), True), (f"Sure: {GOOD} bye", True), ("garbage", False), ("", False), (None, False), (f"{GOOD} {GOOD}", False)])
def test_llm_json(spark, raw, ok):
    got = one(spark, mo.parse_llm_json(F.col("v")), raw)
    assert (got is not None) == ok and (not ok or got["size"]["value"] == "200")


def test_spans(spark):
    cell = lambda s, e: tuple(one(spark, e(F.col("v")), s))[:2]
    assert cell("200 nm in diameter", mo.numeric_span) == ("200", "nm") and cell("80% encapsulation", mo.numeric_span) == ("80", "%")
    assert cell("approximately 200", mo.numeric_span) == ("200", NR) and cell("not a number at all", mo.numeric_span) == (NR, NR) and cell(None, mo.numeric_span) == (NR, NR)
    assert cell("doxorubicin", mo.text_span) == ("doxorubicin", "") and cell("   ", mo.text_span) == (NR, NR)


def test_qa_span_against_plain_code(spark):
    rng = random.Random(3)
    rows = [([rng.gauss(0, 2) for _ in range(30)], [rng.gauss(0, 2) for _ in range(30)], [k > 5 for k in range(30)]) for _ in range(40)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s array<double>, e array<double>, c array<boolean>")
    got = {r["i"]: r["x"] for r in df.select("i", mo.qa_span(F.col("s"), F.col("e"), F.col("c"), 20, 8).alias("x")).collect()}
    for i, (s, e, c) in enumerate(rows):
        tops = [sorted(range(30), key=lambda k: -z[k])[:20] for z in (s, e)]
        spans = [(s[a] + e[b], a, b) for a in tops[0] for b in tops[1] if a and b and c[a] and c[b] and 0 <= b - a < 8]
        best = max(spans, default=None)
        want = (best[1], best[2]) if best and s[0] + e[0] < best[0] else None
        assert (got[i] and (got[i]["first"], got[i]["last"])) == want


def test_extractors(spark):
    rows = [("a", "Lipid nanobubbles 200 nm in diameter were prepared."), ("b", "Zeta potential -12.5 mV measured by DLS."), ("c", "Encapsulation efficiency 81% with sustained release."), ("d", "We review applications in water treatment."), ("e", None)]
    df = spark.createDataFrame(rows, "record_id string, abstract_or_summary string")
    out = {r["record_id"]: r for r in extract.predict(df, extract.RegexExtractor()).collect()}
    assert (out["a"]["size_value"], out["a"]["size_unit"]) == ("200", "nm") and out["b"]["zeta_potential_value"] == "-12.5"
    assert (out["c"]["loading_efficiency_value"], out["c"]["loading_efficiency_unit"]) == ("81", "%") and out["c"]["payload_value"] == NR
    assert all(out[k][f"{f}_value"] == NR for k in "de" for f in HEADLINE)
    said = extract.QAExtractor(lambda texts: [[("200 nm", 0.9), ("x", 0.1), ("", 0.9), ("dye", 0.9), ("80%", 0.15), ("slow", 0.5)] for _ in texts])
    r = extract.predict(df, said).where("record_id = 'a'").first()
    assert (r["size_value"], r["payload_value"], r["loading_efficiency_value"], r["stability_value"]) == ("200", "dye", NR, NR)
    broken = extract.LLMExtractor(lambda prompts: 1 / 0)
    assert extract.predict_cells(df, broken).where(f"value <> '{NR}'").count() == 0
    assert extract.predict_cells(df, extract.LLMExtractor(lambda p: [GOOD] * len(p))).where("value = '200'").count() == 5
    with pytest.raises(KeyError):
        extract.predict(df, said, "nope")
    with pytest.raises(TypeError):
        type("X", (extract.Base,), {})()


def records(spark, rows):
    return spark.createDataFrame([(i, f"r{i}", *r) for i, r in enumerate(rows)], COLUMNS)


def test_greedy_dedup(spark):
    row = lambda doi=None, pmid=None, title="", url=None, abstract="": (doi, pmid, None, title, url, abstract)
    kept = lambda rows: [tuple(r) for r in dedup.greedy(records(spark, rows)).select("slot_seq", "seq").orderBy("slot_seq").collect()]
    assert kept([row("10.1/X", title="a"), row("10.1/x", title="b", abstract="long")]) == [(0, 1)]
    assert kept([row(pmid="123", title="a"), row(pmid="123", title="b")]) == [(0, 1)]
    assert kept([row(title="Some Title!"), row(title="some title")]) == [(0, 0)]  # the longer title is richer
    assert kept([row("10.1/a", title="a"), row("10.1/b", title="b")]) == [(0, 0), (1, 1)]
    assert kept([row("D1", title="a"), row("D1", "P", "b"), row(None, "P", "c")]) == [(0, 1), (2, 2)]


def test_greedy_dedup_against_one_pass(spark):
    rng = random.Random(5)
    rows = [(*(rng.choice([None, "", f"{k}{rng.randrange(25)}"]) for k in ("d", "p", "c")), rng.choice(["", f"t {rng.randrange(40)}"]), rng.choice([None, f"u{rng.randrange(30)}"]), "x" * rng.randrange(4)) for _ in range(150)]
    seen, slots = {}, []
    for i, (doi, pmid, pmcid, title, url, text) in enumerate(rows):
        keys = [(k, v) for k, v in (("d", doi), ("p", pmid), ("c", pmcid), ("t", title), ("u", url)) if v]
        rich = (bool(doi), bool(pmid), bool(pmcid), len(text), len(title))
        at = next((seen[k] for k in keys if k in seen), None)
        if at is None:
            seen |= {k: len(slots) for k in keys}
            slots.append([i, i, rich])
        elif rich >= slots[at][2]:
            slots[at][1:] = [i, rich]
    got = dedup.greedy(records(spark, rows)).select("slot_seq", "seq").orderBy("slot_seq").collect()
    assert [tuple(r) for r in got] == [(a, b) for a, b, _ in slots]


def test_labels_of_many_nodes_are_not_broadcast(spark, monkeypatch):
    from gleanspark.operators import components

    seen, write = [], components.written
    monkeypatch.setattr(components, "FEW", 5)
    monkeypatch.setattr(components, "written", lambda df, name: (seen.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    pairs = spark.range(9).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {tuple(r) for r in components.components(pairs).collect()} == {(i, 0) for i in range(10)}
    assert len(seen) > 2 and not any("Broadcast" in plan for plan in seen)
    sides = dedup.greedy(records(spark, [("d", None, None, "", None, "")] * 3))._jdf.queryExecution().executedPlan().toString()
    assert sides.count("SortMergeJoin") > 1 and "BroadcastHashJoin" not in sides


def test_resolver_asks_own_source_first(spark):
    missing = spark.createDataFrame([("x", "OpenAlex", ["d1", "d2"]), ("y", "PubMed", ["d9"])], "record_id string, source string, candidates array<string>")
    landed = spark.createDataFrame([("PubMed", "d1", "P"), ("OpenAlex", "d2", "O"), ("OpenAlex", "d1", "")], "api string, doi string, title string")
    got = {r["record_id"]: (r["ok"], r["title"]) for r in recover.resolve(missing, landed).collect()}
    assert got == {"x": (True, "O"), "y": (False, None)}


def test_splits(spark):
    rows = [(str(i), str(2000 + i % 25), f"s{i % 3}", ["original", "review", None][i % 3], ["a", "b"][i % 2], "water", "t") for i in range(200)]
    gold = spark.createDataFrame(rows, "record_id string, year string, source_api string, document_type string, nanobubble_vs_nanoparticle string, application_category string, abstract_or_summary string")
    pins = gold.where("cast(record_id as int) % 10 = 0").select("record_id")
    s = sampling.build_splits(gold, pins).cache()
    assert s.where("split = 'dev'").count() == 20 and s.where("split = 'dev' and in_iaa").count() == 0 and s.count() == 200
    assert all(r["ok"] for r in sampling.leakage(s, pins).collect())
    again = sampling.build_splits(gold.orderBy(F.desc("record_id")), pins)
    assert {tuple(r) for r in s.select("record_id", "split").collect()} == {tuple(r) for r in again.select("record_id", "split").collect()}
    assert sampling.splits_meta(s).first()["n_dev"] == 20


def test_harvest_parsers(spark, tmp_path):
    import json

    (tmp_path / "w.json").write_text(json.dumps({"id": "https://x/W1", "doi": "https://doi.org/10.1/a", "title": "T", "type": "review", "publication_year": 2020, "authorships": [{"author": {"display_name": "A"}}, {"author": {"display_name": None}}], "primary_location": None, "abstract_inverted_index": {"hello": [0], "world": [1]}}) + "\n")
    w = harvest.read_openalex(spark, str(tmp_path / "w.json")).first()
    assert (w["record_id"], w["doi"], w["document_type"], w["abstract_or_summary"], w["authors"], w["journal_or_venue"]) == ("OpenAlex_W1", "10.1/a", "review", "hello world", "A", "")
    xml = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">7</PMID><Article><ArticleTitle>A title</ArticleTitle><Journal><Title>J</Title><JournalIssue><PubDate><MedlineDate>Spring 1999 Jan</MedlineDate></PubDate></JournalIssue></Journal>
    <Abstract><AbstractText Label="AIM">one</AbstractText><AbstractText>two</AbstractText></Abstract><AuthorList><Author><LastName>L</LastName><ForeName>F</ForeName></Author></AuthorList><PublicationTypeList><PublicationType UI="x">Systematic Review</PublicationType></PublicationTypeList></Article></MedlineCitation>
    <PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/z</ArticleId><ArticleId IdType="pmc">PMC1</ArticleId></ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>"""
    (tmp_path / "p.xml").write_text(xml)
    p = harvest.read_pubmed(spark, str(tmp_path / "p.xml")).first()
    assert (p["record_id"], p["title"], p["year"], p["abstract_or_summary"], p["authors"], p["doi"], p["pmcid"], p["document_type"]) == ("PubMed_7", "A title", 1999, "AIM: one two", "F L", "10.1/z", "PMC1", "review")
    pages = {"*": ({"results": [{"id": "W1"}, {"id": "W2"}], "meta": {"next_cursor": "n"}}), "n": {"results": [{"id": "W3"}], "meta": {}}}
    calls = []

    def call(url, params):
        calls.append(params["cursor"])
        return (503, None) if len(calls) == 1 else (200, pages[params["cursor"]])

    source = harvest.OpenAlex(call, delay=0)
    source.fetch.pause = 0
    assert len(list(source.search("q", 10))) == 3 and calls == ["*", "*", "n"]
    assert sum(map(len, harvest.QUERY_FAMILIES.values())) == 50 and harvest.work_table(spark, ["A", "B"]).count() == 100


def test_braces_in_a_quote_are_text(spark):
    from gleanspark.functions import model_output as mo

    raw = [('{"size": {"value": 5, "unit": "nm", "evidence_quote": "sets {a} {b} of 5 nm \\" x } {"}}',), ('{"size": {"value": 5}} {"size": {"value": 6}}',)]
    got = spark.createDataFrame(raw, "raw string").select(mo.parse_llm_json(F.col("raw")).alias("r")).select("r.size.value").collect()
    assert [r["value"] for r in got] == ["5", None]


def test_a_failing_abstract_fails_alone(spark):
    from gleanspark.operators import extract

    def answer(texts):
        if "bad" in texts:
            raise ValueError("bad")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(t,) for t in ("a", "bad", "c", None)], "abstract string").coalesce(1)
    got = extract.answered(df, "said", "string", answer, None, "abstract").collect()
    assert {r["abstract"]: r["said"] for r in got} == {"a": "A", "bad": None, "c": "C", None: ""}


def test_quota_ends_inside_a_large_stratum(spark):
    from gleanspark.operators import sampling

    df = spark.range(5000).select(F.col("id").cast("string").alias("record_id"), (F.col("id") % 2).cast("string").alias("s"))
    quotas = spark.createDataFrame([("0", 1700), ("1", 3)], "s string, quota int")
    got = [r["record_id"] for r in sampling.quota_sample(df, ["s"], 1703, quotas, 7).collect()]
    import hashlib

    draw = lambda i: hashlib.md5(f"7:{i}".encode()).hexdigest()
    want = [x for s, n in ((0, 1700), (1, 3)) for x in sorted((str(i) for i in range(5000) if i % 2 == s), key=draw)[:n]]
    assert got == sorted(want, key=draw)
    assert sampling.quota_sample(df, ["s"], 1710, quotas, 7).count() == 1710
