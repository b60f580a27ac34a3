"""The same queries in DuckDB's SQL, written independently of the operators."""

from __future__ import annotations

from ..functions.bibliography import APPLICATIONS
from ..functions.model_output import UNIT_WORDS
from ..operators.extract import PATTERNS
from ..schema import HEADLINE, NUMERIC, UNITS
from . import inputs as i

GOLD, PRED = f"({i.long_sql(i.GOLD)})", f"({i.long_sql(i.PRED)})"
PART, CUSTOMER, DOCS = i.duck(i.WAREHOUSE, "part"), i.duck(i.AUDIT, "customer"), i.duck(i.POOL, "documents")
TEXTS = i.duck(i.ABSTRACTS, "part")
NUM = r"-?\d+(?:\.\d+)?(?:[eE]-?\d+)?"


def nr(v: str) -> str:
    return f"(coalesce(upper(trim({v})), '') IN ('', 'NOT_REPORTED'))"


def number(v: str) -> str:
    plain = f"replace(replace(replace({v}, '−', '-'), '±', ' '), '+/-', ' ')"
    return f"CASE WHEN {nr(v)} OR regexp_matches({v}, '[<>≤≥]') OR regexp_matches({v}, '\\d\\s*[-–]\\s*\\d') THEN NULL ELSE TRY_CAST(nullif(regexp_extract({plain}, '{NUM}'), '') AS DOUBLE) END"


def unit(u: str) -> str:
    return f"CASE WHEN {nr(u)} THEN '' ELSE replace(replace(replace(lower(trim({u})), ' ', ''), '·', ''), '.', '') END"


def factor(field: str, u: str) -> str:
    cases = " ".join(f"WHEN '{n}|{k}' THEN CAST('{x!r}' AS DOUBLE)" for n, (_, table) in UNITS.items() for k, x in table.items())
    return f"CASE {field} || '|' || {u} {cases} END"


def amount(v: str, u: str, field: str) -> str:
    x, n = f"({number(v)})", f"({unit(u)})"
    share = f"CASE WHEN {x} >= 0 AND {x} <= 1 THEN {x} * 100 ELSE {x} END"
    return f"CASE WHEN {field} = 'loading_efficiency' AND {n} IN ('', 'fraction') THEN {share} WHEN {n} <> '' THEN {x} * {factor(field, n)} END"


def text(v: str) -> str:
    return f"CASE WHEN {nr(v)} THEN 'NOT_REPORTED' ELSE lower(trim(regexp_replace({v}, '\\s+', ' ', 'g'))) END"


def shown(x: str) -> str:
    return f"CASE WHEN abs({x} - trunc({x})) < 1e-9 THEN CAST(CAST(trunc({x}) AS BIGINT) AS VARCHAR) ELSE format('{{:g}}', {x}) END"


def supported(v: str, e: str, field: str) -> str:
    """The answer stands in its evidence."""
    x = f"({number(v)})"
    numeric = ", ".join(f"'{n}'" for n in NUMERIC)
    return f"(NOT {nr(e)} AND CASE WHEN {field} IN ({numeric}) AND {x} IS NOT NULL THEN contains({text(e)}, {shown(x)}) ELSE contains({text(e)}, {text(v)}) END)"


CUNIT = "CASE field " + " ".join(f"WHEN '{n}' THEN '{unit}'" for n, (unit, _) in UNITS.items()) + " END"
ORD = "CASE field " + " ".join(f"WHEN '{f}' THEN {k + 1}" for k, f in enumerate(HEADLINE)) + " ELSE 99 END"
NUMERIC_SQL = ", ".join(f"'{n}'" for n in NUMERIC)


def pairs(a: str, b: str) -> str:
    """Cells side by side with everything that metrics need."""
    return f"""
    c AS (SELECT a.record_id, a.field, a.label, a.value av, a.unit au, a.evidence_quote ae, b.value bv, b.unit bu, b.evidence_quote be, NOT {nr("a.value")} g, NOT {nr("b.value")} p,
            {amount("a.value", "a.unit", "a.field")} ax, {amount("b.value", "b.unit", "b.field")} bx, {text("a.value")} at_, {text("b.value")} bt, {text("a.evidence_quote")} aq, {text("b.evidence_quote")} bq
          FROM {a} a JOIN {b} b ON a.record_id = b.record_id AND a.field = b.field),
    m AS (SELECT *, CASE WHEN abs(ax) < 1e-12 THEN abs(bx) < 1e-12 ELSE abs(ax - bx) <= 0.05e0 * abs(ax) END close,
            string_split(aq, '') al, string_split(bq, '') bl FROM c),
    s AS (SELECT *, g AND p AND CASE WHEN field IN ({NUMERIC_SQL}) THEN CASE WHEN ax IS NULL OR bx IS NULL THEN at_ = bt ELSE close END ELSE contains(at_, bt) OR contains(bt, at_) END same,
            CASE WHEN g AND p AND aq <> '' AND bq <> '' THEN len(list_intersect(al, bl)) / len(list_distinct(list_concat(al, bl)))::DOUBLE END iou,
            g AND p AND ax IS NOT NULL AND bx IS NOT NULL num FROM m)"""


def f1(tp: str, fp: str, fn: str) -> str:
    return f"CASE WHEN {tp} > 0 THEN 2.0e0 * {tp} / (2 * {tp} + {fp} + {fn}) ELSE 0 END"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {a}::DOUBLE / {b} END"


def scores(by: str) -> str:
    group = f"{by}, field" if by else "field"
    lead = f"{by}, " if by else ""
    join = f"k.{by} = e.{by} AND " if by else ""
    labelled = f"(SELECT p.*, g.label AS glabel FROM {PRED} p JOIN (SELECT DISTINCT record_id, label FROM {GOLD} x) g USING (record_id))"
    return f"""WITH {pairs(GOLD, PRED)},
    k AS (SELECT {group}, count(*) n, count(*) FILTER (same) tp, count(*) FILTER (p AND NOT same) fp, count(*) FILTER (g AND NOT p) fn, count(*) FILTER (NOT g AND NOT p) ntp, count(*) FILTER (NOT g AND p) nfn,
            avg(iou) span_iou, count(iou) n_iou_evaluable, count(*) FILTER (num AND close) num_ok, count(*) FILTER (num) n_num_evaluable,
            count(*) FILTER (num AND NOT {nr("au")} AND NOT {nr("bu")}) n_unit_evaluable FROM s GROUP BY {group}),
    e AS (SELECT {"glabel AS label, " if by else ""}field, avg(CASE WHEN {supported("value", "evidence_quote", "field")} THEN 1.0e0 ELSE 0 END) ae_consistency FROM {labelled if by else PRED} q WHERE NOT {nr("value")} GROUP BY {"glabel, " if by else ""}field),
    r AS (SELECT k.*, {f1("tp", "fp", "fn")} naive_f1, {f1("ntp", "fn", "nfn")} nr_f1, {ratio("num_ok", "n_num_evaluable")} num_match, {ratio("n_unit_evaluable", "n_unit_evaluable")} unit_accuracy, e.ae_consistency
          FROM k LEFT JOIN e ON {join}k.field = e.field),
    t AS (SELECT {lead}field, n, naive_f1, nr_f1, (naive_f1 + nr_f1) / 2 acal_f1, span_iou, num_match, unit_accuracy, ae_consistency, tp + fn n_emit_gold, tp + fp n_emit_pred, ntp + nfn n_nr_gold, n_iou_evaluable, n_num_evaluable, n_unit_evaluable FROM r)"""


MEANS = ["naive_f1", "nr_f1", "acal_f1", "span_iou", "num_match", "unit_accuracy", "ae_consistency"]
TAIL = ["n_emit_gold", "n_emit_pred", "n_nr_gold", "n_iou_evaluable", "n_num_evaluable", "n_unit_evaluable"]


def rnd(columns: list[str]) -> str:
    return ", ".join(f"round({c}, 9) AS {c}" for c in columns)


eval_headline = (
    scores("")
    + f" SELECT field, n, {rnd(MEANS)}, {', '.join(TAIL)}, {ORD} AS field_ord FROM t UNION ALL SELECT 'MACRO', max(n), {', '.join(f'round(avg({c}), 9)' for c in MEANS)}, {', '.join('NULL' for _ in TAIL)}, 99 FROM t"
)
eval_by_slice = scores("label") + f" SELECT label, max(n) AS n, {', '.join(f'CASE WHEN max(n) >= 4 THEN round(avg({c}), 9) END AS {c}' for c in MEANS)} FROM t GROUP BY label"
quote_check = f"""SELECT field, count(*) AS n, count(*) FILTER (NOT {nr("value")} AND NOT (NOT {nr("evidence_quote")} AND ({supported("value", "evidence_quote", "field")} OR contains({text("evidence_quote")}, {text("value")})))) AS dropped FROM {PRED} q GROUP BY field"""
canonical_values = f"SELECT record_id, field, round({amount('value', 'unit', 'field')}, 9) AS canonical_value, CASE WHEN {amount('value', 'unit', 'field')} IS NOT NULL THEN {CUNIT} END AS canonical_unit FROM {GOLD} q"
parse_numbers = f"SELECT record_id, field, {number('value')} AS number, {unit('unit')} AS unit, {nr('value')} AS nr FROM {PRED} q"
number_strings = f"SELECT o_orderkey, {shown('o_totalprice')} AS price, {shown('(o_totalprice / 100000000)')} AS small, {shown('(o_orderkey % 97)::DOUBLE')} AS whole FROM orders"
char_overlap = f"WITH {pairs(GOLD, PRED)} SELECT field, round(avg(iou), 9) AS mean_iou, count(iou) AS n_iou, count(*) FILTER (same) AS n_same FROM s GROUP BY field"
ae_consistency = f"SELECT field, round(avg(CASE WHEN {supported('value', 'evidence_quote', 'field')} THEN 1.0e0 ELSE 0 END), 9) AS ae_consistency FROM {PRED} q WHERE NOT {nr('value')} GROUP BY field"


def found(field: str) -> str:
    """A field's cells by its pattern (its only one)."""
    if field not in PATTERNS:
        return f"SELECT record_id, '{field}' AS field, 'NOT_REPORTED' AS value, 'NOT_REPORTED' AS unit, 'NOT_REPORTED' AS evidence_quote FROM t"
    p = "(?i)" + PATTERNS[field][0].replace("'", "''")
    part = lambda g: f"regexp_extract(x, '{p}', {g})"
    return f"SELECT record_id, '{field}' AS field, CASE WHEN {part(0)} = '' THEN 'NOT_REPORTED' ELSE regexp_replace({part(1)}, '\\s+', '', 'g') END AS value, CASE WHEN {part(0)} = '' THEN 'NOT_REPORTED' ELSE {part(2)} END AS unit, CASE WHEN {part(0)} = '' THEN 'NOT_REPORTED' ELSE trim({part(0)}) END AS evidence_quote FROM t"


REGEX = f"WITH t AS (SELECT record_id, abstract_or_summary AS x FROM ({TEXTS}) y) " + " UNION ALL ".join(found(f) for f in HEADLINE)
regex_extract = REGEX
regex_then_eval = f"""WITH p AS ({REGEX}), q AS (SELECT *, value <> 'NOT_REPORTED' p, value <> 'NOT_REPORTED' AND CAST(record_id AS BIGINT) % 5 <> 0 g FROM p),
    k AS (SELECT field, count(*) n, count(*) FILTER (g) tp, count(*) FILTER (p AND NOT g) fp, count(*) FILTER (NOT p) ntp FROM q GROUP BY field),
    r AS (SELECT field, n, tp AS n_emit_gold, tp + fp AS n_emit_pred, ntp + fp AS n_nr_gold, ({f1("tp", "fp", "0")} + {f1("ntp", "0", "fp")}) / 2 AS acal_f1 FROM k)
    SELECT field, n, n_emit_gold, n_emit_pred, n_nr_gold, round(acal_f1, 9) AS acal_f1 FROM r UNION ALL SELECT 'MACRO', max(n), NULL, NULL, NULL, round(avg(acal_f1), 9) FROM r"""
reconcile_stats = f"""WITH {pairs(GOLD, PRED)},
    k AS (SELECT field, count(*) n, count(*) FILTER (g AND p) b, count(*) FILTER (NOT g AND NOT p) z, count(*) FILTER (g AND NOT p) a, count(*) FILTER (NOT g AND p) o, count(*) FILTER (same) ok,
            count(*) FILTER (num) nn, count(*) FILTER (num AND close) nk, avg(iou) iou, count(iou) ni FROM s GROUP BY field),
    e AS (SELECT *, (b + z)::DOUBLE / n po, ((b + a)::DOUBLE / n) * ((b + o)::DOUBLE / n) + ((z + o)::DOUBLE / n) * ((z + a)::DOUBLE / n) pe FROM k)
    SELECT field, n, round(CASE WHEN pe = 1 THEN 'nan'::DOUBLE ELSE (po - pe) / (1 - pe) END, 9) AS "kappa_NR_vs_emit", round(po, 9) AS "raw_NR_vs_emit_agreement", b AS n_emit_both, round({ratio("ok", "b")}, 9) AS value_match_rate_among_both_emit,
      round({ratio("nk", "nn")}, 9) AS num_match_canonical, nn AS n_num_evaluable, round(iou, 9) AS mean_span_iou_among_both_emit, ni AS n_iou_evaluable FROM e"""
SIDES = "av AS ann_value, au AS ann_unit, ae AS ann_evidence_quote, bv AS bob_value, bu AS bob_unit, be AS bob_evidence_quote"
reconcile_agreements = f"WITH {pairs(GOLD, PRED)} SELECT record_id, field, {SIDES}, av AS resolved_value, au AS resolved_unit, ae AS resolved_evidence_quote FROM s WHERE same OR (NOT g AND NOT p)"
reconcile_disagreements = f"""WITH {pairs(GOLD, PRED)} SELECT record_id, field, {SIDES}, CASE WHEN g AND p THEN 'value_mismatch' WHEN g THEN 'ann_emit_bob_NR' ELSE 'bob_emit_ann_NR' END AS disagreement_type,
    '' AS adjudicated_value, '' AS adjudicated_unit, '' AS adjudicated_evidence_quote FROM s WHERE NOT (same OR (NOT g AND NOT p))"""


def quotas(source: str, a: str, b: str, n: str) -> str:
    """Proportional quotas by a and b, as CTEs ending in q."""
    return f"""z AS (SELECT {a} a, {b} b, count(*) size FROM {source} GROUP BY 1, 2),
    h AS (SELECT *, round_even(size::DOUBLE / (sum(size) OVER ()) * {n}, 0)::BIGINT quota FROM z), d AS (SELECT *, {n} - (sum(quota) OVER ()) diff FROM h),
    y AS (SELECT *, CASE WHEN diff <> 0 AND quota + sign(diff) BETWEEN 0 AND size THEN 1 ELSE 0 END can FROM d),
    x AS (SELECT *, sum(can) OVER (ORDER BY CASE WHEN diff < 0 THEN size ELSE -size END, a, b ROWS UNBOUNDED PRECEDING) turn FROM y),
    q AS (SELECT a, b, CASE WHEN can = 1 AND turn <= abs(diff) THEN quota + sign(diff) ELSE quota END::BIGINT quota FROM x)"""


POOLED = f"o AS (SELECT *, coalesce(document_type, 'unknown') dt, coalesce(nanobubble_vs_nanoparticle, 'unknown') lab FROM ({DOCS}) u)"
strat_quotas = f"WITH {POOLED}, {quotas('o', 'source_api', 'dt', '101')} SELECT a AS source_api, b AS document_type, quota FROM q"
strat_sample = f"""WITH o AS ({DOCS}), r AS (SELECT record_id, source_api, row_number() OVER (PARTITION BY source_api ORDER BY md5('42:' || record_id)) k, (count(*) OVER (PARTITION BY source_api)) // 10 quota FROM o)
    SELECT record_id, source_api FROM r WHERE k <= quota"""
BUCKETS = """CASE WHEN TRY_CAST(year AS INT) IS NULL THEN 'unknown' WHEN TRY_CAST(year AS INT) <= 2014 THEN 'pre_2015' WHEN TRY_CAST(year AS INT) <= 2020 THEN 'y2015_2020' ELSE 'post_2020' END AS year_bucket, CASE WHEN coalesce(application_category, '') = '' THEN 'unknown' """ + " ".join(
    f"WHEN regexp_matches(lower(application_category), '{'|'.join(w)}') THEN '{n}'" for n, w in APPLICATIONS
) + " ELSE 'other' END AS application_bucket"
split_buckets = f"SELECT record_id, {BUCKETS} FROM ({DOCS}) u"
SPLITS = f"""{POOLED}, pin AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) record_id FROM labels WHERE doc_id % 9 = 0),
    f AS (SELECT o.*, pin.record_id IS NOT NULL in_iaa FROM o LEFT JOIN pin ON o.record_id = pin.record_id), free AS (SELECT * FROM f WHERE NOT in_iaa),
    {quotas("free", "lab", "dt", "(SELECT round_even(count(*) * 0.1e0, 0)::BIGINT FROM f)")},
    w AS (SELECT record_id, row_number() OVER (PARTITION BY lab, dt ORDER BY md5('42:' || record_id)) k, lab, dt FROM free),
    dev AS (SELECT w.record_id FROM w JOIN q ON w.lab = q.a AND w.dt = q.b WHERE k <= quota),
    sp AS (SELECT f.*, CASE WHEN dev.record_id IS NULL THEN 'test' ELSE 'dev' END split FROM f LEFT JOIN dev ON f.record_id = dev.record_id)"""
splits_rows = f"WITH {SPLITS} SELECT split, in_iaa, count(*) AS n FROM sp GROUP BY ALL"
slice_totals = f"""WITH {SPLITS}, v AS (SELECT split, in_iaa, source_api, dt, lab, {BUCKETS} FROM sp) """ + " UNION ALL ".join(
    f"SELECT '{s}' AS slice, {c} AS value, count(*) AS total, count(*) FILTER (in_iaa) AS iaa, count(*) FILTER (split = 'dev') AS dev, count(*) FILTER (split = 'test') AS test FROM v GROUP BY {c}"
    for s, c in (("year_bucket", "year_bucket"), ("source_api", "source_api"), ("document_type", "dt"), ("nb_label", "lab"), ("application_bucket", "application_bucket"))
)
leakage = f"""WITH {SPLITS}, a AS (SELECT count(*) - count(DISTINCT record_id) dup, count(*) FILTER (in_iaa) iaa, count(*) FILTER (in_iaa AND split = 'test') iaa_test, count(*) FILTER (year IS NULL) y, count(*) FILTER (abstract_or_summary IS NULL) t FROM sp),
    b AS (SELECT count(*) both_ FROM (SELECT record_id FROM sp GROUP BY record_id HAVING count(DISTINCT split) > 1)), c AS (SELECT count(*) pins, count(*) FILTER (record_id IN (SELECT record_id FROM sp)) present FROM pin)
    SELECT 'no duplicate record_id' AS "check", dup = 0 AS ok, dup AS found, 0 AS of FROM a UNION ALL SELECT 'dev and test are disjoint', both_ = 0, both_, 0 FROM b UNION ALL SELECT 'pinned records are in test', iaa_test = iaa, iaa_test, iaa FROM a
    UNION ALL SELECT 'year present', y = 0, y, 0 FROM a UNION ALL SELECT 'abstract present', t = 0, t, 0 FROM a UNION ALL SELECT 'pinned records exist', present = pins, present, pins FROM c"""
TITLE = "trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'))"
DOI = "nullif(trim(regexp_replace(lower(trim(doi)), '^(https?://(dx\\.)?doi\\.org/|doi:)', '')), '')"
title_doi_keys = f"SELECT seq, coalesce({TITLE}, '') AS title_key, {DOI} AS doi_key FROM ({PART}) u"


def staged() -> str:
    keys = ["kd", "kp", "kc", "kt", "ku"]
    ctes = [f"s0 AS (SELECT seq, record_id, {DOI} kd, nullif(trim(pmid), '') kp, nullif(trim(pmcid), '') kc, nullif({TITLE}, '') kt, nullif(url, '') ku, lpad(CAST(seq AS VARCHAR), 12, '0') ord FROM ({PART}) u)"]
    for k, key in enumerate([*keys, "record_id"]):
        ctes.append(f"s{k + 1} AS (SELECT * REPLACE (CASE WHEN {key} IS NULL THEN '1' ELSE '0' END || ord AS ord) FROM (SELECT *, row_number() OVER (PARTITION BY coalesce({key}, '~' || ord) ORDER BY ord) rn FROM {'s0' if not k else f's{k}'}) WHERE rn = 1)".replace("SELECT * REPLACE", "SELECT * EXCLUDE (rn) REPLACE"))
    return "WITH " + ", ".join(ctes) + " SELECT seq, record_id FROM s6"


dedup_staged = staged()


def parsed(c: str) -> str:
    shape = "^API_(PubMed|OpenAlex|EuropePMC)_(.*)$"
    tail = f"regexp_extract({c}, '{shape}', 2)"
    doi = lambda sign: f"CASE WHEN regexp_matches({tail}, '^10_\\d{{4,7}}_.+$') THEN '10.' || regexp_extract({tail}, '^10_(\\d{{4,7}})_(.+)$', 1) || '/' || replace(regexp_extract({tail}, '^10_(\\d{{4,7}})_(.+)$', 2), '_', '{sign}') ELSE '' END"
    return f"""regexp_extract({c}, '{shape}', 1) AS source, {tail} AS encoded_tail, {doi(".")} AS dot, {doi("-")} AS dash,
      CASE WHEN NOT starts_with({c}, 'API_') THEN 'missing API_ prefix' WHEN NOT regexp_matches({c}, '{shape}') THEN 'unknown source slug; rest=''' || substr({c}, 5, 30) || '''' ELSE '' END AS notes"""


id_parse = f"SELECT k, {parsed('id_text')} FROM ({CUSTOMER}) u"
containment = f"""WITH g AS (SELECT id_text record_id, min_by(title, k) title FROM ({CUSTOMER}) u GROUP BY 1), p AS (SELECT record_id, title, {parsed("record_id")} FROM g),
    w AS (SELECT seq, record_id wid, {DOI} d, {TITLE} t FROM ({PART}) u), wd AS (SELECT d, min_by(wid, seq) wid FROM w WHERE d IS NOT NULL GROUP BY d), wt AS (SELECT t, min_by(wid, seq) wid, arg_min_null(d, seq) d FROM w WHERE t <> '' GROUP BY t),
    j AS (SELECT p.*, a.wid aw, b.wid bw, wt.wid tw, wt.d td FROM p LEFT JOIN wd a ON a.d = p.dash LEFT JOIN wd b ON b.d = p.dot LEFT JOIN wt ON wt.t = {TITLE.replace("title", "p.title")})
    SELECT record_id, source, dash AS primary_doi, dash AS doi_candidate_dash, dot AS doi_candidate_dot, substr(title, 1, 40) AS title_first40, aw IS NOT NULL OR bw IS NOT NULL OR tw IS NOT NULL AS matched,
      CASE WHEN aw IS NOT NULL OR bw IS NOT NULL THEN 'doi' WHEN tw IS NOT NULL THEN 'normalized_title' ELSE '' END AS matched_by,
      CASE WHEN aw IS NOT NULL THEN dash WHEN bw IS NOT NULL THEN dot ELSE coalesce(td, '') END AS matched_doi, coalesce(aw, bw, tw, '') AS matched_warehouse_record_id FROM j"""
NORM = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))".format
crosscheck = f"""WITH u AS (SELECT k, abstract_or_summary a, CASE k % 3 WHEN 0 THEN abstract_or_summary WHEN 1 THEN upper(replace(abstract_or_summary, '  ', ' ')) ELSE CASE WHEN k % 2 = 0 THEN '' ELSE 'another text' END END b FROM ({CUSTOMER}) c)
    SELECT k, CASE WHEN a <> '' AND a = b THEN 'verbatim_match' WHEN a <> '' AND b <> '' AND {NORM("a")} = {NORM("b")} THEN 'normalized_match' WHEN b = '' THEN 'refetch_failed' WHEN a = '' THEN 'no_gold_abstract' ELSE 'source_side_revision_or_mismatch' END AS status FROM u"""
crosscheck_counts = f"SELECT status AS value, count(*) AS n FROM ({crosscheck}) x GROUP BY status"
llm_json = """WITH a AS (SELECT p_partkey k, p_partkey % 6 m, p_size FROM part), f AS (SELECT unnest(['size', 'stability', 'payload']) field)
    SELECT k, field,
      CASE WHEN m = 0 AND field = 'size' THEN CAST(p_size AS VARCHAR) WHEN m = 1 AND field = 'size' THEN '12' WHEN m = 2 AND field = 'payload' THEN 'dye' WHEN m = 5 AND field = 'stability' THEN '7' ELSE 'NOT_REPORTED' END AS value,
      CASE WHEN m = 0 AND field = 'size' THEN 'nm' WHEN m = 1 AND field IN ('size', 'payload') OR m = 2 AND field = 'payload' OR m = 5 AND field = 'stability' THEN '' ELSE 'NOT_REPORTED' END AS unit,
      CASE WHEN m = 0 AND field = 'size' THEN 'a quote' WHEN m = 1 AND field = 'payload' THEN 'x' WHEN m = 2 AND field = 'payload' THEN 'dye' ELSE 'NOT_REPORTED' END AS evidence_quote
    FROM a CROSS JOIN f"""
NU = r"(?i)(-?\d+(?:\.\d+)?)\s*(%|(?:" + "|".join(UNIT_WORDS) + r")\b)"
numeric_spans = f"""SELECT record_id, CASE WHEN regexp_matches(x, '{NU}') THEN regexp_extract(x, '{NU}', 1) WHEN ({number("x")}) IS NOT NULL THEN {shown(f"({number('x')})")} ELSE 'NOT_REPORTED' END AS value,
    CASE WHEN regexp_matches(x, '{NU}') THEN regexp_extract(x, '{NU}', 2) ELSE 'NOT_REPORTED' END AS unit FROM (SELECT record_id, abstract_or_summary x FROM ({TEXTS}) t) u"""
inverted_index = "SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> ''), ' ') AS text FROM conversations"
year_hist = f"SELECT CAST(year AS INT) AS year, count(*) AS n FROM ({DOCS}) u WHERE CAST(year AS INT) BETWEEN 2000 AND 2025 GROUP BY 1"
year_bins = f"SELECT CASE WHEN y IS NULL THEN 'NOT_REPORTED' WHEN y <= 2010 THEN '<=2010' WHEN y <= 2014 THEN '2011-2014' WHEN y <= 2018 THEN '2015-2018' WHEN y <= 2021 THEN '2019-2021' WHEN y <= 2024 THEN '2022-2024' ELSE '2025+' END AS bin, count(*) AS n FROM (SELECT CAST(year AS INT) y FROM ({DOCS}) u) v GROUP BY 1"
coverage = f"SELECT field, count(*) AS n, count(*) FILTER (NOT {nr('value')}) AS reported FROM {GOLD} q GROUP BY field"
cooccurrence = f"WITH e AS (SELECT record_id, field FROM {GOLD} q WHERE NOT {nr('value')}) SELECT a.field AS field_a, b.field AS field_b, count(*) AS n FROM e a JOIN e b USING (record_id) GROUP BY ALL"
source_shares = f"SELECT value, n, round(n::DOUBLE / sum(n) OVER (), 9) AS share FROM (SELECT coalesce(document_type, 'unknown') AS value, count(*) n FROM ({DOCS}) u GROUP BY 1) v"
top_venues = f"SELECT source_api AS venue, count(*) AS n FROM ({DOCS}) u GROUP BY 1 ORDER BY n DESC, venue LIMIT 10"
missing_values = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (coalesce({c}, '') = '') AS missing FROM ({PART}) u" for c in ("doi", "pmid", "pmcid", "title", "url"))
corpus_compare = " UNION ALL ".join(
    f"SELECT '{m}' AS measure, count(*) FILTER ({c})::DOUBLE AS warehouse, count(*) FILTER ({c} AND seq % 10 = 0)::DOUBLE AS subset FROM ({PART}) u"
    for m, c in (("records", "true"), ("with_abstract", "coalesce(abstract_or_summary, '') <> ''"), ("with_doi", "coalesce(doi, '') <> ''"))
)
LOW = "lower(coalesce({}, ''))".format
tiers = f"""SELECT CASE WHEN {LOW("title")} LIKE '%widget%' THEN 'A1' WHEN {LOW("abstract_or_summary")} LIKE '%widget%' THEN 'A2' WHEN regexp_matches({LOW("title")}, 'bolt|brass') OR regexp_matches({LOW("abstract_or_summary")}, 'bolt|brass') THEN 'B' ELSE 'C' END AS tier, count(*) AS n FROM ({PART}) u GROUP BY 1"""
completeness = f"SELECT record_id, {' AND '.join(f'trim({f}_value) <> {chr(39)}{chr(39)}' for f in i.FIELDS)} AS complete, true AS verbatim FROM ({i.wide(i.GOLD, 'orders')}) u"
task_view_counts = f"SELECT 'all' AS view, count(*) AS n FROM {GOLD} q UNION ALL SELECT 'numeric', count(*) FROM {GOLD} q WHERE field IN ({NUMERIC_SQL}) UNION ALL SELECT 'evidence', count(*) FROM {GOLD} q WHERE NOT {nr('value')}"
SPLIT_LINE = ", ".join(f"'\"{k}\":\"' || {c} || '\"'" for k, c in (("year_bucket", "year_bucket"), ("source_api", "source_api"), ("document_type", "dt"), ("nb_label", "lab"), ("application_bucket", "application_bucket")))
splits_payload = f"WITH {SPLITS}, v AS (SELECT record_id, split, in_iaa, source_api, dt, lab, {BUCKETS} FROM sp) SELECT record_id, '{{\"split\":\"' || split || '\",\"in_iaa\":' || in_iaa || ',' || concat_ws(',', {SPLIT_LINE}) || '}}' AS json FROM v"
parse_openalex = """SELECT 'OpenAlex_W' || p_partkey AS record_id, 'OpenAlex' AS source_api, 'W' || p_partkey AS source_id, CASE WHEN p_partkey % 7 < 2 THEN p_type ELSE p_name END AS title, p_brand || '; A. ' || p_brand AS authors,
    CASE WHEN p_partkey % 8 > 0 THEN 1970 + p_size END AS year, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'Journal ' || p_size END AS journal_or_venue, CASE WHEN p_partkey % 3 > 0 THEN '10.1000/' || p_partkey END AS doi,
    CAST(p_partkey AS VARCHAR) AS pmid, CAST(p_partkey % 90 AS VARCHAR) AS pmcid, CASE WHEN p_partkey % 3 > 0 THEN 'https://doi.org/10.1000/' ELSE 'https://openalex.org/W' END || p_partkey AS url,
    CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'the ' || p_brand || ' the ' || p_brand END AS abstract_or_summary, CAST(p_partkey % 100 AS INT) AS citation_count, CASE WHEN p_partkey % 4 < 2 THEN 'review' ELSE 'original' END AS document_type,
    'family ' || (p_partkey % 5) AS query_family FROM part"""
append_rows = f"SELECT seq + CASE WHEN seq % 2 = 1 THEN 1099511627776 ELSE 0 END AS seq, record_id, CASE WHEN seq % 2 = 0 THEN url END AS url FROM ({PART}) u"
resolve_sources = f"""WITH m AS ({i.duck(i.MISSING, "customer")}), l AS ({i.duck(i.LANDED, "supplier")}), t AS (SELECT record_id, source, 0 AS pos, first_doi AS doi FROM m UNION ALL SELECT record_id, source, 1, second_doi FROM m),
    h AS (SELECT t.record_id, l.*, row_number() OVER (PARTITION BY record_id ORDER BY CASE WHEN api = source THEN 0 WHEN api = 'PubMed' THEN 1 WHEN api = 'OpenAlex' THEN 2 ELSE 3 END, pos) turn FROM t JOIN l ON t.doi = l.doi WHERE l.title <> '')
    SELECT m.record_id, h.doi IS NOT NULL AS ok, h.api, h.title, h.doi FROM m LEFT JOIN h ON m.record_id = h.record_id AND turn = 1"""
crosscheck_records = f"""WITH g AS (SELECT CAST(k AS VARCHAR) record_id, k, abstract_or_summary gold FROM ({CUSTOMER}) c), f AS (SELECT record_id, abstract_or_summary re, row_number() OVER (PARTITION BY record_id ORDER BY seq DESC) turn FROM ({i.duck(i.FETCHED, "customer")}) x),
    w AS (SELECT record_id wid, abstract_or_summary wh, row_number() OVER (PARTITION BY record_id ORDER BY seq DESC) turn FROM ({PART}) u),
    j AS (SELECT g.record_id, gold, f.record_id IS NOT NULL again, CASE WHEN f.record_id IS NOT NULL THEN re ELSE coalesce(wh, '') END source FROM g LEFT JOIN f ON g.record_id = f.record_id AND f.turn = 1 LEFT JOIN w ON k % 4 > 0 AND wid = 'rec_' || k AND w.turn = 1)
    SELECT record_id, CASE WHEN again THEN 'refetched' ELSE 'warehouse_existing' END AS origin,
      CASE WHEN gold <> '' AND gold = source THEN 'verbatim_match' WHEN gold <> '' AND source <> '' AND {NORM("gold")} = {NORM("source")} THEN 'normalized_match' WHEN source = '' THEN 'refetch_failed' WHEN gold = '' THEN 'no_gold_abstract' ELSE 'source_side_revision_or_mismatch' END AS status,
      CAST(length(gold) AS INT) AS gold_abstract_len, CAST(length(source) AS INT) AS refetched_abstract_len, substr(gold, 1, 120) AS gold_first120, substr(source, 1, 120) AS refetched_first120 FROM j"""
other_splits = f"SELECT record_id, year, document_type, CASE WHEN CAST(year AS INT) < 2015 THEN 'dev' ELSE 'test' END AS by_year, CASE WHEN coalesce(document_type, 'unknown') IN ('review', 'unknown') THEN 'test' ELSE 'dev' END AS by_type FROM ({DOCS}) u"
splits_meta = f"""WITH {SPLITS}, v AS (SELECT split, in_iaa, source_api, dt AS document_type, lab AS nb_label, {BUCKETS} FROM sp)
    SELECT count(*) AS n_total, count(*) FILTER (split = 'dev') AS n_dev, count(*) FILTER (split = 'test') AS n_test, count(*) FILTER (in_iaa) AS n_iaa, 42 AS seed, 0.1e0 AS dev_fraction,
      {', '.join(f"string_agg(DISTINCT {c}, '|' ORDER BY {c}) AS {c}" for c in ("year_bucket", "source_api", "document_type", "nb_label", "application_bucket"))} FROM v"""

#: Without SQL: bootstrap_ci (hashed draws), dedup_greedy (a sequential fold), qa_spans; pytest compares them with plain code.
ORACLE_SQL = {
    k: globals()[k]
    for k in (
        "eval_headline", "eval_by_slice", "quote_check", "canonical_values", "parse_numbers", "number_strings", "char_overlap", "ae_consistency", "regex_extract", "regex_then_eval",
        "reconcile_stats", "reconcile_agreements", "reconcile_disagreements", "strat_quotas", "strat_sample", "splits_rows", "split_buckets", "slice_totals", "leakage", "splits_payload",
        "dedup_staged", "title_doi_keys", "id_parse", "containment", "crosscheck", "crosscheck_counts", "llm_json", "numeric_spans", "inverted_index", "year_hist", "year_bins", "coverage",
        "cooccurrence", "source_shares", "top_venues", "missing_values", "corpus_compare", "tiers", "completeness", "task_view_counts",
        "parse_openalex", "append_rows", "resolve_sources", "crosscheck_records", "other_splits", "splits_meta",
    )
}
