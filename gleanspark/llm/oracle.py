"""The queries that SQL can express, for DuckDB.  The others use hashes, models or edit distances that it lacks; tests/llm has plain
versions of them."""

from __future__ import annotations

from .mixing import GOLDEN, LEAST, MOST_SLOTS, SLOTS
from .url_filter import RULES, SECOND_LEVEL

WS = r"[\x20\x09-\x0D]+"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str, separators: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{separators}'), lambda x: x <> '')"


op4_substring_dedup = f"""
WITH d AS (SELECT doc_id, {words("coalesce(text, '')", WS)} w FROM documents),
     p AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) i FROM d),
     k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') k FROM p),
     f AS (SELECT k, min(doc_id) m FROM k GROUP BY k),
     g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) pos FROM k JOIN f USING (k) WHERE doc_id > m),
     x AS (SELECT doc_id, unnest(w) word, generate_subscripts(w, 1) pos FROM d),
     s AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.pos) kept FROM x ANTI JOIN g ON x.doc_id = g.doc_id AND x.pos = g.pos GROUP BY x.doc_id),
     n AS (SELECT doc_id, count(*) n FROM g GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n.n, 0) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN s ON d.doc_id = s.doc_id"""

op5_decontaminate = f"""
WITH b AS (SELECT item_id, {words(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')", SEPARATORS)} w FROM benchmark),
     i AS (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 7, 1))) at_ FROM b WHERE len(w) > 0),
     win AS (SELECT DISTINCT item_id, array_to_string(w[at_:at_ + 7], ' ') k, len(w[at_:at_ + 7]) n FROM i),
     sizes AS (SELECT DISTINCT n FROM win),
     d AS (SELECT doc_id, {words(f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')", SEPARATORS)} w FROM documents),
     p AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) at_ FROM d, sizes),
     h AS (SELECT p.doc_id, p.at_, p.n, win.item_id FROM p JOIN win ON win.n = p.n AND win.k = array_to_string(p.w[at_:at_ + p.n - 1], ' ')),
     hit AS (SELECT doc_id, count(DISTINCT pos) n_hit FROM (SELECT doc_id, unnest(generate_series(at_, at_ + n - 1)) pos FROM h) GROUP BY doc_id),
     it AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id"""


def case(column: int) -> str:
    """The longest fitting rule (1) or its verdict (0)."""
    out = []
    for r in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        own, _, prefix = r[1].partition("/")
        out.append(f"WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{prefix}') THEN '{r[column]}'")
    return f"CASE {' '.join(out)} END"


TWO = ", ".join(f"'{s}'" for s in SECOND_LEVEL)
TAIL = "array_to_string(string_split(host, '.')[-{}:], '.')".format


def pull(name: str, table: str) -> str:
    noise = "m * (1 - m)"
    r = f"CASE WHEN sum({noise} * (n - 1)) <> 0 THEN (sum(n * (k::DOUBLE / n - m) * (k::DOUBLE / n - m)) - sum({noise})) / sum({noise} * (n - 1)) ELSE 0.5 END"
    return f"{name} AS (SELECT 1 / least(greatest({r}, 0.001e0), 0.999e0) - 1 AS w FROM {table})"


op8_url_filter = f"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path FROM pages),
     r AS (SELECT page_id, host, path, {case(1)} AS rule, {case(0)} AS says, CASE WHEN {TAIL(2)} IN ({TWO}) THEN {TAIL(3)} ELSE {TAIL(2)} END dom, CASE WHEN {TAIL(2)} IN ({TWO}) THEN {TAIL(2)} ELSE {TAIL(1)} END suf FROM u),
     h AS (SELECT host, dom, suf, count(*) n, count(*) FILTER (says = 'allow') k FROM r WHERE rule IS NOT NULL GROUP BY ALL),
     root AS (SELECT (coalesce(sum(k), 0) + 1.0e0) / (coalesce(sum(n), 0) + 2) m FROM h),
     s0 AS (SELECT suf, sum(n) n, sum(k) k, any_value(root.m) m FROM h, root GROUP BY suf), {pull("w1", "s0")},
     s1 AS (SELECT suf, (k + w * m) / (n + w) m FROM s0, w1),
     d0 AS (SELECT dom, h.suf, sum(n) n, sum(k) k, any_value(s1.m) m FROM h JOIN s1 ON h.suf = s1.suf GROUP BY ALL), {pull("w2", "d0")},
     d1 AS (SELECT dom, (k + w * m) / (n + w) m FROM d0, w2),
     h0 AS (SELECT host, n, k, d1.m FROM h JOIN d1 ON h.dom = d1.dom), {pull("w3", "h0")},
     h1 AS (SELECT host, (k + w * m) / (n + w) mean, n + w total FROM h0, w3),
     o AS (SELECT r.page_id, r.host, r.path, r.rule, r.says, h1.mean, h1.total, coalesce(d1.m, s1.m, root.m) prior, w3.w
           FROM r LEFT JOIN h1 ON r.host = h1.host LEFT JOIN d1 ON r.dom = d1.dom LEFT JOIN s1 ON r.suf = s1.suf, root, w3)
SELECT page_id, host, path, rule,
       coalesce(says, CASE WHEN coalesce(mean + 1.645e0 * sqrt(mean * (1 - mean) / (total + 1)), prior + 1.645e0 * sqrt(prior * (1 - prior) / (w + 1))) < 0.5e0 THEN 'block' ELSE 'allow' END) AS verdict
FROM o"""

op7_mixing = f"""
WITH d AS (SELECT doc_id, source, len({words("coalesce(text, '')", WS)}) size, md5(concat_ws(':', CAST(doc_id AS VARCHAR), coalesce(text, ''))) hash FROM documents),
     s0 AS (SELECT source, CAST(sum(size) AS BIGINT) source_size FROM d GROUP BY source),
     s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 source_no FROM s0),
     s2 AS (SELECT *, ([3e0, 1e0, 2e0])[source_no % 3 + 1] weight, source_size * 2e0 cap FROM s1),
     s3 AS (SELECT *, coalesce(sum(cap) OVER o, 0) cap_before, coalesce(sum(weight) OVER o, 0) weight_before, sum(source_size) OVER () * 1.5e0 whole, sum(weight) OVER () weights
            FROM s2 WINDOW o AS (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     s4 AS (SELECT *, max((whole - cap_before) / (weights - weight_before)) OVER () level FROM s3),
     s AS (SELECT source, source_no, source_size, least(cap, weight * level) target FROM s4),
     total AS (SELECT sum(target) t, min(target) FILTER (target > 0) smallest FROM s),
     slot AS (SELECT t, greatest(1, CAST(least(floor(t / {SLOTS}), floor(smallest / {LEAST})) AS BIGINT), CAST(ceil(t / {MOST_SLOTS}) AS BIGINT)) words FROM total),
     cut AS (SELECT source_no, sum(target) OVER (ORDER BY source_no) / t high, lead(source_no) OVER (ORDER BY source_no) IS NULL AS last FROM s, slot WHERE target > 0),
     ivl AS (SELECT source_no, coalesce(lag(high) OVER (ORDER BY source_no), 0) low, CASE WHEN last THEN 1e0 ELSE high END high FROM cut),
     dealt AS (SELECT i slot, source_no, row_number() OVER (PARTITION BY source_no ORDER BY i) - 1 AS rank
               FROM (SELECT unnest(generate_series(0, CAST(ceil(t / words) AS BIGINT) - 1)) i FROM slot) JOIN ivl ON low <= (i * {GOLDEN!r}e0) % 1e0 AND (i * {GOLDEN!r}e0) % 1e0 < high),
     p AS (SELECT doc_id, d.source, s.source_no, size, source_size, target, hash,
                  coalesce(sum(size) OVER (PARTITION BY s.source_no ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) begins FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
     lap AS (SELECT doc_id, hash, source_no, begins + turn * source_size a, least(begins + turn * source_size + size, floor(target)) z FROM p, (VALUES (0), (1)) v(turn) WHERE size > 0),
     pc AS (SELECT doc_id, hash, source_no, CAST(a AS BIGINT) a, CAST(z AS BIGINT) z, words, unnest(generate_series(CAST(floor(a / words) AS BIGINT), CAST(floor((z - 1) / words) AS BIGINT))) AS rank FROM lap, slot WHERE a < z),
     got AS (SELECT hash, pc.source_no, sum(least(z, (pc.rank + 1) * words) - greatest(a, pc.rank * words)) taken, min(slot) first_slot, count(*) n_slots
             FROM pc JOIN dealt ON pc.source_no = dealt.source_no AND pc.rank = dealt.rank GROUP BY hash, pc.source_no)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, coalesce(first_slot, -1) AS first_slot, coalesce(n_slots, 0) AS n_slots
FROM p LEFT JOIN got ON p.hash = got.hash AND p.source_no = got.source_no"""

ORACLE_SQL = {"op7_mixing": op7_mixing, "op4_substring_dedup": op4_substring_dedup, "op5_decontaminate": op5_decontaminate, "op8_url_filter": op8_url_filter}
