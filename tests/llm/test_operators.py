"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from gleanspark.llm import _shards, decontaminate, fingerprint, language_id, license_scan, lm_bloom, mixing, near_copies, simhash, substring_dedup, toxicity, url_filter
from gleanspark.operators.components import components

WS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, score double, kept string, fp long, chunk int"
EMPTY = "doc_id long, text string, lang string, source string"


def corpus(seed=1, n=60, words=40, vocabulary=60):
    """Random texts with shared passages, copies, nulls, empties, a long text and a repeated row."""
    rng = random.Random(seed)
    v = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randrange(1, 7))) for _ in range(vocabulary)]
    passage = " ".join(rng.choice(v) for _ in range(30))
    rows = []
    for i in range(n):
        t = " ".join(rng.choice(v) for _ in range(rng.randrange(words)))
        t = f"{t} {passage}\n{t}" if i % 4 == 0 else t
        rows.append((i * 3, t.title() if i % 5 == 0 else t))
    rows += [(1, None), (2, ""), (4, " \t\n"), (5, "\x00,;"), (7, " ".join(rng.choice(v) for _ in range(30_000))), (None, passage), (8, rows[9][1]), (10, rows[9][1]), rows[3], (rows[3][0], "other text of that id")]
    return [(d, t, "en" if i % 2 else "fr", f"s{i % 3}" if i % 7 else None, 0.5, "k", 1, 2) for i, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], EMPTY)


def rows_of(df, *columns):
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def test_substring_dedup(docs, nothing):
    rows = [(math.inf if r[0] is None else r[0], r[1], r[0]) for r in corpus()]
    first = {}
    for d, t, _ in rows:
        w = WS.findall(t or "")
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, d), d)
    want = collections.Counter()
    for d, t, own in rows:
        w = WS.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        want[own, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)] += 1
    out = substring_dedup.dedup(docs)
    assert rows_of(out, "doc_id", "n_words", "n_removed", "kept") == want
    spans = out.select("n_removed", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1).alias("s")).collect()
    assert all(r["n_removed"] == r["s"] for r in spans) and any(r["s"] for r in spans)
    assert substring_dedup.dedup(nothing).count() == 0
    assert rows_of(substring_dedup.dedup(docs, verbatim=True).where("n_removed = 0 and doc_id = 4"), "kept") == {(" \t\n",): 1}


def test_decontaminate(spark, docs, nothing):
    texts = [r[1] for r in corpus() if r[1]]
    items = [(1, " ".join(WS.findall(texts[0])[-12:])), (2, "zz yy xx ww"), (3, ""), (4, None), (5, " ".join(WS.findall(texts[4])[2:7])), (6, "a"), (6, "a"), (7, " ".join(WS.findall(texts[0])[-30:]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wins = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        for k in range(max(1, len(w) - 7) if w else 0):
            wins[tuple(w[k : k + 8])].add(str(i))
    want = collections.Counter()
    for r in corpus():
        w = ALNUM.findall((r[1] or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if (q := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[q]
        want[r[0], len(w), len(hit), len(found), ",".join(sorted(found))] += 1
    out = decontaminate.judge(docs, bench).withColumn("items", F.array_join("items", ","))
    assert rows_of(out, "doc_id", "n_words", "n_hit", "n_items", "items") == want and any(k[3] >= 2 for k in want)
    assert decontaminate.judge(nothing, bench).count() == 0
    assert decontaminate.judge(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "rare x x other rare"), (2, "other y y y y rare")], "doc_id long, text string")
    terms = spark.createDataFrame([("rare", 1), ("other", 2)], "word string, word_id long")
    pairs = spark.createDataFrame([(9, 1, 2)], "pair_id long, id0 long, id1 long")
    decontaminate.shared_checkpoints(spark)
    near = decontaminate.Index(docs, terms, 2).near(pairs, 1, 3)
    assert rows_of(near, "doc_id", "pos0", "pos1") == {(1, 0, 3): 1, (1, 4, 3): 1}


def canonical(t):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())).strip()


def test_fingerprint(spark, nothing):
    rows = [(i, t) for i, t in enumerate(["Straße ﬁ", "STRASSE fi", None, "", "abcd", "abcd", "Ünï cödé", "x" * 5000, "a\tb", "A  b "])] + [(None, "abcd"), (50, "abcdefgh"), (50, "abcdefgh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for digest in (fingerprint.digest, lambda c: F.substring(fingerprint.digest(c), 1, 1)):  # the second makes buckets collide
        out = [r.asDict() for r in fingerprint.fingerprints(docs, digest).collect()]
        by = collections.defaultdict(set)
        order = sorted(((math.inf if d is None else d, t or "") for d, t in rows))
        for r in out:
            same = [k for k, (d, _) in enumerate(order) if d == (math.inf if r["doc_id"] is None else r["doc_id"])]
            tries = []
            for k in same:
                t, n = order[k][1], order[(k + 1) % len(order)][1]
                q = len(t) // 4
                e = t[: len(t) - q] + n[:q]
                tries.append((len(t), hashlib.sha256(e.encode()).hexdigest(), float(canonical(t) == canonical(e)), float(canonical(t) == canonical(n)), canonical(t), canonical(e)))
            hit = [x for x in tries if x[:4] == (r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"])]
            assert hit
            by[hit[0][4]].add(r["fingerprint"])
            by[hit[0][5]].add(r["edited_fingerprint"])
        assert len(out) == len(rows) and all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)
    assert fingerprint.fingerprints(nothing).count() == 0
    assert fingerprint.fingerprints(docs.limit(1)).count() == 1


def test_fingerprint_blocks_are_even(spark, monkeypatch):
    """Ids in clusters, an outlier, many rows without an id: no block is far above its size, ids of a block are neighbours, nulls come last."""
    ids = [*range(4000), *range(10**6, 10**6 + 4000), *range(0, 10**12, 10**9), (1 << 63) - 2, -(1 << 62)] + [None] * 2000 + [77] * 40
    docs = spark.createDataFrame([(i, f"{k:06d}", "clash") for k, i in enumerate(ids)], "doc_id long, text string, block string").repartition(3)
    for block, fanout in ((64, 64), (32, 8)):
        monkeypatch.setattr(fingerprint, "BLOCK", block)
        monkeypatch.setattr(fingerprint, "FANOUT", fanout)
        placed = fingerprint.in_blocks(docs.select(F.col("doc_id").alias("order"), F.xxhash64("text").alias("text_key")))
        per = placed.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("order").alias("lo"), F.max("order").alias("hi"), F.count("order").alias("known")).orderBy("block").collect()
        assert sum(r["n"] for r in per) == len(ids) and max(r["n"] for r in per) <= 3 * block + 40
        own = [r for r in per if r["known"]]
        assert all(r["known"] == r["n"] for r in own) and all(a["hi"] < b["lo"] for a, b in zip(own, own[1:]))
        assert max(r["block"] for r in own) < min(r["block"] for r in per if not r["known"])
    # the next document is the same whatever the blocks are
    plain = sorted(((math.inf if i is None else i), f"{k:06d}") for k, i in enumerate(ids))
    known = {t: plain[(k + 1) % len(plain)][1] for k, (i, t) in enumerate(plain) if i not in (math.inf, 77, 76)}
    got = {r["text"]: r["t"] for r in fingerprint.with_next(docs).select("text", F.col("next.text").alias("t")).collect()}
    ends = {t for t, n in known.items() if n == next(x for i, x in plain if i == math.inf)}
    assert len(got) == len(ids) and all(got[t] == n for t, n in known.items() if t not in ends)
    assert fingerprint.fingerprints(docs.limit(300)).count() == 300


def plain_fingerprint(t, size=3):
    w = WS.findall((t or "").translate(LOW))
    s = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else ([" ".join(w)] if w else [])
    if not s:
        return 0
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_fingerprints(docs, nothing):
    got = rows_of(simhash.fingerprints(docs).where("doc_id <> 7 or doc_id is null"), "doc_id", "fp")
    assert got == collections.Counter((r[0], np.uint64(plain_fingerprint(r[1])).astype(np.int64).item()) for r in corpus() if r[0] != 7)
    groups = simhash.groups(docs).where("doc_id in (1, 2, 4)")
    assert rows_of(groups, "component_id") == {(1,): 3}
    assert simhash.groups(nothing).count() == 0 and near_copies.leaving(nothing).count() == 0


def test_simhash_links_against_all_pairs(spark):
    rng = random.Random(2)
    fps = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):  # chains of small steps
            fps.add(x)
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
    fps |= {0, (1 << 64) - 1, 1 << 63, 1}
    ids = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in ids], "fp long").repartition(5)
    edges = simhash.links(df).collect()
    assert edges and all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 2 for r in edges)
    root = {x: x for x in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    want = collections.defaultdict(set)
    for x in ids:
        want[find(x)].add(signed(x))
    got = collections.defaultdict(set)
    for r in components(simhash.links(df)).collect():
        got[r["root"]].add(r["node"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def kept_ids(docs):
    gone = near_copies.leaving(docs)
    left = docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_key"]), "left_anti")
    return sorted(r["doc_id"] for r in left.collect())


def test_keepers(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(4000)}" for _ in range(300)] for _ in range(12)]
    rows = []
    for k, words in enumerate(base):
        rows.append((10 * k, " ".join(words)))
        for j in range(1, 4):  # two words changed: similarity about 0.93
            near = list(words)
            for _ in range(2):
                near[rng.randrange(300)] = f"z{rng.randrange(10**6)}"
            rows.append((10 * k + j, " ".join(near)))
    rows += [rows[0], (999, rows[0][1])]
    assert kept_ids(spark.createDataFrame(rows, "doc_id long, text string")) == sorted([0, *(10 * k for k in range(12))])  # equal rows aren't told apart


def test_near_copies_of_nothing_and_short_texts(spark):
    rows = [(3, None), (1, ""), (2, " \n"), (None, ""), (5, "a b"), (6, "A  b"), (7, "b a"), (None, "b a"), (None, "only here"), (9, "x" * 100_000)]
    docs = spark.createDataFrame([(d, t, "node", 1) for d, t in rows], "doc_id long, text string, node string, size int")
    gone = near_copies.leaving(docs)
    left = docs.join(gone, docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.xxhash64(docs["text"]) == gone["gone_key"]), "left_anti")
    assert rows_of(left, "doc_id", "text") == collections.Counter([(1, ""), (5, "a b"), (7, "b a"), (None, "only here"), (9, "x" * 100_000)])


def test_segment_parities_bound_the_difference():
    rng = np.random.default_rng(5)
    for n, m, both in ((300, 300, 250), (40, 500, 30), (1, 0, 0), (2000, 1100, 1000)):
        shared, x, y = (rng.integers(0, 2**63, k).astype(np.uint64) for k in (both, n - both, m - both))
        a, b = (np.frombuffer(near_copies.parities(np.unique(np.concatenate([shared, z]))), np.uint8) for z in (x, y))
        far = near_copies.apart(a, b)
        assert far == near_copies.apart(b, a) and far <= n + m - 2 * both and far % 2 == (n + m) % 2
        assert far >= 0.4 * min(n + m - 2 * both, 8 * min(len(a), len(b)))


def test_neighbours_span_batches(spark):
    rows = [(k, 0, (100 << 32), n) for k in range(40) for n in range(k % 5)] + [(99, s, (100 << 32), 1000 + s) for s in (1, 2)]
    df = spark.createDataFrame(rows + rows[:30], "key long, salt long, meta long, node long")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for n in ("1", "3", "1000"):
        spark.conf.set(key, n)
        got = rows_of(near_copies.neighbours(df, 0.8), "key", "node", "next_node")
        want = [(k, n, n + 1 if n + 1 < k % 5 else None) for k in range(40) for n in range(k % 5) if k % 5 > 1]
        assert got == collections.Counter(want + [(99, 1001, None), (99, 1002, None)])
    spark.conf.set(key, before)


def test_strangers_span_batches(spark):
    rng = random.Random(6)
    rows = [(k, s, 0, d, 100 << 32, 1000 * k + 100 * s + d, rng.randrange(3)) for k in range(12) for s in range(1 + k % 2) for d in range(k * 2)]
    want = set()
    for (*_, d, _, n, r), x in zip(rows, rows):
        before = [y for y in rows if y[:2] == x[:2] and y[3] < d]
        while before and before[-1][6] == r:
            before.pop()
        want |= {(y[5], n, min(y[6], r), max(y[6], r)) for y in before[-near_copies.MEET :] if y[6] != r}
    df = spark.createDataFrame(rows, "key long, salt long, band long, dice long, meta long, node long, root long").repartition(3)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for n in ("1", "3", "1000"):
        spark.conf.set(key, n)
        got = rows_of(near_copies.strangers(df, 0.8), "a", "b", "low", "high")
        assert set(got) == want and max(got.values()) == 1
    spark.conf.set(key, before)


def test_families_link_without_their_pairs(spark, monkeypatch):
    """Texts with two words changed are near copies of those with one, rarely of one another: groups are those of all pairs, and far
    fewer pairs are compared."""
    rng = random.Random(7)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(600):
        words = list(base)
        for at in rng.sample(range(150), 1 if i % 4 == 0 else 2):
            words[at] = f"z{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = [frozenset(hash(tuple(w[k : k + 5])) for k in range(146)) for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    asked, verified = [], near_copies.Sets.verified

    def counted(self, pairs):
        pairs = pairs.checkpoint()
        asked.append(pairs.count())
        return verified(self, pairs)

    monkeypatch.setattr(near_copies.Sets, "verified", counted)
    assert kept_ids(spark.createDataFrame(rows, "doc_id long, text string")) == sorted({find(i) for i in range(len(rows))})
    assert sum(asked) < 30 * len(rows)


def test_chunks_are_even(spark, monkeypatch):
    """Ids in clusters, an outlier, many rows without an id: no chunk is far above its size, and all rows of an id share one."""
    ids = [*range(3000), *range(10**6, 10**6 + 3000), *range(0, 10**12, 10**9), (1 << 63) - 2] + [None] * 2000 + [77] * 40
    docs = spark.createDataFrame([(i, f"{k:020d}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(3)
    monkeypatch.setattr(_shards, "SHARD_BYTES", 20 * 100)
    for quantiles in (16, 1024):
        monkeypatch.setattr(_shards, "QUANTILES", quantiles)
        dealt, _, size, null_from = _shards.by_id(docs)
        per = [(r["chunk"], r["n"]) for r in dealt.groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).collect()]
        assert size == 20 * len(ids) and sum(n for _, n in per) == len(ids) and max(n for _, n in per) <= 250 and len(per) > 60
        assert dealt.where("doc_id is null").agg(F.min("chunk")).first()[0] >= null_from > dealt.where("doc_id is not null").agg(F.max("chunk")).first()[0]
        assert dealt.groupBy("doc_id").agg(F.countDistinct("chunk").alias("n")).where("n > 1 and doc_id is not null").count() == 0
        by = sorted((r["lo"], r["hi"], r["chunk"]) for r in dealt.where("doc_id is not null").groupBy("chunk").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect())
        assert all(a[1] < b[0] and a[2] < b[2] for a, b in zip(by, by[1:]))


def test_substring_dedup_over_many_chunks(spark, docs, monkeypatch):
    rows = [(*r[:2], k) for k, r in enumerate(corpus(seed=8, n=80))] + [(None, corpus()[0][1] + " tail" * k, 900 + k) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk long").repartition(3)
    once = rows_of(substring_dedup.dedup(df), "doc_id", "n_words", "n_removed", "kept")
    monkeypatch.setattr(_shards, "SHARD_BYTES", 700)
    monkeypatch.setattr(_shards, "QUANTILES", 8)
    assert rows_of(substring_dedup.dedup(df), "doc_id", "n_words", "n_removed", "kept") == once

def test_lm(docs, nothing):
    train = docs.where("doc_id % 2 = 0")
    model, rest = lm_bloom.learn(train, filter_bytes=1 << 16, head_words=20)
    out = lm_bloom.score(docs, model, rest)
    token = lambda t: [*WS.findall((t or "").translate(LOW)), None]
    c = collections.Counter(x for r in corpus() if r[0] is not None and r[0] % 2 == 0 for x in token(r[1]))
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for r in corpus():
        w = token(r[1])
        want[r[0], len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 3)] += 1
    assert rows_of(out.withColumn("base", F.round("base_score", 3)), "doc_id", "n_tokens", "n_known", "train_tokens", "base") == want
    assert out.where("score > 0 or score is null or isnan(score)").count() == 0
    model, rest = lm_bloom.learn(nothing)
    assert lm_bloom.score(docs, model, rest).where("n_known > 0 or base_score > 1e-9").count() == 0
    assert lm_bloom.score(nothing, model, rest).count() == 0


def near_pairs():
    """Two texts each, word lists with a similarity of 0.7 to 0.9, chance words shared by all, a family of near copies."""
    rng = random.Random(12)
    rows = []
    for i in range(240):
        w = [f"v{rng.randrange(9000)}" for _ in range(rng.randrange(120, 260))]
        if i % 3 == 0:
            w[:12] = [f"h{k}" for k in range(12)]  # a beginning that many have
        other = list(w)
        for k in range(rng.randrange(1, 9)):
            other[rng.randrange(len(w))] = f"n{i}x{k}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
    family = [f"f{rng.randrange(9000)}" for _ in range(200)]
    for i in range(60):
        w = list(family)
        w[rng.randrange(200)] = f"g{i}"
        rows.append((1000 + i, " ".join(w)))
    return rows


def kept_by_brute_force(rows):
    sets = {d: frozenset(zip(*(t.split()[i:] for i in range(5)))) for d, t in rows}
    root = {d: d for d in sets}
    index = []
    for a in sets:
        for b in sets:
            if a < b:
                same = len(sets[a] & sets[b])
                s = same / (len(sets[a]) + len(sets[b]) - same)
                if s >= 0.7:
                    index.append(s)
                if s >= 0.8:
                    low, high = sorted((root[a], root[b]))
                    root = {d: low if r == high else r for d, r in root.items()}
    return sorted(set(root.values())), index


def test_near_dedup_is_exact(spark):
    rows = near_pairs()
    want, index = kept_by_brute_force(rows)
    assert sum(0.7 <= s < 0.8 for s in index) > 30 and sum(0.8 <= s < 0.9 for s in index) > 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert kept_ids(docs) == want


def test_near_dedup_does_not_depend_on_batches(spark):
    rows = near_pairs()[-120:]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7")
    try:
        assert kept_ids(docs) == kept_by_brute_force(rows)[0]
    finally:
        spark.conf.set(key, before)


def test_lm_bloom_keeps_what_was_seen_once(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(60))) for i in range(300)]
    train = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    words = [t.split() for _, t in rows]
    strange = [(1000 + i, " ".join(f"w{rng.randrange(4000)}" for _ in range(60))) for i in range(100)]  # seen words, other pairs
    new = [(2000 + i, " ".join(f"x{rng.randrange(4000)}" for _ in range(60))) for i in range(100)]
    docs = spark.createDataFrame([*rows, *strange, *new, rows[3], (None, None)], "doc_id long, text string").repartition(3)
    scores = []
    for bound in (1 << 24, 1 << 10):
        model, rest = lm_bloom.learn(train, filter_bytes=bound)
        assert (model.filter is None) == (bound == 1 << 10)
        out = lm_bloom.score(docs, model, rest)
        assert out.count() == len(rows) + 202
        scores.append(rows_of(out.withColumn("s", F.round("score", 6)).withColumn("b", F.round("base_score", 6)), "doc_id", "n_tokens", "n_known", "s", "b"))
        by = {r["doc_id"]: r["score"] for r in out.collect()}
        assert min(by[i] for i, _ in rows) > max(by[i] for i, _ in strange) and min(by[i] for i, _ in strange) > max(by[i] for i, _ in new)
    assert scores[0] == scores[1]  # broadcast or asked by bucket
    model, _ = lm_bloom.learn(train)
    asked = lm_bloom.Asked(lm_bloom.tokens(next(lm_bloom.chunks(pa.array([t for _, t in rows]), lower=True)))[0])
    single, pair = collections.Counter(w for t in words for w in [*t, None]), collections.Counter(p for t in words for p in zip([None, *t], [*t, None]))
    q = model.levels(asked)
    assert len(q[0]) == len(single) and (q[0] > 0).all() and len(q[2]) == len(pair) and (q[2] > 0).all() and (q[2] == 1).mean() > 0.9


def test_filter_reads_what_was_put_in():
    rng = np.random.default_rng(1)
    keys, counts = rng.integers(0, 1 << 63, 3000).astype(np.uint64), rng.integers(1, 1000, 3000)
    q = lm_bloom.levels(counts, 1.0)
    owner = lm_bloom.bucket_of(keys, np.uint64(0), 4)
    bits = 1 << 17
    data = np.concatenate([np.frombuffer(lm_bloom.Filter.filled([(keys[owner == b], np.uint64(0), q[owner == b])], bits), np.uint8) for b in range(4)])
    f = lm_bloom.Filter(4, bits, data)
    assert (f.read(keys, np.uint64(0), np.uint64(0)) >= q).all() and (f.read(keys, np.uint64(0), np.uint64(0)) == q).mean() > 0.9
    strange = f.read(rng.integers(0, 1 << 63, 5000).astype(np.uint64), np.uint64(0), np.uint64(0))
    assert (strange > 0).mean() < 0.1
    assert abs(lm_bloom.value_of(lm_bloom.levels(np.array([1, 7, 500]), 1.0), 1.0) / [1, 7, 500] - 1).max() < 0.3


def test_language_id(spark, nothing):
    rng = random.Random(6)
    parts = {"aa": ["tion", "ing", "the", "er"], "bb": ["sch", "eit", "ung", "pf"], "cc": ["ción", "ñado", "que", "ll"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k]) for _ in range(2)) for _ in range(20)), k) for i, k in enumerate(list(parts) * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.learn(docs.where("doc_id % 3 <> 2 or doc_id > 30"), 20)
    odd = spark.createDataFrame([(900, None, "aa"), (901, "12 .. !", "aa"), (902, "", None), (903, "Ж", None)], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in language_id.identify(docs.union(odd), model).collect()}
    assert np.mean([out[i]["lang_pred"] == k for i, _, k in rows]) > 0.95
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (900, 901, 902)) and out[903]["lang_pred"] in parts
    assert all(0 <= r["score"] <= 1 for r in out.values())
    blank = language_id.learn(nothing)
    assert {r["lang_pred"] for r in language_id.identify(docs, blank).collect()} == {"und"} and language_id.identify(nothing, model).count() == 0
    single = language_id.learn(docs.where("lang = 'aa'"))
    assert {r["lang_pred"] for r in language_id.identify(docs, single).collect()} == {"aa"}


def test_toxicity(spark, nothing):
    model = toxicity.learn(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    texts = ["You are an idiot and a m0r0n", "іdіоt scum you", "a trash can by the road", "a kind word", None, "", "id!ot l0ser", "idiotic? no", "ｉｄｉｏｔ fool"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert [out[i]["n_hits"] for i in range(9)] == [2, 2, 0, 0, 0, 0, 2, 0, 1] and out[0]["score"] > 0.5 > out[3]["score"] and out[4]["score"] == out[5]["score"]
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["good", "fine", "day", "tree"]) for _ in range(15)) + (" vileword" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(90)]
    learnt = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert " viieword " in learnt.weights
    probe = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame([(1, "fine VILEW0RD day"), (2, "fine day")], "doc_id long, text string"), learnt).collect()}
    assert probe[1] >= 0.5 > probe[2] and toxicity.score(nothing, model).count() == 0


def test_license_scan(spark, nothing):
    rng = random.Random(8)
    words = ["gnu", "general", "public", "license", "apache", "cc", "by", "mit", "x", "é", "licensed"]
    texts = [rng.choice(["", "  ", "--"]) + "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-", "\x00"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += [None, "", "MIT License", "xmit license", "Released under the Apahce License.", "Apache-License", "Permission is hereby granted, free of charge", "the gnu generl public licence v3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    for i, t in enumerate(texts):
        w = ALNUM.findall((t or "").translate(LOW))
        at = sorted((k, label) for p, label in license_scan.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    n = len(texts)
    assert "apache" in out[n - 4]["labels"] and out[n - 4]["base_labels"] == "" and "mit" in out[n - 2]["labels"] and "gpl" in out[n - 1]["labels"]
    assert any(s["words"] == "apahce license" for s in out[n - 4]["spans"]) and license_scan.scan(nothing).count() == 0


def test_mixing(spark, docs, nothing):
    rows = [(r[0], len(WS.findall(r[1] or "")), r[3]) for r in corpus()]
    size = collections.Counter()
    for _, n, s in rows:
        size[s] += n
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = dict(zip(names, [3, 1, 2] * 9))
    total, full = 1.5 * sum(size.values()), set()
    while True:
        left, share = total - sum(2 * size[s] for s in full), sum(w[s] for s in names if s not in full)
        t = {s: 2 * size[s] if s in full else left * w[s] / share for s in names}
        if not (new := {s for s in names if t[s] > 2 * size[s] + 1e-6}):
            break
        full |= new
    out = mixing.mix(docs).collect()
    got = collections.Counter()
    for r in out:
        got[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["target"] == pytest.approx(t[r["source"]]) and r["source_size"] == size[r["source"]]
    assert collections.Counter((r["doc_id"], r["size"], r["source"]) for r in out) == collections.Counter(rows)
    words = mixing.slot_words(sum(t.values()), min(t.values()))
    assert all(t[s] - 3 * words - 1 <= got[s] <= t[s] for s in names)
    # by hand: each source's slots in their order, block by block over the repeated stream
    cuts, low = {}, 0.0
    for s in names:
        cuts[s] = (low, low := low + t[s] / sum(t.values()))
    dealt = {s: [] for s in names}
    for i in range(math.ceil(sum(t.values()) / words)):
        p = i * mixing.GOLDEN % 1.0
        dealt[next(s for s in names if p < cuts[s][1] or s is names[-1])].append(i)
    order = lambda r: hashlib.md5(":".join([*([str(r[0])] if r[0] is not None else []), r[1] or ""]).encode()).hexdigest()
    want = collections.Counter()
    for s in names:
        stream = [k for k, r in enumerate(sorted((r for r in corpus() if r[3] == s), key=order)) for _ in WS.findall(r[1] or "")] * 2
        mine = sorted((r for r in corpus() if r[3] == s), key=order)
        took, slots = collections.Counter(), collections.defaultdict(set)
        for rank, slot in enumerate(dealt[s]):
            for at in range(rank * words, min((rank + 1) * words, math.floor(t[s] + 1e-9))):
                took[stream[at]] += 1
                slots[stream[at]].add((slot, at // size[s]))
        for k, r in enumerate(mine):
            want[r[0], len(WS.findall(r[1] or "")), took[k], min((x for x, _ in slots[k]), default=-1), len(slots[k])] += 1
    assert collections.Counter((r["doc_id"], r["size"], r["taken"], r["first_slot"], r["n_slots"]) for r in out) == want
    other = mixing.mix(docs, step=0.3).collect()
    assert sorted((r["doc_id"] or 0, r["first_slot"]) for r in other) != sorted((r["doc_id"] or 0, r["first_slot"]) for r in out)
    alone = collections.Counter()
    for r in mixing.mix(docs, step=0.0).collect():  # every slot is dealt to the first source
        alone[r["source"]] += r["taken"]
    assert [s for s in names if alone[s]] == names[:1]
    again = mixing.mix(docs.orderBy(F.desc("doc_id")))
    assert rows_of(again, "doc_id", "text_key", "taken") == collections.Counter((r["doc_id"], r["text_key"], r["taken"]) for r in out)
    assert mixing.mix(nothing).count() == 0 and mixing.mix(docs.where("text is null")).first()["taken"] == 0


def test_schedule_is_even(spark):
    sources = spark.createDataFrame([(0, 5000.0), (1, 3000.0), (2, 2000.0)], "source_no int, target double")
    mixing.shared_checkpoints(spark)
    slots = sorted((r["slot"], r["source_no"], r["rank"]) for r in mixing.schedule(sources, 10).collect())
    for cut in (100, 300, 700):
        seen = collections.Counter(s for _, s, _ in slots[:cut])
        assert all(abs(seen[k] - cut * share) < 6 for k, share in ((0, 0.5), (1, 0.3), (2, 0.2)))
    for k, n in ((0, 500), (1, 300), (2, 200)):
        ranks = [r for _, s, r in slots if s == k]
        assert ranks == list(range(len(ranks))) and abs(len(ranks) - n) <= 2


def test_url_filter(spark):
    urls = ["http://A.Example.org/es/x", "http://example.org/en/12?q", "https://example.org/en/2", "http://x.com/fr/a#b", "http://x.com/de/", "http://y.net/fr/", "no scheme", None, "", "http://org", "http://worg/", "x://com/fr/?://b", "http://a.com?x://b/fr/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    want = [("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("example.org", "/en/2", "org/", "allow"), ("x.com", "/fr/a", "com/fr/", "allow"), ("x.com", "/de/", "com/de/", "block")]
    assert [(out[i]["host"], out[i]["path"], out[i]["rule"], out[i]["verdict"]) for i in range(5)] == want
    assert [(out[i]["host"], out[i]["path"], out[i]["rule"]) for i in (5, 6, 7, 8, 9, 10, 12)] == [("y.net", "/fr/", None), ("", "", None), ("", "", None), ("", "", None), ("org", "", None), ("worg", "/", None), ("a.com", "", None)]
    assert out[11]["rule"] == "com/fr/" and all(r["verdict"] in ("allow", "block") for r in out.values())
    assert url_filter.judge(pages.where("false")).count() == 0
    again = spark.createDataFrame([(1, "http://x.com/de/"), (1, "http://x.com/de/"), (None, "http://y.net/" + "p" * 200_000)], "page_id long, url string")
    assert rows_of(url_filter.judge(again), "page_id", "rule") == {(1, "com/de/"): 2, (None, None): 1}
    seen = spark.createDataFrame([("bad.spam.net", 0)] * 40 + [("ok.fine.net", 1)] * 40 + [("b.spam.net", 0)] * 5, "host string, good int")
    asked = spark.createDataFrame([(1, "http://bad.spam.net/"), (2, "http://ok.fine.net/"), (3, "http://new.spam.net/")], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(asked, [], seen).collect()}
    assert got == {1: "block", 2: "allow", 3: "block"}


def test_hashes_depend_on_all_bytes():
    from gleanspark.llm._text import hash_spans

    rng = random.Random(9)
    texts = {bytes(rng.randrange(256) for _ in range(rng.randrange(1, 40))) for _ in range(3000)} | {b"a", b"a\0", b"a" * 8, b"a" * 9, b"x" * 600, b"x" * 601}
    texts = sorted(texts)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    h = hash_spans(data, np.concatenate([[0], ends[:-1]]), ends, 1)
    assert len(set(h.tolist())) == len(texts)
    assert hash_spans(data[ends[4] : ends[5]], np.array([0]), np.array([ends[5] - ends[4]]), 1)[0] == h[5]
