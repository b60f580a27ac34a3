"""The pipeline against a plain version of its stages, and that the rest works without it."""

import collections
import random
import re

import pytest

import corpus_pipeline

WS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    v = [f"w{i}x" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(v) for _ in range(n))
    passage, item = text(60), text(12)
    rows = []
    for i in range(40):
        t = text(rng.randrange(100, 200))
        if i in (5, 9, 21):
            t = f"{t} {passage} {text(20)}"
        if i in (7, 30):
            t = f"{t} {item.upper()} {text(9)}"
        rows.append((i, t, "en", f"s{i % 4}", len(t), "extra"))
    rows += [(100, rows[3][1], "en", "s1", 1, None), (101, None, None, None, None, None), (102, "12 !", "en", "s2", 4, ""), (None, text(50), "en", None, 1, "x"), rows[4]]
    words = rows[8][1].split()
    words[4] = "changed"
    rows.append((103, " ".join(words), "en", "s0", 1, "near"))
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item), (2, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, item


def plain(rows, item):
    docs = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    sets = [frozenset(zip(*(w[i:] for i in range(5)))) for w in (r[1].translate(LOW).split() for r in docs)]
    kept = []
    for k in sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0)):
        if not any(len(sets[k] & sets[j]) >= 0.8 * len(sets[k] | sets[j]) for j in kept):
            kept.append(k)
    docs, seen, out = [docs[k] for k in kept], set(), []
    for r in docs:  # ascending doc_id
        w = WS.findall(r[1])
        gone, own = [False] * len(w), []
        for i in range(len(w) - 49):
            own.append(tuple(w[i : i + 50]))
            if own[-1] in seen:
                gone[i : i + 50] = [True] * 50
        seen.update(own)
        out.append((r[0], " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else r[1], r[3]))
    b = ALNUM.findall(item.translate(LOW))
    wins = {tuple(b[i : i + 8]) for i in range(len(b) - 7)}
    clean = []
    for d, t, s in out:
        w = ALNUM.findall(t.translate(LOW))
        if not any(tuple(w[i : i + 8]) in wins for i in range(len(w) - 7)):
            clean.append((d, t, s))
    return clean


def test_run(spark, folder):
    at, rows, item = folder
    want = plain(rows, item)
    got = corpus_pipeline.run(spark, at).collect()
    texts = {(d, t): s for d, t, s in want}
    assert {(r["doc_id"], r["text"]) for r in got} <= set(texts) and all(r["source"] == texts[r["doc_id"], r["text"]] for r in got)
    assert len(got) == len({(r["doc_id"], r["text"]) for r in got}) and all(0 < r["taken"] <= 2 * r["size"] and r["size"] == len(WS.findall(r["text"])) for r in got)
    total = 1.5 * sum(len(WS.findall(t)) for _, t, _ in want)
    assert abs(sum(r["taken"] for r in got) - total) < 0.02 * total
    by = collections.defaultdict(lambda: [0, 0])
    for r in got:
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] = r["target"]
    assert all(b * 0.97 < a <= b for a, b in by.values())


def test_stages_keep_columns_and_clean_documents(spark, folder):
    at, rows, item = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    clean = {i for i in range(40)} - {5, 7, 9, 21, 30}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at).cache()
        assert docs.columns == columns
        now = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert all(now[i] == rows[i][1] for i in clean), name
    assert 100 not in now and 103 not in now and 101 not in now and 7 not in now and len(now[9]) < len(rows[9][1]) and now[5] == rows[5][1]


def test_empty_table(spark, folder, tmp_path):
    at, *_ = folder
    spark.read.parquet(f"{at}/documents.parquet").where("false").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{at}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
