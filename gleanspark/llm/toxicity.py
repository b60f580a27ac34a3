"""Toxicity by a weighted lexicon.

Texts are folded first: case, lookalike letters of other scripts, full-width
forms, digits and signs that stand for letters, zero-width characters.  An
Aho-Corasick automaton then finds lexicon entries (whole words, or stems that
begin a word) and exception phrases; an entry inside an exception phrase
doesn't count.  The summed weights, also by length, give the score through a
logistic curve fitted on labelled rows.

The lexicon is a fixed list of seeds plus up to ``entries`` words and stems that
labelled toxic texts hold far more often than others.

Edge cases: a null or empty text scores as one without hits; repeated rows each
give their row; an empty table an empty result; without labels of both kinds
the seeds and a fixed curve serve.  Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import chunks, small_batches, trimmed, with_columns

# Insults that count without any label.
SEEDS = ["idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "bastard", "dumbass", "asshole", "bitch"]
# Harmless phrases around lexicon words.
EXCEPTIONS = ["trash can", "trash bin", "trash bag", "trash collection", "clown fish", "class clown", "circus clown", "pond scum", "sore loser"]
# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("асеорхуіјѕһԁԛԝкмтвнАВЕКМНОРСТХУІЈЅαοενικρτυχγηωΑΒΕΖΗΙΚΜΝΟΡΤΥΧıɑɡⅼ", "aceopxyijshdqwkmtbhabekmhopctxyijsaoevikptuxynwabezhikmnoptyxiagl"))
LOOKALIKES |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
# Zero-width characters, the soft hyphen and combining marks go.
LOOKALIKES |= {c: "" for c in "​‌‍⁠﻿­"} | {chr(c): "" for c in range(0x300, 0x370)}
TABLE = str.maketrans(LOOKALIKES)
#: Lead bytes of what TABLE maps.
LEADS = np.zeros(256, bool)
LEADS[sorted({c.encode()[0] for c in LOOKALIKES} - {0xC2})] = True

# Digits for letters; l, 1 and | all fold to i, on both sides.
ASCII = np.full(256, 0x20, np.uint8)
ASCII[0x61:0x7B] = np.arange(0x61, 0x7B)
ASCII[0x41:0x5B] = np.arange(0x61, 0x7B)
ASCII[0x80:] = np.arange(0x80, 0x100)
for _from, _to in zip(b"0134578l1|Ll", b"oieastbiiiii"):
    ASCII[_from] = _to
for _from in b"269":
    ASCII[_from] = _from
SIGNS = re.compile(rb"(?<=[A-Za-z0-9])[$@!](?=[A-Za-z0-9])")
SIGN = {b"$": b"s", b"@": b"a", b"!": b"i"}
TABLE_BYTES = ASCII.tobytes()


def fold(text: bytes) -> str:
    """Words of letters, each between single spaces, as Latin-1 code units of UTF-8 bytes."""
    if LEADS[np.frombuffer(text, np.uint8)].any() or b"\xc2\xad" in text:
        text = text.decode("utf-8", "replace").translate(TABLE).encode()
    if b"$" in text or b"@" in text or b"!" in text:
        text = SIGNS.sub(lambda m: SIGN[m[0]], text)
    return " " + b" ".join(text.translate(TABLE_BYTES).split()).decode("latin-1") + " "


def fold_entry(entry: str) -> str:
    return fold(entry.encode()).strip(" ")


@dataclass
class Model:
    weights: dict[str, float]  # of " word " and " stem"
    exceptions: list[str]
    curve: np.ndarray


class Matcher:
    def __init__(self, model: Model):
        self.model = model
        self.automaton = ahocorasick.Automaton()
        for entry, weight in model.weights.items():
            self.automaton.add_word(entry, (len(entry), weight))
        for phrase in model.exceptions:
            self.automaton.add_word(f" {fold_entry(phrase)} ", (len(fold_entry(phrase)) + 2, None))
        self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """Start, end and weight of the entries that count: of those that begin at one place only the heaviest."""
        found: dict[int, tuple[int, float]] = {}
        excused: list[tuple[int, int]] = []
        for last, (size, weight) in self.automaton.iter(folded):
            start = last + 1 - size
            if weight is None:
                excused.append((start, last + 1))
            elif start not in found or found[start][1] < weight:
                found[start] = (last + 1, weight)
        return [(s, e, w) for s, (e, w) in sorted(found.items()) if not any(a <= s and e <= b for a, b in excused)]


def signals(hits: list[tuple[int, int, float]], words: int) -> list[float]:
    total = sum(w for _, _, w in hits)
    return [math.log1p(total), min(4.0, 20 * total / (words + 20)), float(bool(hits)), 1.0]


def entries_of(folded: str) -> set[str]:
    """Candidates for the lexicon: words, and their first 5 to 8 letters as stems."""
    words = set(folded.split(" ")) - {""}
    return {f" {w} " for w in words if 3 <= len(w) <= 24} | {f" {w[:n]}" for w in words for n in (5, 6, 7, 8) if len(w) > n}


def bounded(labels: DataFrame, rows: int = 20_000) -> DataFrame:
    """Labels (doc_id, toxic) of about ``rows`` documents at most, drawn by a hash of doc_id: few enough to broadcast, so that no
    text is shuffled to be joined with them."""
    n = labels.count()
    million = 1_000_000
    return F.broadcast(labels if n <= rows else labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(million)) < rows * million // n))


def learn(labelled: DataFrame, rows: int = 20_000, entries: int = 2_000, at_least: int = 8, odds: float = 3.0) -> Model:
    """labelled: doc_id, text and toxic (0 or 1).  Fits on a bounded sample of labelled rows: about ``rows``, drawn by a hash."""
    small_batches(labelled.sparkSession)
    labelled = labelled.where(F.col("toxic").isin(0, 1)).select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    n = labelled.count()
    million = 1_000_000
    sample = labelled if n <= rows else labelled.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(million)) < rows * million // n)
    seeds = {f" {fold_entry(w)} ": 2.0 for w in SEEDS}

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            for t in chunks(b["text"], rows=256):
                toxic = b["toxic"].slice(t.rows.start, len(t)).to_numpy(zero_copy_only=False)
                found = [sorted(entries_of(fold(t.text(i)))) for i in range(len(t))]
                yield pa.RecordBatch.from_arrays([pa.array([x for f in found for x in f], pa.string()), pa.array(np.repeat(toxic, [len(f) for f in found]), pa.int32())], ["entry", "toxic"])

    both = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = both.get(1, 0), both.get(0, 0)
    if not n1 or not n0:
        return Model(seeds, EXCEPTIONS, np.array([1.5, 1.0, 1.0, -3.0]))
    a, b = F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")
    log_odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    top = (
        sample.mapInArrow(candidates, "entry string, toxic int").groupBy("entry").agg(a, b)
        .where(F.col("a") >= at_least).withColumn("odds", log_odds).where(F.col("odds") >= odds)
        .orderBy(F.desc(F.col("a") * F.col("odds")), "entry").limit(entries).collect()
    )
    weights = seeds | {r["entry"]: max(seeds.get(r["entry"], 0.0), r["odds"] / 2) for r in top}
    model = Model(weights, EXCEPTIONS, np.zeros(4))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for b in trimmed(batches):
            for t in chunks(b["text"], rows=256):
                x = np.array([signals(matcher.hits(f := fold(t.text(i))), f.count(" ") - 1) for i in range(len(t))])
                yield pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(3)), b["toxic"].slice(t.rows.start, len(t))], ["x0", "x1", "x2", "toxic"])

    got = np.array(sorted(map(tuple, sample.mapInArrow(measured, "x0 double, x1 double, x2 double, toxic int").collect())))
    x, y = np.column_stack([got[:, :3], np.ones(len(got))]), got[:, 3]
    curve = np.zeros(4)
    for _ in range(40):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        slope = x.T @ (y - p) - 0.1 * curve
        curve += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4), slope)
    return Model(weights, EXCEPTIONS, curve)


def score(docs: DataFrame, model: Model, keep: list[str] = ("doc_id",)) -> DataFrame:
    """keep, score (0 to 1), n_hits and the matched entries with their places in the folded text."""
    small_batches(docs.sparkSession)
    source = docs.select(*keep, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for b in trimmed(batches):
            for t in chunks(b["text"]):
                total, found = [], []
                for i in range(len(t)):
                    folded = fold(t.text(i))
                    hits = matcher.hits(folded)
                    total.append(1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(model.curve, signals(hits, folded.count(" ") - 1))))))))
                    found.append([f"{s}:{folded[s:e].strip(" ").encode('latin-1').decode('utf-8', 'replace')}" for s, e, _ in hits])
                own = [b[k].slice(t.rows.start, len(t)) for k in keep]
                yield pa.RecordBatch.from_arrays([*own, pa.array(total, pa.float64()), pa.array([len(f) for f in found], pa.int64()), pa.array(found, pa.list_(pa.string()))], [*keep, "score", "n_hits", "hits"])

    return source.mapInArrow(run, with_columns(source, keep, "score double, n_hits long, hits array<string>"))
