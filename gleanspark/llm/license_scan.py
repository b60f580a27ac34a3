"""Licence scans: short notices found exactly and with a few errors.

Exact places are runs of words.  Fuzzy labels come from notice phrases that may
differ by up to k edits: a phrase is split into k + 1 pieces, one of which must
stand unchanged in any match (pigeonhole), so the pieces are exact seeds; near
each seed the regex library's bounded-error matching verifies the edits and
gives the span.

Edge cases: a null or empty text has no words, no places and empty labels;
repeated rows each give their row; an empty table an empty result.  Extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._text import NOT_ALNUM, chunks, small_batches, trimmed, with_columns

# The phrases and labels that are counted exactly.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
# Notice phrases matched with up to so many edits.
NOTICES = [
    ("gnu general public license", "gpl", 3),
    ("gnu lesser general public license", "lgpl", 3),
    ("apache license", "apache", 2),
    ("licensed under the apache", "apache", 3),
    ("mit license", "mit", 1),
    ("permission is hereby granted free of charge", "mit", 4),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("bsd license", "bsd", 1),
    ("mozilla public license", "mpl", 2),
    ("creative commons attribution", "cc-by", 3),
    ("all rights reserved", "all-rights-reserved", 2),
    ("public domain", "public-domain", 1),
]
WORD = np.ones(256, bool)
WORD[[0x00, 0x20]] = False
FLAT = np.where(NOT_ALNUM, 0x20, np.arange(256)).astype(np.uint8)


def pieces(phrase: str, errors: int) -> list[bytes]:
    """errors + 1 parts of the phrase that cover it."""
    b, n = phrase.encode(), errors + 1
    cuts = [len(b) * i // n for i in range(n + 1)]
    return [b[i:j] for i, j in zip(cuts, cuts[1:])]


def flatten(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """All texts with their words joined by one space, each text between two NULs; and where each text's NUL is."""
    raw = np.frombuffer(b"\xff".join([b"", *texts, b""]), np.uint8)  # 0xff is in no UTF-8 text
    d = FLAT[raw]
    d[raw == 0xFF] = 0
    blank = d == 0x20
    after = np.zeros(len(d), bool)
    after[1:] = ~WORD[d[:-1]]
    before = np.zeros(len(d), bool)
    before[:-1] = d[1:] == 0
    d = d[~(blank & after)]
    blank = d == 0x20
    before = np.zeros(len(d), bool)
    before[:-1] = d[1:] == 0
    d = d[~(blank & before)]
    return d.tobytes(), np.flatnonzero(d == 0)


def places(flat: bytes, phrase: bytes) -> Iterator[int]:
    """Where the phrase stands as whole words."""
    at = flat.find(phrase)
    while at >= 0:
        if not WORD[flat[at - 1]] and not WORD[flat[at + len(phrase)]]:
            yield at
        at = flat.find(phrase, at + 1)


class Scanner:
    """Compiled phrases over flattened texts."""

    def __init__(self, base=BASE, notices=NOTICES):
        self.base = [(p.encode(), label) for p, label in base]
        self.notices = []
        for phrase, label, errors in notices:
            rx = regex.compile(rb"(?b)(?<![^\x00 ])(?:" + regex.escape(phrase.encode()) + rb"){e<=%d}(?![^\x00 ])" % errors)
            seeds, at = [], 0
            for piece in pieces(phrase, errors):
                seeds.append((piece, at))
                at += len(piece)
            self.notices.append((rx, label, errors, len(phrase), seeds))

    def exact(self, flat: bytes) -> list[tuple[int, int, str]]:
        return [(at, at + len(p), label) for p, label in self.base for at in places(flat, p)]

    def fuzzy(self, flat: bytes) -> list[tuple[int, int, str, float]]:
        """Verified spans, their labels and likeness (1 - edits by phrase length)."""
        found: dict[tuple[int, int, str], float] = {}
        for rx, label, errors, size, seeds in self.notices:
            starts = set()
            for piece, offset in seeds:
                at = flat.find(piece)
                while at >= 0:
                    starts.add(at - offset)
                    at = flat.find(piece, at + 1)
            done = -1
            for start in sorted(starts):
                if start < done:
                    continue
                low, high = max(0, start - errors - 1), min(len(flat), start + size + errors + 1)
                if hit := rx.search(flat, low, high):
                    if b"\0" not in hit[0]:
                        found[hit.start(), hit.end(), label] = 1 - sum(hit.fuzzy_counts) / size
                        done = hit.end() - size // 2
        return [(*k, v) for k, v in sorted(found.items())]


def scan(docs: DataFrame, keep: list[str] = ("doc_id",), scanner: Scanner | None = None) -> DataFrame:
    """keep, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans: label, first and last word
    (from 0), matched words and likeness of every fuzzy or exact notice."""
    small_batches(docs.sparkSession)
    scanner = scanner or Scanner()
    source = docs.select(*keep, "text")
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("words", pa.string()), ("likeness", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            for t in chunks(b["text"], lower=True):
                n = len(t)
                n_words = t.words(NOT_ALNUM).counts()
                flat, nul = flatten([t.text(i) for i in range(n)])
                blanks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 0x20)
                before = np.searchsorted(blanks, nul)

                def word(at: int, doc: int) -> int:
                    return int(np.searchsorted(blanks, at) - before[doc])

                base: list[list] = [[] for _ in range(n)]
                near: list[list] = [[] for _ in range(n)]
                for at, _, label in scanner.exact(flat):
                    doc = int(np.searchsorted(nul, at)) - 1
                    base[doc].append((word(at, doc), label))
                for at, end, label, like in scanner.fuzzy(flat):
                    doc = int(np.searchsorted(nul, at)) - 1
                    near[doc].append({"label": label, "first_word": word(at, doc), "last_word": word(end - 1, doc), "words": flat[at:end].decode("utf-8", "replace"), "likeness": like})
                own = [b[k].slice(t.rows.start, n) for k in keep]
                cols = {
                    "n_words": pa.array(n_words.astype(np.int64)),
                    "n_base": pa.array([len(x) for x in base], pa.int64()),
                    "first_word": pa.array([min(x)[0] if x else None for x in base], pa.int64()),
                    "last_word": pa.array([max(x)[0] if x else None for x in base], pa.int64()),
                    "base_labels": pa.array([",".join(sorted({k for _, k in x})) for x in base], pa.string()),
                    "labels": pa.array([",".join(sorted({k for _, k in x} | {s["label"] for s in y})) for x, y in zip(base, near)], pa.string()),
                    "score": pa.array([1.0 if x else max((s["likeness"] for s in y), default=0.0) for x, y in zip(base, near)], pa.float64()),
                    "spans": pa.array(near, pa.list_(span)),
                }
                yield pa.RecordBatch.from_arrays([*own, *cols.values()], [*keep, *cols])

    return source.mapInArrow(run, with_columns(source, keep, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:bigint,last_word:bigint,words:string,likeness:double>>"))
