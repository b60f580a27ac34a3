"""Language ID by error-correcting output codes.

Each language has a codeword of +1 and -1 bits.  One logistic classifier for
each bit, over hashed character n-grams, predicts that bit; a text gets the
language whose codeword has the least loss, bits weighted by how reliably they
were predicted in training.  A text whose two nearest codewords are about as
near is flagged as ambiguous; one whose predicted bits lie outside the code's
radius (as far from the nearest codeword as half the distance of the two nearest
languages, or farther) is flagged as far: no language explains it.

Edge cases: a null text, or one without a letter of any script, is ``und``
with score 0; an empty table gives an empty result; repeated rows each give
their row; of languages with equal loss the first by name wins; with one learned
language every text with a letter gets it, with none all are ``und`` (and none
is far).  A very long text is a chunk of its own, in arrays of about 20 bytes a
byte of text.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import Texts, chunks, per_text, small_batches, trimmed, with_columns

UNKNOWN = "und"
DIM_BITS = 12
DIM = 1 << DIM_BITS
ROWS = 512
#: How sharply a codeword's loss turns into likelihood.
SHARPNESS = 6.0

FOLD = np.full(256, 0x20, np.uint8)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)
LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit, +1 or -1
    weights: np.ndarray  # (features + 1) x bit
    trust: np.ndarray  # by bit


def has_letter(t: Texts) -> np.ndarray:
    found = per_text(LETTER[t.data], t.offsets) > 0
    for i in np.flatnonzero(~found):
        found[i] = any(c.isalpha() for c in t.text(i).decode("utf-8", "replace"))
    return found


def features(t: Texts) -> np.ndarray:
    """Root counts of hashed two- and three-byte grams of each whole text, scaled to length 1; the last column is 1."""
    d = FOLD[t.data]
    if len(d) > 1:
        latin = (d[:-1] == 0xC3) & (d[1:] >= 0x80) & (d[1:] <= 0x9E)  # capitals of Latin-1
        d[1:][latin] += 0x20
    out = np.zeros((len(t), DIM + 1), np.float32)
    out[:, DIM] = 1
    doc = np.repeat(np.arange(len(t), dtype=np.int64) << DIM_BITS, np.diff(t.offsets))
    code = d.astype(np.uint32)
    counts = np.zeros(len(t) << DIM_BITS, np.int64)
    for size in (2, 3):
        n = len(d) - size + 1
        if n <= 0:
            continue
        gram = code[:n].copy()
        for j in range(1, size):
            gram = (gram << np.uint32(8)) | code[j : n + j]
        ok = (doc[:n] == doc[size - 1 :]) & ~((d[:n] == 0x20) & (d[1 : n + 1] == 0x20))
        bin_ = ((gram[ok] + np.uint32(size)) * np.uint32(2654435761)) >> np.uint32(32 - DIM_BITS)
        counts += np.bincount(doc[:n][ok] + bin_, minlength=len(counts))
    x = np.sqrt(counts.reshape(len(t), DIM).astype(np.float32))
    out[:, :DIM] = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-6)
    return out


def codewords(languages: int, bits: int) -> np.ndarray:
    """The best of many drawn codes: rows far apart, no bit the same for all."""
    rng, best, apart = np.random.default_rng(7), None, -1.0
    for _ in range(300):
        code = np.where(rng.random((languages, bits)) < 0.5, -1, 1)
        code[:, np.abs(code.sum(0)) == languages] *= np.where(np.arange(languages) % 2, -1, 1)[:, None]
        gap = bits if languages == 1 else min((code[i] != code[j]).sum() for i in range(languages) for j in range(i)) if languages <= 64 else bits / 4
        if gap > apart:
            best, apart = code, gap
    return best


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], bits: int, steps: int = 200, decay: float = 1e-5) -> Model:
    """Logistic classifiers of all bits at once, by gradient descent with momentum."""
    code = codewords(len(languages), bits)
    w = np.zeros((x.shape[1], bits), np.float32)
    target = code[y].astype(np.float32)
    share = 1 / np.maximum(np.bincount(y, minlength=len(languages)), 1)
    share = (share[y] / share[y].sum()).astype(np.float32)[:, None]
    speed = np.zeros_like(w)
    for _ in range(steps):
        slope = -target / (1 + np.exp(np.clip(target * (x @ w), -30, 30)))
        speed = 0.9 * speed - 8.0 * (x.T @ (slope * share) + decay * w)
        w += speed
    right = (share * ((x @ w) * target > 0)).sum(0)
    trust = np.clip(2 * right - 1, 0.05, 1)
    return Model(languages, code, w, (trust / trust.sum()).astype(np.float32))


def learn(labelled: DataFrame, per_language: int = 1500, bits: int = 15) -> Model:
    """labelled: text, lang and a doc_id to draw by.  Fits on a bounded sample: about per_language rows of each
    language (all where there are fewer), drawn by a hash of doc_id and text."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, bits)), np.zeros((DIM + 1, bits), np.float32), np.ones(bits, np.float32))
    million = 1_000_000
    rate = F.create_map(*[F.lit(x) for k in languages for x in (k, min(million, -(-per_language * million // sizes[k])))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(million))
    sample = labelled.where(draw < F.element_at(rate, F.col("lang"))).select("text", "lang")
    small_batches(labelled.sparkSession)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            for t in chunks(b["text"], rows=ROWS):
                x, ok = features(t), has_letter(t)
                rows = [(r := np.flatnonzero(v[:DIM])).astype("<u2").tobytes() + v[r].astype("<f4").tobytes() for v in x]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), b["lang"].slice(t.rows.start, len(t)), pa.array(ok)], ["x", "lang", "ok"])

    rows = sample.mapInArrow(vectors, "x binary, lang string, ok boolean").where("ok").drop("ok").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    x = np.zeros((len(rows), DIM + 1), np.float32)
    x[:, DIM] = 1
    for i, r in enumerate(rows):
        n = len(r["x"]) // 6
        x[i, np.frombuffer(r["x"][: 2 * n], "<u2")] = np.frombuffer(r["x"][2 * n :], "<f4")
    y = np.array([languages.index(r["lang"]) for r in rows], np.int64)
    return fit(x, y, languages, bits)


def decode(m: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nearest codeword of each row, its share of the likelihood, the gap to the next one, and whether the bits are far from it."""
    f = x @ m.weights
    loss = np.logaddexp(0, -f[:, None, :] * m.code[None, :, :]) @ (m.trust * SHARPNESS)
    like = np.exp(loss.min(1, keepdims=True) - loss)
    like /= like.sum(1, keepdims=True)
    best = like.argmax(1)
    ranked = np.sort(like, 1)
    wrong = (f * m.code[best] <= 0) @ m.trust
    return best, ranked[:, -1], ranked[:, -1] - (ranked[:, -2] if like.shape[1] > 1 else 0), wrong >= radius(m)


def radius(m: Model) -> float:
    """Half the least distance of two codewords, bits weighted by trust."""
    n = len(m.languages)
    return min(((m.code[i] != m.code[j]) @ m.trust for i in range(n) for j in range(i)), default=2.0) / 2


def identify(docs: DataFrame, model: Model, keep: list[str] = ("doc_id",), gap: float = 0.2) -> DataFrame:
    """keep, lang_pred, score (0 to 1), ambiguous (the gap between the two nearest codewords is below gap) and far."""
    small_batches(docs.sparkSession)
    source = docs.select(*dict.fromkeys([*keep, "text"]))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            for t in chunks(b["text"], rows=ROWS):
                n = len(t)
                known = has_letter(t) if model.languages else np.zeros(n, bool)
                best, score, apart, far = decode(model, features(t)) if model.languages else (np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros(n, bool))
                langs = pa.array([model.languages[i] if ok else UNKNOWN for i, ok in zip(best, known)], pa.string())
                own = [b[k].slice(t.rows.start, n) for k in keep]
                cols = [langs, pa.array(np.where(known, np.clip(score, 0, 1), 0.0).astype(float)), pa.array(~known | (apart < gap)), pa.array(known & far)]
                yield pa.RecordBatch.from_arrays([*own, *cols], [*keep, "lang_pred", "score", "ambiguous", "far"])

    return source.mapInArrow(predict, with_columns(source, keep, "lang_pred string, score double, ambiguous boolean, far boolean"))
