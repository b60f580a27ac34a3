"""SimHash near-dedup.

A text's fingerprint has a bit for each majority among its shingles' XXH64
bits.  Fingerprints that differ in few bits are found through their segment
popcounts: 16 segments of four bits map a fingerprint to a point of the grid
{0..4}^16, and differing in d bits moves that point by at most d in Manhattan
distance.  Two points within distance 2 share a grid cell within distance 1 of
both, so each fingerprint is put into its own cell and the 1-step neighbours of
it (33 at most), and only cells that hold at least two fingerprints live on.
There the exact check follows without comparing all pairs: fingerprints differ
in at most two bits exactly if some word is within one bit of both; each
fingerprint of a live cell lists the words within one bit that fall in that
cell, and equal words link.  At most 65 fingerprints can share a word, so no
group grows with the data, and a group of copies is one fingerprint from the
start.

Edge cases: a null or empty text has fingerprint 0, linked like any other;
repeated rows each give their row; a null doc_id is linked but never names a
component (a component of null ids only has null); an empty table gives an
empty result.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shards import shared_checkpoints
from ._text import LOWER, U64, chunks, small_batches, trimmed, with_columns
from ..operators.components import components

SEED = 42
SEGMENT = 4
SEGMENTS = 64 // SEGMENT
LOWER_BYTES = LOWER.tobytes()


def counts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """By text (hashes first[i] up to first[i + 1]): of each of the 64 bits, twice the hashes that have it less their number."""
    block = 1 << 17
    sizes = np.diff(first)
    ones = np.zeros((len(sizes), 64), np.int64)
    some = np.flatnonzero(sizes)
    for low in range(0, len(hashes), block):
        bits = np.unpackbits(hashes[low : low + block].astype(">u8").view(np.uint8)).reshape(-1, 64)
        a = int(np.searchsorted(first[some], low, "right")) - 1
        b = int(np.searchsorted(first[some], low + len(bits), "left"))
        starts = np.maximum(first[some[a:b]] - low, 0)
        ones[some[a:b]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    return ones * 2 - sizes[:, None]


def majorities(over: np.ndarray) -> np.ndarray:
    """Fingerprints: the bits that over half of the hashes have."""
    return np.packbits(over > 0, axis=1).view(">u8").ravel().astype(U64)


def shingle_hashes(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle (repeats included) of each text, words joined by one space."""
    digest, all_, first = xxhash.xxh64_intdigest, [], [0]
    for text in texts:
        words = text.translate(LOWER_BYTES).split()
        if words:
            flat = b" ".join(words)
            if len(words) <= size:
                all_.append(digest(flat, SEED))
            else:
                blanks = np.flatnonzero(np.frombuffer(flat, np.uint8) == 0x20)
                starts = np.concatenate([[0], blanks + 1])[: len(words) - size + 1].tolist()
                ends = np.append(blanks, len(flat))[size - 1 :].tolist()
                all_ += [digest(flat[a:b], SEED) for a, b in zip(starts, ends)]
        first.append(len(all_))
    return np.array(all_, U64), np.array(first)


def fingerprints(docs: DataFrame, shingle: int = 3, keep: list[str] = ("doc_id",)) -> DataFrame:
    """keep and fp, the fingerprint's 64 bits as long."""
    small_batches(docs.sparkSession)
    source = docs.select(*dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            for t in chunks(b["text"], most=1 << 20):
                fp = majorities(counts(*shingle_hashes([t.text(i) for i in range(len(t))], shingle)))
                own = [b[k].slice(t.rows.start, len(t)) for k in keep]
                yield pa.RecordBatch.from_arrays([*own, pa.array(fp.view(np.int64))], [*keep, "fp"])

    return source.mapInArrow(run, with_columns(source, keep, "fp long"))


def nibbles(fp: np.ndarray) -> np.ndarray:
    """The grid point: the bit count of each 4-bit segment, in that segment's place."""
    x = (fp & U64(0x5555555555555555)) + (fp >> U64(1) & U64(0x5555555555555555))
    return (x & U64(0x3333333333333333)) + (x >> U64(2) & U64(0x3333333333333333))


def cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and the cells they are put into: their own and all at Manhattan distance 1."""
    point = nibbles(fp)
    out_fp, out_cell = [fp], [point]
    for s in range(SEGMENTS):
        count, unit = point >> U64(SEGMENT * s) & U64(15), U64(1 << (SEGMENT * s))
        out_fp += [fp[count < SEGMENT], fp[count > 0]]
        out_cell += [point[count < SEGMENT] + unit, point[count > 0] - unit]
    return np.concatenate(out_fp), np.concatenate(out_cell)


def witnesses(fp: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words within one bit of a fingerprint that lie in the cell, and that fingerprint."""
    point = nibbles(fp)
    own = point == cell
    words, of = [fp[own]], [fp[own]]
    fp, cell, point = fp[~own], cell[~own], point[~own]
    up = cell > point
    step = np.where(up, cell - point, point - cell)  # one unit of one segment
    for bit in range(SEGMENT):
        mask = step << U64(bit)
        ok = (fp & mask == 0) == up
        words.append(fp[ok] ^ mask[ok])
        of.append(fp[ok])
    return np.concatenate(words), np.concatenate(of)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray]]:
    """Batches of rows sorted by key, cut so that a pair of neighbours is never split: each block begins with the row before it."""
    last = None
    for b in batches:
        cols = {k: (c.flatten().to_numpy().reshape(len(c), -1) if pa.types.is_list(c.type) else c.to_numpy()) for k, c in zip(b.schema.names, b.columns)}
        if len(cols[key]):
            if last is not None:
                cols = {k: np.concatenate([last[k], c]) for k, c in cols.items()}
            yield cols | {"carried": np.array(last is not None)}
            last = {k: c[-1:] for k, c in cols.items()}


def batch(**cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in cols.values()], list(cols))


def links(fps: DataFrame) -> DataFrame:
    """fps: distinct fp.  Edges a, b that connect all fingerprints linked by differing in one or two bits (a star for each shared word)."""

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b["fp"].to_numpy().view(U64)
            for low in range(0, len(fp), 4096):
                own, cell = cells(fp[low : low + 4096])
                yield batch(cell=cell, fp=own)

    def live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose cell holds another fingerprint, spread to their words."""
        told = False
        for x in runs(batches, "cell"):
            cell, fp = x["cell"].view(U64), x["fp"].view(U64)
            same = cell[1:] == cell[:-1]
            alive = np.zeros(len(cell), bool)
            alive[1:] |= same
            alive[:-1] |= same
            if x["carried"]:
                last_alive = bool(alive[0]) and not told
                alive[0] = last_alive
            told = bool(alive[-1]) if len(alive) > 1 or not x["carried"] else told
            word, of = witnesses(fp[alive], cell[alive])
            yield batch(word=word, fp=of)

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in runs(batches, "word"):
            same = x["word"][1:] == x["word"][:-1]
            yield batch(a=x["fp"][:-1][same], b=x["fp"][1:][same])

    spread = fps.mapInArrow(to_cells, "cell long, fp long").repartition("cell").sortWithinPartitions("cell")
    words = spread.mapInArrow(live, "word long, fp long").repartition("word").sortWithinPartitions("word", "fp")
    return words.mapInArrow(stars, "a long, b long").distinct()


def groups(docs: DataFrame, shingle: int = 3, keep: list[str] = ("doc_id",)) -> DataFrame:
    """keep, fp and component_id (the smallest doc_id of the fingerprints reachable by links) of every text."""
    shared_checkpoints(docs.sparkSession)
    fps = fingerprints(docs, shingle, list(dict.fromkeys([*keep, "doc_id"]))).checkpoint()
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first")).checkpoint()
    roots = components(links(first.select("fp"))).select(F.col("node").alias("fp"), "root")
    named = first.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    best = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(named.join(best, "root").select("fp", "component_id"), "fp").select(*keep, "fp", "component_id")
