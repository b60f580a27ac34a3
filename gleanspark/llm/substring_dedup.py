"""Substring dedup: word windows that an earlier document has are removed.

Every window of ``size`` consecutive words gets a Rabin-Karp hash.  Documents
are dealt out in chunks that rise with doc_id; each chunk sends its distinct
window hashes, packed, to one of many hash buckets.  A bucket counts in which
chunks a hash occurs and tells every chunk but the first one that has it (one
bit for each hash sent).  Back in the chunk, a window counts as repeated if an
earlier chunk has it or an earlier document of the same chunk; repeated windows
merge into maximal removal intervals.  A window that a third of all documents
share is sent once by each chunk, so no bucket grows with it.

A hash has 64 bits beside its bucket, which is drawn from other bits; as
buckets grow in number with the data, less than two wrong matches are expected
even over 100 TB.

Edge cases: a null or empty text has no words; a text shorter than a window
loses nothing; rows of the same doc_id don't make each other repeat; null
doc_ids come after all others and don't make each other repeat either; a very
long text makes a chunk larger, in arrays of some 60 bytes a word; an empty table
gives an empty result.  Other columns are passed on where they are asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._shards import by_id
from ._text import U64, WHITESPACE, chunks, mix, small_batches, windows, with_columns

BASE = 0x9E3779B97F4A7C15
#: Windows that one bucket holds, about.
BUCKET = 500_000


def hashed(table: pa.Table, size: int, buckets: int):
    """Texts, words, and of all windows in a chunk: hash, bucket, text and first word (counted over the chunk)."""
    parts, words_before, texts_before = [], 0, 0
    for t in chunks(table["text"]):
        w = t.words(WHITESPACE)
        h = w.hashes(3)
        win, at = windows(h, w.first, size, BASE)
        total = np.concatenate([np.zeros(1, U64), np.cumsum(h * U64(0xD6E8FEB86659FD93))])
        where = ((mix(total[at + size] - total[at]) >> U64(33)) % U64(buckets)).astype(np.int32) if len(at) else np.empty(0, np.int32)
        doc = np.searchsorted(w.first, at, "right") - 1
        parts.append((t, w, win, where, doc + texts_before, at + words_before))
        words_before += len(h)
        texts_before += len(t)
    if not parts:
        e = np.empty(0, np.int64)
        return [], np.empty(0, U64), e, e, e, 0
    return [(p[0], p[1]) for p in parts], *(np.concatenate([p[i] for p in parts]) for i in range(2, 6)), words_before


def by_bucket(where: np.ndarray, buckets: int):
    """Bucket and the windows in it, in their order."""
    order = np.argsort(where, kind="stable")
    cuts = np.searchsorted(where[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), order[cuts[b] : cuts[b + 1]]


def dedup(docs: DataFrame, size: int = 13, keep: list[str] = ("doc_id",), verbatim: bool = False) -> DataFrame:
    """keep, n_words, n_removed, kept (the other words joined by one space; with verbatim, a text that loses nothing as it
    was), spans (first and last word of each removed interval, from 0) of every document."""
    small_batches(docs.sparkSession)
    names = list(dict.fromkeys([*keep, "doc_id", "text"]))
    dealt, n, total, null_from = by_id(docs.select(*names))
    buckets = max(4, min(1 << 30, total // 6 // BUCKET))

    def send(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        _, win, where, *_ = hashed(table.select(["text"]), size, buckets)
        rows = [(b, np.unique(win[i]).astype("<u8").tobytes()) for b, i in by_bucket(where, buckets)]
        return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int32()), "chunk": pa.array([chunk] * len(rows), pa.int32()), "hashes": pa.array([h for _, h in rows], pa.binary())})

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        bucket, sent = table["bucket"][0].as_py(), table["chunk"].to_pylist()
        hashes = [np.frombuffer(x.as_buffer(), "<u8") for x in table["hashes"]]
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        new = np.ones(len(every), bool)
        new[1:] = every[order[1:]] != every[order[:-1]]
        known = np.repeat(np.array(sent) < null_from, [len(x) for x in hashes])
        again = np.zeros(len(every), bool)
        again[order] = ~new & known[order[np.maximum.accumulate(np.where(new, np.arange(len(every)), 0))]]  # null ids repeat only others
        ends = np.cumsum([len(x) for x in hashes])
        rows = [(c, np.packbits(bits).tobytes()) for c, x, e in zip(sent, hashes, ends) if (bits := again[e - len(x) : e]).any()]
        return pa.table({"chunk": pa.array([c for c, _ in rows], pa.int32()), "bucket": pa.array([bucket] * len(rows), pa.int32()), "bits": pa.array([x for _, x in rows], pa.binary())})

    def remove(table: pa.Table, told: pa.Table) -> pa.Table:
        table = table.sort_by("order_key")
        parts, win, where, doc, at, n_words = hashed(table.select(["text"]), size, buckets)
        keys = table["order_key"].to_numpy()
        rank = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])[doc] if len(keys) else doc
        bits = {b: x for b, x in zip(told["bucket"].to_pylist(), told["bits"])}
        repeated = np.zeros(len(win), bool)
        for b, i in by_bucket(where, buckets):
            values, first, which = np.unique(win[i], return_index=True, return_inverse=True)
            r = rank[i]
            flag = r > r[first][which]
            if b in bits:
                flag |= np.unpackbits(np.frombuffer(bits[b].as_buffer(), np.uint8), count=len(values)).astype(bool)[which]
            repeated[i] = flag
        edge = np.zeros(n_words + 1, np.int32)
        np.add.at(edge, at[repeated], 1)
        np.add.at(edge, at[repeated] + size, -1)
        gone = np.cumsum(edge[:-1]) > 0
        n_all, n_gone, kept, spans, before = [], [], [], [], 0
        for t, w in parts:
            for k in range(len(t)):
                g = gone[before + w.first[k] : before + w.first[k + 1]]
                words = t.text(k).split()
                lost = int(g.sum())
                if lost:
                    words = [x for x, y in zip(words, g) if not y]
                    turn = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(np.int8), [0]])))
                    spans.append([{"first": int(a), "last": int(b) - 1} for a, b in zip(turn[::2], turn[1::2])])
                else:
                    spans.append([])
                n_all.append(len(g))
                n_gone.append(lost)
                kept.append((t.text(k) if verbatim and not lost else b" ".join(words)).decode("utf-8", "replace"))
            before += len(w.starts)
        out = {k: table[k] for k in keep} | {"n_words": pa.array(n_all, pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "kept": pa.array(kept, pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))}
        return pa.table(out)

    counted = dealt.groupBy("chunk").applyInArrow(send, "bucket int, chunk int, hashes binary").repartition(max(4, buckets // 4), "bucket").groupBy("bucket").applyInArrow(count, "chunk int, bucket int, bits binary")
    told = counted.repartition(n, "chunk")
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(remove, with_columns(docs, keep, "n_words long, n_removed long, kept string, spans array<struct<first:bigint,last:bigint>>"))
