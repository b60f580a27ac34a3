"""Language-model scoring from a log-frequency Bloom filter.

Counts of words and word pairs are taken over all training texts: each worker
sends what it counted, packed, to hash buckets, which add up.  Counts are then
quantised to a logarithmic scale, and a key whose count has level q is put into
a Bloom filter q times, as (key, 1) to (key, q).  Reading a count is a run of
membership probes up to the first miss.  The scale starts at count 1 and the
filter grows with the corpus, ten bits for each insertion, so whatever was seen
in training is in it.  Each bucket owns one segment of the filter and fills it
alone, so building it moves no key again.  Up to ``filter_bytes`` the filter is
broadcast; beyond, each chunk of texts sends its distinct keys to the segments
and gets a byte for each back, with the same scores, and its words' exact counts.

The probability of a word after a word is the discounted pair count by the
first word's count, plus the weight that discounting left times the word's
add-half probability; all counts come from probes.

The exact base score uses exact counts: while the filter is broadcast, the
``head_words`` most frequent words are too (a bounded table) and the rarer words of
each text are joined with their counts.  Beyond, the buckets that hold the segments answer them.

Edge cases: a null or empty text is one end token; without training texts all
counts are 0; repeated rows each give their row; a null doc_id is never held
out; a very long text is a chunk of its own, in arrays of some 100 bytes a word;
an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shards import shared_checkpoints
from ._text import U64, WHITESPACE, Texts, Words, chunks, mix, small_batches, trimmed, with_columns

END = U64(0x5E7D0FE4D)
#: The counts from which words may be head words.
CUTS = sorted({int(round(2 ** (i / 2))) for i in range(84)})
SCALE = 1.5
PROBES = 4
BITS_EACH = 10
DISCOUNT = 0.75
#: Discounted counts are whole numbers of such parts.
PARTS = 4
#: Tokens that a worker counts before it sends.
TOKENS = 1_000_000
#: Tokens of the corpus for each bucket, about.
BUCKET = 500_000
PAIRS, CONTEXTS = U64(0x9B1A5C0D), U64(0x3C6EF372)


def tokens(t: Texts) -> tuple[np.ndarray, np.ndarray, Words]:
    """Hashes of all words and ends, and where each text's tokens begin."""
    w = t.words(WHITESPACE)
    return np.insert(w.hashes(1), w.first[1:], END), w.first + np.arange(len(w.first)), w


def pairs(tok: np.ndarray) -> np.ndarray:
    """Keys of each token after the one before it (an end before the first)."""
    before = np.concatenate([np.array([END], U64), tok[:-1]]) if len(tok) else tok
    return (before & U64(0xFFFFFFFF)) << U64(32) | (tok & U64(0xFFFFFFFF))


def bucket_of(keys: np.ndarray, salt: U64, n: int) -> np.ndarray:
    """A word and the context it makes (the word's low half) share a bucket, so one question asks for both."""
    if salt != PAIRS:
        keys, salt = keys & U64(0xFFFFFFFF), U64(0)
    return ((mix(keys ^ salt) >> U64(20)) % U64(n)).astype(np.int64)


def short(keys: np.ndarray, salt: U64) -> np.ndarray:
    """What a bucket knows a key by: 32 bits, independent of the bucket.  With some 400,000 keys in a bucket an unseen key meets
    a seen one with 0.0001, against 0.01 of the filter itself."""
    return mix(mix(keys ^ salt) ^ U64(0x2545F4914F6CDD1D)) >> U64(32)


def dealt(keys: np.ndarray, salt: U64, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has keys, and where they are, in their order."""
    b = bucket_of(keys, salt, n)
    order = np.argsort(b.astype(np.uint16) if n <= 1 << 16 else b, kind="stable")
    cuts = np.searchsorted(b[order], np.arange(n + 1))
    for i in np.flatnonzero(np.diff(cuts)):
        yield int(i), order[cuts[i] : cuts[i + 1]]


def levels(counts: np.ndarray, least: float) -> np.ndarray:
    """Quantised counts: 0 below least, then one more for each factor of SCALE."""
    c = np.asarray(counts, float)
    return np.where(c < least, 0, 1 + np.floor(np.log(np.maximum(c, least) / least) / math.log(SCALE) + 1e-9)).astype(np.int64)


def value_of(q: np.ndarray, least: float) -> np.ndarray:
    """The count that a level stands for: the mean of its whole numbers, geometric where they are many."""
    low = least * SCALE ** (np.maximum(q, 1) - 1.0)
    first, last = np.ceil(low - 1e-9), np.ceil(low * SCALE - 1e-9) - 1
    return np.where(q == 0, 0.0, np.where(first < 50, (first + np.maximum(last, first)) / 2, low * math.sqrt(SCALE)))


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their summed counts."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.empty(0, np.int64)
    return k[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0]


class Filter:
    """n segments, of the same number of bits or of one for each; a key's bits lie in the segment of its bucket."""

    def __init__(self, segments: int, bits: int | np.ndarray, data: np.ndarray):
        self.segments, self.data = segments, data
        self.bits = np.broadcast_to(np.asarray(bits, np.int64), segments)
        self.first = np.concatenate([[0], np.cumsum(self.bits // 8)])

    @staticmethod
    def places(keys: np.ndarray, salt: U64, level: np.ndarray | int, bits: int | np.ndarray) -> Iterator[np.ndarray]:
        a = mix(keys ^ mix(salt + np.atleast_1d(np.asarray(level, U64)) * U64(0x9E3779B97F4A7C15)))
        step = (a >> U64(32)) | U64(1)
        for j in range(PROBES):
            yield (mix(a + step * U64(j)) % np.asarray(bits, U64)).astype(np.int64)

    @classmethod
    def filled(cls, parts: list[tuple[np.ndarray, U64, np.ndarray]], bits: int) -> bytes:
        """One segment, from (keys, salt, levels)."""
        on = np.zeros(bits, bool)
        for keys, salt, q in parts:
            for level in range(1, int(q.max(initial=0)) + 1):
                for at in cls.places(keys[q >= level], salt, level, bits):
                    on[at] = True
        return np.packbits(on, bitorder="little").tobytes()

    @classmethod
    def sized(cls, parts: list[tuple[np.ndarray, U64, np.ndarray]]) -> bytes:
        """One segment with BITS_EACH bits for each insertion."""
        return cls.filled(parts, max(512, -(-sum(int(q.sum()) for *_, q in parts) * BITS_EACH // 8) * 8))

    def read(self, keys: np.ndarray, salt: U64, owner: U64, owned: np.ndarray | None = None) -> np.ndarray:
        """Levels of the keys; owned: their buckets, where the keys don't tell."""
        q = np.zeros(len(keys), np.int64)
        todo = np.arange(len(keys))
        owned = bucket_of(keys, owner, self.segments) if owned is None else owned
        base, bits = self.first[owned], self.bits[owned]
        level = 1
        while len(todo):
            own, b = keys[todo], base[todo]
            ok = np.ones(len(todo), bool)
            live = np.arange(len(todo))
            for at in self.places(own, salt, level, bits[todo]):
                at = at[live]
                live = live[self.data[b[live] + (at >> 3)] >> (at & 7).astype(np.uint8) & 1 == 1]
                if not len(live):
                    break
            ok[:] = False
            ok[live] = True
            todo = todo[ok]
            q[todo] = level
            level += 1
        return q


class Asked:
    """The distinct words and pairs of tokens, and which of them each token is."""

    def __init__(self, tok: np.ndarray):
        self.words, self.which = np.unique(tok, return_inverse=True)
        self.pairs, self.pair = np.unique(pairs(tok), return_inverse=True)

    def keys(self) -> list[tuple[np.ndarray, U64]]:
        """What the filters are asked, with the salt of each: words, words as contexts, pairs."""
        return [(self.words, U64(0)), (self.words & U64(0xFFFFFFFF), CONTEXTS), (self.pairs, PAIRS)]


class Model:
    """filter and contexts are None where they exceed the broadcast bound; then segments has them: bucket, main, words, word_n, side."""

    def __init__(self, tokens: int, types: int, filter_: Filter | None, contexts: Filter | None, head: tuple[np.ndarray, np.ndarray], buckets: int, segments: DataFrame | None = None):
        self.tokens, self.types, self.filter, self.contexts, self.head, self.buckets, self.segments = tokens, types, filter_, contexts, head, buckets, segments

    def __getstate__(self) -> dict:
        return self.__dict__ | {"segments": None}

    def exact(self, words: np.ndarray) -> np.ndarray:
        """Counts of head words, 0 for others."""
        keys, counts = self.head
        if not len(keys):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(keys, words), len(keys) - 1)
        return np.where(keys[at] == words, counts[at], 0)

    def levels(self, asked: Asked) -> list[np.ndarray]:
        """Of asked.keys(), from filters that were broadcast."""
        return [f.read(short(k, salt), salt, salt, bucket_of(k, salt, f.segments)) for f, (k, salt) in zip((self.filter, self.contexts, self.filter), asked.keys())]

    def log10(self, asked: Asked, q: list[np.ndarray]) -> np.ndarray:
        """Of all tokens the model's log10 probability; q: levels of asked.keys()."""
        which = asked.which
        total = self.tokens + 0.5 * (self.types + 1)
        count, kept, seen = (value_of(x, 1.0) for x in q)
        alone = (count + 0.5) / total
        kept /= PARTS
        kept[count == 0] = 0
        before = np.concatenate([[np.searchsorted(asked.words, END)], which[:-1]])
        p = alone[which]
        h = np.flatnonzero((kept[before] > 0) & (count[which] > 0))  # only after words that have pairs in the filter
        c, s = count[before[h]], kept[before[h]]
        c = np.maximum(c, s + DISCOUNT)
        p[h] = np.maximum(np.minimum(seen[asked.pair[h]], c) - DISCOUNT, 0) / c + (1 - s / c) * p[h]
        return np.log10(np.minimum(p, 1.0))


def binary(x: np.ndarray) -> bytes:
    return x.astype("<u8").tobytes()


def array(x: pa.Scalar | bytes) -> np.ndarray:
    return np.frombuffer(x.as_buffer() if isinstance(x, pa.Scalar) else x, "<u8")


def learn(texts: DataFrame, filter_bytes: int = 16 << 20, head_words: int = 1 << 19) -> tuple[Model, DataFrame]:
    """texts: text of all training documents.  The model, and the exact counts of the words outside its head: word, c.
    filter_bytes: up to which the filter is broadcast; it holds all that was seen at any size."""
    spark = texts.sparkSession
    small_batches(spark)
    shared_checkpoints(spark)
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(4, int(size) // 6 // BUCKET)
    tasks = max(4, n // 3)  # several buckets for each, which evens them out

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        pair: list[np.ndarray] = []

        def send() -> pa.RecordBatch:
            rows = {}
            for kind, found, salt in ((0, held, U64(0)), (1, pair, PAIRS)):
                keys, c = np.unique(np.concatenate(found), return_counts=True)
                for i, at in dealt(keys, salt, n):
                    rows.setdefault(i, [b"", b"", b"", b""])[2 * kind : 2 * kind + 2] = [binary(keys[at]), c[at].astype("<u4").tobytes()]
            held.clear()
            pair.clear()
            cols = [pa.array(list(rows), pa.int32()), *(pa.array([r[j] for r in rows.values()], pa.binary()) for j in range(4))]
            return pa.RecordBatch.from_arrays(cols, ["bucket", "words", "word_n", "pairs", "pair_n"])

        for b in trimmed(batches):
            for t in chunks(b["text"], lower=True):
                tok, *_ = tokens(t)
                held.append(tok)
                pair.append(pairs(tok))
                if sum(map(len, held)) > TOKENS:
                    yield send()
        if held:
            yield send()

    def add(table: pa.Table) -> pa.Table:
        sums = []
        for keys, numbers in (("words", "word_n"), ("pairs", "pair_n")):
            k = np.concatenate([array(x) for x in table[keys]])
            c = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table[numbers]]).astype(np.int64)
            sums.append(added(k, c))
        (word, word_n), (pair, pair_n) = sums
        q = levels(pair_n, 1.0)
        main = Filter.sized([(short(word, U64(0)), U64(0), levels(word_n, 1.0)), (short(pair, PAIRS), PAIRS, q)])
        before, kept = added(pair >> U64(32), value_of(q, 1.0) - DISCOUNT)
        row = {"words": binary(word), "word_n": binary(word_n), "word_kept": [int((word_n >= t).sum()) for t in CUTS], "main": main, "before": before.astype("<u4").tobytes(), "kept": kept.astype("<f4").tobytes()}
        columns = {k: pa.array([v], pa.binary() if isinstance(v, bytes) else pa.list_(pa.int64())) for k, v in row.items()}
        return pa.table({"bucket": table["bucket"].slice(0, 1), **columns, "n": pa.array([int(word_n.sum())], pa.int64()), "types": pa.array([len(word)], pa.int64())})

    sent = texts.select("text").mapInArrow(count, "bucket int, words binary, word_n binary, pairs binary, pair_n binary")
    blobs = "words binary, word_n binary, word_kept array<bigint>, main binary, before binary, kept binary"
    counted = sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(add, f"bucket int, {blobs}, n long, types long").checkpoint()

    sums = [F.sum(x) for x in ("n", "types")] + [F.sum(F.octet_length("main"))] + [F.sum(F.col("word_kept")[i]) for i in range(len(CUTS))]
    n_tokens, types, main_bytes, *word_kept = (int(x or 0) for x in counted.agg(*sums).first())
    at_head = next(i for i, x in enumerate(word_kept) if x <= head_words or i == len(CUTS) - 1)
    head_from = CUTS[at_head]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            for k, c in zip(b["before"], b["kept"]):
                k, c = np.frombuffer(k.as_buffer(), "<u4").astype(U64), np.frombuffer(c.as_buffer(), "<f4")
                rows = [(i, k[at].astype("<u4").tobytes(), c[at].tobytes()) for i, at in dealt(k, CONTEXTS, n)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "keys", "sums"])

    def context_segment(table: pa.Table) -> pa.Table:
        k = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table["keys"]]).astype(U64)
        k, c = added(k, np.concatenate([np.frombuffer(x.as_buffer(), "<f4") for x in table["sums"]]).astype(float))
        return pa.table({"bucket": table["bucket"].slice(0, 1), "side": pa.array([Filter.sized([(short(k, CONTEXTS), CONTEXTS, levels(c * PARTS, 1.0))])], pa.binary())})

    def gathered(rows: list) -> Filter:
        parts = [bytes(64)] * n
        for i, bits in rows:
            parts[i] = bits
        return Filter(n, np.array([len(x) * 8 for x in parts]), np.frombuffer(b"".join(parts), np.uint8))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            for k, c in zip(b["words"], b["word_n"]):
                k, c = array(k), array(c)
                yield pa.RecordBatch.from_arrays([pa.array([binary(k[c >= head_from])], pa.binary()), pa.array([binary(c[c >= head_from])], pa.binary())], ["k", "c"])

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            for k, c in zip(b["words"], b["word_n"]):
                k, c = array(k), array(c)
                yield pa.RecordBatch.from_arrays([pa.array(k[c < head_from].view(np.int64)), pa.array(c[c < head_from].astype(np.int64))], ["word", "c"])

    moved = counted.select("before", "kept").mapInArrow(contexts, "bucket int, keys binary, sums binary").repartition(tasks, "bucket")
    sides = moved.groupBy("bucket").applyInArrow(context_segment, "bucket int, side binary").checkpoint()
    main = side = segments = None
    if main_bytes + int(sides.agg(F.sum(F.octet_length("side"))).first()[0] or 0) <= filter_bytes:
        main, side = (gathered(x.collect()) for x in (counted.select("bucket", "main"), sides.select("bucket", "side")))
    else:
        segments = counted.select("bucket", "main", "words", "word_n").join(sides, "bucket", "full")
    # bounded: head_words words
    head = counted.select("words", "word_n").mapInArrow(frequent, "k binary, c binary").collect()
    keys = np.concatenate([array(r["k"]) for r in head]) if head else np.empty(0, U64)
    c = np.concatenate([array(r["c"]) for r in head]).astype(np.int64) if head else np.empty(0, np.int64)
    order = np.argsort(keys)
    # what the counts and contexts shuffled is used up, and its files go once nothing refers to it
    del sent, moved
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return Model(n_tokens, types, main, side, (keys[order], c[order]), n, segments), counted.select("words", "word_n").mapInArrow(rare, "word long, c long")


def score(docs: DataFrame, model: Model, rest: DataFrame, keep: list[str] = ("doc_id",)) -> DataFrame:
    """keep, n_tokens, n_known, train_tokens, base_score and score of every text.  rest: word and c as learn() gives them."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    source = docs.select(*keep, "text")

    def row(t: Texts, own: list[pa.Array], q: list[np.ndarray] | None = None, exact: np.ndarray | None = None) -> pa.RecordBatch:
        """exact: counts of the asked words; without them only the head's are known, and the others are listed as rare."""
        m: Model = sent.value
        tok, first, _ = tokens(t)
        asked = Asked(tok)
        log_p, which, whole = m.log10(asked, q or m.levels(asked)), asked.which, exact is not None
        doc = np.repeat(np.arange(len(t)), np.diff(first))
        known = (exact if whole else m.exact(asked.words))[which]
        base = np.bincount(doc, np.where(whole | (known > 0), np.log10(known + 0.5), 0.0), len(t))
        tail = np.flatnonzero(known == 0)[: 0 if whole else None]
        # each text's rarer words, once each with how often
        order = tail[np.lexsort((tok[tail], doc[tail]))]
        new = np.flatnonzero(np.concatenate([[True], (np.diff(doc[order]) != 0) | (tok[order][1:] != tok[order][:-1])])) if len(order) else order
        lists = np.searchsorted(doc[order][new], np.arange(len(t) + 1))
        rare = pa.StructArray.from_arrays([pa.array(tok[order][new].view(np.int64)), pa.array(np.diff(np.append(new, len(order))).astype(np.int64))], ["word", "times"])
        cols = [
            pa.array(np.diff(first).astype(np.int64)),
            pa.array(np.bincount(doc, known > 0, len(t)).astype(np.int64)),
            pa.array(base),
            pa.array(np.bincount(doc, log_p, len(t))),
            pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), rare),
            pa.array([hash_of(t.text(i)) for i in range(len(t))], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays([*own, *cols], [*keep, "n_tokens", "head_known", "head_base", "score", "rare", "text_hash"])

    def hash_of(text: bytes) -> int:
        return xxhash.xxh64_intdigest(text, 11) - (1 << 63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            for t in chunks(b["text"], lower=True):
                yield row(t, [b[k].slice(t.rows.start, len(t)) for k in keep])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Texts, pa.RecordBatch]]:
        """Chunks with an id, which is the same in both reads of docs (or nothing is found, and homes() fails)."""
        part, k = TaskContext.get().partitionId(), 0
        for b in trimmed(batches):
            for t in chunks(b["text"], lower=True):
                yield xxhash.xxh64_intdigest(t.data, part << 32 | k) - (1 << 63), t, b
                k += 1

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, t, _ in numbered(batches):
            rows: dict[int, list[bytes]] = {}
            asked = Asked(tokens(t)[0])
            for i, at in dealt(asked.words, U64(0), n):  # whole, for their exact counts
                rows.setdefault(i, [b"", b""])[0] = binary(asked.words[at])
            for i, at in dealt(asked.pairs, PAIRS, n):
                rows.setdefault(i, [b"", b""])[1] = short(asked.pairs[at], PAIRS).astype("<u4").tobytes()
            cols = [pa.array([r[j] for r in rows.values()], pa.binary()) for j in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), pa.array(np.full(len(rows), chunk)), *cols], ["bucket", "chunk", "words", "pairs"])

    def answers(asking: pa.Table, segment: pa.Table) -> pa.Table:
        out: list[list[bytes]] = [[] for _ in range(asking.num_rows)]

        def told(found: np.ndarray, parts: list[np.ndarray]) -> None:
            for o, x in zip(out, np.split(found, np.cumsum([len(x) for x in parts])[:-1])):
                o.append(x.tobytes())

        for name, bits, salt in (("words", "main", U64(0)), ("before", "side", CONTEXTS), ("pairs", "main", PAIRS)):
            parts = [np.frombuffer(x.as_buffer(), "<u4" if name == "pairs" else "<u8") for x in asking["pairs" if name == "pairs" else "words"]]
            keys = np.concatenate(parts).astype(U64) if parts else np.empty(0, U64)
            data = segment[bits][0].as_py() if segment.num_rows else None
            if name == "words":
                own, n_own = (array(segment[c][0]) if data is not None else np.zeros(1, U64) for c in ("words", "word_n"))
                at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                counts = np.where(own[at] == keys, n_own[at], 0).astype("<u8")
                told(counts if data is not None else counts * U64(0), parts)
            keys = {"words": lambda: short(keys, salt), "before": lambda: short(keys & U64(0xFFFFFFFF), salt), "pairs": lambda: keys}[name]()
            q = np.zeros(len(keys), np.uint8) if data is None else Filter(1, len(data) * 8, np.frombuffer(data, np.uint8)).read(keys, salt, salt, np.zeros(len(keys), np.int64)).astype(np.uint8)
            told(q, parts)
        return pa.table({"chunk": asking["chunk"], "bucket": asking["bucket"], **{k: pa.array([o[j] for o in out], pa.binary()) for j, k in enumerate(("counts", "words", "before", "pairs"))}})

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A chunk's rows as one compressed message."""
        for chunk, t, b in numbered(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_batch(b.slice(t.rows.start, len(t)))
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "rows"])

    def finish(home: pa.Table, answer: pa.Table) -> pa.Table:
        home = pa.ipc.open_stream(home["rows"][0].as_buffer()).read_all().combine_chunks()
        (t,) = chunks(home["text"], lower=True, most=1 << 40, rows=1 << 40)
        got = {b: i for i, b in enumerate(answer["bucket"].to_pylist())}
        asked, q = Asked(tokens(t)[0]), []
        exact = np.zeros(len(asked.words), np.int64)
        for (keys, salt), name in zip(asked.keys(), ("words", "before", "pairs")):
            q.append(np.zeros(len(keys), np.int64))
            for i, at in dealt(keys, salt, n):
                q[-1][at] = np.frombuffer(answer[name][got[i]].as_buffer(), np.uint8)
                if name == "words":
                    exact[at] = np.frombuffer(answer["counts"][got[i]].as_buffer(), "<u8")
        return pa.Table.from_batches([row(t, [home[k].combine_chunks() for k in keep], q, exact)])

    out_schema = with_columns(source, keep, "n_tokens long, head_known long, head_base double, score double, rare array<struct<word:bigint,times:bigint>>, text_hash long")
    if model.segments is None:
        scored = source.mapInArrow(run, out_schema)
    else:
        n = model.buckets
        tasks = max(4, n // 3)
        asking = source.mapInArrow(probes, "bucket int, chunk long, words binary, pairs binary").repartition(tasks, "bucket").groupBy("bucket")
        answered = asking.cogroup(model.segments.repartition(tasks, "bucket").groupBy("bucket")).applyInArrow(answers, "chunk long, bucket int, counts binary, words binary, before binary, pairs binary")
        named = source.mapInArrow(homes, "chunk long, rows binary")
        scored = named.repartition(tasks, "chunk").groupBy("chunk").cogroup(answered.repartition(tasks, "chunk").groupBy("chunk")).applyInArrow(finish, out_schema)
    total = math.log10(model.tokens + 0.5 * (model.types + 1))
    train = F.lit(model.tokens).cast("long").alias("train_tokens")
    less = F.col("n_tokens") * F.lit(total)
    if model.segments is not None:
        return scored.select(*keep, "n_tokens", F.col("head_known").alias("n_known"), train, (F.col("head_base") - less).alias("base_score"), "score")
    # one row for the text itself (0 times a word drawn from the text, so that such rows don't meet), one for each rarer word; rows
    # of one text and id come together again
    own = F.array(F.struct(F.col("text_hash").alias("word"), F.lit(0).cast("long").alias("times")))
    rows = scored.select(*keep, "n_tokens", "head_known", "head_base", "score", "text_hash", F.explode(F.concat(own, "rare")).alias("r"))
    c = F.coalesce("c", F.lit(0))
    joined = rows.select("*", "r.word", "r.times").drop("r").join(rest, "word", "left")
    sums = joined.groupBy(*keep, "text_hash", "n_tokens", "head_known").agg(
        F.sum((F.col("times") == 0).cast("long")).alias("copies"), F.max("head_base").alias("head_base"), F.max("score").alias("score"),
        F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"), F.sum(F.col("times") * F.log10(c + 0.5)).alias("rare_base"),
    )
    sums = sums.select("*", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return sums.select(
        *keep, "n_tokens", (F.col("head_known") + (F.col("rare_known") / F.col("copies")).cast("long")).alias("n_known"), train,
        (F.col("head_base") + F.col("rare_base") / F.col("copies") - less).alias("base_score"), "score",
    )
