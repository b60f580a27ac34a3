"""Near copies: SimHash near-dedup for whole documents, exact at a Jaccard index.

Documents are compared by their sets of word shingles; two are near copies if
the sets' Jaccard index reaches ``similarity``, and a group is what near copies
connect.  Equal sets are one node from the start.  Candidates come from

1. SimHash: fingerprints that link in the grid of segment popcounts (``simhash``),
   which connects families of close copies by few pairs;
2. prefixes, which miss nothing: in one order of all shingles (hot ones last, else
   by hash) two sets of the similarity share one of their first shingles.  Each
   set is compared with the next one in its key's order.  Then come rounds: in a
   new random order of each key, sets meet the last sets of other parts before
   them, some for each two parts, and parts that link are one from then on; so a
   family grows together without its pairs.  When a round no longer saves more
   pairs than it costs rows, all of a key that are still apart are compared.

Every candidate pair passes three tests: the sizes, the places of the shared
shingle, and a lower bound by embedding: each set has a row of segment parities
(two segments a shingle or more), and the Hamming distance of two rows is at most
the number of shingles that only one set has.  Only then the sets themselves
are brought together and compared.  No test loses a pair of the similarity.

Hot keys are salted while neighbours are linked and in rounds; sorted rows are
read as a stream, so a task's memory doesn't grow with a key.  What stays
quadratic are sets that share a key, pass the tests and yet are not similar: each
pair of them is compared once, as nothing less shows that no link is lost.

Edge cases: a null or empty text has no shingles; such texts are copies of one
another; a text shorter than a shingle is its own; a null doc_id comes after
all others; repeated rows are copies; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shards import shared_checkpoints
from ._text import U64, WHITESPACE, Texts, chunks, small_batches, trimmed, windows, with_columns
from ..operators.components import components
from .decontaminate import few
from .simhash import SEED, batch, counts, links, majorities

BASE = 0x9E3779B97F4A7C15
#: A shingle that HOT of every SAMPLE-th set have comes last in the order of shingles.  Any such list gives the same groups.
SAMPLE, HOT, MOST_HOT = 16, 8, 200_000
#: Parts of a hot key while neighbours are linked.
SALTS = 64
#: Pairs of any two parts that the first round tries; each round doubles that, up to 2^20 times.
TRIES = 32
#: Earlier sets that a set meets in a round; rows of a key that stay together there; passes over the rows that a round costs, about.
MEET, TOGETHER, PASSES = 4, 1024, 4
#: Sets that a task remembers, so as to send copies once.
REMEMBERED = 1 << 18
NO_PLACE = (1 << 32) - 1


def sets_of(t: Texts, shingle: int) -> list[np.ndarray]:
    """Of each text the distinct 64-bit hashes of its shingles, ascending."""
    w = t.words(WHITESPACE)
    h, at = windows(w.hashes(SEED), w.first, shingle, BASE)
    cuts = np.searchsorted(at, w.first)
    out = []
    for i, n in enumerate(w.counts()):
        if n >= shingle:
            out.append(np.unique(h[cuts[i] : cuts[i + 1]]))
        else:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(t.text(i).split()), SEED)] if n else [], U64))
    return out


def node_of(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes())


def parities(hashes: np.ndarray) -> bytes:
    """Parity of the number of shingles in each segment; segments are a power of two, two a shingle or more."""
    n = 64
    while n < 2 * len(hashes):
        n *= 2
    odd = np.bincount((hashes & U64(n - 1)).astype(np.int64), minlength=n) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """At least so many shingles are in one set only.  The longer row is folded to the shorter one's segments: those share low
    bits of the hash, so rows of a segment's number modulo n add up."""
    if len(x) < len(y):
        x, y = y, x
    x = x.reshape(-1, len(y))
    return int(np.bitwise_count(np.bitwise_xor.reduce(x, axis=0) ^ y).sum())


def once(batches: Iterator[pa.RecordBatch], shingle: int, each: int = 1) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Node and set of texts, of every each-th node; copies within a task are left out, as far as it remembers."""
    seen: set[int] = set()
    for b in trimmed(batches):
        for t in chunks(b["text"], lower=True, most=1 << 20):
            out = []
            for h in sets_of(t, shingle):
                node = node_of(h)
                if node % each == 0 and node not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(node)
                    out.append((node, h))
            yield out


def described(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_key, node, size, fp (the set's SimHash) and parities of every document."""
    source = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in trimmed(batches):
            for t in chunks(b["text"], lower=True, most=1 << 20):
                sets = sets_of(t, shingle)
                sizes = np.array([len(x) for x in sets], np.int64)
                fp = majorities(counts(np.concatenate([*sets, np.empty(0, U64)]), np.concatenate([[0], np.cumsum(sizes)])))
                node = np.array([node_of(x) for x in sets], U64)
                own = [b[k].slice(t.rows.start, len(t)) for k in ("doc_id", "text_key")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(node.view(np.int64)), pa.array(sizes), pa.array(fp.view(np.int64)), pa.array([parities(x) for x in sets], pa.binary())], ["doc_id", "text_key", "node", "size", "fp", "parities"])

    return source.mapInArrow(run, with_columns(source, ["doc_id", "text_key"], "node long, size long, fp long, parities binary"))


def hot_shingles(docs: DataFrame, shingle: int) -> np.ndarray:
    """Shingles of many sets, by every SAMPLE-th set; bounded by MOST_HOT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in once(batches, shingle, SAMPLE):
            yield batch(key=np.concatenate([np.empty(0, U64), *(h for _, h in found)]))

    tally = docs.select("text").mapInArrow(run, "key long").groupBy("key").count().where(F.col("count") >= HOT)
    found = tally.orderBy(F.desc("count"), "key").limit(MOST_HOT).select("key").collect()
    return np.sort(np.array([r["key"] for r in found], np.int64).view(U64))


def among(h: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which of h the ascending array holds."""
    if not len(ordered):
        return np.zeros(len(h), bool)
    return ordered[np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)] == h


def prefixes(docs: DataFrame, shingle: int, similarity: float, hot: np.ndarray) -> DataFrame:
    """key, salt, meta (the set's size << 32 | the shingle's place in the order), node of the shingles in sets' prefixes."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in once(batches, shingle):
            key, salt, meta, nodes = ([np.empty(0, U64)] for _ in range(4))
            for node, h in found:
                late = among(h, sent.value)
                n = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1 if len(h) else 0
                first = np.concatenate([h[~late], h[late]])[:n]
                is_hot = np.arange(len(first)) >= len(h) - int(late.sum())
                key.append(first)
                salt.append(np.where(is_hot, 1 + node % SALTS, 0).astype(U64))
                meta.append(U64(len(h) << 32) | np.arange(len(first), dtype=U64))
                nodes.append(np.full(len(first), node, U64))
            yield batch(key=np.concatenate(key), salt=np.concatenate(salt), meta=np.concatenate(meta), node=np.concatenate(nodes))

    return docs.select("text").mapInArrow(run, "key long, salt long, meta long, node long")


def may_link(m1: np.ndarray, m2: np.ndarray, similarity: float) -> np.ndarray:
    """By sizes, and by places: no shingle before a pair's first shared one is shared."""
    (n1, p1), (n2, p2) = (((m >> U64(32)).astype(np.int64), (m & U64(NO_PLACE)).astype(np.int64)) for m in (m1, m2))
    need = np.ceil(similarity / (1 + similarity) * (n1 + n2) - 1e-9)
    return (np.minimum(n1, n2) >= similarity * np.maximum(n1, n2) - 1e-9) & (np.minimum(n1 - p1, n2 - p2) >= need)


def may_link_columns(m1: Column, m2: Column, similarity: float) -> Column:
    """may_link in SQL."""
    n1, n2 = F.shiftright(m1, 32), F.shiftright(m2, 32)
    left = lambda m, n: n - m.bitwiseAND(F.lit(NO_PLACE))
    need = F.ceil(F.lit(similarity / (1 + similarity)) * (n1 + n2) - 1e-9)
    return (F.least(n1, n2) >= F.lit(similarity) * F.greatest(n1, n2) - 1e-9) & (F.least(left(m1, n1), left(m2, n2)) >= need)


def neighbours(rows: DataFrame, similarity: float) -> DataFrame:
    """rows: key, salt, meta, node.  Those whose key another node has too (or may have: salt above 0), each once, with next_node:
    the next in the order of its key and salt, if the two may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shared = {k: np.empty(0, U64) for k in ("key", "salt", "meta", "node")}, False

        def out(x: dict[str, np.ndarray], same: np.ndarray, n: int) -> pa.RecordBatch:
            """The first n rows of x; same: of each row whether the row after it has its key and salt."""
            before = np.concatenate([[shared], same])[:n]
            ok = (before | same[:n] if len(same) >= n else before) | (x["salt"][:n] > 0)
            pair = np.zeros(n, bool)
            m = min(n, len(same))
            pair[:m] = same[:m] & may_link(x["meta"][:m], x["meta"][1 : m + 1], similarity)
            after = np.zeros(n, np.int64)
            after[:m] = x["node"][1 : m + 1].view(np.int64)
            cols = [pa.array(x[k][:n][ok].view(np.int64)) for k in ("key", "salt", "meta", "node")]
            return pa.RecordBatch.from_arrays([*cols, pa.array(after[ok], mask=~pair[ok])], ["key", "salt", "meta", "node", "next_node"])

        for b in trimmed(batches):
            x = {k: np.concatenate([held[k], b[k].to_numpy().view(U64)]) for k in held}
            new = np.ones(len(x["key"]), bool)
            new[1:] = (x["key"][1:] != x["key"][:-1]) | (x["node"][1:] != x["node"][:-1])
            x = {k: v[new] for k, v in x.items()}
            if not len(x["key"]):
                continue
            same = (x["key"][1:] == x["key"][:-1]) & (x["salt"][1:] == x["salt"][:-1])
            yield out(x, same, len(same))
            shared = bool(same[-1]) if len(same) else shared
            held = {k: v[-1:] for k, v in x.items()}
        if len(held["key"]):
            yield out(held, np.empty(0, bool), 1)

    return rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "meta", "node").mapInArrow(run, "key long, salt long, meta long, node long, next_node long")


def strangers(rows: DataFrame, similarity: float) -> DataFrame:
    """rows: key, salt, band, dice, meta, node, root.  Pairs a, b of nodes with the lesser and greater root: in the order of key, salt,
    band and dice each row and the last MEET before its run of equal roots, as far as roots differ and the two may link."""
    names = ["key", "salt", "meta", "node", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: np.empty(0, U64) for k in names}  # of the last key and salt the last rows of the last run, and the last before it
        for b in trimmed(batches):
            if not len(b):
                continue
            known = len(held["key"])
            x = {k: np.concatenate([held[k], b[k].to_numpy().view(U64)]) for k in names}
            at = np.arange(len(x["key"]))
            new = np.ones(len(at), bool)
            new[1:] = (x["key"][1:] != x["key"][:-1]) | (x["salt"][1:] != x["salt"][:-1])
            turn = new.copy()
            turn[1:] |= x["root"][1:] != x["root"][:-1]
            first, start = (np.maximum.accumulate(np.where(k, at, 0)) for k in (new, turn))
            for back in range(1, MEET + 1):
                mine = at[(start - back >= first) & (at >= known)]
                other = start[mine] - back
                ok = (x["root"][mine] != x["root"][other]) & may_link(x["meta"][mine], x["meta"][other], similarity)
                (n1, r1), (n2, r2) = ((x["node"][i[ok]].view(np.int64), x["root"][i[ok]].view(np.int64)) for i in (mine, other))
                yield batch(a=np.minimum(n1, n2), b=np.maximum(n1, n2), low=np.minimum(r1, r2), high=np.maximum(r1, r2))
            keep = np.append(at[max(first[-1], start[-1] - MEET) : start[-1]], at[max(start[-1], len(at) - MEET) :])
            held = {k: v[keep] for k, v in x.items()}

    dealt = rows.repartition("key", "salt").sortWithinPartitions("key", "salt", "band", "dice", "node")
    return dealt.mapInArrow(run, "a long, b long, low long, high long")


def pairs_of(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


class Sets:
    """What is known of all sets: the described documents (checkpointed), and the texts."""

    def __init__(self, docs: DataFrame, shingle: int, similarity: float):
        self.docs, self.shingle, self.similarity = docs, shingle, similarity
        self.rows = described(docs, shingle).checkpoint()
        one = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_key")
        self.first = self.rows.groupBy("node").agg(F.min(one).alias("first"), F.min("size").alias("size"), F.min("fp").alias("fp")).checkpoint()

    def both(self, pairs: DataFrame, known: DataFrame, names: list[str]) -> DataFrame:
        """pairs a, b with the named columns of known for either node, as of_a_… and of_b_…"""
        for side in "ab":
            pairs = pairs.join(known.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in names]), side)
        return pairs

    def nodes_of(self, pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct().checkpoint()
        return few(asked, asked.count())

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of the distinct pairs a, b of nodes those whose sets have the similarity."""
        similarity, shingle = self.similarity, self.shingle

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in trimmed(batches):
                far = [apart(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) for x, y in zip(b["parities_a"], b["parities_b"])]
                total = b["size_a"].to_numpy() + b["size_b"].to_numpy()
                yield b.select(["a", "b"]).filter(pa.array(np.array(far, np.int64) <= (1 - similarity) / (1 + similarity) * total + 1e-9))

        def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found in once(batches, shingle):
                yield pa.RecordBatch.from_arrays([pa.array(np.array([n for n, _ in found], U64).view(np.int64)), pa.array([h.astype("<u8").tobytes() for _, h in found], pa.binary())], ["node", "hashes"])

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in trimmed(batches):
                ok = []
                for x, y in zip(b["hashes_a"], b["hashes_b"]):
                    both = np.sort(np.concatenate([np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")]))
                    same = int((both[1:] == both[:-1]).sum())
                    ok.append(same >= similarity * (len(both) - same) - 1e-9)
                yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        pairs = pairs.checkpoint()
        maps = self.rows.join(self.nodes_of(pairs), "node", "left_semi").groupBy("node").agg(F.min("size").alias("size"), F.first("parities").alias("parities"))
        pairs = self.both(pairs, maps, ["size", "parities"]).mapInArrow(bound, "a long, b long").checkpoint()
        homes = self.first.join(self.nodes_of(pairs), "node", "left_semi").select(F.col("first.doc_id").alias("i"), F.col("first.text_key").alias("k")).checkpoint()
        keyed = self.docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
        texts = keyed.join(few(homes, homes.count()), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k")), "left_semi").select("text")
        known = texts.mapInArrow(hashes, "node long, hashes binary").dropDuplicates(["node"]).checkpoint()
        return self.both(pairs, known, ["hashes"]).mapInArrow(exact, "a long, b long").checkpoint()


def by_fingerprint(sets: Sets) -> DataFrame:
    """Pairs a, b of nodes whose SimHash fingerprints are equal or link; a chain for each fingerprint, and one for each link."""
    own = sets.first.select(F.col("fp").alias("key"), F.lit(0).cast("long").alias("salt"), (F.shiftleft(F.col("size"), 32)).alias("meta"), "node")
    chain = neighbours(own, sets.similarity).where("next_node is not null").select(*pairs_of(F.col("node"), F.col("next_node")))
    heads = sets.first.groupBy("fp").agg(F.min("node").alias("node")).checkpoint()
    linked = links(heads.select("fp")).withColumnsRenamed({"a": "fa", "b": "fb"})
    for side in "ab":
        linked = linked.join(heads.select(F.col("fp").alias(f"f{side}"), F.col("node").alias(f"n{side}")), f"f{side}")
    return chain.union(linked.select(*pairs_of(F.col("na"), F.col("nb")))).distinct()


def rooted(live: DataFrame, roots: DataFrame) -> DataFrame:
    """live (key, meta, node) with root, in keys that hold more than one."""
    told = live.select("key", "meta", "node").join(roots, "node", "left").select("key", "meta", "node", F.coalesce("root", "node").alias("root")).checkpoint()
    open_ = told.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return told.join(open_, "key", "left_semi").checkpoint()


def early(told: DataFrame, similarity: float) -> DataFrame:
    """Rows whose place lets them link to a set of their size."""
    return told.where(may_link_columns(F.col("meta"), F.col("meta"), similarity))


def to_come(told: DataFrame) -> tuple[int, float]:
    """Rows, and pairs of rows that share a key and are of two roots."""
    n = told.groupBy("key", "root").agg(F.count(F.lit(1)).cast("double").alias("n"))
    by_key = n.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    rows, pairs = by_key.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2)).first()
    return int(rows or 0), pairs or 0.0


def tries(told: DataFrame, asked: DataFrame, turn: int, similarity: float) -> DataFrame:
    """Pairs a, b for the round of that number: some for any two parts that meet in a key, none of those that were asked."""
    rows = early(told, similarity)
    large = rows.groupBy("key").count().where(F.col("count") > TOGETHER).checkpoint()
    salt = F.coalesce(F.pmod(F.xxhash64(F.lit(2 * turn + 1), "node"), F.ceil(F.col("count") / TOGETHER)), F.lit(0).cast("long"))
    # sizes of a band are near enough for a link
    band = F.floor(4 * F.log2(F.greatest(F.shiftright("meta", 32), F.lit(1).cast("long"))))
    rows = rows.join(few(large, large.count()), "key", "left").select("key", salt.alias("salt"), band.alias("band"), F.xxhash64(F.lit(2 * turn), "key", "node").alias("dice"), "meta", "node", "root")
    found = strangers(rows, similarity).distinct().join(asked, ["a", "b"], "left_anti")
    place = F.pmod(F.xxhash64(F.lit(turn), "a", "b"), F.lit(TRIES << min(turn, 20)))
    return found.groupBy("low", "high", place).agg(F.min(F.struct("a", "b")).alias("pair")).select("pair.a", "pair.b").checkpoint()


def similar(sets: Sets) -> DataFrame:
    """node and root: what pairs of the similarity connect."""
    docs, similarity = sets.docs, sets.similarity
    edges = sets.verified(by_fingerprint(sets))
    roots = components(edges)
    live = neighbours(prefixes(docs, sets.shingle, similarity, hot_shingles(docs, sets.shingle)), similarity).checkpoint()
    ends = [roots.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root")) for k in "ab"]

    def still_apart(pairs: DataFrame) -> DataFrame:
        """Pairs whose nodes no edge connects so far."""
        for k, side in zip("ab", ends):
            pairs = pairs.join(side, k, "left")
        return pairs.where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")

    asked = still_apart(live.where("next_node is not null").select(*pairs_of(F.col("node"), F.col("next_node"))).distinct()).checkpoint()
    edges = edges.union(sets.verified(asked))
    told = rooted(live, components(edges))
    rows, left = to_come(early(told, similarity))
    for turn in itertools.count():
        if left <= rows:
            break
        tried = tries(told, asked, turn, similarity)
        edges, asked, before = edges.union(sets.verified(tried)), asked.union(tried), left
        told = rooted(told, components(edges))
        rows, left = to_come(early(told, similarity))
        if before - left < PASSES * rows:
            break
    x, y = told.alias("x"), told.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.root") < F.col("y.root")) & may_link_columns(F.col("x.meta"), F.col("y.meta"), similarity))
    rest = met.select(*pairs_of(F.col("x.node"), F.col("y.node"))).distinct().join(asked, ["a", "b"], "left_anti")
    return components(edges.union(sets.verified(rest)))


def leaving(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """gone_id and gone_key (xxhash64 of the text) of the documents that go: all of a group of near copies but the one with the
    smallest doc_id (and, of rows of that id, the smallest key).  Rows of equal id and text are not told apart."""
    shared_checkpoints(docs.sparkSession)
    small_batches(docs.sparkSession)
    sets = Sets(docs, shingle, similarity)
    named = sets.first.join(similar(sets), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    best = named.groupBy("root").agg(F.min("first").alias("best"))
    stays = named.join(best, "root").select("node", "best")
    other = ~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key")))
    return sets.rows.select("doc_id", "text_key", "node").join(stays, "node").where(other).select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key")).distinct()
