"""Exact self-join of word-shingle sets by Jaccard similarity, with set-relation skipping.

The links are exactly the pairs of sets with ``of * |A & B| >= at_least * |A | B|``; what skips work never drops one.

1. Rare first. Every shingle is counted over all documents, as sorted 38-bit prints packed by deltas. What comes of the
   counts has a fixed size whatever the input: a bitmap of cells that hold a repeated shingle (8 MB) and the most
   frequent prints with their magnitude (5 MB). They only order the shingles; any order gives the same links, and a full
   bitmap costs time, not results.
2. Index. In that order two linked sets share a shingle of their prefixes. Shingles that only one set has fill a prefix
   but are no postings, so a text that nothing resembles has none. Equal sequences of words are one set.
3. Index-level skipping. A list is sorted by size; from its position in two sets a shingle bounds their overlap, which
   gives each set one range of sizes to look at. Everything outside is skipped unread.
4. Answer-level skipping. Short lists give all their pairs. A long list (a large group of near copies, or a shingle that
   many texts share) first gives a chain of pairs only. Sets that these link belong to one component whatever else
   links them: the answer of one holds for all, and later rounds look at pairs of components only. Each set carries a
   parity sketch, whose differing bits bound the difference of two sets from below. What a set's sketch says of another
   component follows from its leader's: if the leaders differ by more than both components' spread and the threshold
   allow, none of their members is looked at. Of the pairs left, each component gives its nearest few a round, more in
   the next where few of them link, until no pair that the bounds allow is unknown.
5. Texts that occur in a pair are written once and compared in groups by leader, one text in memory at a time.

Defined results: a word is a run of characters other than ASCII white space, A-Z lower-cased. A text with fewer words
than a shingle is one shingle as a whole; a null text or one without words has an empty set and links with nothing. The
component id is the smallest doc_id of the component; null doc_ids count as larger than all and give null only where
there is no other. Repeated doc_ids with different texts are different documents. Shingles are compared by 64-bit hash,
sets of words by 128 bits. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm.common import Scratch, connected_components, free, give_back, table

#: Bits of a print, of which the first BUCKET_BITS choose the bucket and the rest fit in 32 bits.
PRINT_BITS, BUCKET_BITS, CELL_BITS = 38, 6, 26
FREQUENT, MOST_FREQUENT = 16, 1 << 19
#: Lists up to this length give all pairs at once.
SHORT = 24
#: Up to this many sets of words (16 bytes each) are broadcast to fetch their texts; beyond it they are joined by shuffle.
BROADCAST_SETS = 500_000
SHINGLES_AT_A_TIME = 2_000_000
#: Most bits of a parity sketch (a narrower one bounds less and loses nothing); sets of a list that one task holds.
MOST_BITS, BLOCK = 2048, 4096
_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """Word to 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def _give_back() -> None:
    """Nothing of a task stays in the worker, which later stages use again."""
    _HASHES.clear()
    give_back()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def shingles(words: list[bytes], k: int) -> np.ndarray:
    """Hashes of all shingles of one text in order, repeats included."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    m = min(k, n)
    h = w[: n - m + 1].copy()
    for j in range(1, m):
        h *= _P
        h += w[j : n - m + 1 + j]
    return _finish(h + np.uint64(m))


def prefix_length(n: int, at_least: int, of: int) -> int:
    return n - -(-at_least * n // of) + 1


def required(a, b, at_least: int, of: int):
    """Least overlap of linked sets of these sizes; works on arrays too."""
    return -(-at_least * (a + b) // (at_least + of))


def _pack(values: np.ndarray) -> bytes:
    """Sorted uint32 values as deltas in byte planes: high planes are nearly all zero and compress to nothing."""
    return np.diff(values, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.uint64).astype(np.uint32)


class Frequencies:
    """What orders the shingles: cells with a repeated shingle, and magnitudes of the most frequent prints."""

    def __init__(self, cells: np.ndarray, prints: np.ndarray, levels: np.ndarray):
        self.cells, self.prints, self.levels = cells, prints, levels

    def level(self, h: np.ndarray) -> np.ndarray:
        """0: in no other set. 1: perhaps in others. From 2: frequent, by magnitude."""
        cell = h >> np.uint64(64 - CELL_BITS)
        out = ((self.cells[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1).astype(np.int64)
        some = np.flatnonzero(out)
        if len(self.prints) and len(some):
            p = h[some] >> np.uint64(64 - PRINT_BITS)
            at = np.minimum(np.searchsorted(self.prints, p), len(self.prints) - 1)
            hit = self.prints[at] == p
            out[some[hit]] = self.levels[at[hit]]
        return out


def count_shingles(spark: SparkSession, docs: DataFrame, k: int) -> Frequencies:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            p = np.sort(np.concatenate(held) >> np.uint64(64 - PRINT_BITS)) if held else np.zeros(0, np.uint64)
            held.clear()
            low = PRINT_BITS - BUCKET_BITS
            edges = np.searchsorted(p, np.arange((1 << BUCKET_BITS) + 1, dtype=np.uint64) << np.uint64(low))
            full = np.flatnonzero(np.diff(edges))
            packed = [_pack((p[edges[i] : edges[i + 1]] & np.uint64((1 << low) - 1)).astype(np.uint32)) for i in full]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(packed, pa.binary())], ["bucket", "packed"])

        n = 0
        for batch in batches:
            for x in batch.column(0):
                h = shingles(words_of(x.as_py()), k)
                held.append(h)
                n += len(h)
                if n > SHINGLES_AT_A_TIME:
                    yield flush()
                    n = 0
        yield flush()
        _give_back()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts.setdefault(b, []).append(packed)
        for b, packed in sorted(parts.items()):
            values, counts = np.unique(np.concatenate([_unpack(x) for x in packed]), return_counts=True)
            low = PRINT_BITS - BUCKET_BITS
            again = values[counts > 1]
            cells = np.zeros(1 << (CELL_BITS - BUCKET_BITS), np.uint8)
            cells[(again >> np.uint32(low - (CELL_BITS - BUCKET_BITS))).astype(np.int64)] = 1
            often = np.flatnonzero(counts >= FREQUENT)
            most = MOST_FREQUENT >> BUCKET_BITS
            if len(often) > most:
                often = np.sort(often[np.argpartition(counts[often], -most)[-most:]])
            levels = np.log2(counts[often] / FREQUENT).astype(np.int8) + 2
            yield pa.RecordBatch.from_arrays(
                [pa.array([b], pa.int32()), pa.array([np.packbits(cells, bitorder="little").tobytes()], pa.binary()), pa.array([values[often].tobytes()], pa.binary()), pa.array([levels.astype(np.int8).tobytes()], pa.binary())],
                ["bucket", "cells", "prints", "levels"],
            )
        _give_back()

    found = docs.select("text").mapInArrow(run, "bucket int, packed binary").repartition("bucket").mapInArrow(merge, "bucket int, cells binary, prints binary, levels binary")
    cells = np.zeros(1 << (CELL_BITS - 3), np.uint8)
    prints, levels, size = [], [], len(cells) >> BUCKET_BITS
    for r in sorted(found.collect(), key=lambda r: r.bucket):  # 64 rows of fixed size
        cells[r.bucket * size : (r.bucket + 1) * size] = np.frombuffer(r.cells, np.uint8)
        prints.append(np.frombuffer(r.prints, np.uint32).astype(np.uint64) | (np.uint64(r.bucket) << np.uint64(PRINT_BITS - BUCKET_BITS)))
        levels.append(np.frombuffer(r.levels, np.int8).astype(np.int64))
    empty = np.zeros(0, np.uint64)
    return Frequencies(cells, np.concatenate([empty, *prints]), np.concatenate([empty.astype(np.int64), *levels]))


def index(spark: SparkSession, docs: DataFrame, freq: Frequencies, k: int, at_least: int, of: int) -> DataFrame:
    """One row per document (doc_id, d, size) and one per posting of its prefix (shingle, d, size, place)."""
    shared = spark.sparkContext.broadcast(freq)
    names = ["doc_id", "shingle", "d", "size", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, seen = shared.value, set()
        for batch in batches:
            ds, sizes, out = [], [], ([], [], [], [])
            for x in batch.column(1):
                words = words_of(x.as_py())
                h = np.unique(shingles(words, k))
                d, n = digest(words), len(h)
                ds.append(d)
                sizes.append(n)
                if not n or d in seen:
                    continue
                seen.add(d)
                p = prefix_length(n, at_least, of)
                lv = freq.level(h)
                alone = int((lv == 0).sum())
                if alone >= p:
                    continue
                # h is sorted, so a stable sort by level orders by (level, hash)
                at = np.argsort(lv, kind="stable")[alone:p]
                out[0].append(h[at].view(np.int64))
                out[1].extend([d] * len(at))
                out[2].append(np.full(len(at), n, np.int32))
                out[3].append(np.arange(alone, p, dtype=np.int32))
            m = len(ds)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.nulls(m, pa.int64()), pa.array(ds, pa.binary()), pa.array(sizes, pa.int32()), pa.nulls(m, pa.int32())], names)
            if out[0]:
                s = np.concatenate(out[0])
                yield pa.RecordBatch.from_arrays([pa.nulls(len(s), batch.column(0).type), pa.array(s), pa.array(out[1], pa.binary()), pa.array(np.concatenate(out[2])), pa.array(np.concatenate(out[3]))], names)
        seen.clear()
        _give_back()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, shingle bigint, d binary, size int, place int")


def _lists(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[tuple[np.ndarray, ...]]:
    """Groups of two rows or more with equal first columns, from rows sorted by them, as arrays."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(rest, cols, strict=True)]
        if not len(cols[0]):
            continue
        cuts = np.flatnonzero(np.logical_or.reduce([s[1:] != s[:-1] for s in cols[:keys]])) + 1
        starts = np.concatenate([[0], cuts])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b - a > 1:
                yield tuple(c[a:b] for c in cols)
        rest = [c[starts[-1] :] for c in cols]
    if rest is not None and len(rest[0]) > 1:
        yield tuple(rest)


def _once(d: np.ndarray, *others: np.ndarray) -> list[np.ndarray]:
    """Rows of a list (sorted by size, d) without repeats of a set."""
    keep = np.concatenate([[True], d[1:] != d[:-1]])
    return [x[keep] for x in (d, *others)]


def _reach(size: np.ndarray, place: np.ndarray, at_least: int, of: int) -> np.ndarray:
    """Largest size of a partner that the position of the shingle allows each set of a list."""
    return ((at_least + of) * (size - place) - at_least * size) // at_least


def candidates(postings: DataFrame, at_least: int, of: int) -> DataFrame:
    """All pairs (a, b) of short lists, chains and stars through long ones; rows of long lists, with shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shingle", "a", "b", "size", "place"]
        pairs: set[tuple[bytes, bytes]] = set()

        def flush() -> pa.RecordBatch:
            x = sorted(pairs)
            pairs.clear()
            n = len(x)
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array([p[0] for p in x], pa.binary()), pa.array([p[1] for p in x], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32())], names)

        for s, d, size, place in _lists(batches):
            d, size, place = _once(d, size, place)
            m = len(d)
            if m < 2:
                continue
            size, place = size.astype(np.int64), place.astype(np.int64)
            reach = _reach(size, place, at_least, of)
            if m <= SHORT:
                for i in range(m - 1):
                    top = int(np.searchsorted(size, reach[i], "right"))
                    for j in range(i + 1, top):
                        if size[i] <= reach[j]:
                            pairs.add((d[i], d[j]) if d[i] < d[j] else (d[j], d[i]))
            else:
                # a chain, and a star within every SHORT neighbours
                for i in range(1, m):
                    for j in {i - 1, i - i % SHORT}:
                        if j < i and size[i] <= reach[j] and size[j] <= reach[i]:
                            pairs.add((d[i], d[j]) if d[i] < d[j] else (d[j], d[i]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, s[0])), pa.array(d, pa.binary()), pa.nulls(m, pa.binary()), pa.array(size.astype(np.int32)), pa.array(place.astype(np.int32))], names)
            if len(pairs) > 200_000:
                yield flush()
        yield flush()

    dealt = postings.select("shingle", "d", "size", "place").repartition("shingle").sortWithinPartitions("shingle", "size", "d", "place")
    return dealt.mapInArrow(run, "shingle bigint, a binary, b binary, size int, place int")


def parity_bits(size: np.ndarray) -> np.ndarray:
    """Bits of the sketch of a set, a power of two: wider ones can be folded to narrower ones."""
    return np.minimum(MOST_BITS, np.maximum(256, 1 << np.ceil(np.log2(np.maximum(1, 4 * size))).astype(np.int64)))


def size_class(at_least: int, of: int) -> str:
    """SQL of a set's class of sizes: linked sets are of one class or of two neighbouring ones."""
    return f"cast(floor(ln(size) / {max(math.log(of / at_least), 0.05) * 1.001!r}D) as int)"


def sketches(texts: DataFrame, k: int) -> DataFrame:
    """(d, bits): for each of 2**i places the parity of the number of shingles that hash there, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                h = np.unique(shingles(words_of(x.as_py()), k))
                m = int(parity_bits(np.array(len(h))))
                out.append(np.packbits((np.bincount((h & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["d", "bits"])
        _give_back()

    return texts.select("d", "text").mapInArrow(run, "d binary, bits binary")


def _folded(bits: list[bytes]) -> np.ndarray:
    """Sketches of a cell as rows of 64-bit words, wider ones folded to the width of the narrowest."""
    width = min(map(len, bits))
    out = np.empty((len(bits), width // 8), np.uint64)
    for i, x in enumerate(bits):
        w = np.frombuffer(x, np.uint64)
        while len(w) > width // 8:
            w = w[: len(w) // 2] ^ w[len(w) // 2 :]
        out[i] = w
    return out


def _differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each row of a and each of b."""
    return np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(2, dtype=np.int64)


def open_pairs(sk: np.ndarray, size: np.ndarray, place: np.ndarray, comp: np.ndarray, home: np.ndarray, side: np.ndarray | None, at_least: int, of: int, tries: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places (i, j) of sets of two components that may link: for each component its ``tries`` nearest pairs with others of
    the cell, and whether there are more. ``comp`` is sorted. ``side``: only pairs across two blocks count.
    """
    limit = lambda a, b: (of - at_least) * (a + b) // (of + at_least)
    reach = _reach(size, place, at_least, of)
    starts = np.flatnonzero(np.concatenate([[True], comp[1:] != comp[:-1]]))
    ends = np.concatenate([starts[1:], [len(comp)]])
    lead = sk[starts]
    # how far members are from their leader, and how large they get
    spread = np.maximum.reduceat(np.bitwise_count(sk ^ np.repeat(lead, ends - starts, axis=0)).sum(1, dtype=np.int64), starts)
    most = np.maximum.reduceat(size, starts)
    which = np.repeat(np.arange(len(starts)), ends - starts)
    held, n, more = [], 0, False
    for g in range(len(starts) - 1):
        apart = np.bitwise_count(lead[g + 1 :] ^ lead[g]).sum(1, dtype=np.int64)
        near = np.zeros(len(starts), bool)
        near[g + 1 :] = apart - spread[g + 1 :] - spread[g] <= limit(most[g + 1 :], most[g])
        if not near.any():
            continue
        others = np.flatnonzero(near[which])
        step = max(1, 4_000_000 // (len(others) * sk.shape[1]))
        for a in range(starts[g], ends[g], step):
            mine = np.arange(a, min(a + step, ends[g]))
            h = _differ(sk[mine], sk[others])
            s, t = size[mine][:, None], size[others][None, :]
            ok = (h <= limit(s, t)) & (t <= reach[mine][:, None]) & (s <= reach[others][None, :]) & (home[mine][:, None] | home[others][None, :])
            if side is not None:
                ok &= side[mine][:, None] != side[others][None, :]
            i, j = np.nonzero(ok)
            held.append(np.stack([mine[i], others[j], h[i, j]]))
            n += len(i)
            if n > 1_000_000:
                every = np.concatenate(held, axis=1)
                held, n = [_nearest(every, which, tries)], 0
                more |= held[0].shape[1] < every.shape[1]
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), False
    every = np.concatenate(held, axis=1)
    best = _nearest(every, which, tries)
    return best[0], best[1], more or best.shape[1] < every.shape[1]


def _nearest(pairs: np.ndarray, comp: np.ndarray, tries: int) -> np.ndarray:
    """Of pairs (i, j, difference), those among the ``tries`` nearest of the component of either end."""
    keep = np.zeros(pairs.shape[1], bool)
    for end in (0, 1):
        c = comp[pairs[end]]
        at = np.lexsort((pairs[1], pairs[0], pairs[2], c))
        first = np.flatnonzero(np.concatenate([[True], c[at][1:] != c[at][:-1]]))
        rank = np.arange(len(at)) - np.repeat(first, np.diff([*first, len(at)]))
        keep[at[rank < tries]] = True
    return pairs[:, keep]


def cells(spread: DataFrame, at_least: int, of: int) -> DataFrame:
    """Rows of long lists dealt into cells of a bounded number of sets: a list is cut by classes of sizes, a class meets
    itself and the next one, and where that is more than BLOCK sets, blocks of it meet two by two."""
    cls = F.expr(size_class(at_least, of))
    # a set is at home in its class and a visitor in the one below
    met = spread.withColumn("c", cls).select("*", F.explode(F.array(F.struct(F.col("c").alias("cls"), F.lit(True).alias("home")), F.struct((F.col("c") - 1).alias("cls"), F.lit(False).alias("home")))).alias("at")).select("shingle", "d", "size", "place", "bits", "at.cls", "at.home")
    large = met.groupBy("shingle", "cls").agg(F.count("*").alias("n"), F.max("home").alias("any")).where("any").select("shingle", "cls", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    met = met.join(large, ["shingle", "cls"])
    mine = F.pmod(F.xxhash64("d"), F.col("blocks")).cast("int")
    met = met.withColumn("side", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select("shingle", "cls", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "home", "d", "size", "place", "bits")


def across(dealt: DataFrame, parts: DataFrame, at_least: int, of: int, tries: int) -> DataFrame:
    """Pairs (a, b) that the cells leave open between sets of two components, and a row without them where a component
    has more than it gave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: set[tuple[bytes, bytes]] = set()
        cut = False

        def flush() -> pa.RecordBatch:
            x = sorted(pairs)
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in x], pa.binary()) for i in range(2)], ["a", "b"])

        for _, _, lo, hi, side, home, d, size, place, bits, root in _lists(batches, 4):
            ids = {x: i for i, x in enumerate(sorted(set(root)))}
            if len(ids) < 2:
                continue
            comp = np.fromiter((ids[x] for x in root), np.int64, len(root))
            size, place = size.astype(np.int64), place.astype(np.int64)
            order = np.lexsort((np.arange(len(d)), size, comp))
            i, j, more = open_pairs(
                _folded([bits[x] for x in order]), size[order], place[order], comp[order], home[order].astype(bool), side[order] if lo[0] != hi[0] else None, at_least, of, tries
            )
            cut |= more
            names = d[order]
            pairs.update((names[x], names[y]) if names[x] < names[y] else (names[y], names[x]) for x, y in zip(i, j, strict=True))
            if len(pairs) > 100_000:
                yield flush()
        yield flush()
        if cut:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary())] * 2, ["a", "b"])
        _give_back()

    keys = ["shingle", "cls", "lo", "hi"]
    led = dealt.join(parts.withColumnRenamed("node", "d"), "d", "left").withColumn("root", F.coalesce("root", "d"))
    rows = led.select(*keys, "side", "home", "d", "size", "place", "bits", "root").repartition(*keys).sortWithinPartitions(*keys, "size", "d")
    return rows.mapInArrow(run, "a binary, b binary").distinct()


def compare(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Overlap of each pair (a, b): a, b, overlap, size_a, size_b. Texts are met in groups by a, one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, last = None, None, None
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for g, d, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if (g, d) == last:
                    continue  # a text that was written twice
                last = (g, d)
                h = np.unique(shingles(words_of(text.as_py()), k))
                if g != key:
                    key, held = g, h
                    continue
                both = np.concatenate([held, h])
                both.sort()
                for x, v in zip(out, (g, d, int((both[1:] == both[:-1]).sum()), len(held), len(h)), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.binary()), *(pa.array(x, pa.int64()) for x in out[2:])], ["a", "b", "overlap", "size_a", "size_b"])
        _give_back()

    # the leader of a group comes first
    members = pairs.select(F.col("a").alias("g"), F.lit(1).alias("part"), F.col("b").alias("d")).unionByName(pairs.select(F.col("a").alias("g"), F.lit(0).alias("part"), F.col("a").alias("d")).distinct())
    dealt = members.join(texts, "d").select("g", "part", "d", "text").repartition("g").sortWithinPartitions("g", "part", "d")
    return dealt.mapInArrow(run, "a binary, b binary, overlap bigint, size_a bigint, size_b bigint")


def fetch(spark: SparkSession, docs: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(d, text) of the wanted sets (d, doc_id: one document that has it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([digest(words_of(x.as_py())) for x in batch.column(1)], pa.binary())], ["doc_id", "text", "d"])

    kind = dict(docs.dtypes)["doc_id"]
    keyed = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, d binary")
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_SETS else wanted
    w = side.select(F.col("d").alias("wd"), F.col("doc_id").alias("wid"))
    return scratch.put(keyed.join(w, (keyed["d"] == w["wd"]) & keyed["doc_id"].eqNullSafe(w["wid"])).select("d", "text"))


def contract(spark: SparkSession, parts: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Components (node, root) after further links (a, b): only the roots they join are met again."""
    if parts is None:
        return connected_components(spark, links, scratch)
    for end in ("a", "b"):
        links = links.join(parts.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    ends = links.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    joined = connected_components(spark, ends, scratch)
    moved = parts.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    out = scratch.put(moved.unionByName(joined.join(parts.select("node"), "node", "left_anti")).coalesce(spark.sparkContext.defaultParallelism))
    scratch.drop(joined, parts)
    return out


def link(spark: SparkSession, docs: DataFrame, k: int = 5, at_least: int = 80, of: int = 100, scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """members (doc_id, d, size) and components (node, root) of the sets that have a link."""
    scratch = scratch or Scratch(spark)
    # tables of a few numbers a row: as many files as there are cores, whatever the number of partitions before
    cores = spark.sparkContext.defaultParallelism
    small = lambda df: scratch.put(df.coalesce(cores))
    freq = count_shingles(spark, docs, k)
    indexed = scratch.put(index(spark, docs, freq, k, at_least, of))
    members = small(indexed.where("shingle is null").select("doc_id", "d", "size"))
    listed = scratch.put(candidates(indexed.where("shingle is not null"), at_least, of))
    scratch.drop(indexed)
    pairs = listed.where("b is not null").select("a", "b").distinct()
    long_lists = listed.where("shingle is not null").select("shingle", F.col("a").alias("d"), "size", "place")
    wanted = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).unionByName(long_lists.select(F.col("d").alias("a"))).distinct()
    one = members.groupBy("d").agg(F.min("doc_id").alias("doc_id"))
    wanted = small(one.join(wanted.withColumnRenamed("a", "d"), "d"))
    texts = fetch(spark, docs, wanted, scratch)
    scratch.drop(wanted)

    linked = F.expr(f"{of} * overlap >= {at_least} * (size_a + size_b - overlap)")
    tried = scratch.put(compare(pairs, texts, k))
    parts = contract(spark, None, tried.where(linked), scratch)
    # lists whose sets are all of one component are answered
    led = long_lists.join(parts.withColumnRenamed("node", "d"), "d", "left").withColumn("root", F.coalesce("root", "d"))
    unanswered = led.groupBy("shingle").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("shingle")
    kept = small(long_lists.join(unanswered, "shingle"))
    bits = sketches(texts.join(kept.select("d").distinct(), "d", "left_semi"), k)
    dealt = scratch.put(cells(kept.join(bits, "d"), at_least, of))
    scratch.drop(listed, kept)
    seen, tries = [tried], 1
    while True:
        found = small(across(dealt, parts, at_least, of, tries))
        known = seen[0].select("a", "b")
        for t in seen[1:]:
            known = known.unionByName(t.select("a", "b"))
        tried = small(compare(found.where("a is not null").join(known, ["a", "b"], "left_anti"), texts, k))
        asked, new, cut = tried.count(), tried.where(linked).count(), not found.where("a is null").isEmpty()
        scratch.drop(found)
        if not asked and not cut:
            break
        if new:
            parts = contract(spark, parts, tried.where(linked), scratch)
        seen.append(tried)
        if 2 * new <= asked:
            tries *= 8
    scratch.drop(*seen, tried, dealt, texts)
    return members, parts


def components(spark: SparkSession, docs: DataFrame, k: int = 5, at_least: int = 80, of: int = 100) -> DataFrame:
    """One row per document: doc_id, d (digest of its words), n_shingles, component_id."""
    members, parts = link(spark, docs, k, at_least, of)
    sets = members.where("size > 0").groupBy("d").agg(F.min("doc_id").alias("least")).join(parts.withColumnRenamed("node", "d"), "d", "left").withColumn("root", F.coalesce("root", "d"))
    least = sets.groupBy("root").agg(F.min("least").alias("component_id"))
    named = sets.join(least, "root").select("d", "component_id")
    return members.join(named, "d", "left").select("doc_id", "d", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def deduplicate(spark: SparkSession, docs: DataFrame, k: int = 5, at_least: int = 80, of: int = 100) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id (nulls last), then smallest digest.

    Documents without words stay. Repeated rows are one document, also where no other is like it.
    """
    scratch = Scratch(spark)
    members, parts = link(spark, docs, k, at_least, of, scratch)
    named = members.where("size > 0").groupBy("doc_id", "d").agg(F.count("*").alias("rows")).join(parts.withColumnRenamed("node", "d"), "d", "left").withColumn("root", F.coalesce("root", "d"))
    best = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "d")).alias("best"))
    judged = named.join(best, "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("d") == F.col("best.d")))
    name, d, i = (free(x, docs.columns) for x in ("_digest", "_d", "_id"))
    judged = scratch.put(judged.select(F.col("d").alias(d), F.col("doc_id").alias(i), F.col("rows").alias("n_rows"), F.col("stays").alias("one_stays")))
    scratch.drop(members, parts)
    out = judged.where("not one_stays").select(d, i)
    keyed = _with_digest(docs, name)
    side = F.broadcast(out) if out.count() <= BROADCAST_SETS else out
    same = (F.col(name) == F.col(d)) & F.col("doc_id").eqNullSafe(F.col(i))
    kept = keyed.join(side, same, "left_anti")
    again = judged.where("one_stays and n_rows > 1").select(d, i)
    if not again.isEmpty():
        # rows that are repeated whole: one of each
        twice = same
        once = kept.join(again, twice, "left_semi").dropDuplicates([name, "doc_id"])
        kept = kept.join(again, twice, "left_anti").unionByName(once)
    return kept.select(*docs.columns)


def _with_digest(docs: DataFrame, name: str) -> DataFrame:
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([digest(words_of(x.as_py())) for x in batch.column(at)], pa.binary())], [*names, name])

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(None).cast("binary")).schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark, table(spark, sf_dir, "documents"), k=4, at_least=85, of=100).drop("d")


SQL = r"""
WITH texts AS (SELECT DISTINCT list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
ids AS (SELECT w, row_number() OVER () AS tid FROM texts),
docs AS (SELECT d.doc_id, i.tid FROM documents d JOIN ids i ON i.w = list_filter(regexp_split_to_array(translate(coalesce(d.text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')),
sets AS (
  SELECT DISTINCT tid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS s FROM ids),
numbered AS MATERIALIZED (SELECT tid, hash(s) AS s FROM sets),
sizes AS MATERIALIZED (SELECT tid, count(*) AS n FROM numbered GROUP BY tid),
freq AS (SELECT s, count(*) AS f FROM numbered GROUP BY s),
ranked AS (
  SELECT x.tid, x.s, z.n, row_number() OVER (PARTITION BY x.tid ORDER BY f.f, x.s) AS place
  FROM numbered x JOIN freq f ON f.s = x.s JOIN sizes z ON z.tid = x.tid),
prefixes AS MATERIALIZED (SELECT tid, s, n FROM ranked WHERE place <= n - (85 * n + 99) // 100 + 1),
pairs AS MATERIALIZED (SELECT DISTINCT a.tid AS a, b.tid AS b FROM prefixes a JOIN prefixes b ON a.s = b.s AND a.tid < b.tid AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n),
shared AS (SELECT p.a, p.b, count(*) AS o FROM pairs p JOIN numbered x ON x.tid = p.a JOIN numbered y ON y.tid = p.b AND y.s = x.s GROUP BY p.a, p.b),
links AS MATERIALIZED (
  SELECT o.a, o.b FROM shared o JOIN sizes x ON x.tid = o.a JOIN sizes y ON y.tid = o.b WHERE 100 * o.o >= 85 * (x.n + y.n - o.o)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  WITH RECURSIVE r(tid, other) AS (SELECT tid, tid FROM sizes UNION SELECT r.tid, l.b FROM r JOIN both_ways l ON l.a = r.other)
  SELECT * FROM r),
least AS (SELECT r.tid, min(d.doc_id) AS component_id FROM reached r JOIN docs d ON d.tid = r.other GROUP BY r.tid)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, CASE WHEN z.n IS NULL THEN d.doc_id ELSE l.component_id END AS component_id
FROM docs d LEFT JOIN sizes z ON z.tid = d.tid LEFT JOIN least l ON l.tid = d.tid
"""
