"""Cross-tokenizer alignment: which tokens of a byte-level vocabulary and of a piece vocabulary cover the same bytes.

Both tokenizers encode a text with one blank before it (the piece model adds its own). Each byte gets a label: ``.`` where
no token ends, ``a`` or ``b`` where one of that tokenizer ends, ``=`` where both do. A regular expression takes the spans
up to each ``=``; the labels counted in a span say how many tokens of either side make its group. Spans of a batch are
few different strings, so each is counted once.

The last tokens of a group end together: a link. Links are counted over the corpus by id pair, pre-aggregated by document
and by task, and met again with the pairs of each document.

Defined results: a text that is null or empty, or that one of the tokenizers doesn't give back byte by byte, has no
tokens, groups or links; strings of special tokens are plain text; repeated rows count each; an empty table gives no
rows; very long texts are batched by size, whole; further columns are kept by ``align``, whatever their names, and
columns named as its own are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waybill.llm.common import Scratch, table
from waybill.llm.pieces import BYTE, MARK, MODEL, Codec, codec_of, read_model, slices
from waybill.llm.token_counts import LONG, PATTERN

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
#: Characters of text that are aligned at a time.
BATCH_CHARS = 2_000_000
#: Distinct parts whose ids a process remembers.
CACHE = 100_000
#: Counted id pairs (17 bytes each) go to all executors up to this many; more are joined by shuffle.
BROADCAST_PAIRS = 1_000_000
#: Bits of a token id within an id pair.
ID_BITS = 18

_LABELS = np.frombuffer(b".ab=", np.uint8)
_SPAN = re.compile(rb"[^=]*=")


def _byte_of_char() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others in order from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteCodec:
    """Ids of a byte-level tokenizer for " " + text.

    The file's ids are in the order of its merges (checked), so the same vocabulary as ranks gives the same tokens, several
    times faster. Long runs of white space are cut out by the pattern's own rule, see ``token_counts.count_tokens``.
    """

    def __init__(self, data: bytes):
        import tiktoken

        said = json.loads(data)
        vocabulary, merges = said["model"]["vocab"], said["model"]["merges"]
        made = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
        if made != sorted(made) or said["pre_tokenizer"]["type"] != "ByteLevel" or said["normalizer"]:
            raise ValueError("not a byte-level vocabulary in the order of its merges")
        of, plain = _byte_of_char(), {t["id"] for t in said["added_tokens"]}
        ranks = {bytes(of[c] for c in t): i for t, i in vocabulary.items() if i not in plain}
        names = {i: t for t, i in ranks.items()}
        self.enc = tiktoken.Encoding("waybill-bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.spelled = pa.array([names.get(i, b"") for i in range(max(names) + 1)], pa.large_binary())

    def encode(self, text: str) -> np.ndarray:
        out, at = [], 0
        for m in LONG.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            out += [self.enc.encode_to_numpy(text[at : m.start()], disallowed_special=()), np.array(self.enc._encode_single_piece(text[m.start() : end]), np.uint32)]
            at = end
        out.append(self.enc.encode_to_numpy(text[at:] if at else text, disallowed_special=()))
        return np.concatenate(out) if at else out[0]

    def run(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin, with the end last."""
        each = [self.encode(" " + x) for x in texts.to_pylist()]
        return np.concatenate([np.zeros(0, np.uint32), *each]).astype(np.int32), _starts(np.array([len(x) for x in each], np.int64))


_BUILT: dict[str, ByteCodec] = {}


def byte_codec_of(data: bytes) -> ByteCodec:
    key = hashlib.sha256(data).hexdigest()
    if key not in _BUILT:
        _BUILT[key] = ByteCodec(data)
    return _BUILT[key]


def piece_bytes(codec: Codec) -> pa.Array:
    """Bytes of each piece: the marker as a blank, a byte piece as its byte."""
    return pa.array([bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in codec.model.pieces], pa.large_binary())


def _starts(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


@dataclass
class Aligned:
    """Tokens and groups of a batch, document after document; ``*_at`` are where each document's begin, with the end last."""

    a: np.ndarray
    a_at: np.ndarray
    b: np.ndarray
    b_at: np.ndarray
    a_sizes: np.ndarray  # tokens of each group
    b_sizes: np.ndarray
    group_at: np.ndarray

    def links(self) -> np.ndarray:
        """An id pair for each group: the tokens that end it."""
        return self.a[np.cumsum(self.a_sizes) - 1].astype(np.int64) << ID_BITS | self.b[np.cumsum(self.b_sizes) - 1]


class _Sizes(dict):
    """Tokens that the labels of a span end: those of the first tokenizer, then those of the second."""

    def __missing__(self, span: bytes) -> tuple[int, int]:
        found = span.count(b"a") + 1, span.count(b"b") + 1
        if len(span) <= 64 and len(self) < 100_000:
            self[span] = found
        return found


class Aligner:
    def __init__(self, a: ByteCodec, b: Codec):
        self.a, self.b, self.a_bytes, self.b_bytes, self.sizes = a, b, a.spelled, piece_bytes(b), _Sizes()
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << ID_BITS:
            raise ValueError("vocabulary too large for id pairs")
        self.a_len, self.b_len = (np.asarray(pc.binary_length(x)) for x in (self.a_bytes, self.b_bytes))

    def run(self, texts: pa.Array) -> Aligned:
        """``texts``: strings without nulls."""
        a, a_at = self.a.run(texts)
        found = self.b.run(texts)
        b, b_at = found.ids, found.id_ends
        if found.order is not None:
            size = np.diff(b_at)[found.order]
            b, b_at = np.asarray(found.lists().flatten()), _starts(size)
        n = np.asarray(pc.binary_length(texts.cast(pa.large_binary()))) + 1
        ends_a, ends_b = _starts(self.a_len[a]), _starts(self.b_len[b])
        good = (n > 1) & (np.diff(ends_a[a_at]) == n) & (np.diff(ends_b[b_at]) == n)
        want = pc.binary_join_element_wise("", texts, " ").cast(pa.large_binary())
        for ids, at, ends, spelled in ((a, a_at, ends_a, self.a_bytes), (b, b_at, ends_b, self.b_bytes)):
            got, total = memoryview(spelled.take(pa.array(ids)).buffers()[2] or b""), int(n.sum())
            if good.all() and got[:total] == memoryview(want.buffers()[2])[:total]:
                continue
            for i in np.flatnonzero(good).tolist():
                good[i] = bytes(got[ends[at[i]] : ends[at[i + 1]]]) == want[i].as_py()
        if not good.all():
            a, a_at = _only(a, a_at, good)
            b, b_at = _only(b, b_at, good)
        ends_a, ends_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        ends = np.zeros(int(ends_a[-1]) if len(ends_a) else 0, np.uint8)
        ends[ends_a - 1] += 1
        ends[ends_b - 1] += 2
        labels = _LABELS[ends].tobytes()
        counted = np.array(list(map(self.sizes.__getitem__, _SPAN.findall(labels))), np.int64).reshape(-1, 2)
        a_sizes, b_sizes = counted[:, 0], counted[:, 1]
        return Aligned(a, a_at, b, b_at, a_sizes, b_sizes, np.searchsorted(np.cumsum(a_sizes), a_at, side="right"))


def _only(ids: np.ndarray, at: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(at)
    return ids[np.repeat(good, size)], _starts(np.where(good, size, 0))


def _aligner(a: bytes, b: bytes) -> Aligner:
    return Aligner(byte_codec_of(a), codec_of(b, cache=CACHE))


def _each(aligner: Aligner, batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, Aligned]]:
    for batch in batches:
        texts = batch.column(text)
        for i, j in slices(pc.utf8_length(texts).to_pylist(), BATCH_CHARS):
            yield batch.slice(i, j - i), aligner.run(texts.slice(i, j - i))
    aligner.b.forget()


def align(spark: SparkSession, docs: DataFrame, a: str = BYTE_BPE, b: str = MODEL) -> DataFrame:
    """``docs`` without text, with a_ids, b_ids (tokens) and a_sizes, b_sizes (tokens of each group in order), array<int>."""
    names = ["a_ids", "b_ids", "a_sizes", "b_sizes"]
    kept = [c for c in docs.columns if c.lower() not in ("text", *names)]
    sent = [spark.sparkContext.broadcast(read_model(spark, x)) for x in (a, b)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, found in _each(_aligner(sent[0].value, sent[1].value), batches, len(kept)):
            lists = ((found.a, found.a_at), (found.b, found.b_at), (found.a_sizes, found.group_at), (found.b_sizes, found.group_at))
            made = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.astype(np.int32))) for x, at in lists]
            yield pa.RecordBatch.from_arrays([rows.column(i) for i in range(len(kept))] + made, [*kept, *names])

    whole = docs.select(*kept, F.coalesce("text", F.lit("")).alias("text"))
    schema = docs.select(*kept, *[F.array().cast("array<int>").alias(x) for x in names]).schema
    return whole.mapInArrow(run, schema)


class _Written:
    """Groups of documents in decimal ids: ``a1,a2|b1;a3|b2,b3``."""

    def __init__(self, ids: int):
        self.table = pa.array([f"{i}{end}".encode() for i in range(ids) for end in ",|;"], pa.large_binary())

    def digests(self, found: Aligned) -> list[str]:
        order = np.arange(len(found.a) + len(found.b))
        a_ends, b_ends = np.cumsum(found.a_sizes), np.cumsum(found.b_sizes)
        a_to = order[: len(found.a)] + np.repeat(b_ends - found.b_sizes, found.a_sizes)
        b_to = order[: len(found.b)] + np.repeat(a_ends, found.b_sizes)
        codes = np.empty(len(order), np.int64)
        codes[a_to], codes[b_to] = found.a.astype(np.int64) * 3, found.b.astype(np.int64) * 3
        codes[a_to[a_ends - 1]] += 1
        codes[b_to[b_ends - 1]] += 2
        said = self.table.take(pa.array(codes))
        raw = memoryview(said.buffers()[2] or b"")
        at = np.frombuffer(said.buffers()[1], np.int64, len(codes) + 1)[found.a_at + found.b_at].tolist() if len(codes) else [0] * len(found.a_at)
        return [hashlib.sha256(raw[i : j - 1]).hexdigest() if j > i else "" for i, j in zip(at, at[1:], strict=False)]


def digests(spark: SparkSession, docs: DataFrame, a: str = BYTE_BPE, b: str = MODEL) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, and the document's links: distinct id pairs with the times each is linked."""
    sent = [spark.sparkContext.broadcast(read_model(spark, x)) for x in (a, b)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(sent[0].value, sent[1].value)
        written = _Written(max(len(aligner.a_bytes), len(aligner.b_bytes)))
        for rows, found in _each(aligner, batches, 1):
            links, groups = found.links(), np.diff(found.group_at)
            doc = np.repeat(np.arange(len(groups)), groups)
            order = np.lexsort((links, doc))
            links, doc = links[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], (links[1:] != links[:-1]) | (doc[1:] != doc[:-1])])[: len(links)])
            at = pa.array(np.searchsorted(doc[first], np.arange(len(groups) + 1)).astype(np.int32))
            times = np.diff(np.append(first, len(links))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array(np.diff(found.a_at)),
                    pa.array(np.diff(found.b_at)),
                    pa.array(groups.astype(np.int64)),
                    pa.array(written.digests(found), pa.string()),
                    pa.ListArray.from_arrays(at, pa.array(links[first])),
                    pa.ListArray.from_arrays(at, pa.array(times)),
                ],
                ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"],
            )

    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return whole.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<long>, times array<int>")


def link_counts(linked: DataFrame) -> DataFrame:
    """Over the corpus: pair, a_id, b_id, links, and whether no other pair of its b_id has more."""
    pairs = linked.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("links"))
    pairs = pairs.select("pair", F.shiftright("pair", ID_BITS).cast("int").alias("a_id"), F.col("pair").bitwiseAND((1 << ID_BITS) - 1).cast("int").alias("b_id"), "links")
    # a token of one side has the other vocabulary's size of partners at most
    return pairs.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b_id")))


def summarize(spark: SparkSession, docs: DataFrame, a: str = BYTE_BPE, b: str = MODEL, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best (links whose pair is its B token's most frequent), count_sum (of the
    links' counts over the corpus) and groups_sha256."""
    scratch = Scratch(spark)
    linked = scratch.put(digests(spark, docs, a, b).withColumn("row", F.monotonically_increasing_id()))
    counts = scratch.put(link_counts(linked))
    few = counts.count() <= broadcast_pairs
    each = linked.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), "times"))).toDF("row", "pair", "times")
    met = each.join(F.broadcast(counts) if few else counts, "pair")
    sums = met.groupBy("row").agg(F.sum(F.col("links") * F.col("times")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"))
    zero = F.lit(0).cast("long")
    return linked.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize(spark, table(spark, sf_dir, "documents"))
