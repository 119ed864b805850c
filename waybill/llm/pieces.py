"""SentencePiece models on the tokenizers library: parse the model file, rebuild it, encode and decode in batches.

The protobuf is read field by field: pieces with scores and kinds, the model type, and the normaliser's settings. From
these come the normaliser (precompiled character map, white space rules, dummy prefix), the metaspace marker, the
model (unigram scores, or BPE merges ranked by score) with byte fallback, and the decoder. Control pieces are never
produced from a text, as in the original. Where no piece holds the marker after another character, texts are cut before
runs of the marker, which cannot change the result and lets equal words be encoded once.

Defined results: a null or empty text has no ids and decodes to an empty text; a null id list decodes to null; an empty
table gives no rows; repeated rows and texts are encoded one by one; a column named as the ids is replaced; very long
texts are batched by size. Texts that hold the marker itself decode with spaces, as in
the original.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm.common import give_back, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Characters of text that are encoded at a time; encodings take many times the space of the text.
BATCH_CHARS = 4_000_000
#: Distinct parts that a process remembers.
CACHE = 300_000


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    def of_kind(self, kind: int) -> list[int]:
        return [i for i, p in enumerate(self.pieces) if p[2] == kind]


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        out |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return out, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError(f"wire type {wire}")
        yield tag >> 3, value


def parse(data: bytes) -> Model:
    """Model file to its parts; fields that don't bear on encoding are skipped."""
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    m.kind = v
                elif n == 35:
                    m.byte_fallback = bool(v)
                elif n == 24 and v:
                    raise ValueError("white space as suffix isn't supported")
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.dummy_prefix = bool(v)
                elif n == 4:
                    m.squeeze = bool(v)
                elif n == 5:
                    m.escape = bool(v)
    return m


def model_of(m: Model, cache: int = CACHE):
    """The tokenizers model: scores for unigram, merges ranked by score for BPE."""
    from tokenizers import models

    unknown = m.of_kind(UNKNOWN)[0]
    if m.kind == UNIGRAM:
        low = min((s for _, s, k in m.pieces if k == NORMAL), default=0.0)
        return models.Unigram([(p, s if k in (NORMAL, USER) else low - 1e4) for p, s, k in m.pieces], unknown, m.byte_fallback)
    if m.kind == BPE:
        ids = {p: i for i, (p, _, k) in enumerate(m.pieces) if k in (NORMAL, USER)}
        ranked = sorted(((s, p) for p, s, k in m.pieces if k in (NORMAL, USER) and len(p) > 1), key=lambda x: (-x[0], ids[x[1]]))
        merges = [(p[:i], p[i:]) for _, p in ranked for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids]
        return models.BPE({p: i for i, (p, _, _) in enumerate(m.pieces)}, merges, unk_token=m.pieces[unknown][0], fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=cache)
    raise ValueError(f"model type {m.kind}")


def parts_are_independent(m: Model) -> bool:
    """Whether a text may be cut before runs of the marker: no piece holds the marker after another character."""
    return m.escape and not any(MARK in p.lstrip(MARK) for p, _, k in m.pieces if k in (NORMAL, USER))


def build(m: Model):
    """A tokenizers.Tokenizer that encodes and decodes as the model does."""
    from tokenizers import Regex, Tokenizer, decoders, normalizers, pre_tokenizers

    t = Tokenizer(model_of(m))
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if m.escape else " "))
    if m.escape:
        steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    if parts_are_independent(m):
        t.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    ends = [decoders.Strip(" ", 1, 0)] if m.dummy_prefix else []
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
    return t


class Codec:
    """Encodes and decodes batches of texts. Where parts are independent, each distinct part of a batch is encoded once.

    ``ids`` are packed as little-endian int32. Parts not seen yet go to the library as one multithreaded batch.
    """

    def __init__(self, data: bytes, cache: int = CACHE):
        from tokenizers import Tokenizer, decoders

        self.cache = cache
        self.model = parse(data)
        self._whole = None
        self.by_parts = parts_are_independent(self.model)
        self.part = Tokenizer(model_of(self.model, cache))
        self.part.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.plain = not self.model.charsmap and not self.model.squeeze and self.model.dummy_prefix
        self.packed: dict[str, bytes] = {}
        self.text: dict[str, str] = {}
        kinds = self.model.pieces
        self.starts = np.array([p.startswith(MARK) for p, _, _ in kinds])
        self.spelled = pa.array([p.replace(MARK, " ").encode() for p, _, _ in kinds], pa.large_binary())
        self.unspelled = np.array([k not in (NORMAL, USER) for _, _, k in kinds])

    @property
    def whole(self):
        """The tokenizer for whole texts, built where it is needed: parts that are independent do without."""
        if self._whole is None:
            self._whole = build(self.model)
        return self._whole

    def _parts(self, text: str) -> list[str]:
        """Parts of a text without their first marker."""
        if self.plain:
            if not text:
                return []
            if MARK not in text and "  " not in text and text[-1] != " " and text[0] != " ":
                return text.split(" ")
            text = MARK + text.replace(" ", MARK)
        else:
            text = self.whole.normalizer.normalize_str(text)
        return [x[1:] if x[0] == MARK else _BARE + x for x in _PART.findall(text)]

    def _learn(self, parts: set[str]) -> None:
        if len(self.packed) > self.cache:
            self.packed.clear()
            self.text.clear()
        new = [x for x in parts if x not in self.packed]
        if not new:
            return
        found = [e.ids for e in self.part.encode_batch_fast([x[1:] if x[:1] == _BARE else MARK + x for x in new], add_special_tokens=False)]
        for x, ids, back in zip(new, found, self.part.decode_batch(found, skip_special_tokens=False), strict=True):
            self.packed[x], self.text[x] = struct.pack(f"<{len(ids)}i", *ids), back

    def forget(self) -> None:
        self.packed.clear()
        self.text.clear()
        give_back()

    def run(self, texts: pa.Array) -> "Encoded":
        """Encodes texts (no nulls) and decodes their ids again."""
        if not (self.by_parts and self.plain):
            return Encoded.of(*self._run_each(texts.to_pylist()))
        # texts that split at single blanks stay in Arrow: only distinct parts are looked at in Python
        odd = pc.or_(pc.or_(pc.match_substring(texts, MARK), pc.match_substring(texts, "  ")), pc.or_(pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")), pc.equal(texts, "")))
        lists, order = pc.split_pattern(texts, " "), None
        if odd.true_count:
            at = np.concatenate([np.flatnonzero(~odd.to_numpy(zero_copy_only=False)), np.flatnonzero(odd.to_numpy(zero_copy_only=False))])
            others = pa.array([self._parts(x) for x in texts.filter(odd).to_pylist()], pa.list_(texts.type))
            lists, order = pa.concat_arrays([lists.filter(pc.invert(odd)), others]), np.argsort(at)
        ends = np.asarray(lists.offsets).astype(np.int64)
        ends -= ends[0]
        coded = lists.flatten().dictionary_encode()
        ids, text = self._encode_parts(coded.dictionary)
        ids, text = ids.take(coded.indices), text.take(coded.indices)
        return Encoded(np.asarray(ids.values), np.asarray(ids.offsets).astype(np.int64)[ends], text.buffers()[2], np.frombuffer(text.buffers()[1], np.int64, len(text) + 1)[ends] if len(text) else ends, order, 1)

    def _encode_parts(self, parts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Ids and decoded bytes of distinct parts. Those with one marker go to the library as words of a few long batches:
        a token that starts with the marker starts the next part."""
        marked = pc.binary_join_element_wise(MARK, parts, "")
        single = pc.invert(pc.match_substring(parts, MARK)).to_numpy(zero_copy_only=False)
        words = marked.filter(pa.array(single)).to_pylist()
        step = max(1, -(-len(words) // 8))
        found = self.part.encode_batch_fast([words[i : i + step] for i in range(0, len(words), step)], is_pretokenized=True, add_special_tokens=False) if words else []
        ids = np.concatenate([np.zeros(0, np.int32), *(np.array(e.ids, np.int32) for e in found)])
        starts = np.flatnonzero(self.starts[ids])
        if len(starts) != len(words):
            raise ValueError("a part doesn't start with the marker")
        starts = np.append(starts, len(ids)).astype(np.int32)
        coded = pa.ListArray.from_arrays(pa.array(starts), pa.array(ids))
        spelled = self.spelled.take(pa.array(ids))
        ends = np.frombuffer(spelled.buffers()[1], np.int64, len(ids) + 1)[starts] if len(ids) else starts.astype(np.int64)
        text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(np.ascontiguousarray(ends)), spelled.buffers()[2]])
        # bytes, unknown pieces and several markers: as the library decodes them
        odd = np.flatnonzero(np.add.reduceat(self.unspelled[ids], starts[:-1])) if len(words) else np.zeros(0, np.int64)
        if len(odd):
            mask = np.zeros(len(words), bool)
            mask[odd] = True
            back = self.part.decode_batch([ids[starts[i] : starts[i + 1]].tolist() for i in odd.tolist()], skip_special_tokens=False)
            text = pc.replace_with_mask(text, pa.array(mask), pa.array([x.encode() for x in back], pa.large_binary()))
        if single.all():
            return coded, text
        several = [e.ids for e in self.part.encode_batch_fast(marked.filter(pa.array(~single)).to_pylist(), add_special_tokens=False)]
        back = [x.encode() for x in self.part.decode_batch(several, skip_special_tokens=False)]
        order = pa.array(np.argsort(np.concatenate([np.flatnonzero(single), np.flatnonzero(~single)])))
        return pa.concat_arrays([coded, pa.array(several, coded.type)]).take(order), pa.concat_arrays([text, pa.array(back, pa.large_binary())]).take(order)

    def _run_each(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """Packed ids and decoded texts, text by text."""
        if not self.by_parts:
            found = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
            return [struct.pack(f"<{len(x)}i", *x) for x in found], self.whole.decode_batch(found, skip_special_tokens=False)
        split = [self._parts(x) for x in texts]
        self._learn(set().union(*split))
        packed, back = self.packed.__getitem__, self.text.__getitem__
        cut = 1 if self.model.dummy_prefix else 0
        decoded = ["".join(map(back, x)) for x in split]
        return [b"".join(map(packed, x)) for x in split], [x[cut:] if x[:1] == " " else x for x in decoded]


@dataclass
class Encoded:
    """Ids and decoded texts of a batch: flat ids with the bounds of each text, the bytes of the decoded texts with theirs.

    ``order`` gives the place of each text of the batch where they aren't in order; ``cut`` blanks that start a decoded
    text are the marker's.
    """

    ids: np.ndarray
    id_ends: np.ndarray
    text: bytes | pa.Buffer | None
    text_ends: np.ndarray
    order: np.ndarray | None = None
    cut: int = 0

    @classmethod
    def of(cls, packed: list[bytes], back: list[str]) -> "Encoded":
        raw = [x.encode("utf-8", "surrogatepass") for x in back]
        ends = lambda sizes: np.cumsum([0, *sizes], dtype=np.int64)
        return cls(np.frombuffer(b"".join(packed), "<i4"), ends(len(x) // 4 for x in packed), b"".join(raw), ends(map(len, raw)))

    def _places(self) -> list[int]:
        return list(range(len(self.id_ends) - 1)) if self.order is None else self.order.tolist()

    def sizes(self) -> np.ndarray:
        n = np.diff(self.id_ends)
        return n if self.order is None else n[self.order]

    def packed(self) -> list[bytes]:
        raw, ends = memoryview(np.ascontiguousarray(self.ids)).cast("B"), (4 * self.id_ends).tolist()
        return [bytes(raw[ends[i] : ends[i + 1]]) for i in self._places()]

    def decoded(self) -> list[bytes]:
        raw, ends = memoryview(self.text or b""), self.text_ends.tolist()
        out = [bytes(raw[ends[i] : ends[i + 1]]) for i in self._places()]
        return [x[1:] if x[:1] == b" " else x for x in out] if self.cut else out

    def lists(self) -> pa.Array:
        out = pa.ListArray.from_arrays(pa.array(self.id_ends.astype(np.int32)), pa.array(self.ids))
        return out if self.order is None else out.take(pa.array(self.order))


#: Marks the key of a part that doesn't start with the marker; no text holds a lone surrogate.
_BARE = "\ud800"
_PART = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_BUILT: dict[str, Codec] = {}


def codec_of(data: bytes, threads: int = 2, cache: int = CACHE) -> Codec:
    """The codec for a model's bytes, built once in each process."""
    key = f"{hashlib.sha256(data).hexdigest()}-{cache}"
    if key not in _BUILT:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        _BUILT[key] = Codec(data, cache)
    return _BUILT[key]


def slices(sizes: list[int], most: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes sum to ``most`` at most (or of one that is larger)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def read_model(spark: SparkSession, path: str = MODEL) -> bytes:
    """The driver reads the file once; executors get its bytes (half a megabyte), so it needs to be in one place only."""
    with open(path, "rb") as f:
        return f.read()


def encode(spark: SparkSession, docs: DataFrame, model: str = MODEL, text: str = "text", ids: str = "ids", cache: int = CACHE) -> DataFrame:
    """``docs`` with its token ids as a last column array<int>; the text column is dropped.

    ``cache``: distinct parts that a process remembers within a task; fewer save memory and cost time.
    """
    data = spark.sparkContext.broadcast(read_model(spark, model))
    kept = [c for c in docs.columns if c not in (text, ids)]
    src = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(text))
    schema = docs.select(*kept, F.array().cast("array<int>").alias(ids)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(data.value, cache=cache)
        for batch in batches:
            texts = batch.column(len(kept))
            for a, b in slices(pc.utf8_length(texts).to_pylist(), BATCH_CHARS // 4):
                found = codec.run(texts.slice(a, b - a)).lists()
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(kept))] + [found], [*kept, ids])
        codec.forget()

    return src.mapInArrow(run, schema)


def decode(spark: SparkSession, encoded: DataFrame, model: str = MODEL, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with its text in place of the ids."""
    data = spark.sparkContext.broadcast(read_model(spark, model))
    kept = [c for c in encoded.columns if c not in (text, ids)]
    schema = encoded.select(*kept, F.lit("").cast("string").alias(text)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = codec_of(data.value).whole
        for batch in batches:
            lists = batch.column(len(kept)).to_pylist()
            for a, b in slices([len(x or ()) for x in lists]):
                texts = iter(tok.decode_batch([x for x in lists[a:b] if x is not None], skip_special_tokens=False))
                out = [None if x is None else next(texts) for x in lists[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a) for i in range(len(kept))] + [pa.array(out, pa.string())], [*kept, text])

    return encoded.select(*kept, ids).mapInArrow(run, schema)


def summarize(spark: SparkSession, docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Encode and decode in one pass: doc_id, n_tokens, ids_sha256 (of the ids as little-endian int32), round_trip."""
    data = spark.sparkContext.broadcast(read_model(spark, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(data.value)
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(pc.utf8_length(texts).to_pylist()):
                part = texts.slice(a, b - a)
                found = codec.run(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array(found.sizes()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in found.packed()], pa.string()),
                        pa.array([x == y for x, y in zip(found.decoded(), part.cast(pa.binary()).to_pylist(), strict=True)], pa.bool_()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "round_trip"],
                )

    return _id_and_text(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, round_trip boolean")


def _id_and_text(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def parity(spark: SparkSession, docs: DataFrame, model: str = MODEL) -> DataFrame:
    """Documents on which the rebuilt tokenizer and the original library differ in ids or decoded text; none are expected."""
    data = spark.sparkContext.broadcast(read_model(spark, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=data.value)
        codec = codec_of(data.value)
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(pc.utf8_length(texts).to_pylist()):
                found = codec.run(texts.slice(a, b - a))
                theirs = sp.encode(texts.slice(a, b - a).to_pylist(), num_threads=1)
                bad = [i for i, (x, ids, back) in enumerate(zip(theirs, found.packed(), found.decoded(), strict=True)) if struct.pack(f"<{len(x)}i", *x) != ids or sp.decode(x).encode() != back]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(a, b - a).take(pa.array(bad, pa.int64())) for i in range(2)], ["doc_id", "text"])

    return _id_and_text(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize(spark, table(spark, sf_dir, "documents"))
