"""Toxicity: a factorization machine over hashed terms.

The score of a text is sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over its distinct terms (lower-cased words and
pairs of neighbours are left to the factors: <v_i, v_j> is what two terms say together, such as an insult and the name
of a group). Linear weights are learned by follow-the-regularized-leader with an L1 penalty, so many terms that
say nothing get none; only terms with a weight get factors, which keeps the interactions of a long text's neutral terms
few and the model small. Presence, not frequency, is the value of a term, so one insult counts the same in a
short and a very long text.

Training fits at most ``max_rows`` labelled rows (a documented bound: rows are taken in hash order of their ids, positives
and negatives alike; a row that is repeated counts once); scoring reads every whole text. Labels, lang, source and doc_id are no inputs of a score.

Defined results: a null or empty text scores sigmoid(b); equal texts score the same; without labelled rows every text
scores near 0; a row of ``docs`` with a null doc_id is scored, and is held out never to be trained on; labels other than 0
and 1 are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm.common import free, give_back, table

BITS = 22
MAX_ROWS = 16_000
FOLDS = 5
#: Words whose place a process remembers; others are hashed again.
REMEMBERED = 200_000
_TERM = re.compile(r"[^\W\d_]+")


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct hashed terms of a whole text."""
    words = set(_TERM.findall((text or "").lower()))
    return np.unique(np.fromiter((zlib.crc32(w.encode()) for w in words), np.int64, len(words)) & ((1 << BITS) - 1))


class Machine:
    """Weights of the terms that have any: ids (sorted), w, v (one row of factors each), b."""

    def __init__(self, ids: np.ndarray, w: np.ndarray, v: np.ndarray, b: float):
        self.ids, self.w, self.v, self.b = ids, w, v, b

    def margin(self, at: np.ndarray) -> float:
        """Log-odds of a text whose terms with weights are at the places ``at``."""
        f = self.v[at]
        return float(self.b + self.w[at].sum() + 0.5 * (np.square(f.sum(0)) - np.square(f).sum(0)).sum())


def squash(z: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def fit(rows: list[np.ndarray], labels: np.ndarray, factors: int = 4, epochs: int = 10, alpha: float = 1.0, l1: float | None = None, l2: float = 0.01, least: int = 3, seed: int = 7) -> Machine:
    """Train on term sets. Terms in fewer than ``least`` rows are left out. Deterministic for the same rows in the same order.

    Chance gradients add up with the square root of the rows, and so does the default penalty.
    """
    l1 = max(0.3, 4.0 * (len(rows) / 12_000) ** 0.5) if l1 is None else l1
    rng = np.random.default_rng(seed)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    ids, counts = np.unique(flat, return_counts=True)
    ids = ids[counts >= least]
    local = [np.searchsorted(ids, r[np.isin(r, ids, assume_unique=True)]) for r in rows]
    n = len(ids)
    z, s, w = np.zeros(n), np.zeros(n), np.zeros(n)
    v, sv = rng.normal(0, 0.02, (n, factors)), np.full((n, factors), 1e-2)
    rate = float(np.clip(labels.mean(), 1e-4, 1 - 1e-4)) if len(labels) else 1e-4
    b, sb = float(np.log(rate / (1 - rate))), 1.0
    for epoch in range(epochs):
        for i in rng.permutation(len(local)):
            t = local[i]
            live = t[w[t] != 0]
            total = v[live].sum(0)
            margin = b + w[t].sum() + (0.5 * (np.square(total) - np.square(v[live]).sum(0)).sum() if len(live) > 1 and epoch else 0.0)
            g = 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30))) - labels[i]
            if abs(g) < 1e-3:
                continue
            sb += g * g
            b -= 0.1 * g / np.sqrt(sb)
            new = s[t] + g * g
            z[t] += g - (np.sqrt(new) - np.sqrt(s[t])) / alpha * w[t]
            s[t] = new
            w[t] = np.where(np.abs(z[t]) <= l1, 0.0, -(z[t] - np.sign(z[t]) * l1) / ((0.1 + np.sqrt(new)) / alpha + l2))
            if len(live) > 1 and epoch:
                gv = g * (total - v[live]) + 1e-3 * v[live]
                sv[live] += gv * gv
                v[live] -= 0.05 * gv / np.sqrt(sv[live])
    keep = np.flatnonzero(w)
    return Machine(ids[keep], w[keep], v[keep], b)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(True))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """At most ``max_rows`` labelled texts as rows (toxic, h, terms): an id may have several texts, and a repeated row counts
    once."""
    marked = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    chosen = marked.withColumn("h", F.xxhash64(F.lit(3), "doc_id")).orderBy("h", "doc_id").limit(max_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "text", F.xxhash64("text", "h").alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms(x.as_py()).astype(np.int32) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), batch.column(2), pa.array(found, pa.list_(pa.int32()))], ["toxic", "h", "terms"])

    return texts.mapInArrow(run, "toxic int, h long, terms array<int>").dropDuplicates(["h", "toxic"]).orderBy("h", "toxic").limit(max_rows)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, **fitting: float) -> Machine:
    """The sample is hashed into terms on the executors, and one task fits on its at most ``max_rows`` term sets."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(h, y, np.asarray(t.values, dtype=np.int64)) for b in batches for h, y, t in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), b.column(2), strict=True)]
        got.sort(key=lambda x: x[:2])
        m = fit([t for _, _, t in got], np.array([y for _, y, _ in got], float), **fitting)
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (m.ids.astype(np.int64), m.w, m.v)] + [pa.array([m.b])], ["ids", "w", "v", "b"])
        got.clear()
        give_back()

    r = sample(docs, labels, max_rows).repartition(1).mapInArrow(learn, "ids binary, w binary, v binary, b double").first()
    ids, w = np.frombuffer(r.ids, np.int64), np.frombuffer(r.w, np.float64)
    return Machine(ids, w, np.frombuffer(r.v, np.float64).reshape(len(ids), -1) if len(ids) else np.zeros((0, 1)), r.b)


def score(spark: SparkSession, docs: DataFrame, machine: Machine, keep: Sequence[str] = ("doc_id",), name: str = "score") -> DataFrame:
    """``keep`` columns and the score of every row; a column already called ``name`` is replaced. The model is bounded by
    the terms of the training sample."""
    model = spark.sparkContext.broadcast((machine.ids, machine.w, machine.v, machine.b))
    keep = [c for c in keep if c != name]
    cols = [*keep, *([] if "text" in keep else ["text"])]
    at_text = cols.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine(*model.value)
        known = {int(x): i for i, x in enumerate(m.ids)}
        seen: dict[str, int] = {}
        mask = (1 << BITS) - 1
        for batch in batches:
            out = []
            for x in batch.column(at_text):
                at = set()
                for word in set(_TERM.findall((x.as_py() or "").lower())):
                    i = seen.get(word)
                    if i is None:
                        i = known.get(zlib.crc32(word.encode()) & mask, -1)
                        if len(seen) < REMEMBERED:
                            seen[word] = i
                    if i >= 0:
                        at.add(i)
                out.append(squash(m.margin(np.array(sorted(at), np.int64))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.float64())], [*keep, name])
        seen.clear()
        give_back()

    return docs.select(*cols).mapInArrow(run, docs.select(*keep, F.lit(0.0).alias(name)).schema)


def reject(spark: SparkSession, docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more."""
    name = free("_toxicity", docs.columns)
    return score(spark, docs, machine, keep=docs.columns, name=name).where(F.col(name) < threshold).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = train(spark, docs, table(spark, sf_dir, "labels"))
    return score(spark, docs, machine).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))
