"""Ranked lexical search: WAND over document shards, heaps of shards merged.

One pass over the texts keeps, for each document, its length and how often it holds each term of the queries; from these
come document frequencies and the mean length. A shard is a block of documents of bounded postings. Its posting lists
hold impacts (weight times saturated frequency, whole numbers) and each list its maximum. A query's lists advance
together: by ascending next document, the maxima are summed until the heap's least score is reached, and that list's next
document is the pivot. What lies before the pivot is skipped. From the pivot to the end of its window, documents get
impacts from the strongest lists on; once the maxima left can't lift a new document to the heap, only documents that can
still reach it are looked up in the other lists. A task's heaps go on from shard to shard, and each task hands over
at most k documents for a query.

Defined results: a term is a maximal run of letters and digits, all characters beyond ASCII counting as letters, only A-Z
lower-cased; a null or empty text, of a query or a document, has none; each row of ``queries`` is a query of its own, also
where ids repeat; equal scores go by ascending doc_id (an integer), null last; rows equal in doc_id and score are
interchangeable; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waybill.llm.common import Scratch, give_back, table

K = 50
#: Terms of queries, repeats counted, that one pass over the documents looks for; more queries take more passes.
QUERY_TERMS = 200_000
#: Postings of a shard (28 bytes each); a longer document is a shard by itself.
SHARD_POSTINGS = 2_000_000
#: Documents of a window, at least.
WINDOW = 1024
#: Tasks that merge the heaps of one query first.
MERGES = 16

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8, in order, with repeats."""
    return text.translate(_FOLD).split()


def count_terms(spark: SparkSession, docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Documents with a term: doc_id, n (their terms), terms (places in the vocabulary) and tfs (times each occurs)."""
    known = spark.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = known.value.get
        for batch in batches:
            at, n, ends, terms, tfs = [], [], [0], [], []
            for i, text in enumerate(batch.column(1)):
                found = terms_of(memoryview(text.as_buffer()).tobytes()) if text.is_valid else ()
                if found:
                    held = Counter(map(place, found))
                    held.pop(None, None)
                    at.append(i)
                    n.append(len(found))
                    terms += held
                    tfs += held.values()
                    ends.append(len(terms))
            bounds = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x, pa.int32())) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])
        give_back()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Shard:
    """Posting lists of a block of documents: by term the documents, ascending, and their impacts."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, bounds: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, n_docs: int, length: int):
        self.ids = ids
        doc = np.repeat(np.arange(len(n)), np.diff(bounds))
        norm = 20 * (50 + 50 * n * n_docs // length)
        tfs = tfs.astype(np.int64)
        impact = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + norm[doc]))
        order = np.argsort(terms, kind="stable")
        self.doc, self.impact = doc[order], impact[order]
        self.window = max(WINDOW, -(-len(n) // 32))
        self.windows = -(-len(n) // self.window)
        count = np.bincount(terms.astype(np.int64) * self.windows + doc // self.window, minlength=len(weights) * self.windows)
        ends = np.concatenate([[0], np.cumsum(count)])
        #: where the postings of a term in a window start; the last column is the end of the list
        self.at = ends[np.arange(len(weights))[:, None] * self.windows + np.arange(self.windows + 1)]
        self.most = np.zeros(len(weights), np.int64)
        held = np.flatnonzero(self.at[:, 0] < self.at[:, -1])
        if len(held):
            self.most[held] = np.maximum.reduceat(self.impact, self.at[held, 0])

    def search(self, terms: np.ndarray, heap: Heap) -> None:
        """Offers the heap every document of the shard that could enter it."""
        terms = terms[self.most[terms] > 0]
        terms = terms[np.argsort(-self.most[terms], kind="stable")]
        most, at = self.most[terms], self.at[terms]
        cursor, end = at[:, 0], at[:, -1]
        while len(terms):
            live = cursor < end
            terms, most, at, end, cursor = terms[live], most[live], at[live], end[live], cursor[live]
            heads = self.doc[cursor]
            order = np.argsort(heads, kind="stable")
            pivot = int(np.searchsorted(np.cumsum(most[order]), heap.least))
            if pivot == len(order):
                return
            window = int(heads[order[pivot]]) // self.window
            self._evaluate(window, at[:, window], at[:, window + 1], most, heap)
            cursor = np.maximum(cursor, at[:, window + 1])

    def _evaluate(self, window: int, start: np.ndarray, end: np.ndarray, most: np.ndarray, heap: Heap) -> None:
        """Scores of a window's documents, strongest lists first; those that can't reach the heap are left."""
        held = start < end
        start, end, most = start[held].tolist(), end[held].tolist(), most[held]
        left = np.concatenate([np.cumsum(most[::-1])[::-1], [0]]).tolist()
        base = window * self.window
        score = np.zeros(min(self.window, len(self.ids) - base), np.int64)
        i = 0
        while i < len(start) and left[i] >= heap.least:
            score[self.doc[start[i] : end[i]] - base] += self.impact[start[i] : end[i]]
            i += 1
        found = np.flatnonzero(score + left[i] >= heap.least) if i == len(start) else np.flatnonzero((score > 0) & (score + left[i] >= heap.least))
        for j in range(i, len(start)):
            if not len(found):
                return
            docs = self.doc[start[j] : end[j]]
            if len(docs) < 8 * len(found):
                score[docs - base] += self.impact[start[j] : end[j]]
            else:
                near = np.minimum(np.searchsorted(docs, found + base), len(docs) - 1)
                hit = docs[near] == found + base
                score[found[hit]] += self.impact[start[j] + near[hit]]
            found = found[score[found] + left[j + 1] >= heap.least]
        found = found[score[found] >= heap.least]
        if len(found):
            heap.offer(score[found], self.ids[found + base])


class Heap:
    """The k best documents so far, equal scores by ascending id. ``least``: what a document must score to enter."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[best], ids[best]
        if len(best) == self.k:
            self.least = int(self.scores[-1])


#: Stands for a null id: after all others.
_NO_ID = np.iinfo(np.int64).max


def _shards(batches: Iterator[pa.RecordBatch], weights: np.ndarray, n_docs: int, length: int) -> Iterator[Shard]:
    held, postings = [], 0

    def build() -> Shard:
        t = pa.Table.from_batches(held).combine_chunks()
        ids = t.column("doc_id").fill_null(_NO_ID).to_numpy()
        lists = pa.concat_arrays(t.column("terms").chunks), pa.concat_arrays(t.column("tfs").chunks)
        bounds = np.asarray(lists[0].offsets).astype(np.int64)
        return Shard(ids, t.column("n").to_numpy(), bounds - bounds[0], np.asarray(lists[0].flatten()), np.asarray(lists[1].flatten()), weights, n_docs, length)

    for batch in batches:
        if batch.num_rows:
            size = len(batch.column("terms").flatten())
            if held and postings + size > SHARD_POSTINGS:
                yield build()
                held, postings = [], 0
            held.append(batch)
            postings += size
    if held:
        yield build()


def best_of_shards(spark: SparkSession, counted: DataFrame, queries: list[np.ndarray], weights: np.ndarray, n_docs: int, length: int, k: int) -> DataFrame:
    """At most k documents of each task for each query: query (place in the list), doc_id, score."""
    sent = spark.sparkContext.broadcast((queries, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, w = sent.value
        heaps = [Heap(k) for _ in asked]
        for shard in _shards(batches, w, n_docs, length):
            for terms, heap in zip(asked, heaps, strict=True):
                shard.search(terms, heap)
        for i in range(0, len(heaps), 1000):
            some = heaps[i : i + 1000]
            ids = np.concatenate([h.ids for h in some])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(i, i + len(some)), [len(h.ids) for h in some]), pa.int32()),
                    pa.array(ids, mask=ids == _NO_ID),
                    pa.array(np.concatenate([h.scores for h in some])),
                ],
                ["query", "doc_id", "score"],
            )
        give_back()

    return counted.mapInArrow(run, "query int, doc_id long, score long")


def _first(found: DataFrame, by: list, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(spark: SparkSession, docs: DataFrame, queries: DataFrame, k: int = K, query_terms: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``queries`` (item_id, text) its k best documents with a score above 0."""
    scratch = Scratch(spark)
    asked = scratch.put(queries.select("item_id", "text", F.monotonically_increasing_id().alias("row")))
    size = asked.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    passes = -(-size // query_terms)
    out = []
    for p in range(passes):
        # a pass holds few terms by its size: the driver turns them into numbers
        rows = asked.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == p).select("row", "text").collect()
        lists = [dict.fromkeys(terms_of((r.text or "").encode())) for r in rows]
        vocabulary = list(dict.fromkeys(t for x in lists for t in x))
        place = {t: i for i, t in enumerate(vocabulary)}
        counted = scratch.put(count_terms(spark, docs, vocabulary))
        n_docs, length = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        df = {r.term: r.df for r in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
        weights = np.array([weight(n_docs, df[i]) if i in df else 0 for i in range(len(vocabulary))], np.int64)
        found = best_of_shards(spark, counted, [np.array([place[t] for t in x], np.int64) for x in lists], weights, n_docs, length, k)
        # heaps of all tasks meet in two steps, so no task takes a query's heaps of the whole cluster
        few = _first(found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(MERGES))), ["query", "part"], k)
        best = _first(few.select("query", "doc_id", "score"), ["query"], k)
        names = spark.createDataFrame([(i, r.row) for i, r in enumerate(rows)], "query int, row long")
        out.append(scratch.put(best.join(names, "query").select("row", "rank", "doc_id", "score")))
        scratch.drop(counted)
    if not out:
        return asked.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    ranks = out[0]
    for more in out[1:]:
        ranks = ranks.unionByName(more)
    return ranks.join(asked.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH terms AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
held AS (SELECT row, doc_id, t, len(t)::BIGINT AS n FROM terms WHERE len(t) > 0),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS length FROM held),
tf AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(t) AS term FROM held) GROUP BY row, term),
w AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term, n_docs),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scored AS (
  SELECT item_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // length))))::BIGINT AS score
  FROM items JOIN tf USING (term) JOIN w USING (term) JOIN held USING (row), total GROUP BY item_id, row),
ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
  FROM scored JOIN held USING (row) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50
"""
