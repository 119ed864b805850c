"""Sharding, cross-tokenizer alignment and ranked search against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waybill.llm import registry, sharding, token_alignment, wand_search
from waybill.llm.pieces import MODEL, codec_of, read_model

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, rank int, shard string, row int"
ODD = [
    (1, "Alpha beta, gamma delta!", "en", "b", 5, "x", 1, "y", 1),
    (1, "Alpha beta, gamma delta!", "en", "b", 5, "x", 1, "y", 1),
    (2, "Alpha beta, gamma delta!", None, "a", None, None, None, None, None),
    (3, "", "en", None, 0, None, None, None, None),
    (4, None, None, None, None, None, None, None, None),
    (None, "beta only", "de", "", 1, None, None, None, None),
    (5, "Gamma\n\n über straße été  two  blanks \t\n x" + " word" * 40_000, "fr", "a", 9, None, None, None, None),
    (6, "marker ▁ inside <|endoftext|> <s> <0x41> 東京 🚚", "en", "a", 9, None, None, None, None),
    (7, "!?.,", "en", "a", 9, None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def pile(spark, n=3000):
    """A source with a third of all rows, one of every fifth, and many of one row each."""
    rng = random.Random(5)
    rows = [(i, "w" * rng.randint(0, 300), "en", "hot" if i % 3 == 0 else "warm" if i % 5 == 1 else f"own{i}", 1, None, None, None, None) for i in range(n)]
    return spark.createDataFrame(rows, DOCS)


# 11 sharding


@pytest.mark.parametrize("law", sharding.LAWS)
def test_shards_match_the_mixture(spark, law):
    docs = pile(spark)
    got = sharding.place(spark, docs, 8, law).select("doc_id", "text", "source", "shard", "slot").collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r)
    assert set(shards) == set(range(8))
    assert all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in shards.values())
    counts, sizes = [len(x) for x in shards.values()], [sum(len(r.text) + 1 for r in x) for x in shards.values()]
    assert max(counts) - min(counts) <= 1 if law == "rows" else max(sizes) - min(sizes) <= 2 * 301
    hot, n = [sum(r.source == "hot" for r in x) for x in shards.values()], [len(x) for x in shards.values()]
    # sources of one row each fall where they may, so they move the cuts a little
    assert all(abs(h - 1000 * k / 3000) <= 12 for h, k in zip(hot, n, strict=True))
    # single rows of sources of their own spread as well
    alone = [sum(r.source.startswith("own") for r in x) for x in shards.values()]
    assert max(alone) - min(alone) < 60
    again = sharding.place(spark, docs.repartition(5), 8, law).select("doc_id", "shard", "slot").collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {tuple(r) for r in again}
    few = docs.where("source not like 'own%'")
    mixed = sharding.place(spark, few, 8, law).groupBy("shard").agg(F.count_if(F.col("source") == "hot").alias("hot"), F.count("*").alias("n")).collect()
    assert all(abs(r.hot - 1000 * r.n / few.count()) <= 2 for r in mixed)
    other = sharding.place(spark, docs, 8, law, seed=1).select("doc_id", "shard", "slot").collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} != {tuple(r) for r in other}


def test_any_stretch_holds_sources_in_proportion(spark):
    rows = sorted(sharding.place(spark, pile(spark), 1).select("slot", "source").collect())
    at = [r.slot for r in rows if r.source == "hot"]
    assert all(abs((b - a) - 3) <= 12 for a, b in zip(at, at[1:], strict=False))
    for start in range(0, 2700, 100):
        assert abs(sum(r.source == "hot" for r in rows[start : start + 300]) - 100) <= 10


@pytest.mark.parametrize("law", sharding.LAWS)
def test_shards_odd(spark, odd, empty, law):
    got = sharding.place(spark, odd, 4, law)
    assert [c for c in got.columns if c not in ("shard", "slot")] == [c for c in odd.columns if c != "shard"] and got.count() == len(ODD)
    assert sharding.place(spark, empty, 4, law).count() == 0
    assert sharding.place(spark, odd, 40).agg(F.countDistinct("shard")).first()[0] == len(ODD)
    with pytest.raises(ValueError):
        sharding.place(spark, odd, 4, "weight")


def test_written_shards(spark, tmp_path):
    placed = sharding.place(spark, pile(spark, 500), 4)
    sharding.write(placed, str(tmp_path / "out"), 6)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.shard, r.slot) for r in back.select("doc_id", "shard", "slot").collect()) == sorted((r.doc_id, r.shard, r.slot) for r in placed.select("doc_id", "shard", "slot").collect())


def test_checksum_is_crc32(spark, odd):
    for r in odd.select("text", sharding.checksum(F.col("text")).alias("c"), sharding.size_of(F.col("text")).alias("n")).collect():
        raw = (r.text or "").encode()
        assert (r.c, r.n) == (zlib.crc32(raw), len(raw) + 1)


# 12 cross-tokenizer alignment


def aligned_by_hand(texts):
    """Ids, groups and links of each text: the libraries' own tokens, and sets of their ends."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(token_alignment.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    chars = token_alignment._byte_of_char()
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        want = (" " + text).encode()
        a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        a_raw = [bytes(chars[c] for c in a.id_to_token(i)) for i in a_ids]
        b_raw = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        if b"".join(a_raw) != want or b"".join(b_raw) != want:
            out.append(None)
            continue
        ends_a, ends_b = ([int(x) for x in np.cumsum([len(x) for x in raw])] for raw in (a_raw, b_raw))
        both = sorted({*ends_a} & {*ends_b})
        groups, i, j = [], 0, 0
        for end in both:
            k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append((a_ids[i:k], b_ids[j:m]))
            i, j = k, m
        out.append((a_ids, b_ids, groups))
    return out


TEXTS = [*[r[1] for r in ODD if r[1] is None or len(r[1]) < 1000], "the theory of everything", "don't we'll I'd", " starts blank", "ends blank ", "two  blanks", "tab\tand hard   space", "line\n\nbreak\r\n", "\u0000\u0001 control", "١٢٣ ४५६ 789", "é combining", "﻿bom", "x" * 3000, "\U0001f469‍\U0001f680" * 5]


def test_alignment_by_hand(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(3)
    hand = aligned_by_hand(TEXTS)
    got = {r.doc_id: r for r in token_alignment.align(spark, docs).collect()}
    for i, want in enumerate(hand):
        r = got[i]
        if want is None:
            assert (r.a_ids, r.b_ids, r.a_sizes, r.b_sizes) == ([], [], [], [])
        else:
            assert (r.a_ids, r.b_ids) == want[:2], TEXTS[i]
            assert (r.a_sizes, r.b_sizes) == ([len(x) for x, _ in want[2]], [len(x) for _, x in want[2]])
    assert hand[TEXTS.index("two  blanks")] is not None and sum(x is None for x in hand) >= 3


@pytest.mark.parametrize("most", [10**6, 0])
def test_alignment_digests(spark, most):
    texts = TEXTS + TEXTS[:6]
    docs = spark.createDataFrame([(i % len(TEXTS), t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    hand = aligned_by_hand(texts)
    count = Counter((g[0][-1], g[1][-1]) for x in hand if x for g in x[2])
    most_of = defaultdict(int)
    for (_, b), n in count.items():
        most_of[b] = max(most_of[b], n)
    want = []
    for i, x in enumerate(hand):
        if not x:
            want.append((i % len(TEXTS), 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(g[0][-1], g[1][-1]) for g in x[2]]
        said = ";".join("|".join(",".join(map(str, y)) for y in g) for g in x[2])
        want.append((i % len(TEXTS), len(x[0]), len(x[1]), len(links), len(links), sum(count[k] == most_of[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(said.encode()).hexdigest()))
    got = token_alignment.summarize(spark, docs, broadcast_pairs=most)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()) == sorted(want)


def test_alignment_in_any_batches(spark, monkeypatch):
    a, b = token_alignment.byte_codec_of(read_model(spark, token_alignment.BYTE_BPE)), codec_of(read_model(spark, MODEL))
    texts = [t for t in TEXTS if t is not None] * 3
    whole = token_alignment.Aligner(a, b).run(pa.array(texts))
    parts = [token_alignment.Aligner(a, b).run(pa.array(texts).slice(i, 4)) for i in range(0, len(texts), 4)]
    for name in ("a", "b", "a_sizes", "b_sizes"):
        assert np.array_equal(getattr(whole, name), np.concatenate([getattr(p, name) for p in parts])), name
    assert int(whole.a_sizes.sum()) == len(whole.a) and whole.group_at[-1] == len(whole.a_sizes)


def test_alignment_odd(spark, odd, empty):
    got = token_alignment.align(spark, odd)
    assert got.columns == [c for c in odd.columns if c != "text"] + ["a_ids", "b_ids", "a_sizes", "b_sizes"] and got.count() == len(ODD)
    assert token_alignment.align(spark, empty).count() == 0 and token_alignment.summarize(spark, empty).count() == 0
    rows = {r.doc_id: r for r in token_alignment.summarize(spark, odd).collect()}
    assert rows[3].n_a == rows[4].n_b == rows[6].n_groups == 0 and rows[3].groups_sha256 == "" and rows[5].n_a > 40_000 and rows[None].n_groups > 0


def test_long_white_space(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 50_000 + "b"), (2, "\n" * 50_000)], "doc_id long, text string")
    assert all(r.n_groups > 0 for r in token_alignment.summarize(spark, docs).collect())


def test_alignment_query(spark, tmp_path):
    spark.createDataFrame(ODD, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.QUERIES["op12_token_alignment"](spark, str(tmp_path))
    texts = [r[1] for r in ODD]
    hand = aligned_by_hand(texts)
    assert sorted((r.n_a, r.n_b, r.n_groups) for r in got.collect()) == sorted((len(x[0]), len(x[1]), len(x[2])) if x else (0, 0, 0) for x in hand)


# 13 ranked lexical search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked_by_hand(docs, items, k):
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, Counter(t), len(t)) for d, t in held if t]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in held:
            m = 100 - 50 + (50 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in {*terms(text)} if t in c)
            scores += [(-s, d is None, d or 0)] if s > 0 else []
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return out


def corpus(seed, n, words=60):
    rng = random.Random(seed)
    known = [f"{'bcdfg'[i % 5]}o{i}" for i in range(words)]
    return [(i if i % 97 else None, " ".join(known[min(words - 1, int(rng.expovariate(0.08)))] for _ in range(rng.randint(0, 60)))) for i in range(n)]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize(("postings", "window", "merges"), [(10**6, 1024, 16), (500, 8, 1), (1, 1, 3)])
def test_search_by_hand(spark, monkeypatch, postings, window, merges):
    monkeypatch.setattr(wand_search, "MERGES", merges)
    docs = corpus(3, 700) + [(5000 + i, "bo0 co1 do2 rare") for i in range(40)]
    items = [(i, t) for i, (_, t) in enumerate(corpus(4, 25))] + [(90, "bo0 bo0 CO1 rare unseen"), (91, None), (92, "!!"), (93, "absent")]

    class Small(wand_search.Shard):
        pass

    # cut into shards and windows as given: what is skipped must not change what is found
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    searched = wand_search._shards.__globals__
    monkeypatch.setitem(searched, "SHARD_POSTINGS", postings)
    monkeypatch.setitem(searched, "WINDOW", window)
    got = [tuple(r) for r in wand_search.search(spark, table, asked, 10).collect()]
    assert in_order(got) == in_order(ranked_by_hand(docs, items, 10))


def shard_of(docs, vocabulary, weights):
    place = {t: i for i, t in enumerate(vocabulary)}
    counts = [Counter(place[t] for t in terms(x) if t in place) for _, x in docs]
    flat = [(t, n) for c in counts for t, n in c.items()]
    return wand_search.Shard(np.array([d for d, _ in docs]), np.array([len(terms(x)) for _, x in docs]), np.concatenate([[0], np.cumsum([len(c) for c in counts])]), np.array([t for t, _ in flat]), np.array([n for _, n in flat]), weights, len(docs), sum(len(terms(x)) for _, x in docs))


def test_pivots_skip_windows(monkeypatch):
    """Once the heap is full of strong documents, windows that hold only weak terms are never evaluated."""
    monkeypatch.setattr(wand_search, "WINDOW", 16)
    docs = [(i, "strong rare weak" if i < 20 else "weak other words") for i in range(2000)]
    docs[1500] = (1500, "strong rare")
    shard = shard_of(docs, ["strong", "rare", "weak"], np.array([9000, 9000, 10]))
    seen, evaluate = [], shard._evaluate
    monkeypatch.setattr(shard, "_evaluate", lambda window, *x: (seen.append(window), evaluate(window, *x)))
    heap = wand_search.Heap(5)
    shard.search(np.array([0, 1, 2]), heap)
    assert len(heap.ids) == 5 and 1500 in heap.ids and len(seen) <= 3 < shard.windows


def test_search_passes(spark):
    docs, items = corpus(7, 120), [(i, t) for i, (_, t) in enumerate(corpus(8, 12))]
    table, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = in_order(ranked_by_hand(docs, items, 5))
    assert in_order(tuple(r) for r in wand_search.search(spark, table, asked, 5, query_terms=60).collect()) == want


def test_search_odd(spark, odd, empty):
    asked = spark.createDataFrame([(1, "beta ALPHA über"), (1, "beta ALPHA über"), (None, "word")], "item_id long, text string")
    got = wand_search.search(spark, odd, asked, 4).collect()
    docs = [(r[0], r[1]) for r in ODD]
    want = ranked_by_hand(docs, [(1, "beta ALPHA über"), (1, "beta ALPHA über"), (-1, "word")], 4)
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == sorted(want, key=lambda r: (r[0], r[1], r[2] or 0)) or sorted(map(repr, ((-1 if r[0] is None else r[0], *r[1:]) for r in got))) == sorted(map(repr, want))
    assert wand_search.search(spark, empty, asked).count() == 0 and wand_search.search(spark, odd, asked.limit(0)).count() == 0
