"""The corpus pipeline against a plain version of each stage."""

from __future__ import annotations

import re

import pyarrow as pa

import corpus_pipeline
from tests.llm.test_llm import DOCS, ODD, corpus, jaccard_by_hand, mix_by_hand, words
from waybill.llm import pieces


def test_pipeline(spark, tmp_path):
    bad = [(500 + i, f"plain words {i} here and there with some nastyword inside {i * 7}", "en", "b", 1, None, None) for i in range(12)]
    rows = corpus(3) + [(1000 + (r[0] or 0), *r[1:]) for r in ODD[:-1]] + [(2000, ODD[-1][1], *ODD[-1][2:])] + bad
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(r[0], 1, int("nastyword" in (r[1] or ""))) for r in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = {}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        at.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        out[name] = at.collect()
        if name != "tokens":
            assert at.columns == docs.columns
    clean = [r for r in rows if "nastyword" not in (r[1] or "")]
    assert sorted(r.doc_id for r in out["toxicity"]) == sorted(r[0] for r in clean)
    comp = {(a, n): c for a, n, c in jaccard_by_hand(clean, 5, 80, 100)}
    empty = {r[0] for r in clean if not words(r[1])}
    assert sorted(r.doc_id for r in out["near_copies"]) == sorted({a for (a, n), c in comp.items() if n and a == c} | empty)
    assert len(out["secrets"]) == len(out["near_copies"]) and not any(re.search(r"[0-9a-f]{40}|hunter2x", r.text or "") for r in out["secrets"])
    _, target = mix_by_hand([(r.doc_id, r.text, r.lang, r.source) for r in out["secrets"]])
    taken: dict = {}
    for r in out["mix"]:
        taken[r.source] = taken.get(r.source, 0) + len(words(r.text))
    longest = max(len(words(r.text)) for r in out["secrets"])
    assert all(abs(taken.get(s, 0) - t) <= longest for s, t in target.items())
    codec = pieces.codec_of(pieces.read_model(spark))
    want = sorted((r.doc_id, int(codec.run(pa.array([r.text or ""])).sizes()[0])) for r in out["mix"])
    assert sorted((r.doc_id, r.n_tokens) for r in out["tokens"]) == want and all(len(r.ids) == r.n_tokens for r in out["tokens"])


def test_pipeline_empty(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "lang", "source", "n_chars", "score", "seen", "n_tokens", "ids"]
