"""The training-data operators against brute force, exact round trips and edge cases."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waybill.llm import chat_format, jaccard_join, merkle, mixing, nn_descent, pieces, registry, secret_scan, token_counts, toxicity, url_filter
from waybill.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, seen string"
#: Nulls in every column, empty and long texts, ties, repeated rows, and columns with names that operators use inside.
ODD = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "b", 5, "x", "y"),
    (1, "alpha beta gamma delta epsilon zeta", "en", "b", 5, "x", "y"),
    (2, "alpha beta gamma delta epsilon zeta", None, "a", None, None, None),
    (3, "", "en", None, 0, None, None),
    (4, None, None, None, None, None, None),
    (None, "only words here", "de", "", 1, None, None),
    (5, "One two three.\n\nFour FIVE six, seven eight!\nnine " + "word " * 3000, "fr", "a", 9, None, None),
    (6, 'token = "0123456789abcdef0123456789abcdef01234567" password=hunter2x', "en", "a", 9, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_connected_components(spark, one_task):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.root for r in connected_components(spark, spark.createDataFrame(links, "a long, b long"), one_task=one_task).collect()}
    used = {x for p in links if p[0] != p[1] for x in p}
    assert got == components(used, [p for p in links if p[0] != p[1]])


# 1 chat formatting


def test_chat_snapshots(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bot", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "bot", "yo"), (3, 2, "user", "ok <|im_end|>"), (4, 0, "user", "hi"), (4, 1, "bot", "no"), (5, 0, "user", "hi"), (5, 1, "bot", "no"), (None, None, None, None), (6, 0, "user", None), (6, 0, "user", None)]
    got = {r.conv_id: (r.n_turns, r.copies, r.chat) for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {3, 4, None, 6} and got[4][1] == 2 and got[6][0] == 2
    assert got[3][2].count("<|im_end|>") == 3 and "<|im_end |>" in got[3][2]


def test_chat_odd(spark):
    """Turns without a conversation, very long texts, columns with names that the operator uses inside."""
    rows = [(None, 0, "user", "hi", 1, 2)] * 3 + [(None, 0, "user", "long " * 100_000, 1, 2), (1, 0, "user", "hi", 1, 2), (1, 1, "bot", "yo", 1, 2), (2, 0, "a", "b", 1, 2)]
    got = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int, h1 int")).collect()
    assert sorted((r.conv_id or 0, r.n_turns, r.copies) for r in got) == [(0, 1, 1), (1, 2, 1), (2, 1, 1)] and max(len(r.chat) for r in got) > 500_000


def test_chat_empty(spark):
    assert chat_format.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 2 mixing


def mix_by_hand(rows):
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, goal, target = set(order), 1.5 * sum(sizes.values()), {}
    while left:
        total = sum(w[s] for s in left)
        over = [s for s in left if goal * w[s] / total > 2 * sizes[s]]
        if not over:
            target |= {s: goal * w[s] / total for s in left}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            goal -= target[s]
            left.remove(s)
    return sizes, target


def test_mixing(spark, odd):
    sizes, target = mix_by_hand(ODD)
    got = mixing.mix(spark, odd).collect()
    assert len(got) == len(ODD)
    taken = {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - int(target[s])) <= 1 for s in sizes)
    again = mixing.mix(spark, odd.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixed_documents(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", "ab"[i % 3 == 0], 1, None, None) for i in range(200)]
    docs = spark.createDataFrame(rows, DOCS)
    want = {r.doc_id: r.copies + (r.taken > r.copies * r.size) for r in mixing.mix(spark, docs, whole=True).collect()}
    out = mixing.mixed(spark, docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: v for k, v in want.items() if v}


def test_mixed_ties(spark):
    """Rows equal in id and text lie at one place of the order; the cut may fall among them."""
    rows = [(None, "a b c d", "en", "s", 1, None, None)] * 100 + [(1, "w " * 300, "en", "t", 1, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(spark, docs).collect()
    target = {r.source: r.target for r in got}
    out = mixing.mixed(spark, docs).collect()
    assert abs(sum(len(words(r.text)) for r in out if r.source == "s") - target["s"]) <= 4


def test_mixing_empty(spark, empty):
    assert mixing.mix(spark, empty).count() == 0 and mixing.mixed(spark, empty).count() == 0


# 3 fingerprints


def test_merkle(spark, odd):
    rows = sorted(merkle.edits(odd).collect(), key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    assert len(rows) == len(ODD)
    order = sorted(((r[0], r[1] or "") for r in ODD), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    texts = [t for _, t in order]
    want = sorted(hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest() for t, n in zip(texts, [*texts[1:], texts[0]], strict=True))
    assert sorted(r.edited_sha256 for r in rows) == want
    same = {r.fingerprint for r in rows if r.doc_id in (1, 2)}
    assert len(same) == 1 and len({r.fingerprint for r in rows}) == 5
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_merkle_places_an_edit(spark):
    a, b = "one.\ntwo.\n\nthree.\nfour.", "one.\ntwo.\n\nthree.\nFOUR."
    r = spark.createDataFrame([(a, b)], "a string, b string").select(merkle.fingerprint(F.col("a")).alias("x"), merkle.fingerprint(F.col("b")).alias("y")).select(merkle.first_difference(F.col("x"), F.col("y")).alias("d"), merkle.first_difference(F.col("x"), F.col("x")).alias("n"), merkle.likeness(F.col("x"), F.col("y")).alias("l")).first()
    assert (r.d.section, r.d.paragraph, r.n) == (2, 2, None) and r.l == pytest.approx(0.75)


def test_merkle_empty(spark, empty):
    assert merkle.edits(empty).count() == 0


# 4 toxicity


def test_toxicity_held_out_accuracy(spark):
    rng = np.random.default_rng(0)
    vocabulary, bad = [f"w{i}x".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(400)], ["insulta", "insultb"]
    rows, labels = [], []
    for i in range(900):
        y = int(rng.random() < 0.25)
        text = list(rng.choice(vocabulary, rng.integers(5, 60))) + ([bad[i % 2]] if y else [])
        rows.append((i, " ".join(rng.permutation(text)), "en", "s", 1, None, None))
        labels.append((i, 1, y))
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(spark, docs, toxicity.train(spark, docs, marks)).collect()
    truth = {i: y for i, _, y in labels}
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(got) == 900 and np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.97


def test_machine_learns_an_interaction():
    # either term alone is harmless, both together are not
    rows, y = [], []
    for i in range(800):
        a, b = i & 1, i >> 1 & 1
        rows.append(np.array(sorted({5} | ({11} if a else set()) | ({12} if b else set()) | {100 + i % 7})))
        y.append(float(a and b))
    m = toxicity.fit(rows, np.array(y), l1=0.3, epochs=40)
    place = {int(t): i for i, t in enumerate(m.ids)}
    score = lambda *ts: toxicity.squash(m.margin(np.array(sorted(place[t] for t in ts if t in place), np.int64)))
    assert score(5, 11, 12) > 0.5 > max(score(5, 11), score(5, 12), score(5))


def test_toxicity_odd(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = toxicity.train(spark, odd, none)
    got = toxicity.score(spark, odd, m).collect()
    assert len(got) == len(ODD) and all(r.score < 0.01 for r in got)
    kept = toxicity.reject(spark, odd, m)
    assert kept.columns == odd.columns and kept.count() == len(ODD) and toxicity.reject(spark, empty, m).count() == 0


def test_toxicity_bound_holds(spark):
    """Repeated rows count once, different texts of one id at most max_rows times."""
    docs = spark.createDataFrame([(1, f"text {'abcdefghij'[i % 10]}") for i in range(400)], "doc_id long, text string")
    marks = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.sample(docs, marks).count() == 10 and toxicity.sample(docs, marks, 7).count() == 7
    assert toxicity.sample(docs, marks.where("false")).count() == 0


def test_toxicity_score_by_hand(spark):
    """A score is the sigmoid of bias, weights and all pairs of factors, each pair looked at."""
    rng = np.random.default_rng(6)
    texts = ["alpha beta gamma", "beta delta", "", "epsilon " * 50 + "alpha", None, "Alpha BETA"]
    ids = np.sort(np.unique(np.concatenate([toxicity.terms("alpha beta delta"), toxicity.terms("zeta")])))
    m = toxicity.Machine(ids, rng.normal(size=len(ids)), rng.normal(size=(len(ids), 4)), -0.3)
    got = {r.doc_id: r.score for r in toxicity.score(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m).collect()}
    for i, t in enumerate(texts):
        at = [j for j, x in enumerate(ids) if x in set(toxicity.terms(t).tolist())]
        z = m.b + sum(m.w[j] for j in at) + sum(float(m.v[a] @ m.v[b]) for x, a in enumerate(at) for b in at[x + 1 :])
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)))


def test_machine_learns_pairs_by_default():
    """At default settings, among two thousand noise terms, on texts not seen: only both terms together count."""

    def texts(n, seed):
        rng = np.random.default_rng(seed)
        pairs = rng.random((n, 2)) < 0.3
        rows = [np.unique(np.concatenate([rng.integers(100, 2100, 30), [11] * int(a), [12] * int(b)]).astype(np.int64)) for a, b in pairs]
        return rows, pairs.all(1), pairs.any(1)

    rows, y, _ = texts(4000, 9)
    m = toxicity.fit(rows, y.astype(float))
    place = {int(t): i for i, t in enumerate(m.ids)}
    rows, y, either = texts(1500, 10)
    said = np.array([toxicity.squash(m.margin(np.array([place[t] for t in r if t in place], np.int64))) >= 0.5 for r in rows])
    assert np.mean(said == y) > 0.98 and np.mean(said[either & ~y]) < 0.02


# any operator that keeps the columns of its input

CLASH = ["findings", "parts", "_digest", "_d", "_id", "_at", "_none", "_source", "_time", "_toxicity", "_spans", "_before", "rows", "stays", "key", "size"]


def test_clashing_names_are_kept(spark, forest):
    rows = [(*r[:5], *[f"{c}{i}" for c in CLASH]) for i, r in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASH))
    m = toxicity.train(spark, docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    outs = [toxicity.reject(spark, docs, m), jaccard_join.deduplicate(spark, docs), secret_scan.redact(secret_scan.scan(docs, forest)), mixing.mixed(spark, docs)]
    for out in outs:
        got = out.collect()
        assert out.columns == docs.columns and {tuple(r[c] for c in CLASH) for r in got} <= {r[5:] for r in rows} and got
    assert outs[0].count() == outs[2].count() == len(rows)


# 5 secrets


@pytest.fixture(scope="module")
def forest(spark):
    return secret_scan.fit(secret_scan.seed_findings(spark, 120))


def test_secrets(spark, odd, forest):
    scanned = secret_scan.scan(odd, forest)
    found = secret_scan.findings(scanned).collect()
    hits = [r for r in found if r.secret]
    text = ODD[-1][1]
    assert {text[r.start : r.start + r.length] for r in hits} == {"0123456789abcdef0123456789abcdef01234567", "hunter2x"}
    out = secret_scan.redact(scanned)
    assert out.count() == len(ODD) and out.where("doc_id = 6").first().text == 'token = "<SECRET>" password=<SECRET>'
    assert out.where("doc_id = 4").first().text is None


def test_secrets_empty(spark, empty, forest):
    assert secret_scan.findings(secret_scan.scan(empty, forest)).count() == 0 and secret_scan.redact(secret_scan.scan(empty, forest)).count() == 0


def test_candidates_by_hand(spark, forest):
    """Spans and digests against a plain scan of the same pattern."""
    pattern = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{20,}={0,2}")
    texts = [r[1] or "" for r in ODD] + ["x " + "Q7" * 30 + " y " + "z" * 21 + "== end", "é" * 30 + " " + "A1b2" * 200]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.start, r.length, r.value_sha256) for r in secret_scan.findings(secret_scan.scan(docs, forest)).collect()}
    want = {(i, m.start(), len(m[0]), hashlib.sha256(m[0].encode()).hexdigest()) for i, t in enumerate(texts) for m in pattern.finditer(t)}
    assert want <= got and {(i, texts[i][a : a + n]) for i, a, n, _ in got - want} == {(7, "hunter2x")}


def test_secrets_of_any_length(spark, forest):
    rng = np.random.default_rng(7)
    run = lambda n: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), n))
    sizes = [129, 513, 5_000, 1_000_000]
    assert masked(spark, forest, [f"password={run(n)} and" for n in sizes]) == ["password=<SECRET> and"] * len(sizes)


def masked(spark, forest, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.text for r in secret_scan.redact(secret_scan.scan(docs, forest)).orderBy("doc_id").collect()]


def test_long_secrets_go_whole(spark, forest):
    rng = np.random.default_rng(5)
    run = lambda n: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), n))
    jwt = f"eyJ{run(33)}.eyJ{run(240)}.{run(43)}"
    keys = [run(800), run(1600), run(5000)]
    assert masked(spark, forest, [f"token={jwt} and", *(f"key {k} and" for k in keys), f"a {'-' * 900} b"]) == ["token=<SECRET> and"] + ["key <SECRET> and"] * 3 + [f"a {'-' * 900} b"]


NAMED_FORMS = ["DB_PASSWORD={}", "client_secret: {}", "auth_token={}", "SECRET_KEY={}", "user_pwd={}", "userPassword={}", "api_key_id: {}", "AWS_SECRET_ACCESS_KEY={}", "Authorization: Bearer {}", "auth: bearer {}"]


def test_secret_names_with_prefix_and_suffix(spark, forest):
    texts = [f.format(v) + " end" for f in NAMED_FORMS for v in ("hunter2x", "s3cr3t.9a!x", "0123456789abcdef0123456789abcdef01234567")]
    assert masked(spark, forest, texts) == [f.format("<SECRET>") + " end" for f in NAMED_FORMS for _ in range(3)]
    plain = ["the bearer certificate of the author: somebody", "commit 0123456789abcdef0123456789abcdef01234567 fixes"]
    assert masked(spark, forest, plain) == plain


#: Words as a corpus has them, and forms of secrets and of others that no seed has.
CORPUS_WORDS = ["delivery", "system", "between", "network", "reading", "account", "private", "morning", "station", "library", "garden", "winter", "letter", "engine", "silver", "window"]


def held_out_forms(n=60):
    import random

    rng = random.Random(13)
    run = lambda k, a="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(rng.choice(a) for _ in range(k))
    word = lambda: rng.choice(CORPUS_WORDS)
    yes = [lambda: f"slack xoxb-{run(12, '0123456789')}-{run(24)} here", lambda: f"export GITLAB_TOKEN=glpat-{run(20)} done", lambda: f"npm_{run(36)} in the file", lambda: f'"aws_secret_access_key": "{run(40)}" end', lambda: f"client_secret={run(6)}~{run(28)} end"]
    no = [lambda: f"see {word()}-{word()}-{word()}-{word()} for more", lambda: f"the function {word()}_{word()}_{word()}_{word()}(x)", lambda: f"open /{word()}/{word()}/{word()}/{word()}.txt now", lambda: f"revision: {run(40, '0123456789abcdef')} merged", lambda: f"token: {word()}, and so on", lambda: f"{word()}{word().title()}{word().title()}{word().title()} was called"]
    return [(f(), 1) for f in yes for _ in range(n)] + [(f(), 0) for f in no for _ in range(n)]


def test_forest_on_forms_it_has_not_seen(spark):
    corpus_docs = spark.createDataFrame([(i, " ".join(CORPUS_WORDS)) for i in range(3)] + [(9, "once only")], "doc_id long, text string")
    words = secret_scan.dictionary(corpus_docs)
    assert sorted(words) == sorted(CORPUS_WORDS) and secret_scan.dictionary(corpus_docs, 3) == sorted(CORPUS_WORDS)[:3] and secret_scan.dictionary(corpus_docs.limit(0)) == []
    model = secret_scan.fit(secret_scan.seed_findings(spark, 120, words), words)
    cases = held_out_forms()
    found = {r.doc_id for r in secret_scan.findings(secret_scan.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string"), model)).where("secret").collect()}
    hit = [i in found for i, _ in enumerate(cases)]
    truth = [y == 1 for _, y in cases]
    precision, recall = sum(h and t for h, t in zip(hit, truth, strict=True)) / max(1, sum(hit)), sum(h and t for h, t in zip(hit, truth, strict=True)) / sum(truth)
    assert precision >= 0.9 and recall >= 0.9, (precision, recall)


def test_forest_as_expression(spark, forest):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    seeds = secret_scan.seed_findings(spark, 40)
    f = seeds.select("label", F.struct(*[c.cast("double").alias(k) for k, c in secret_scan.features(F.col("before"), F.col("value"), F.col("after")).items()]).alias("f"))
    f = f.select("label", "f.*", secret_scan.as_expression(forest)(F.col("f")).alias("ours"))
    both = forest.transform(VectorAssembler(inputCols=list(secret_scan.FEATURES), outputCol="features").transform(f)).select("label", "ours", vector_to_array("probability")[1].alias("theirs")).collect()
    assert max(abs(r.ours - r.theirs) for r in both) < 1e-9
    assert np.mean([(r.ours >= 0.5) == (r.label == 1) for r in both]) > 0.98


# 6 token counts


def test_token_lengths(spark, odd):
    counted = token_counts.lengths(spark, odd)
    n = [r.n_tokens for r in counted.collect()]
    hist = token_counts.histogram(counted)
    for r in hist.collect():
        assert (r.n_docs, r.docs_at_least) == (n.count(r.length), sum(x >= r.length for x in n))
        assert (r.tokens_at_least, r.truncated_total) == (sum(x for x in n if x >= r.length), sum(min(x, r.length) for x in n))
    for r in token_counts.at_limits(hist, [0, 3, 7, 10**6]).collect():
        assert (r.total_tokens, r.truncated_total, r.docs_cut) == (sum(n), sum(min(x, r.limit) for x in n), sum(x > r.limit for x in n))
    assert token_counts.quantiles(hist, [0.5]).first().length == sorted(n)[3]
    rows = {r.length: r for r in token_counts.answers(hist, [3, 7, max(n), 10**6], [0.5, 1.0]).collect()}
    assert set(rows) == set(n) | {3, 7, 10**6}
    for k, r in rows.items():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least, r.truncated_total) == (n.count(k), sum(x >= k for x in n), sum(x for x in n if x >= k), sum(min(x, k) for x in n))
    assert [k for k, r in rows.items() if 0.5 in r.quantiles] == [sorted(n)[3]] and rows[max(n)].quantiles[-1] == 1.0


def test_token_lengths_of_any_text(spark):
    """Counts against the library on texts it can take, and long runs of white space it can't."""
    enc = token_counts._encoding(open(token_counts.RANKS, "rb").read())
    rng = np.random.default_rng(3)
    parts = [" ", "  ", "\n", "\t", "a", "bc", "Z9", ".", "'s", "\u65e5", "\x1c", "\r\n"]
    short = re.compile(f"{token_counts.SPACE}{{3,}}")
    for _ in range(2000):
        t = "".join(rng.choice(parts, int(rng.integers(0, 14))))
        assert token_counts.count_tokens(enc, t, short) == len(enc.encode_ordinary(t))
    long = [" " * 10**7, "\n" * 10**6 + "x", "a" * 10**6, "x" + " " * 5000 + "y", "", None]
    got = {r.doc_id: r.n_tokens for r in token_counts.lengths(spark, spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")).collect()}
    assert got[3] == len(enc.encode_ordinary(long[3])) and got[4] == got[5] == 0 and got[0] == 10**7 and len(got) == 6


def test_token_lengths_against_plain_merging(spark):
    """Encoding against byte pair merging written out, over the pieces of the pattern."""
    import regex

    ranks = {__import__("base64").b64decode(a): int(b) for a, b in map(bytes.split, open(token_counts.RANKS, "rb").read().splitlines())}

    def merged(piece):
        x = [piece[i : i + 1] for i in range(len(piece))]
        while len(x) > 1:
            rank, i = min((ranks.get(x[i] + x[i + 1], 1 << 60), i) for i in range(len(x) - 1))
            if rank == 1 << 60:
                break
            x[i : i + 2] = [x[i] + x[i + 1]]
        return len(x)

    texts = ["It's a plain text, isn't it?  Yes.\n\n 42 things", "Sch\u00f6ne Gr\u00fc\u00dfe \u65e5\u672c\u8a9e \U0001f389", "", "   lead and trail   "]
    got = {r.doc_id: r.n_tokens for r in token_counts.lengths(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: sum(merged(p.encode()) for p in regex.findall(token_counts.PATTERN, t)) for i, t in enumerate(texts)}


def test_token_lengths_empty(spark, empty):
    assert token_counts.histogram(token_counts.lengths(spark, empty)).count() == 0


# 7 url rules


def test_urls(spark):
    rows = [(1, "http://A.net/x", None), (2, "https://m.example.net/en/5?q=1", None), (3, "https://example.com/de/", None), (4, "https://x.org/fr/a#b", None), (5, None, None), (6, "nothing", None), (7, "http://notnet/", None), (8, "http://a.net", None), (8, "http://a.net", None), (9, "http://É.NET/é", "z")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark, spark.createDataFrame(rows, "page_id long, url string, items string")).collect()}
    assert got[1] == ("a.net", "/x", "net/", "block") and got[2] == ("m.example.net", "/en/5", "example.net/en/", "allow")
    assert got[3][2:] == ("example.com/de/", "block") and got[4] == ("x.org", "/fr/a", "org/fr/", "allow")
    assert got[5][:3] == ("", "", None) == got[6][:3] and got[7][2] is None and got[8][1:3] == ("", None) and got[9][0] == "É.net"
    assert url_filter.judge(spark, spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_urls_with_many_constant_parameters(spark):
    """Tokens of the same rows are one item: thirty constant parameters are no 2^30 sets."""
    query = "&".join(f"p{i}=1" for i in range(30))
    rows = [(i, f"https://shop.org/fr/x?{query}") for i in range(200)] + [(1000 + i, f"https://s{i}.net/a?u=1") for i in range(100)]
    rows += [(2000, f"https://other.com/x?{query}"), (2001, "https://other.com/x?p7=1"), (2002, "https://other.com/" + "y" * 100_000)]
    got = {r.page_id: (r.verdict, r.mined) for r in url_filter.judge(spark, spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert len(got) == len(rows) and got[2000][0] == "allow" and got[2001][1] and got[2002][0] == "allow"


# 8 embeddings


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    near = np.concatenate([base[i] + 0.05 * rng.normal(size=(n, 16)) for i, n in ((0, 30), (1, 3), (2, 1))])
    x = np.concatenate([base, near, base[:2]]).astype(np.float32)
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)] + [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [], 0), (904, [1.0, None], 0), (905, [1.0, 0.0], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in nn_descent.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    close = u @ u.T >= 0.9
    links = [(int(a), int(b)) for a, b in np.argwhere(close) if a < b]
    comp = components(range(len(x)), links)
    assert {k: v for k, v in got.items() if k < 900} == {i: (int(close[i].sum()) - 1, comp[i], comp[i] == i) for i in range(len(x))}
    assert all(got[i] == (0, i, True) for i in range(900, 906))


def test_embeddings_empty(spark):
    assert nn_descent.near_duplicates(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_of_doubles_and_clashing_names(spark):
    rows = [(i, [1.0, 0.001 * i], 1, 2, 3) for i in range(5)] + [(9, [0.0, 1.0], 1, 2, 3), (9, [0.0, 1.0], 1, 2, 3)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in nn_descent.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>, node int, vec int, root int")).collect())
    assert got == [(i, 4, 0) for i in range(5)] + [(9, 1, 9)] * 2


def test_saturated_lists_are_enlarged(spark):
    """Twenty near neighbours fill a list of two; enlarging shows more of them."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=(1, 8)) + 0.02 * rng.normal(size=(20, 8))
    scratch = nn_descent.Scratch(spark)
    _, nodes = nn_descent.nodes_of(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>"), scratch)
    graph = nn_descent.nearest(nn_descent.forest(nodes, 0, range(1), 2).withColumn("k", F.lit(2))).withColumn("fresh", F.lit(False))
    grown = nn_descent.enlarge(graph, 0.9)
    assert {(r.k, r.fresh) for r in grown.collect()} == {(4, True)}
    longer = nn_descent.descend(nodes, grown, 2, scratch)
    assert longer.groupBy("node").count().agg(F.min("count")).first()[0] == 4


def skewed(pairs=900, alone=1200, copies=1000, dim=32):
    """Vectors with a large group of near copies and many isolated pairs, and the truth about their links."""
    rng = np.random.default_rng(8)
    one, base, rest = rng.normal(size=(1, dim)), rng.normal(size=(pairs, dim)), rng.normal(size=(alone, dim))
    x = np.concatenate([one + 0.2 * rng.normal(size=(copies, dim)), base, base + 0.3 * rng.normal(size=(pairs, dim)), rest]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    return x, close


def links_of(spark, x, **search):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = nn_descent.near_duplicates(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"), **search).collect()
    return np.array([r.n_links for r in sorted(got, key=lambda r: r.vec_id)])


def test_embeddings_search_goes_on(spark):
    x, close = skewed()
    want = close.sum(1)
    got = links_of(spark, x, k=1, trees=1)
    assert np.mean(got[want > 0] / want[want > 0]) >= 0.995


def test_embeddings_audit_only_measures(spark, monkeypatch):
    """A search that finds nothing ends in the exact pass; links the audit sees are no result, at any size."""
    x, _ = skewed(40, 20, 30)
    no_edges = lambda nodes, *_: spark.createDataFrame([], nn_descent._EDGES)
    asked = []
    monkeypatch.setattr(nn_descent, "forest", no_edges)
    monkeypatch.setattr(nn_descent, "crossings", no_edges, raising=False)
    monkeypatch.setattr(nn_descent, "all_crossings", lambda *a: asked.append(1) or no_edges(*a), raising=False)
    assert not links_of(spark, x).any() and asked


def test_embeddings_by_search_alone(spark, monkeypatch):
    """A few thousand vectors, of which the search finds what the audit wants without the exact pass."""

    def exact(*_):
        raise AssertionError("the search is not enough")

    x, close = skewed()
    want = close.sum(1)
    monkeypatch.setattr(nn_descent, "all_crossings", exact, raising=False)
    got = links_of(spark, x)
    assert np.mean(got[want > 0] / want[want > 0]) >= 0.995 and (got <= want).all()


def test_crossings_keep_all_that_a_chunk_connects(spark):
    """A node with more than k tighter neighbours still leads to the farther one."""
    a = np.radians(np.concatenate([np.linspace(0, 1, 40), [25.0], np.linspace(49, 50, 40)]))
    rows = [(i, [float(np.cos(t)), float(np.sin(t))]) for i, t in enumerate(a)]
    _, nodes = nn_descent.nodes_of(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), nn_descent.Scratch(spark))
    edges = nn_descent.crossings(nodes.withColumn("root", F.col("node")), 0, range(1), 0.9).collect()
    assert len(edges) == 80
    place = {n: i for i, n in enumerate(sorted({r.node for r in edges} | {r.other for r in edges}))}
    assert set(components(range(81), [(place[r.node], place[r.other]) for r in edges]).values()) == {0}


# 9 Jaccard join


def sets_of(rows, k):
    out = []
    for r in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or ""))
        out.append(set() if not w else {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    return out


def jaccard_by_hand(rows, k, at_least, of):
    s = sets_of(rows, k)
    links = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and of * len(s[i] & s[j]) >= at_least * len(s[i] | s[j])]
    comp = components(range(len(s)), links)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[comp[i]] = min(least.get(comp[i], r[0]), r[0])
    return sorted(((r[0], len(s[i]), least.get(comp[i])) for i, r in enumerate(rows)), key=str)


def corpus(seed, copies=40):
    """A large group of near copies (long index lists), shared passages, short texts."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    text = lambda n: list(rng.choice(vocabulary, n))
    passage, base = text(30), text(120)
    docs = []
    for _ in range(copies):
        t = list(base)
        for _ in range(int(rng.integers(0, 5))):
            t[int(rng.integers(0, len(t)))] = str(rng.choice(vocabulary))
        docs.append(t)
    docs += [passage + text(int(rng.integers(3, 80))) for _ in range(30)] + [text(int(rng.integers(0, 6))) for _ in range(20)]
    docs += [passage + [str(rng.choice(vocabulary))] for _ in range(30)]
    return [(i, " ".join(t), "en", "s", 1, None, None) for i, t in enumerate(docs)]


@pytest.mark.parametrize(("k", "at_least", "seed"), [(4, 85, 0), (5, 80, 1)])
def test_jaccard_join(spark, k, at_least, seed):
    rows = corpus(seed) + ODD
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.components(spark, spark.createDataFrame(rows, DOCS), k, at_least, 100).collect()), key=str)
    want = jaccard_by_hand(rows, k, at_least, 100)
    # documents without words link with nothing, themselves apart
    assert [(a, n, c) for a, n, c in got if n] == [(a, n, c) for a, n, c in want if n] and len(got) == len(rows)


def at_the_threshold(n=400, seed=3):
    """A group of near copies whose similarities lie around the threshold, so few of its links come from chance meetings."""
    rng = np.random.default_rng(seed)
    base, rows = [f"b{i}" for i in range(90)], []
    for i in range(n):
        t = list(base)
        for p in rng.choice(len(t), int(rng.integers(0, 4)), replace=False):
            t[p] = f"x{rng.integers(0, 60)}"
        rows.append((i, " ".join(t), "en", "s", 1, None, None))
    return rows


def test_jaccard_group_at_the_threshold(spark, monkeypatch):
    # small blocks, so that lists are cut, and no memory between rounds
    monkeypatch.setattr(jaccard_join, "BLOCK", 64)
    rows = at_the_threshold()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.components(spark, spark.createDataFrame(rows, DOCS), 4, 85, 100).collect()), key=str)
    assert got == jaccard_by_hand(rows, 4, 85, 100) and 2 < len({c for *_, c in got}) < 300


def test_open_pairs_by_hand():
    """Every pair within the bounds comes with enough tries, and the nearest ones of each component with one."""
    rng = np.random.default_rng(4)
    sk = rng.integers(0, 2**63, (1, 4)).astype(np.uint64) ^ (np.uint64(1) << rng.integers(0, 30, (60, 4)).astype(np.uint64))
    size, place, comp, home = np.full(60, 40), np.zeros(60, np.int64), np.sort(rng.integers(0, 12, 60)), np.ones(60, bool)
    apart = jaccard_join._differ(sk, sk)
    want = {(i, j) for i in range(60) for j in range(60) if comp[i] < comp[j] and apart[i, j] <= 15 * 80 // 185}
    i, j, more = jaccard_join.open_pairs(sk, size, place, comp, home, None, 85, 100, 10**6)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and not more and want
    i, j, more = jaccard_join.open_pairs(sk, size, place, comp, home, None, 85, 100, 1)
    least = {c: min((apart[p] for p in want if c in (comp[p[0]], comp[p[1]])), default=None) for c in set(comp.tolist())}
    got = {c: min((apart[p] for p in zip(i, j, strict=True) if c in (comp[p[0]], comp[p[1]])), default=None) for c in least}
    assert got == least and more and len(i) <= 24


def test_jaccard_empty(spark, empty):
    assert jaccard_join.components(spark, empty).count() == 0 and jaccard_join.deduplicate(spark, empty).count() == 0


def test_deduplicate(spark, odd):
    out = jaccard_join.deduplicate(spark, odd)
    assert out.columns == odd.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([1, 3, 4, None, 5, 6], key=str)


# 10 SentencePiece

TEXTS = ["", " ", "a", " a", "  a  b ", "\n\n x\t y", "<s>hi</s> <0x0A>", "▁a ▁▁b", "日本語 🎉 é ñ", "\x00\x01", "a" * 3000, " " * 50, "<unk>", "ﬁ ①", "a ", "a▁b", "Schöne Grüße, Ça va? ¿Qué?"]


def test_pieces_parity_and_round_trip(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string")
    assert pieces.parity(spark, docs).count() == 0
    back = {r.doc_id: r.text for r in pieces.decode(spark, pieces.encode(spark, docs)).collect()}
    assert len(back) == len(TEXTS) + 1 and all(back[i] == t for i, t in enumerate(TEXTS) if "▁" not in t) and back[len(TEXTS)] == ""
    assert pieces.encode(spark, docs.limit(0)).count() == 0


def test_pieces_odd_tables(spark):
    """Repeated rows, ties and columns with names that the operator uses inside."""
    docs = spark.createDataFrame([(1, "one two", "x", "y"), (1, "one two", "x", "y"), (None, "two  one ", None, None), (2, "b " * 200_000 + "é\u0001", "", "")], "doc_id long, text string, ids string, n_tokens string")
    got = pieces.encode(spark, docs).collect()
    assert [c for c in pieces.encode(spark, docs).columns] == ["doc_id", "n_tokens", "ids"] and len(got) == 4
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(r.doc_id), sp.encode(r.text)) for r in docs.collect())
    assert pieces.summarize(spark, docs).where("round_trip").count() == 4 and pieces.parity(spark, docs).count() == 0


def test_unigram_model_is_rebuilt():
    import struct

    def field(n, wire, data):
        tag = bytes([n << 3 | wire])
        return tag + (bytes([len(data)]) + data if wire == 2 else data)

    piece = lambda p, s, k: field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k])))
    data = piece("<unk>", 0, 2) + piece("▁a", -1, 1) + piece("b", -2, 1) + piece("▁ab", -9, 1) + field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x01"))
    m = pieces.parse(data)
    assert m.kind == pieces.UNIGRAM and m.squeeze and pieces.build(m).encode("ab  ab", add_special_tokens=False).tokens == ["▁a", "b", "▁a", "b"]


def test_names():
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in registry.QUERIES} == set(range(1, 11)) and set(registry.SQL) <= set(registry.QUERIES)
