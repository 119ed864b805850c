"""Secret scans: candidates by pattern, false positives removed by a random forest, all within the row.

Candidates are long runs of token characters and shorter values that are assigned to a secret-like name. A random forest
(Spark's own, fitted in the JVM) judges each by its length, character classes and transitions between them, how much of
it is made of words of a dictionary and of common letter groups, whether it looks like a path, and the words beside it.
The dictionary is the corpus's own: the words that most documents have, counted over all of them. The fitted trees are
turned into one column expression, so that finding, judging and masking are a projection over the scan: no join, no shuffle,
and no text leaves its row.

The forest learns from labelled findings (before, value, after, label). Without any of your own, ``seed_findings`` makes
a fixed set: keys, tokens and passwords of usual forms against hashes of commits, checksums, ids, paths, placeholders
and long words.

Defined results: a null or empty text has no findings; findings carry spans (start from 0, in code points) and a digest
of the value, never the value; repeated rows are scanned one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm.common import free, table

NAMES = "passwords?|passwd|pwd|passphrase|secrets?|token|api[_-]?keys?|access[_-]?keys?|auth|credentials?|bearer|private[_-]?keys?"
#: What may follow such a name; before it anything may stand (DB_PASSWORD, client_secret, userPassword).
SUFFIX = r"(?:[_-]?(?:key|id|value|val|string|str|data|base64|b64|hex|prod|dev|test|live|new|old|[0-9]{1,3}))?" * 2
NAMED = f"(?:{NAMES}){SUFFIX}"
#: A value of a secret-like name or after "Bearer", or any run of at least twenty token characters, each as long as it is.
#: A run that is itself the name of a value is none. The short looks back come first: names are looked for only behind an assignment or a blank.
CANDIDATE = (
    rf"""(?:(?<=[=:][ ]{{0,2}}["']?)(?<=(?i:{NAMED})["']?[ ]{{0,2}}[=:][ ]{{0,2}}["']?)(?!(?i:bearer)[ ])"""
    r"""|(?<=[rR][ ]{1,2}["']?)(?<=(?<![A-Za-z0-9])(?i:bearer)[ ]{1,2}["']?))[^\s"'<>,;]{6,}+"""
    r"""|(?<![A-Za-z0-9+/_\-])(?=[A-Za-z0-9+/_\-]{20})"""
    rf"""(?![A-Za-z0-9_\-]*(?i:{NAMED})["']?[ ]{{0,2}}[=:][ ]{{0,2}}["']?[^\s"'<>,;=])"""
    r"""[A-Za-z0-9+/_\-]{20,}+={0,2}"""
)
#: True of every text with a candidate, and cheap; only texts that pass are searched.
HINT = r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{20}|[eE][rR] "
MASK = "<SECRET>"
CONTEXT = 40
#: Letter groups that words of European languages are made of.
GROUPS = "tion|ing|ent|ment|the|and|ion|ed|er|es|en|on|an|in|re|at|or|ch|ou|le|de|te|st|th|ie|ei|sch|ver|ung|ado|aci|qu|que|un|eau|eux|la|os|as|be|ge|is|it|to|al|ar|ha|nd|nt|ly|ble"

#: Words of the dictionary: the list is collected and becomes part of the expression.
MOST_WORDS, LEAST_LETTERS = 2000, 4

FEATURES = (
    "length", "digits", "upper", "lower", "symbols", "turns", "distinct", "known", "coverage", "vowels", "longest", "hex", "path", "named", "hashed", "quoted", "placeholder",
)


def _share(c: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(c, F.lit(f"[^{pattern}]"), F.lit(""))) / F.length(c)


def dictionary(docs: DataFrame, most: int = MOST_WORDS, text: str = "text") -> list[str]:
    """The ``most`` words of four letters or more that occur in most documents, two at least; equal counts by the word."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"[a-z]{{{LEAST_LETTERS},}}"), 0))
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    # every partition sends its first words to the driver: as many partitions as cores
    few = counted.coalesce(docs.sparkSession.sparkContext.defaultParallelism)
    return [r.word for r in few.orderBy(F.desc("n"), "word").limit(most).collect()]


def known_share(value: Column, words: Sequence[str]) -> Column:
    """Share of a value that is words of the dictionary: runs of letters, cut where a capital follows a small letter."""
    if not words:
        return F.lit(0.0)
    runs = F.transform(F.split(value, "[^A-Za-z]+|(?<=[a-z])(?=[A-Z])"), F.lower)
    listed = F.split(F.lit(" ".join(words)), " ")  # one literal in the plan; candidates are few
    return F.aggregate(F.filter(runs, lambda x: F.array_contains(listed, x)), F.lit(0), lambda n, x: n + F.length(x)) / F.length(value)


def features(before: Column, value: Column, after: Column, words: Sequence[str] = ()) -> dict[str, Column]:
    """What the forest sees of a candidate and the text beside it, as doubles."""
    low = F.lower(value)
    groups = F.regexp_replace(low, F.lit(GROUPS), F.lit(""))
    turns = F.regexp_count(value, F.lit("(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"))
    runs = F.array_max(F.transform(F.split(value, "[^A-Za-z]+"), lambda x: F.length(x)))
    named = before.rlike(rf"""(?i)(?:{NAMED}["']?\s*[=:]\s*|(?<![a-z0-9])bearer\s+)["']?$""")
    flag = lambda c: F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))
    return {
        "length": F.length(value).cast("double"),
        "digits": _share(value, "0-9"),
        "upper": _share(value, "A-Z"),
        "lower": _share(value, "a-z"),
        "symbols": 1.0 - _share(value, "A-Za-z0-9"),
        "turns": turns / F.length(value),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
        "known": known_share(value, words),
        "coverage": 1.0 - F.length(groups) / F.length(value),
        "vowels": _share(low, "aeiou"),
        "longest": runs.cast("double"),
        "hex": flag(value.rlike("^[0-9a-fA-F-]+$")),
        "path": flag(value.rlike(r"^/|/[^/]+/|\.[a-z]{1,4}$") | before.rlike(r"(?:://|/)[^\s]*$")),
        "named": flag(named),
        # the last part of a secret-like name, as in api_key_id, says nothing of a hash
        "hashed": flag(~named & before.rlike(r"(?i)(?:sha-?\d*|md5|commit|checksum|digest|hash|uuid|guid|id|rev|integrity|version|etag)\W{0,4}$")),
        "quoted": flag(after.rlike("""^["']""")),
        "placeholder": flag(low.rlike(r"^(?:x+|\*+|\.+|<.*>|\$\{.*|your.*|example.*|changeme.*|none|null|test.*|placeholder.*|password|secret|todo.*)$")),
    }


def seed_findings(spark: SparkSession, per_form: int = 400, words: Sequence[str] = ()) -> DataFrame:
    """Labelled findings (before, value, after, label) of usual forms, the same on every run for the same dictionary."""
    h = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")).cast("binary"), 256)
    pick = lambda salt, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.abs(F.xxhash64(F.lit(salt), "id")) % len(xs) + 1).cast("int"))
    b64 = lambda salt, n: F.substring(F.translate(F.base64(F.unhex(F.concat(h(salt), h(salt + "'")))), "=\r\n", "A"), 1, n)
    word = F.concat(*[pick(f"w{i}", "tion", "ing", "the", "re", "schaft", "ment", "eau", "lich", "ado", "que", "ver", "an", "st", "on", "er") for i in range(8)])
    size = lambda salt, low, high: (F.abs(F.xxhash64(F.lit(salt), "id")) % (high - low + 1) + low).cast("int")
    # base64 of any length: one digest for each 43 characters
    run = lambda salt, n: F.substring(F.array_join(F.transform(F.sequence(F.lit(1), F.ceil(n / 43).cast("int")), lambda i: F.translate(F.base64(F.unhex(F.sha2(F.concat_ws("/", F.lit(salt), F.col("id").cast("string"), i.cast("string")).cast("binary"), 256))), "=", "")), ""), F.lit(1), n)
    url_safe = lambda c: F.translate(c, "+/", "-_")
    close = F.lit('" and')
    open_name = F.concat(pick("n", "token", "api_key", "secret", "auth", "access_key"), pick("e", ' = "', '="', ': "', "="))
    forms = [
        (1, open_name, F.substring(h("a"), 1, 40), close),
        (1, open_name, F.substring(h("b"), 1, 32), close),
        (1, F.concat(pick("k", "of the ", "is ", "key ", "")), F.concat(F.lit("AKIA"), F.upper(F.translate(F.substring(b64("c", 40), 1, 16), "+/", "XY"))), F.lit(" and")),
        (1, pick("g", "", "use ", "export "), F.concat(F.lit("ghp_"), F.translate(b64("d", 36), "+/", "XY")), F.lit(" ")),
        (1, pick("s", "", "key "), F.concat(F.lit("sk_live_"), F.translate(b64("e", 24), "+/", "XY")), F.lit(" ")),
        (1, F.concat(pick("p", "password", "passwd", "pwd"), pick("q", "=", ": ", " = ")), F.substring(F.concat(pick("v", "hunter", "Tr0ub", "s3cr3t", "qwe", "pw"), F.substring(b64("f", 20), 1, 8)), 1, 14), F.lit(" ")),
        (1, F.concat(pick("p2", "password", "secret"), F.lit("=")), b64("g", 12), F.lit(" ")),
        (1, F.concat(pick("p3", "password", "passwd", "pwd", "passphrase"), pick("q3", "=", ": ")), F.concat(pick("v3", "hunter", "letmein", "summer", "dragon", "monkey", "Winter", "admin"), F.substring(F.translate(h("n"), "abcdef", "135790"), 1, 2), pick("v4", "", "x", "!", "#a", "Z")), F.lit(" ")),
        (1, F.concat(pick("p4", "password", "secret", "token"), F.lit("=")), F.substring(h("o"), 1, 12), F.lit(" ")),
        (1, open_name, b64("h", 40), close),
        (1, F.concat(open_name, pick("jq", "", "", "Bearer ")), F.concat_ws(".", F.concat(F.lit("eyJ"), url_safe(run("j1", F.lit(33)))), F.concat(F.lit("eyJ"), url_safe(run("j2", size("jn", 60, 900)))), url_safe(run("j3", F.lit(43)))), close),
        (1, pick("lk", "key ", "", "is ", "\n"), run("l1", size("ln", 64, 2400)), pick("lz", " ", "\n")),
        (1, open_name, run("l2", size("lm", 64, 2400)), close),
        (1, F.concat(pick("p5", "DB_PASSWORD", "client_secret", "auth_token", "SECRET_KEY", "user_pwd", "userPassword", "API_KEY_ID"), pick("q5", "=", ": ", " = ")), F.concat(pick("v5", "hunter", "letmein", "Tr0ub", "summer", "s3cr3t"), F.substring(h("s1"), 1, 3), pick("v6", "", ".x", "!", "#a", "@Z", "$9")), F.lit(" ")),
        (1, pick("b5", "Authorization: Bearer ", "bearer ", "Bearer "), run("t1", size("tn", 8, 60)), pick("b6", " ", '" ')),
        (0, pick("b7", "the bearer ", "bearer ", "standard bearer "), pick("b8", "shares", "certificate", "instruments", "walked", "carried", "through", "securities", "should", "depository", "against", "himself.", "tokens"), F.lit(" ")),
        (0, pick("y5", "export ", "set ", "\n"), F.concat(F.upper(word), F.lit("_"), pick("y6", "SECRET", "TOKEN", "PASSWORD", "URL"), F.lit("_"), F.upper(word), F.lit("=")), F.lit("")),
        (0, pick("c", "commit ", "rev ", "sha1: ", "hash "), F.substring(h("i"), 1, 40), F.lit(" fixes")),
        (0, pick("c2", "sha256:", "checksum ", "digest: ", "integrity "), h("j"), F.lit(" ok")),
        (0, pick("u", "id ", "uuid: ", "guid="), F.concat_ws("-", F.substring(h("k"), 1, 8), F.substring(h("k"), 9, 4), F.substring(h("k"), 13, 4), F.substring(h("k"), 17, 4), F.substring(h("k"), 21, 12)), F.lit(" ")),
        (0, pick("d", "the ", "and ", "of ", ". "), word, F.lit(" and")),
        (0, pick("d2", "the ", "and "), F.concat(F.initcap(word), F.lit("-"), word), F.lit(",")),
        (0, pick("r", "in ", "file ", "https://a.example"), F.concat(F.lit("/"), pick("r1", "usr", "var", "home", "static"), F.lit("/"), word, F.lit("/"), F.substring(h("l"), 1, 6)), F.lit(" ")),
        (0, F.concat(pick("z", "password", "token", "secret"), pick("z2", "=", ": ", ' = "')), pick("z3", "xxxxxxxx", "********", "your_token_here", "changeme", "example-token", "${PASSWORD}", "placeholder", "password"), F.lit('"')),
        (0, pick("y", "call ", "the "), F.concat(pick("y1", "get", "set", "make"), F.initcap(word), F.lit("_"), F.initcap(word)), F.lit("(")),
        (0, pick("x", "number ", "no. ", ""), F.translate(F.substring(h("m"), 1, 24), "abcdef", "012345"), F.lit(" ")),
        (0, pick("c3", "sha512:", "checksum ", "digest: "), F.concat(h("q1"), h("q2")), F.lit(" ok")),
        (0, pick("r5", "in ", "file ", "https://a.example"), F.concat(F.lit("/"), F.array_join(F.array_repeat(F.concat(word, F.lit("/")), size("r6", 2, 30)), "")), F.lit(" ")),
        (0, pick("d5", "the ", "and ", ""), F.array_join(F.array_repeat(word, size("d6", 2, 30)), "-"), F.lit(" ")),
        (0, pick("e5", "", " ", "\n"), F.repeat(pick("e6", "-", "_", "-+", "/"), size("e7", 20, 600)), F.lit(" ")),
    ]
    if words:
        # names and phrases of the corpus's own words
        own = lambda salt: F.element_at(F.split(F.lit(" ".join(words)), " "), (F.abs(F.xxhash64(F.lit(salt), "id")) % len(words) + 1).cast("int"))
        joined = lambda sep, *salts: F.concat_ws(sep, *[own(x) for x in salts])
        forms += [
            (0, pick("o1", "the ", "see ", "\n"), joined("-", "oa", "ob", "oc", "od", "oe"), F.lit(" ")),
            (0, pick("o2", "call ", "name ", ""), joined("_", "of", "og", "oh", "oi", "oj"), F.lit("(")),
            (0, pick("o3", "https://", "in ", "path: "), joined("/", "ok", "ol", "om", "on", "oo"), F.lit(" ")),
            (0, F.concat(pick("o4", "token", "secret", "auth", "password"), F.lit(": ")), own("op"), pick("o5", ".", ",", " ")),
        ]
    # one plan for all forms
    at = spark.range(0, per_form * len(forms), 1, 1).select((F.col("id") % per_form).alias("id"), F.floor(F.col("id") / per_form).cast("int").alias("form"))
    made = [F.struct(b.alias("before"), v.alias("value"), a.alias("after"), F.lit(float(y)).alias("label")) for y, b, v, a in forms]
    finding = F.when(F.col("form") == 0, made[0])
    for i, x in enumerate(made[1:-1], 1):
        finding = finding.when(F.col("form") == i, x)
    return at.select(finding.otherwise(made[-1]).alias("finding")).select("finding.*")


def fit(findings: DataFrame, words: Sequence[str] = (), trees: int = 20, depth: int = 6, seed: int = 11) -> RandomForestClassificationModel:
    """The forest; it keeps the dictionary that it was fitted with."""
    seen = findings.select("label", *[c.cast("double").alias(k) for k, c in features(F.col("before"), F.col("value"), F.col("after"), words).items()])
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(seen.coalesce(4)).select("features", "label").persist()
    try:
        model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, maxBins=64).fit(rows)
        model.words = list(words)
        return model
    finally:
        rows.unpersist()


def learn(spark: SparkSession, docs: DataFrame) -> RandomForestClassificationModel:
    """A forest fitted on the seed findings with the dictionary of ``docs``."""
    words = dictionary(docs)
    return fit(seed_findings(spark, words=words), words)


def as_expression(model: RandomForestClassificationModel) -> Callable[[Column], Column]:
    """The forest as a function from a struct of FEATURES to the share of votes for label 1.

    The nodes of all trees are arrays (feature, threshold, place of the left and the right child), one literal each, and a
    tree is walked by an aggregation over its depth: the plan is the same size for any forest. A leaf is its own child,
    and its threshold is its share.
    """
    feature, threshold, left, right, roots = [], [], [], [], []

    def put(node) -> int:
        at = len(feature)
        leaf = node.numDescendants() == 0
        for x in (feature, threshold, left, right):
            x.append(at)
        if leaf:
            stats = list(node.impurityStats().stats())
            feature[at], threshold[at] = 0, float(stats[1] / sum(stats)) if len(stats) > 1 else 0.0
        else:
            split = node.split()
            feature[at], threshold[at] = split.featureIndex(), float(split.threshold())
            left[at], right[at] = put(node.leftChild()), put(node.rightChild())
        return at

    trees = list(model._java_obj.trees())
    depth = max(t.depth() for t in trees)
    for t in trees:
        roots.append(put(t.rootNode()))
    known = lambda xs, kind: F.split(F.lit(" ".join(map(repr, xs))), " ").cast(f"array<{kind}>")
    features, thresholds, lefts, rights = known(feature, "int"), known(threshold, "double"), known(left, "int"), known(right, "int")
    steps = known(range(max(1, depth)), "int")

    def score(row: Column) -> Column:
        seen = F.array(*[row[x] for x in FEATURES])
        step = lambda at, _: F.when(F.get(seen, F.get(features, at)) <= F.get(thresholds, at), F.get(lefts, at)).otherwise(F.get(rights, at))
        votes = F.transform(known(roots, "int"), lambda root: F.get(thresholds, F.aggregate(steps, root, step)))
        return F.aggregate(votes, F.lit(0.0), lambda a, x: a + x) / float(len(trees))

    return score


def scan(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` with two more columns, the last ones: findings array<struct(start, value, score, secret)> and parts (text
    between candidates), null where none. They take longer names where ``docs`` has these."""
    own = {x: free(x, docs.columns) for x in ("_spans", "_seen", "_judged", "findings", "parts")}
    score = as_expression(model)
    t = F.col(text)
    # the text before a candidate is looked at past the candidate before it, which may be the name of this one
    parts, found = F.split(t, CANDIDATE, -1), F.regexp_extract_all(t, F.lit(CANDIDATE), 0)
    spans = F.aggregate(
        F.arrays_zip(F.slice(parts, 1, F.size(found)).alias("part"), found.alias("value"), F.slice(parts, 2, F.size(found)).alias("rest")),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast("array<struct<start:int,before:string,value:string,after:string>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["part"]) + F.length(x["value"])).alias("at"),
            F.right(F.concat(a["tail"], x["part"], x["value"]), F.lit(CONTEXT)).alias("tail"),
            F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["part"])).alias("start"), F.right(F.concat(a["tail"], x["part"]), F.lit(CONTEXT)).alias("before"), x["value"].alias("value"), F.left(x["rest"], F.lit(8)).alias("after")))).alias("out"),
        ),
    )["out"]
    seen = F.transform(F.col(own["_spans"]), lambda x: F.struct(x.alias("span"), F.struct(*[c.cast("double").alias(k) for k, c in features(x["before"], x["value"], x["after"], model.words).items()]).alias("f")))
    judged = F.transform(F.col(own["_seen"]), lambda x: F.struct(x["span"]["start"].alias("start"), x["span"]["value"].alias("value"), score(x["f"]).alias("score")))
    with_any = (t.contains("=") | t.contains(":") | t.rlike(HINT)) & t.rlike(CANDIDATE)
    return (
        docs.withColumn(own["_spans"], F.when(with_any, spans))
        .withColumn(own["_seen"], F.when(F.col(own["_spans"]).isNotNull(), seen))
        .withColumn(own["_judged"], F.when(F.col(own["_seen"]).isNotNull(), judged))
        .withColumn(own["findings"], F.transform(own["_judged"], lambda x: F.struct(x["start"].alias("start"), x["value"].alias("value"), x["score"].alias("score"), (x["score"] >= threshold).alias("secret"))))
        .withColumn(own["parts"], F.when(with_any, parts))
        .drop(own["_spans"], own["_seen"], own["_judged"])
    )


def findings(scanned: DataFrame) -> DataFrame:
    """One row per candidate of what ``scan`` returned: doc_id, start, length, value_sha256, score, secret."""
    found = scanned.columns[-2]
    return scanned.where(F.col(found).isNotNull()).select("doc_id", F.explode(found).alias("f")).select(
        "doc_id", F.col("f.start").cast("long").alias("start"), F.length("f.value").cast("long").alias("length"), F.sha2("f.value", 256).alias("value_sha256"), "f.score", "f.secret"
    )


def redact(scanned: DataFrame, text: str = "text") -> DataFrame:
    """What ``scan`` was given, from what it returned, with secrets in the text replaced by MASK."""
    found, parts = scanned.columns[-2:]
    values = F.concat(F.transform(found, lambda x: F.when(x["secret"], F.lit(MASK)).otherwise(x["value"])), F.array(F.lit("")))
    masked = F.array_join(F.zip_with(parts, values, lambda p, v: F.concat(p, v)), "")
    return scanned.withColumn(text, F.when(F.exists(found, lambda x: x["secret"]), masked).otherwise(F.col(text))).drop(found, parts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return findings(scan(docs, learn(spark, docs)))
