"""Document fingerprints: Merkle trees over sections, paragraphs and runs of words.

A text splits at blank lines into sections, a section at line ends into paragraphs, a paragraph into leaves: runs of up
to twelve words that end early at punctuation, so that an edit moves no boundary beyond the next punctuation mark. Every
level hashes the hashes below it with SHA-256. A split loses nothing, so equal roots mean equal texts.

The fingerprint is a string of all levels: the root, then for every section the first eight hex digits of its hash, ":",
and its paragraphs, each with the digits of its own hash and of its leaves. Paragraphs are parted by "," and sections by
"/". Two stored fingerprints are compared without their texts, from the root down: equal roots are equal texts; equal
sections are alike as a whole and are not descended, in the others equal paragraphs are alike as a whole, and only leaves
of paragraphs that differ are compared. The likeness is the Dice coefficient of the leaves found alike this way. The first
section, and the first paragraph within it, that differ are the place of an edit.

Defined results: a null text is an empty one; equal doc_ids order by text; null doc_ids come last in descending order;
a table of one row is its own next document; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from waybill.llm.common import table

LEAF = r"(?:[^ ]*[^ .!?;:,] +){0,11}(?:[^ ]+ *| +)"
DIGITS = 8
#: Documents to a range of ids, and the most ranges there may be.
RANGE_ROWS, MOST_RANGES = 1000, 20_000


def tree(text: Column) -> Column:
    """Sections as arrays of paragraphs, each a struct(hash, leaves: leaf hashes joined, cut to DIGITS each)."""

    def paragraph(p: Column) -> Column:
        found = F.transform(F.regexp_extract_all(p, F.lit(LEAF), 0), lambda x: F.sha2(x, 256))
        return F.struct(
            F.sha2(F.concat(F.lit("p"), F.array_join(found, "")), 256).alias("hash"),
            F.array_join(F.transform(found, lambda x: F.substring(x, 1, DIGITS)), "").alias("leaves"),
        )

    return F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), paragraph))


def serialize(t: Column) -> Column:
    """The fingerprint string of a tree."""
    sections = F.transform(
        t,
        lambda s: F.struct(
            F.sha2(F.concat(F.lit("s"), F.array_join(F.transform(s, lambda p: p["hash"]), "")), 256).alias("hash"),
            F.array_join(F.transform(s, lambda p: F.concat(F.substring(p["hash"], 1, DIGITS), p["leaves"])), ",").alias("below"),
        ),
    )
    return F.aggregate(
        F.array(sections),
        F.lit(""),
        lambda _, x: F.concat(
            F.sha2(F.concat(F.lit("r"), F.array_join(F.transform(x, lambda s: s["hash"]), "")), 256),
            F.lit("|"),
            F.array_join(F.transform(x, lambda s: F.concat(F.substring(s["hash"], 1, DIGITS), F.lit(":"), s["below"])), "/"),
        ),
    )


def fingerprint(text: Column) -> Column:
    return serialize(tree(F.coalesce(text, F.lit(""))))


def root(fp: Column) -> Column:
    return F.substring(fp, 1, 64)


def sections(fp: Column) -> Column:
    """The branches below the root of a fingerprint string."""
    return F.split(F.substring(fp, 66, 1 << 30), "/", -1)


def _paragraphs(section: Column) -> Column:
    return F.split(F.substring(section, DIGITS + 2, 1 << 30), ",", -1)


def _leaf_count(paragraphs: Column) -> Column:
    return F.aggregate(paragraphs, F.lit(0).cast("long"), lambda n, p: n + (F.length(p) / DIGITS).cast("long") - 1)


def _leaves(paragraphs: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(paragraphs, lambda p: F.regexp_extract_all(F.substring(p, DIGITS + 1, 1 << 30), F.lit(f".{{{DIGITS}}}"), 0))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two stored fingerprints, 0 to 1: whole branches where hashes are equal, leaves where they differ."""

    def leaves(x: Column) -> Column:
        alike, u, v = x["alike"], _leaves(x["u"]), _leaves(x["v"])
        counts = F.struct(F.size(F.array_intersect(u, v)).alias("both"), (F.size(u) + F.size(v)).alias("all"))
        return _let(counts, lambda c: F.when(2 * alike + c["all"] == 0, F.lit(0.0)).otherwise(F.lit(2.0) * (alike + c["both"]) / (2 * alike + c["all"])))

    def paragraphs(x: Column) -> Column:
        u = F.array_distinct(F.flatten(F.transform(x["u"], _paragraphs)))
        v = F.array_distinct(F.flatten(F.transform(x["v"], _paragraphs)))
        met = F.struct(x["alike"].alias("alike"), u.alias("u"), v.alias("v"))
        down = lambda y: F.struct((y["alike"] + _leaf_count(F.array_intersect(y["u"], y["v"]))).alias("alike"), F.array_except(y["u"], y["v"]).alias("u"), F.array_except(y["v"], y["u"]).alias("v"))
        return _let(met, lambda y: _let(down(y), leaves))

    def branches(x: Column) -> Column:
        equal = F.array_intersect(x["u"], x["v"])
        alike = F.aggregate(equal, F.lit(0).cast("long"), lambda n, s: n + _leaf_count(_paragraphs(s)))
        down = F.struct(alike.alias("alike"), F.array_except(x["u"], x["v"]).alias("u"), F.array_except(x["v"], x["u"]).alias("v"))
        return _let(down, paragraphs)

    met = F.struct(sections(a).alias("u"), sections(b).alias("v"))
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(_let(met, branches))


def first_difference(a: Column, b: Column) -> Column:
    """struct(section, paragraph), from 1, of the first branch in which two fingerprints differ; null if none does."""
    place = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False).cast("int")

    def inner(x: Column) -> Column:
        below = lambda s: F.when(x["i"] <= F.size(s), _paragraphs(F.get(s, x["i"] - 1))).otherwise(F.array().cast("array<string>"))
        return F.struct(x["i"].alias("section"), place(below(x["u"]), below(x["v"])).alias("paragraph"))

    met = F.struct(sections(a).alias("u"), sections(b).alias("v"))
    return F.when(root(a) != root(b), _let(met, lambda x: _let(F.struct(place(x["u"], x["v"]).alias("i"), x["u"].alias("u"), x["v"].alias("v")), inner)))


def neighbours(docs: DataFrame) -> tuple[DataFrame, WindowSpec]:
    """Rows (doc_id, text, ghost) and the window in which lead() finds the next document in descending order of doc_id,
    the first following the last. Ghosts are there to be found only.

    Texts are dealt once, by ranges of about RANGE_ROWS ids whose bounds are quantiles of all ids; the head of each
    range is sent to the range before it as well.
    """
    spark = docs.sparkSession
    k = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), k.alias("k"))
    n = rows.count()
    wanted = min(MOST_RANGES, max(-(-n // RANGE_ROWS), 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    fractions = [i / wanted for i in range(1, wanted)]
    bounds = sorted(set(rows.agg(F.percentile_approx("k", fractions, max(10_000, 10 * wanted)).alias("q")).first().q or [])) if n and fractions else []
    # two levels, so that a lookup compares with twice the root of the number of bounds
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    tops = F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<bigint>")
    lower = F.from_json(F.lit(json.dumps([[]] + groups)), "array<array<bigint>>")
    top = F.size(F.filter(tops, lambda x: x <= F.col("k")))
    inner = F.size(F.filter(F.element_at(lower, F.col("top") + 1), lambda x: x <= F.col("k")))
    rows = rows.withColumn("top", top).withColumn("range", F.col("top") * (step + 1) + inner)
    heads = [tuple(r) for r in rows.groupBy("range").agg(F.max("k").alias("k")).orderBy(F.desc("range")).collect()]  # MOST_RANGES rows at most
    to = [(k, heads[i - 1][0]) for i, (_, k) in enumerate(heads)]
    ghosts = F.broadcast(spark.createDataFrame(to, "k long, ahead int"))
    placed = (
        rows.join(ghosts, "k", "left")
        .select("doc_id", "text", "k", F.explode(F.when(F.col("ahead").isNull(), F.array(F.struct("range", F.lit(False).alias("ghost")))).otherwise(
            F.array(F.struct("range", F.lit(False).alias("ghost")), F.struct(F.col("ahead").alias("range"), F.lit(True).alias("ghost"))))).alias("at"))
        .select("doc_id", "text", "k", "at.range", "at.ghost")
    )
    placed = placed.repartition("range")
    order = Window.partitionBy("range").orderBy("ghost", F.desc("k"), "text")
    return placed, order


def edits(docs: DataFrame) -> DataFrame:
    """Every document with its fingerprint, that of its edited text, and likenesses (see ``query``)."""
    placed, order = neighbours(docs)
    t = placed.withColumn("fingerprint", fingerprint(F.col("text")))
    lead = t.select(
        "doc_id", "text", "ghost", "fingerprint", F.lead("text").over(order).alias("next_text"), F.lead("fingerprint").over(order).alias("next_fingerprint")
    ).where(~F.col("ghost"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = (
        lead.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
        .withColumn("edited_fingerprint", fingerprint(F.col("edited")))
        .withColumn("edit", first_difference(F.col("fingerprint"), F.col("edited_fingerprint")))
    )
    return edited.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.col("edit.section").alias("edit_section"),
        F.col("edit.paragraph").alias("edit_paragraph"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS rn FROM documents),
n AS (
  SELECT a.doc_id, a.rn, a.text, coalesce(b.text, (SELECT text FROM t WHERE rn = 1)) AS next_text, length(a.text) AS n
  FROM t a LEFT JOIN t b ON b.rn = a.rn + 1),
e AS (SELECT *, substr(text, 1, n - n // 2) || substr(next_text, 1, n // 2) AS edited FROM n),
three AS (SELECT rn, 'a' AS what, text AS x FROM e UNION ALL SELECT rn, 'b', edited FROM e UNION ALL SELECT rn, 'c', next_text FROM e),
leaved AS (
  SELECT rn, what, list_transform(string_split(x, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
    lambda p: list_transform(regexp_extract_all(p, '(?:[^ ]*[^ .!?;:,] +){0,11}(?:[^ ]+ *| +)'), lambda l: sha256(l)))) AS tree
  FROM three),
hashed AS (
  SELECT rn, what, list_transform(tree, lambda s: list_transform(s, lambda p: {'h': sha256('p' || array_to_string(p, '')), 'l': array_to_string(list_transform(p, lambda l: substr(l, 1, 8)), '')})) AS t
  FROM leaved),
named AS (
  SELECT rn, what, list_transform(t, lambda s: {'h': sha256('s' || array_to_string(list_transform(s, lambda p: p.h), '')), 'b': array_to_string(list_transform(s, lambda p: substr(p.h, 1, 8) || p.l), ',')}) AS t FROM hashed),
printed AS MATERIALIZED (
  SELECT rn, what, sha256('r' || array_to_string(list_transform(t, lambda s: s.h), '')) AS root, list_transform(t, lambda s: substr(s.h, 1, 8) || ':' || s.b) AS parts FROM named),
met AS (
  SELECT e.rn, x.what, a.root = x.root AS same, a.root || '|' || array_to_string(a.parts, '/') AS fp, x.root || '|' || array_to_string(x.parts, '/') AS other_fp, a.parts AS u, x.parts AS v
  FROM e JOIN printed a ON a.rn = e.rn AND a.what = 'a' JOIN printed x ON x.rn = e.rn AND x.what <> 'a'),
level1 AS (
  SELECT *, coalesce(list_sum(list_transform(list_filter(list_distinct(u), lambda s: list_contains(v, s)), lambda s: list_sum(list_transform(string_split(substr(s, 10), ','), lambda p: length(p) // 8 - 1)))), 0) AS alike1,
    list_distinct(flatten(list_transform(list_filter(u, lambda s: NOT list_contains(v, s)), lambda s: string_split(substr(s, 10), ',')))) AS pu,
    list_distinct(flatten(list_transform(list_filter(v, lambda s: NOT list_contains(u, s)), lambda s: string_split(substr(s, 10), ',')))) AS pv,
    list_position(list_transform(range(1, greatest(len(u), len(v)) + 1), lambda i: u[i] IS NOT DISTINCT FROM v[i]), false) AS first_at
  FROM met),
level2 AS (
  SELECT *, alike1 + coalesce(list_sum(list_transform(list_filter(pu, lambda p: list_contains(pv, p)), lambda p: length(p) // 8 - 1)), 0) AS alike,
    list_distinct(flatten(list_transform(list_filter(pu, lambda p: NOT list_contains(pv, p)), lambda p: regexp_extract_all(substr(p, 9), '.{8}')))) AS lu,
    list_distinct(flatten(list_transform(list_filter(pv, lambda p: NOT list_contains(pu, p)), lambda p: regexp_extract_all(substr(p, 9), '.{8}')))) AS lv,
    CASE WHEN first_at <= len(u) THEN string_split(substr(u[first_at], 10), ',') ELSE [] END AS qu, CASE WHEN first_at <= len(v) THEN string_split(substr(v[first_at], 10), ',') ELSE [] END AS qv
  FROM level1),
scored AS (
  SELECT *, CASE WHEN same THEN 1.0::DOUBLE WHEN 2 * alike + len(lu) + len(lv) = 0 THEN 0.0::DOUBLE
      ELSE 2.0::DOUBLE * (alike + len(list_filter(lu, lambda l: list_contains(lv, l)))) / (2 * alike + len(lu) + len(lv)) END AS near,
    list_position(list_transform(range(1, greatest(len(qu), len(qv)) + 1), lambda i: qu[i] IS NOT DISTINCT FROM qv[i]), false) AS inner_at
  FROM level2)
SELECT e.doc_id, e.n AS n_chars, sha256(e.edited) AS edited_sha256, b.fp AS fingerprint, b.other_fp AS edited_fingerprint, b.near AS near_edited, c.near AS near_next,
  CASE WHEN NOT b.same THEN b.first_at END AS edit_section, CASE WHEN NOT b.same THEN b.inner_at END AS edit_paragraph
FROM e JOIN scored b ON b.rn = e.rn AND b.what = 'b' JOIN scored c ON c.rn = e.rn AND c.what = 'c'
"""
