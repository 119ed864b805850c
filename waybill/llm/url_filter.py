"""URL filters: fixed host and path rules first, then association rules mined from labelled urls.

The fixed rules decide the urls they fit. Those urls, labelled by the rules, are also what the method learns from:
FP-growth (Spark's own, in the JVM) mines frequent combinations of url tokens with the label as one more item, and
rules "tokens => label" pruned by support, confidence and lift judge the other urls through an inverted index from
token to rule. With other labels at hand, pass them as ``labelled``.

The items of a url are drawn from its parts: the labels of its host by their place from the right, its scheme, the
names of its query parameters and the first segment of its path. Tokens that occur in the same rows are one item. Host
labels that only one site has are no frequent items and cost nothing after the first count. As the labels come from the
fixed rules unless others are given, what is mined repeats and widens those rules.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule; an empty host is
allowed unless a mined rule says otherwise; repeated rows are judged one by one; an empty table gives no rows; without
any labelled url all are allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from waybill.llm.common import Scratch, ascii_lower, table

#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Distinct sets of rule tokens are broadcast up to this many; beyond it they are joined by shuffle.
BROADCAST_SETS = 20_000


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), null where none fits."""
    out = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def items(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url, each with the part it stands in."""
    labels = F.reverse(F.filter(F.split(host, r"\."), lambda x: x != ""))
    placed = F.transform(labels, lambda x, i: F.concat(F.lit("h"), F.least(i, F.lit(3)).cast("string"), F.lit("="), x))
    scheme = F.array(F.concat(F.lit("s="), ascii_lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))))
    first = F.filter(F.array(F.concat(F.lit("p="), F.regexp_extract(path, r"^/([^/]*)", 1))), lambda x: x != "p=")
    names = F.transform(F.regexp_extract_all(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), 1), lambda x: F.concat(F.lit("q="), x))
    return F.array_distinct(F.concat(placed, scheme, first, names))


def same_rows(labelled: DataFrame, min_support: float) -> dict[str, str]:
    """Token to item for all tokens with the support: tokens that occur in the same rows are one item, named by the least.

    Tokens below the support are dropped here, which bounds what is collected by the mean number of tokens over the support.
    """
    rows = labelled.select("items", F.monotonically_increasing_id().alias("row"))
    least = F.ceil(F.lit(min_support) * labelled.count())
    seen = rows.select("row", F.explode("items").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"), F.sum(F.xxhash64(F.lit(2), "row").cast("decimal(38,0)")).alias("y")
    )
    groups = seen.where(F.col("n") >= least).groupBy("n", "x", "y").agg(F.collect_list("token").alias("tokens"))
    return {t: min(g.tokens) for g in groups.select("tokens").collect() for t in g.tokens}


def as_items(tokens: Column, item_of: dict[str, str]) -> Column:
    """The items that any of these tokens stands for, sorted."""
    if not item_of:
        return F.array().cast("array<string>")
    known = F.array(*[F.lit(t) for t in sorted(item_of)])
    names = F.create_map(*[F.lit(x) for t in sorted(item_of) for x in (t, item_of[t])])
    return F.array_sort(F.array_distinct(F.transform(F.array_intersect(tokens, known), lambda t: F.element_at(names, t))))


def mine(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.8, min_lift: float = 1.05) -> tuple[DataFrame, dict[str, str]]:
    """Rules (rule_id, tokens, label, confidence, support) from ``labelled`` (items, label), and the item of each token.

    Tokens that always come together are mined as one item, so that twenty constant parameters of one site are one and
    not 2^20 sets of them; a rule on the item is a rule on any of its tokens. A rule that says nothing more than one with
    fewer of its tokens is pruned. Rules have any length.
    """
    item_of = same_rows(labelled, min_support)
    marked = labelled.select(F.concat(as_items(F.col("items"), item_of), F.array(F.concat(F.lit("label="), F.col("label")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(marked)
    found = (
        model.associationRules.where((F.size("consequent") == 1) & F.col("consequent")[0].startswith("label=") & (F.col("lift") >= min_lift))
        .where(~F.exists("antecedent", lambda x: x.startswith("label=")))
        .select(F.array_sort("antecedent").alias("tokens"), F.substring(F.col("consequent")[0], 7, 1000).alias("label"), F.round("confidence", 9).alias("confidence"), "support")
        .withColumn("rule_id", F.concat_ws(" ", "tokens"))
    )
    # every rule meets the rules on one token fewer: if one is as good, it stands for both
    fewer = found.select("label", F.explode("tokens").alias("out"), "rule_id", "tokens", F.col("confidence").alias("c")).select(
        "rule_id", "label", "c", F.concat_ws(" ", F.array_except("tokens", F.array("out"))).alias("part")
    )
    said = fewer.join(found.select(F.col("rule_id").alias("part"), "label", "confidence"), ["part", "label"]).where("confidence >= c").select("rule_id", "label").distinct()
    return found.join(said, ["rule_id", "label"], "left_anti"), item_of


def match(spark: SparkSession, rows: DataFrame, rules: DataFrame, item_of: dict[str, str], scratch: Scratch | None = None) -> DataFrame:
    """Adds label and mined (the id of the best fitting rule, by confidence, then length and support) to ``rows``.

    The inverted index holds each rule under its rarest item. Rows look up by distinct sets of rule items, not one by
    one, so a site with a third of all urls costs one lookup. Frequent tokens number at most the mean tokens of a url
    over the support, which is why the vocabulary may be a literal.
    """
    scratch = scratch or Scratch(spark)
    rules = scratch.put(rules)
    counted = rules.select("rule_id", F.explode("tokens").alias("token")).groupBy("token").agg(F.countDistinct("rule_id").alias("rules"))
    used = {r.token for r in counted.collect()}
    rows = rows.withColumn("seen", as_items(F.col("items"), {t: i for t, i in item_of.items() if i in used}))
    anchors = (
        rules.select("*", F.explode("tokens").alias("token"))
        .join(counted, "token")
        .groupBy("rule_id", "label", "confidence", "support", "tokens")
        .agg(F.min_by("token", F.struct("rules", "token")).alias("token"))
    )
    hit = scratch.put(
        rows.select("seen").distinct().select("seen", F.explode("seen").alias("token"))
        .join(anchors, "token")
        .where(F.size(F.array_except("tokens", "seen")) == 0)
        .groupBy("seen")
        .agg(F.max_by(F.struct("label", "rule_id"), F.struct("confidence", F.size("tokens"), "support", "label", "rule_id")).alias("best"))
    )
    side = F.broadcast(hit) if hit.count() <= BROADCAST_SETS else hit
    return rows.join(side, "seen", "left").withColumns({"label": F.col("best.label"), "mined": F.col("best.rule_id")}).drop("seen", "best")


def judge(spark: SparkSession, pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None, **mining: float) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, mined (the association rule that decided, if any)."""
    scratch = Scratch(spark)
    url = F.col("url")
    split = (
        pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
        .withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
        .withColumn("items", F.when(F.col("host") != "", items(url, F.col("host"), F.col("path"))).otherwise(F.array().cast("array<string>")))
    )
    learned, item_of = mine(labelled if labelled is not None else split.where("fixed is not null").select("items", F.col("fixed.verdict").alias("label")), **mining)
    return match(spark, split, learned, item_of, scratch).select(
        "page_id",
        "host",
        "path",
        F.col("fixed.rule").alias("rule"),
        F.coalesce(F.col("fixed.verdict"), F.col("label"), F.lit("allow")).alias("verdict"),
        F.when(F.col("fixed").isNull(), F.col("mined")).alias("mined"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark, table(spark, sf_dir, "pages"))


SQL = r"""
WITH split AS (
  SELECT page_id, coalesce(url, '') AS url,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
fixed AS (
  SELECT *, CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM split),
judged AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS fixed_verdict,
    row_number() OVER () AS rid,
    list_reverse(list_filter(string_split(host, '.'), lambda x: x <> '')) AS labels
  FROM fixed),
itemized AS (
  SELECT *, CASE WHEN host = '' THEN []::VARCHAR[] ELSE list_distinct(
      list_transform(labels, lambda x, i: 'h' || least(i - 1, 3) || '=' || x)
      || ['s=' || translate(regexp_extract(url, '(?s)^(.*?)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')]
      || list_filter(['p=' || regexp_extract(path, '^/([^/]*)', 1)], lambda x: x <> 'p=')
      || list_transform(regexp_extract_all(regexp_extract(url, '(?s)\?([^#]*)', 1), '(?:^|&)([^=&]+)', 1), lambda x: 'q=' || x)) END AS items
  FROM judged),
learn AS (SELECT rid, fixed_verdict AS label, items FROM itemized WHERE fixed_verdict IS NOT NULL),
total AS (SELECT count(*) AS n FROM learn),
one AS (SELECT rid, label, unnest(items) AS t FROM learn),
frequent AS (SELECT t, md5(string_agg(rid::VARCHAR, ',' ORDER BY rid)) AS which FROM one GROUP BY t HAVING count(*) >= ceil(0.01 * (SELECT n FROM total))),
item_of AS MATERIALIZED (SELECT t, min(t) OVER (PARTITION BY which) AS item FROM frequent),
held AS MATERIALIZED (SELECT DISTINCT o.rid, o.label, i.item AS t FROM one o JOIN item_of i ON i.t = o.t),
sets AS (
  WITH RECURSIVE grown(rid, label, tokens, t) AS (
    SELECT rid, label, [t], t FROM held
    UNION ALL SELECT g.rid, g.label, list_append(g.tokens, h.t), h.t FROM grown g JOIN held h ON h.rid = g.rid AND h.t > g.t)
  SELECT rid, label, tokens FROM grown),
whole AS (SELECT tokens, count(*) AS n FROM sets GROUP BY tokens),
labeled AS (SELECT tokens, label, count(*) AS n FROM sets GROUP BY tokens, label),
label_share AS (SELECT label, count(*) / (SELECT n FROM total)::DOUBLE AS share FROM learn GROUP BY label),
found AS (
  SELECT l.tokens, l.label, round(l.n / w.n::DOUBLE, 9) AS confidence, l.n / (SELECT n FROM total)::DOUBLE AS support
  FROM labeled l JOIN whole w ON l.tokens = w.tokens JOIN label_share s ON l.label = s.label
  WHERE l.n >= ceil(0.01 * (SELECT n FROM total)) AND l.n / w.n::DOUBLE >= 0.8 AND (l.n / w.n::DOUBLE) / s.share >= 1.05),
rules AS (
  SELECT * FROM found f WHERE NOT EXISTS (
    SELECT 1 FROM found g WHERE g.label = f.label AND len(g.tokens) = len(f.tokens) - 1 AND g.confidence >= f.confidence AND list_has_all(f.tokens, g.tokens))),
seen AS (SELECT i.rid, list(DISTINCT o.item) AS items FROM (SELECT rid, unnest(items) AS t FROM itemized) i JOIN item_of o ON o.t = i.t GROUP BY i.rid),
fits AS (
  SELECT i.rid, r.label, array_to_string(r.tokens, ' ') AS mined,
         row_number() OVER (PARTITION BY i.rid ORDER BY r.confidence DESC, len(r.tokens) DESC, r.support DESC, r.label DESC, array_to_string(r.tokens, ' ') DESC) AS place
  FROM seen i JOIN rules r ON list_has_all(i.items, r.tokens))
SELECT page_id, host, path, rule, coalesce(fixed_verdict, f.label, 'allow') AS verdict, CASE WHEN fixed_verdict IS NULL THEN f.mined END AS mined
FROM itemized i LEFT JOIN fits f ON i.rid = f.rid AND f.place = 1
"""
