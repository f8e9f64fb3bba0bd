"""URL filters: given rules first, then token combinations mined from labels.

FP-growth mines the token sets that labelled pages share with the mark of a bad page. A set whose bad share is high
enough blocks, unless a smaller one inside it does so at least as surely. Tokens that the same pages hold are mined as
one. Rules meet pages through an inverted index from token to rules: a page is blocked by a rule all of whose tokens it
holds. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from palmares.llm.common import ascii_lower, packed, text_or_empty, unpacked
from palmares.store import stored

#: Host, path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BAD = "=bad"
MIN_ROWS, MIN_SHARE, MIN_CONFIDENCE = 5, 0.001, 0.5


def host_of(url: str | Column) -> Column:
    return ascii_lower(F.regexp_extract(text_or_empty(url), PARTS, 1))


def path_of(url: str | Column) -> Column:
    return F.regexp_extract(text_or_empty(url), PARTS, 2)


def given_rule(rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule that fits columns ``host`` and ``path``, as a struct of its text and verdict, or null."""
    listed = F.array(*[
        F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))
        for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    ])
    inside = lambda r: (F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))
    fits = F.filter(listed, lambda r: inside(r) & F.startswith(F.col("path"), r["path"]))
    return F.get(fits, F.lit(0))


def tokens() -> Column:
    """The distinct labels of the host and pieces of the path of columns ``host`` and ``path``."""
    labels = F.transform(F.split("host", r"\."), lambda x: F.concat(F.lit("h:"), x))
    pieces = F.transform(F.split(ascii_lower(F.col("path")), "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.filter(F.concat(labels, pieces), lambda x: F.length(x) > 2))


def _marked(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per item of ``rows`` (row, items, bad and ``by``): its rows ``n``, the bad ones ``hits``, and two sums of row
    hashes, equal for items that the same rows hold."""
    marks = [F.sum(F.xxhash64(F.lit(seed), "row").cast("decimal(20,0)")).alias(f"mark{seed}") for seed in (1, 2)]
    each = rows.select("row", "bad", *by, F.explode("items").alias("item"))
    return each.groupBy(*by, "item").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("hits"), *marks)


def _classes(marked: DataFrame, by: Sequence[str]) -> DataFrame:
    """Items of the same rows as one: (by, item, members, n, hits). Members of a class lie together in one url."""
    same = marked.groupBy(*by, "n", "hits", "mark1", "mark2").agg(F.min("item").alias("item"), F.sort_array(F.collect_set("item")).alias("members"))
    return same.select(*by, "item", "members", "n", "hits")


def _choices(lists: Column) -> Column:
    """All arrays that take one element of each of an array of arrays."""
    none = F.array(F.expr("CAST(array() AS array<string>)"))
    return F.aggregate(lists, none, lambda done, more: F.flatten(F.transform(done, lambda d: F.transform(more, lambda m: F.array_append(d, m)))))


def mined_items(
    labelled: DataFrame, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE, min_confidence: float = MIN_CONFIDENCE,
) -> tuple[DataFrame, DataFrame]:
    """Rules (rule_items, confidence), and the classes of tokens (item, members) that their items stand for.

    Tokens that the same rows hold are one item, and a rule fits where a page has any member of each of its items. A set
    of several items is mined among the rows of its rarest item. There, items that all of these rows hold change nothing
    and go, and again items of the same rows are one; FP-growth mines what is left. A set of confidence 1 is not enlarged,
    since it covers all larger ones. So paths that share a deep prefix do not make FP-growth list its subsets.
    """
    spark = labelled.sparkSession
    rows = stored(labelled.select(F.monotonically_increasing_id().alias("row"), F.col("tokens").alias("items"), "bad"), "url-rows")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "rule_items array<string>, confidence double"), spark.createDataFrame([], "item string, members array<string>")
    least = max(min_rows, ceil(min_share * n))
    often, sure, grows = F.col("hits") >= least, F.col("hits") / F.col("n") >= min_confidence, F.col("hits") < F.col("n")
    items = stored(_classes(_marked(rows, []), []).filter(often), "url-items")
    rules = [items.filter(sure).select(F.array("item").alias("rule_items"), (F.col("hits") / F.col("n")).alias("confidence"))]

    # Each row once for every item it holds, with the items that are more frequent.
    inner = items.filter(grows & (F.col("n") < n)).select("item", "n")
    held = rows.select("row", "bad", F.explode("items").alias("item")).join(inner, "item")
    held = held.groupBy("row", "bad").agg(F.array_sort(F.collect_list(F.struct("n", "item"))).alias("held"))
    views = held.select("row", "bad", "held", F.posexplode("held").alias("place", "rare"))
    views = views.select("row", "bad", F.col("rare.item").alias("rare"), F.col("rare.n").alias("rare_n"),
                         F.slice("held", F.col("place") + 2, F.size("held")).getField("item").alias("items"))
    views = stored(views.filter(F.size("items") > 0), "url-views")
    pairs = stored(_classes(_marked(views, ["rare", "rare_n"]), ["rare", "rare_n"]).filter(often & (F.col("n") < F.col("rare_n"))), "url-pairs")
    wide = pairs.filter(sure).select("rare", F.explode("members").alias("item"), (F.col("hits") / F.col("n")).alias("confidence"))
    rules.append(wide.select(F.sort_array(F.array("rare", "item")).alias("rule_items"), "confidence"))

    # Sets of three and more: items carry the rarest one, so that one run mines all views.
    tagged = lambda item: F.to_json(F.array("rare", item))
    open_pairs = pairs.filter(grows).select("rare", "item")
    baskets = views.select("row", "bad", "rare", F.explode("items").alias("item")).join(open_pairs, ["rare", "item"])
    baskets = baskets.groupBy("row", "bad", "rare").agg(F.collect_list(tagged(F.col("item"))).alias("items")).filter(F.size("items") > 1)
    marked = F.when(F.col("bad"), F.array_append("items", tagged(F.lit(BAD)))).otherwise(F.col("items"))
    baskets = stored(baskets.select(marked.alias("items")), "url-baskets")
    n_baskets = baskets.count()
    if n_baskets:
        # Half a row below the wanted count, so that rounding of the share cannot miss it.
        found = FPGrowth(itemsCol="items", minSupport=min((least - 0.5) / n_baskets, 1.0), minConfidence=min_confidence).fit(baskets)
        read = lambda tag, place: F.get(F.from_json(tag, "array<string>"), F.lit(place))
        large = found.associationRules.filter((F.size("antecedent") > 1) & (read(F.get("consequent", F.lit(0)), 1) == BAD))
        parts = large.select("antecedent", "confidence", F.explode("antecedent").alias("tag"))
        parts = parts.select("antecedent", "confidence", read("tag", 0).alias("rare"), read("tag", 1).alias("item"))
        parts = parts.join(pairs.select("rare", "item", "members"), ["rare", "item"])
        sets = parts.groupBy("antecedent", "rare", "confidence").agg(F.collect_list("members").alias("lists"))
        sets = sets.select("rare", "confidence", F.explode(_choices(F.col("lists"))).alias("others"))
        rules.append(sets.select(F.sort_array(F.array_append("others", F.col("rare"))).alias("rule_items"), "confidence"))
    every = stored(reduce(DataFrame.unionAll, rules), "url-rules")
    parts = every.select("rule_items", "confidence", F.explode("rule_items").alias("item"))
    smaller = every.select(F.col("rule_items").alias("part"), F.col("confidence").alias("inner"), F.get("rule_items", F.lit(0)).alias("item"))
    within = (F.size("part") < F.size("rule_items")) & (F.size(F.array_except("part", "rule_items")) == 0)
    covered = parts.join(smaller, "item").filter(within & (F.col("inner") >= F.col("confidence"))).select("rule_items").distinct()
    return stored(every.join(covered, "rule_items", "left_anti"), "url-pruned"), items.select("item", "members")


def mined_rules(labelled: DataFrame, **mining) -> DataFrame:
    """(rule_tokens, confidence) of rows (tokens, bad): token sets of any size that ``min_rows`` rows and ``min_share``
    of all rows hold together with the mark, at least ``min_confidence`` of their rows being bad. A set goes if a subset
    of it has the same or a higher confidence. Written out for every choice of members of the items."""
    rules, items = mined_items(labelled, **mining)
    parts = rules.select("rule_items", "confidence", F.explode("rule_items").alias("item")).join(items, "item")
    lists = parts.groupBy("rule_items", "confidence").agg(F.collect_list("members").alias("lists"))
    return lists.select(F.explode(_choices(F.col("lists"))).alias("rule_tokens"), "confidence").select(F.sort_array("rule_tokens").alias("rule_tokens"), "confidence")


def judged(
    pages: DataFrame, labels: DataFrame, key: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, **mining,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` (allow or block) and ``mined``, whether a mined rule fits.

    ``labels`` has the key of some pages and ``bad``. The longest given rule decides; without one, a page with a fitting
    mined rule is blocked and any other allowed. Null urls and urls without ``://`` have empty parts and are allowed.
    Rows that repeat a key are judged each by its url; urls may be of any length and hold any number of pieces; added
    columns replace those of their names.
    """
    rows = pages.select(packed(pages.columns).alias("row"), F.col(f"`{key}`").alias("key"), host_of(f"`{url}`").alias("host"), path_of(f"`{url}`").alias("path"))
    known = labels.select(F.col(f"`{key}`").alias("key"), "bad").filter(F.col("bad").isNotNull())
    labelled = stored(rows.select("key", tokens().alias("tokens")).join(known, "key").select("tokens", "bad"), "url-labelled")
    mined, items = mined_items(labelled, **mining)
    index = mined.select("rule_items", F.explode("rule_items").alias("item"))
    held = rows.select("host", "path").distinct().select("host", "path", F.explode(tokens()).alias("token"))
    held = held.join(items.select("item", F.explode("members").alias("token")), "token").select("host", "path", "item").distinct().join(index, "item")
    hits = held.groupBy("host", "path", "rule_items").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == F.size("rule_items"))
    hits = stored(hits.select("host", "path").distinct().withColumn("mined", F.lit(True)), "url-hits")
    out = rows.join(hits, ["host", "path"], "left").withColumn("mined", F.coalesce("mined", F.lit(False))).withColumn("given", given_rule(rules))
    verdict = F.coalesce(F.col("given.verdict"), F.when(F.col("mined"), "block").otherwise("allow"))
    out = out.withColumn("verdict", verdict).withColumn("rule", F.col("given.rule"))
    return unpacked(out, "row", ["host", "path", "rule", "verdict", "mined"])


_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_GIVEN = "\n".join(
    f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
    for h, p, _ in sorted(RULES, key=lambda r: -len(r[0] + r[1]))
)
ORACLE = f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{PARTS}', 1), ''), {_UPPER}) AS host,
    coalesce(regexp_extract(url, '{PARTS}', 2), '') AS path
  FROM pages
),
ruled AS (SELECT *, CASE
{_GIVEN}
  END AS rule FROM parts),
tok AS (
  SELECT DISTINCT host, path, t FROM (
    SELECT host, path, 'h:' || unnest(string_split(host, '.')) AS t FROM parts
    UNION ALL SELECT host, path, 'p:' || unnest(string_split(translate(path, {_UPPER}), '/')) FROM parts
  ) WHERE length(t) > 2
),
lab AS (
  SELECT host, path, bad, row_number() OVER () AS r FROM parts JOIN (
    SELECT doc_id, max(CASE WHEN coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
  ) ON page_id = doc_id
),
least AS (SELECT greatest({MIN_ROWS}, ceil({MIN_SHARE} * count(*))) AS k FROM lab),
item AS (SELECT r, bad, t FROM lab JOIN tok USING (host, path)),
one AS (SELECT t, sum(bad) AS hits, sum(bad) / count(*) AS conf FROM item GROUP BY t),
one_rule AS (SELECT * FROM one, least WHERE hits >= k AND conf >= {MIN_CONFIDENCE}),
two AS (
  SELECT a.t AS t, b.t AS u, sum(a.bad) AS hits, sum(a.bad) / count(*) AS conf
  FROM item a JOIN item b ON a.r = b.r AND a.t < b.t GROUP BY ALL
),
two_rule AS (
  SELECT t, u FROM two, least WHERE hits >= k AND conf >= {MIN_CONFIDENCE}
    AND NOT EXISTS (SELECT 1 FROM one_rule o WHERE o.t IN (two.t, two.u) AND o.conf >= two.conf)
),
mined AS (
  SELECT host, path FROM tok JOIN one_rule USING (t)
  UNION SELECT a.host, a.path FROM tok a JOIN two_rule r ON a.t = r.t JOIN tok b ON b.host = a.host AND b.path = a.path AND b.t = r.u
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IS NOT NULL THEN CASE rule {" ".join(f"WHEN '{h}{p}' THEN '{v}'" for h, p, v in RULES)} END
  WHEN EXISTS (SELECT 1 FROM mined m WHERE m.host = ruled.host AND m.path = ruled.path) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
