"""URL filtering: stated host and path rules, then association rules mined with Spark's FP-growth.

A URL becomes a basket of tokens. FP-growth finds token combinations of labelled URLs; those that imply a label with enough
confidence and support become rules. Rules are matched through an inverted index from token to rule.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted

#: Rules as (verdict, host, path).
STATED = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: A mined rule holds for at least this share of the labelled URLs, and is right for at least this share of those it fits.
MIN_SUPPORT, MIN_CONFIDENCE = 0.02, 0.8
#: Rules or tokens that are broadcast; more of them are met by shuffles.
ROWS_HELD = 50_000
_BLOCK, _ALLOW = "=block", "=allow"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def stated_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = STATED) -> Column:
    """Struct (length, rule, verdict) of the longest stated rule that fits, or null. The list is a setting, a few hundred at most."""
    fits = []
    for verdict, h, p in rules:
        on = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        fits.append(F.when(on, F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits)))


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL: its host's domain suffix parts, path parts and query names; runs of digits become one token."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*\?([^#]*)", 1)
    marked = lambda mark, parts: F.transform(parts, lambda x: F.concat(F.lit(mark), F.regexp_replace(x, "[0-9]+", "0")))
    names = F.transform(F.split(query, "&"), lambda x: F.split(x, "=")[0])
    parts = F.concat(marked("h:", F.split(host, r"\.")), marked("p:", F.split(path, "/")), marked("q:", names))
    return F.array_distinct(F.filter(parts, lambda x: F.length(x) > 2))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (rule_id, items, verdict, confidence, support) of labelled URLs (url, block boolean).

    Baskets are mined whole: only min_support bounds the work, so k tokens that enough URLs hold together make up to 2^k sets.
    Tokens that all URLs hold are left out, as every rule with them is a rule without them. Null urls or labels take no part; without any labelled URL there are no rules.
    """
    rows = labelled.where("url is not null and block is not null").select(tokens(F.col("url")).alias("items"), "block")
    n = rows.count()
    if n == 0:
        return labelled.sparkSession.createDataFrame([], "rule_id long, items array<string>, verdict string, confidence double, support double")
    # Tokens too rare to be in any frequent set are left out; there are at most 1/min_support times the URLs' mean length.
    frequent = rows.select(F.explode("items").alias("token")).groupBy("token").count()
    frequent = cut(frequent.where((F.col("count") >= min_support * n) & (F.col("count") < n)))
    rows = cut(rows.withColumn("key", F.monotonically_increasing_id()))
    n_frequent = frequent.count()
    kept = rows.select("key", F.explode("items").alias("token")).join(_held(frequent.select("token"), n_frequent), "token")
    kept = kept.groupBy("key").agg(F.collect_list("token").alias("kept"))
    baskets = rows.join(kept, "key", "left").select(F.concat(F.coalesce("kept", F.array()), F.array(F.when(F.col("block"), _BLOCK).otherwise(_ALLOW))).alias("items"))
    # Each partition grows the trees of some items, from its own copy of the baskets: no more partitions than items can fill.
    parts = 1 + n_frequent // 4
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence, numPartitions=parts).fit(cut(baskets))
    found = model.associationRules.where(F.col("consequent")[0].isin(_BLOCK, _ALLOW))
    found = found.where(~F.array_contains("antecedent", _BLOCK) & ~F.array_contains("antecedent", _ALLOW))
    items = F.sort_array("antecedent")
    return cut(found.select(F.xxhash64(items, F.col("consequent")[0]).alias("rule_id"), items.alias("items"), F.when(F.col("consequent")[0] == _BLOCK, "block").otherwise("allow").alias("verdict"), "confidence", "support"))


def _held(small: DataFrame, n: int) -> DataFrame:
    """small, of n rows, to be broadcast if that is not too many."""
    return F.broadcast(small) if n <= ROWS_HELD else small


def _key(url: Column) -> Column:
    return F.sha2(url, 256)


def match(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, n, mined, confidence) of distinct urls, key being a URL's SHA-256 and n its rows: the verdict of the rule that fits with the highest confidence, then support, then most items; null where none fits.

    A rule is posted under the one of its tokens that fewest rules hold. Each URL's tokens look up the rules posted there, and a
    rule fits when the URL has all its tokens.
    """
    held = rules.select("rule_id", F.explode("items").alias("token"))
    often = held.groupBy("token").agg(F.count("*").alias("rules"))
    rarest = held.join(often, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("rules", "token")).alias("token"))
    index = _held(rules.select("rule_id", "items", F.size("items").alias("needs"), "verdict", "confidence", "support").join(rarest, "rule_id"), rules.count())
    urls = pages.where("url is not null").groupBy("url").agg(F.count("*").alias("n")).select("url", _key(F.col("url")).alias("key"), "n")
    met = urls.select("key", tokens(F.col("url")).alias("has")).select("key", "has", F.explode("has").alias("token")).join(index, "token")
    fits = met.where(F.forall("items", lambda x: F.array_contains("has", x)))
    best = F.max(F.struct("confidence", "support", "needs", "verdict", "rule_id"))
    found = fits.groupBy("key").agg(best.alias("best"))
    return urls.select("key", "n").join(found, "key", "left").select("key", "n", F.col("best.verdict").alias("mined"), F.col("best.confidence").alias("confidence"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = STATED, labels: DataFrame | None = None) -> DataFrame:
    """Each page's host, path, stated rule and verdict.

    The labels (url, block) to mine are given, or else the pages that a stated rule decides. A page that no stated rule fits
    takes the mined verdict; without one, also with a null or unparsable url, it is allowed. Repeated rows each get a row.
    """
    rows = pages.select("page_id", "url").select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("stated", stated_rule(F.col("host"), F.col("path"), rules))
    if labels is None:
        labels = rows.where("stated is not null").select("url", (F.col("stated.verdict") == "block").alias("block"))
    rest = rows.where("stated is null and url is not null")
    # Urls of many pages, fewer than HOT_KEYS keys, are met by a broadcast; pages that need no mined verdict are not joined.
    mined = join_counted(rest.withColumn("key", _key(F.col("url"))), cut(match(rest, mine(labels))), ["key"], "n").drop("key", "n")
    plain = rows.where("stated is not null or url is null").withColumns({"mined": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    verdict = F.coalesce("stated.verdict", "mined", F.lit("allow"))
    return mined.unionByName(plain).select("page_id", "host", "path", F.col("stated.rule").alias("rule"), verdict.alias("verdict"), "confidence")
