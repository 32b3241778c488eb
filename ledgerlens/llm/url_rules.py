"""URL filter: a host/path rule list first, mined association rules for the rest.

Native: DataFrame functions and Spark ML's FP-growth only.

1. ``judge_by_list``: the longest fitting entry of a (host, path, verdict) list decides.
2. ``mine``: the list's verdicts are the labels, and the URLs that have one are mined. The tokens
   that the list's own hosts and paths are made of are left out, since with them the rules
   would say the list again. FP-growth mines token combinations with a verdict as
   consequent; support, confidence and lift among the labelled URLs prune them.
   Tokens that stand in the same labelled URLs are one item, so a site's fixed path is one
   item and not all its combinations; any of them stands for the item, which is what rules over single tokens say too.
3. ``match``: each rule stands in an inverted index under its rarest item. An unlisted URL's items
   look up candidates there, and every item of the antecedent is then verified.

Cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
allowed. Repeated URLs get equal verdicts. An empty table gives an empty result; without
labels nothing is mined and the rest is allowed. Columns beside ``page_id`` and
``url`` are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import scratch, written

#: (host, path, verdict): the list given for the query (fixed values).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
LABEL = "verdict="
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], field: int | None = None) -> Column:
    """The longest fitting rule as ``host + path`` text (or its verdict, ``field=2``), else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == rule[0]) | host.endswith("." + rule[0])) & path.startswith(rule[1])
        out = F.when(fits, F.lit(rule[field] if field is not None else rule[0] + rule[1])).otherwise(out)
    return out


def tokens(host: Column, path: Column) -> Column:
    """Distinct host labels (``h:``) and words of the path (``p:``)."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.filter(F.concat(labels, words), lambda x: F.length(x) > 2))


def judge_by_list(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    url = F.col("url")
    cut = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    return cut.withColumns({"rule": listed_rule(host, path, rules), "listed": listed_rule(host, path, rules, 2)})


def own_tokens(rules: Sequence[tuple[str, str, str]]) -> list[str]:
    """The tokens of the list's hosts and paths."""
    words = {f"h:{x}" for host, _, _ in rules for x in host.split(".")} | {f"p:{x}" for _, path, _ in rules for x in path.lower().split("/")}
    return sorted(w for w in words if len(w) > 2)


def mine(urls: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, min_support: float = 0.01, min_rows: int = 20,
         min_confidence: float = 0.9, min_lift: float = 1.05, most_common: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """(rules, items) from ``urls`` (tokens, verdict or null); rows without a verdict are not read.

    rules: antecedent (items), verdict, support, confidence, lift, anchor (the antecedent's rarest
    item). items: token, item. A combination has one item or more, and occurs in a share ``min_support`` of the
    labelled URLs and in ``min_rows`` of them. Tokens in over ``most_common`` of them say nothing and are left out.
    All others of a URL enter the mining, and FP-growth itself leaves out those below the least support, which are in no rule.
    """
    spark = urls.sparkSession
    left_out = F.array(*map(F.lit, own_tokens(rules))).cast("array<string>")
    labelled = urls.filter("verdict is not null").select(F.monotonically_increasing_id().alias("url"), F.array_except("tokens", left_out).alias("tokens"), "verdict")
    labelled = written(labelled, scratch(spark, "url-labels"))
    n = labelled.count()
    least = max(min_support * n, min_rows)
    mark = F.xxhash64("url")
    counts = labelled.select("url", F.explode("tokens").alias("token")).groupBy("token").agg(
        F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(mark, 24)).alias("s")).filter((F.col("n") >= least) & (F.col("n") <= most_common * n))
    # tokens of the same URLs: equal counts and digests of the URLs' numbers
    same = written(counts, scratch(spark, "url-tokens"))
    items = written(same.join(same.groupBy("n", "x", "s").agg(F.min("token").alias("item")), ["n", "x", "s"]).select("token", "item", "n"),
                    scratch(spark, "url-items"))
    held = labelled.select("url", "verdict", F.explode("tokens").alias("token")).join(items, "token").groupBy("url", "verdict").agg(F.collect_set("item").alias("items"))
    baskets = labelled.select("url", "verdict").join(held.select("url", "items"), "url", "left").select(
        F.concat(F.coalesce("items", F.array().cast("array<string>")), F.array(F.concat(F.lit(LABEL), "verdict"))).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, least / max(n, 1)), minConfidence=min_confidence).fit(baskets).associationRules
    mined = (found.filter(F.col("consequent")[0].startswith(LABEL) & (F.col("lift") >= min_lift) & ~F.exists("antecedent", lambda x: x.startswith(LABEL)))
             .select("antecedent", F.substring(F.col("consequent")[0], len(LABEL) + 1, 1 << 20).alias("verdict"), "support", "confidence", "lift"))
    numbered = written(mined.withColumn("rule_id", F.xxhash64(F.concat_ws("\x00", F.sort_array("antecedent")), "verdict")), scratch(spark, "url-rules"))
    anchors = (numbered.select("rule_id", F.explode("antecedent").alias("token")).join(items.select("token", "n"), "token")
               .groupBy("rule_id").agg(F.min(F.struct("n", "token")).alias("rarest")))
    return written(numbered.join(anchors, "rule_id").select("antecedent", "verdict", "support", "confidence", "lift", F.col("rarest.token").alias("anchor")),
                   scratch(spark, "url-index")), items.select("token", "item")


def match(urls: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """(url, mined_rule, verdict) for the rows of ``urls`` (url, tokens) that a rule fits; of
    several, the most confident, then the best supported, then the last by text."""
    held = urls.select("url", F.explode("tokens").alias("token")).join(items, "token").groupBy("url").agg(F.collect_set("item").alias("items"))
    looked_up = held.withColumn("anchor", F.explode("items")).join(rules, "anchor")
    fits = looked_up.filter(F.size(F.array_except("antecedent", "items")) == 0)
    best = F.max(F.struct("confidence", "support", F.array_join(F.sort_array("antecedent"), " ").alias("mined_rule"), "verdict"))
    return fits.groupBy("url").agg(best.alias("best")).select("url", "best.mined_rule", "best.verdict")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, **mining: float) -> DataFrame:
    """One row for each of ``pages``: page_id, url, host, path, rule, verdict, mined_rule."""
    judged = judge_by_list(pages, rules)
    words = tokens(F.col("host"), F.col("path")).alias("tokens")
    mined, items = mine(judged.select(words, F.col("listed").alias("verdict")), rules, **mining)
    rest = judged.filter(F.col("listed").isNull() & F.col("url").isNotNull()).select("url", words).dropDuplicates(["url"])
    said = match(rest, mined, items).withColumnRenamed("verdict", "said")
    return judged.join(said, "url", "left").select(
        "page_id", "url", "host", "path", "rule", F.coalesce("listed", "said", F.lit("allow")).alias("verdict"), "mined_rule")
