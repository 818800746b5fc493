"""URL filters: a list of host and path rules, and combinations of URL tokens mined from labels by FP-growth.

A list rule fits its host and all subdomains where the URL's path starts with the rule's; the longest wins.  URLs that
no list rule fits are judged by association rules: FP-growth mines token combinations of labelled URLs, and those that
imply the label `block` with enough support and confidence are kept, without rules that a shorter one covers.  Rules
are found through an inverted index: each is posted under its rarest token, and only URLs with that token are compared.

Defined cases: a null url, or one without ://, has an empty host and path and is allowed;
repeated rows are judged alike; equal lengths of list rules can't both fit one URL unless
they are the same rule; no labels, or one kind only, mine no rules; an empty table gives an empty table; columns of the
input that clash with the result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidekeep.sources.shared import stored

#: (rule, verdict) of the contract.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Least share of labelled URLs that a mined rule covers, and least share of those that are labelled block.
SUPPORT, CONFIDENCE = 0.002, 0.9
#: Labelled URLs that a mined rule covers at least, so that few labels mine no chance combinations.
LEAST = 10
BLOCK = "label=block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def listed(rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits columns host and path, else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = rule.partition("/")
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith("/" + p)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def tokens(h: Column, p: Column) -> Column:
    """Distinct tokens of a URL: labels of its host, segments of its path (numbers as one token), marked by kind."""
    part = lambda x, sep, mark: F.transform(F.filter(F.split(x, sep), lambda t: t != ""), lambda t: F.concat(F.lit(mark), F.regexp_replace(t, r"\d+", "#")))
    return F.array_distinct(F.concat(part(h, r"\.", "host="), part(F.lower(p), r"[/._-]", "path=")))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (antecedent array<string>, confidence, support) for `block` from rows (tokens, block boolean)."""
    from pyspark.ml.fpm import FPGrowth

    n = labelled.count()
    if not n:
        return labelled.select(F.col("tokens").alias("antecedent"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support"))
    support = min(1.0, max(support, LEAST / n))
    items = F.concat("tokens", F.when(F.col("block"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>")))
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(labelled.select(items.alias("items"))).associationRules
    # support counts an itemset with its label; a rule must add to every shorter rule that it contains
    rules = found.where(F.element_at("consequent", 1) == BLOCK).select("antecedent", "confidence", "support")
    a, b = rules.alias("a"), rules.select(F.col("antecedent").alias("less")).alias("b")
    shorter = (F.size("b.less") < F.size("a.antecedent")) & (F.size(F.array_except("b.less", "a.antecedent")) == 0)
    # rules meet on a shared token, so this is no cross join
    pairs = a.withColumn("t", F.explode("antecedent")).join(b.withColumn("t", F.element_at("less", 1)), "t")
    covered = pairs.where(shorter).select("antecedent").distinct()
    return stored(rules.join(covered, "antecedent", "left_anti"), "url-rules")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct urls (url, tokens) that hold all tokens of some rule."""
    common = rules.select(F.explode("antecedent").alias("token")).distinct()
    each = urls.select("url", "tokens", F.explode("tokens").alias("token"))
    seen = each.join(common, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = rules.select("antecedent", F.explode("antecedent").alias("token")).join(seen, "token").groupBy("antecedent").agg(F.min(F.struct("n", "token"))["token"].alias("token"))
    return each.join(rarest, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0).select("url").distinct()


def _verdict(rules: tuple[tuple[str, str], ...]) -> Column:
    out = F.lit(None).cast("string")
    for rule, verdict in rules:
        out = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(out)
    return out


def listed_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """url and block (boolean) of the pages that the list judges: labels from which rules for the others are mined."""
    url = F.col("url").cast("string")
    judged = pages.select(url.alias("url"), host(url).alias("host"), path(url).alias("path")).withColumn("rule", listed(rules))
    return judged.where("rule is not null").select("url", (_verdict(rules) == "block").alias("block"))


def url_filter(pages: DataFrame, labels: DataFrame | None = None, rules: tuple[tuple[str, str], ...] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """pages with host, path, rule, verdict and mined (whether a mined rule gave it).  labels: url and block (boolean), from which rules are mined."""
    url = F.col("url").cast("string")
    judged = pages.drop("host", "path", "rule", "verdict", "mined").withColumns({"host": host(url), "path": path(url)}).withColumn("rule", listed(rules))
    judged = judged.withColumn("verdict", _verdict(rules))
    found = None
    if labels is not None:
        known = labels.where("block is not null").select(tokens(host(url), path(url)).alias("tokens"), "block")
        found = mine(known, support, confidence)
    if found is None or found.isEmpty():
        return judged.withColumns({"verdict": F.coalesce("verdict", F.lit("allow")), "mined": F.lit(False)})
    distinct = judged.where("rule is null and url is not null").select("url", tokens(F.col("host"), F.col("path")).alias("tokens")).distinct()
    hits = matched(distinct, found).withColumnRenamed("url", "_hit")
    out = judged.join(hits, judged["url"] == F.col("_hit"), "left")
    mined = F.col("rule").isNull() & F.col("_hit").isNotNull()
    return out.withColumns({"verdict": F.coalesce("verdict", F.when(F.col("_hit").isNotNull(), "block").otherwise("allow")), "mined": mined}).drop("_hit")
