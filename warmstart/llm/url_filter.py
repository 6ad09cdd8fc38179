"""URL filters: association rules from labelled URLs, and a list of host and path rules.

A URL is the set of its tokens (parts of the host, of the path with digits as ``#``, names in the query).
Spark's FP-growth mines token combinations together with the label; rules ``tokens -> label`` stay if
their support, confidence and lift are high enough. Matching uses an inverted index: a rule is
posted under its rarest token, URLs meet it by a join on that token, and the rest of the rule is checked on the URL's
token set. Of several rules that fit, the one with the highest confidence wins (then support, then text).
No rule table is collected or broadcast by hand.

Defined results: a null URL or one without ``://`` has an empty host and path, no tokens beyond that, fits no
list rule and gets the default verdict; repeated URLs are matched once and all their rows get the
result; labels other than allow and block are not learned from; without labelled URLs there are no mined rules; very long URLs
are taken whole; an empty table gives an empty table; other columns stay, helper columns avoid their names (``judged`` is the
name of the result, so the caller's table must have none).
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from warmstart.llm.common import ascii_lower, fresh, store

MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.005, 0.6, 1.1
DEFAULT = "allow"
_LABEL = "label="


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host parts, path parts with digits as ``#``, query names. ``&`` inside a part is written ``%26``, so no token
    holds one and the name of a rule, its tokens joined by ``&``, stands for one set of tokens only."""
    plain = lambda c: F.replace(c, F.lit("&"), F.lit("%26"))
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    parts = [F.transform(F.filter(F.split(plain(host(url)), r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host="), x)),
             F.transform(F.filter(F.split(plain(F.regexp_replace(path(url), "[0-9]+", "#")), "/"), lambda x: x != ""),
                         lambda x: F.concat(F.lit("path="), x)),
             F.transform(F.filter(F.split(query, "&"), lambda x: x != ""),
                         lambda x: F.concat(F.lit("query="), F.substring_index(x, "=", 1)))]
    return F.array_distinct(F.concat(*parts))


def list_rule(h: Column, p: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule ``host/path`` that fits, null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's. The list is a parameter
    written by hand; equal lengths go to the first in code-point order."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((h == name) | h.endswith("." + name)) & p.startswith(slash + rest)
        hit = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


_RULES = "verdict string, tokens array<string>, confidence double, support double, key string"


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
               min_lift: float = MIN_LIFT) -> DataFrame:
    """Rules (verdict, tokens, confidence, support, key) from (url, label) rows; key is the rarest token."""
    spark = labelled.sparkSession
    rows = store(labelled.filter("url is not null and label in ('allow', 'block')")
                 .select(url_tokens(F.col("url")).alias("tokens"), "label"), "urls")
    if rows.isEmpty():
        return spark.createDataFrame([], _RULES)
    items = rows.select(F.array_append("tokens", F.concat(F.lit(_LABEL), F.col("label"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = (model.associationRules.filter(F.col("consequent")[0].startswith(_LABEL) & (F.col("lift") >= min_lift))
             .select(F.expr(f"substring(consequent[0], {len(_LABEL) + 1})").alias("verdict"),
                     F.array_sort("antecedent").alias("tokens"), "confidence", "support"))
    count = rows.select(F.explode("tokens").alias("key")).groupBy("key").count()
    rules = rules.withColumn("name", F.concat_ws("&", "tokens"))
    rarest = (rules.select("name", F.explode("tokens").alias("key")).join(count, "key")
              .groupBy("name").agg(F.min(F.struct("count", "key")).alias("k")).select("name", F.col("k.key").alias("key")))
    return store(rules.join(rarest, "name").select("verdict", "tokens", "confidence", "support", "key"), "rules")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined_verdict, mined_rule, confidence) for the distinct ``url`` values that fit a rule."""
    posted = rules.withColumnRenamed("tokens", "need")
    found = (urls.filter("url is not null").select("url").distinct().withColumn("tokens", url_tokens(F.col("url")))
             .withColumn("key", F.explode("tokens")).join(posted, "key")
             .filter(F.size(F.array_except("need", "tokens")) == 0))
    order = F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"),
                     F.concat_ws("&", "need").alias("rule"), "verdict")
    return (found.groupBy("url").agg(F.min(order).alias("m"))
            .select("url", F.col("m.verdict").alias("mined_verdict"), F.col("m.rule").alias("mined_rule"),
                    (-F.col("m.c")).alias("confidence")))


def judge(pages: DataFrame, listed: list[tuple[str, str]], rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with a struct ``judged``: host, path, rule, verdict, mined_rule, confidence."""
    u, l, m = fresh(pages, "__url", "__listed", "__mined")
    found = match_rules(pages.select(F.col(url_col).cast("string").alias("url")), rules)
    found = found.select(F.col("url").alias(u), F.struct("mined_verdict", "mined_rule", "confidence").alias(m))
    url = F.col(url_col).cast("string")
    out = pages.join(found, url == F.col(u), "left").withColumn(l, list_rule(host(url), path(url), listed))
    verdict = F.coalesce(F.col(l)["verdict"], F.col(m)["mined_verdict"], F.lit(DEFAULT))
    return out.select(*pages.columns, F.struct(
        host(url).alias("host"), path(url).alias("path"), F.col(l)["rule"].alias("rule"), verdict.alias("verdict"),
        F.col(m)["mined_rule"].alias("mined_rule"), F.col(m)["confidence"].alias("confidence")).alias("judged"))
