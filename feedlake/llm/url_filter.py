"""Operator 6 [native]: URL filters by rules indexed under their rarest literal token.

A rule is (host, path, verdict). Its literal tokens are the labels of its host and
the path segments that a slash ends (a last segment may go on in the url, so it is
no literal). Token counts over the urls choose each rule's rarest one; a url's
tokens fetch the rules filed under them, and only those run their regular
expression. The longest fitting rule wins.

Defined results: a url that is null or has no ``://`` has empty host and path and
gets the default verdict with a null rule; page rows are never merged (repeated ids
stay); ties of equal rules go to ``block``; rules with null or empty host never fit.
Extra columns of the pages pass through unless they carry an output's name.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedlake.llm.common import ascii_lower

#: The rules of the registered query: host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _after_scheme(url: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _tokens(host: Column, path: Column) -> Column:
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.split(path, "/")
    ended = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    segments = F.transform(F.filter(ended, lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, segments))


def _quote(c: Column) -> Column:
    return F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def rule_index(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """(token, rule, pattern, verdict): every rule once, under its rarest token among the urls."""
    known = (rules.select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
             .where("host is not null and host <> ''")
             .select(F.concat("host", "path").alias("rule"), "verdict",
                     F.concat(F.lit(r"^(?:[^/]*\.)?"), _quote(F.col("host")),
                              F.when(F.col("path") == "", F.lit("(?=/|$)")).otherwise(_quote(F.col("path")))).alias("pattern"),
                     F.explode(_tokens(F.col("host"), F.col("path"))).alias("token")))
    seen = (urls.select(F.explode(_tokens(F.col("host"), F.col("path"))).alias("token"))
            .join(known.select("token").distinct(), "token", "left_semi").groupBy("token").count())
    return (known.join(seen, "token", "left")
            .groupBy("rule", "pattern", "verdict")
            .agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token")))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    split = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    urls = split.select("host", "path").distinct()
    fetched = (urls.withColumn("token", F.explode(_tokens(F.col("host"), F.col("path"))))
               .join(rule_index(rules, urls), "token")
               .where(F.expr("rlike(concat(host, path), pattern)")))
    best = (fetched.groupBy("host", "path")
            .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best")).select("host", "path", "best.rule", "best.verdict"))
    return split.join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def rules_frame(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")
