"""URL filters: host-suffix and path-prefix expressions against a rule list, found by short hash prefixes.

Each URL is expanded into (host suffix + directory of its path) expressions. Expressions meet rules in an
equi-join on the first PREFIX_HEX digits of their SHA-256; the full digest and the rule's whole path confirm
a hit, and precedence picks one rule. DataFrame functions only.

An expression deeper than the deepest rule can match none, so the expansion stops at the depths that the
rules have; this bound comes from the rules and leaves no match out.

Defined cases: a null URL or one without ``://`` has empty host and path, fits no rule and gets the default
verdict; an empty rule list gives every row the default; repeated rows come back as often as they came, null
ids stay null; columns besides the id and the URL are ignored; rules with a null or empty host fit nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritrail.llm.common import ascii_lower

#: Hex digits of a digest that the join goes by (32 bits, as in public safe-browsing lists).
PREFIX_HEX = 8
#: Rows of one equal (id, URL) pair that are written out from one array.
COPIES = 4096


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def directory(path: Column) -> Column:
    """The path up to its last slash, which is what a path prefix is found by."""
    return F.regexp_extract(path, "^(?s)(.*/)?", 1)


def _up_to(text: Column, mark: str, k: Column) -> Column:
    return F.call_function("substring_index", text, F.lit(mark), k)


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, url, host, path, rule, verdict) for each row. rules: (host, path, verdict).

    A rule fits its host and all subdomains if the URL's path starts with the rule's path. The longest
    rule string wins; among equals the longer host, then block before allow.
    """
    rules = (
        rules.select(ascii_lower(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
        .where("r_host <> ''")
        .withColumn("r_digest", _digest(F.concat_ws("\n", "r_host", directory(F.col("r_path")))))
        .withColumn("prefix", F.substring("r_digest", 1, PREFIX_HEX))
    )
    depth = rules.agg(F.max(F.size(F.split("r_host", "\\."))), F.max(F.size(F.split("r_path", "/")))).first()
    labels, levels = (depth[0] or 0), (depth[1] or 0)
    pages = (
        urls.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
        .groupBy("page_id", "url")
        .agg(F.count("*").alias("copies"))
        .withColumn("host", url_host(F.col("url")))
        .withColumn("path", url_path(F.col("url")))
    )
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(max(labels, 1))), lambda k: _up_to(F.col("host"), ".", -k))
    prefixes = F.transform(
        F.sequence(F.lit(0), F.lit(max(levels - 1, 0))),
        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(_up_to(F.concat("path", F.lit("/")), "/", k), F.lit("/"))),
    )
    prefixes = F.filter(F.array_distinct(prefixes), lambda p: F.startswith(F.col("path"), p))
    expressions = F.flatten(
        F.transform(F.array_distinct(suffixes), lambda s: F.transform(prefixes, lambda p: _digest(F.concat_ws("\n", s, p))))
    )
    expanded = pages.withColumn("digest", F.explode_outer(F.when(F.col("host") != "", expressions))).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    confirmed = (F.col("digest") == F.col("r_digest")) & F.startswith(F.col("path"), F.col("r_path"))
    hit = F.when(
        confirmed,
        F.struct(
            (F.length("r_host") + F.length("r_path")).alias("size"),
            F.length("r_host").alias("host_size"),
            (F.col("r_verdict") == "block").alias("blocks"),
            F.concat("r_host", "r_path").alias("rule"),
            F.col("r_verdict").alias("verdict"),
        ),
    )
    best = expanded.join(rules, "prefix", "left").withColumn("hit", hit).groupBy("page_id", "url", "copies", "host", "path").agg(F.max("hit").alias("hit"))
    return (
        best.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / COPIES))))
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.lit(COPIES), F.col("copies") - F.col("block") * COPIES))))
        .select("page_id", "url", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
    )
