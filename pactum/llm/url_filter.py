"""URL allow and block rules: expand, join on short hash prefixes, confirm, let the longest rule win.

Every URL is expanded into the host-suffix and path-prefix expressions that
some rule could equal.  Expressions meet rules in an equi-join on the first
hex digits of their SHA-256; a hit counts only if the full digests agree.  Of
the rules that fit, the one with the longest host + path wins, then the one
with the longer host, then block before allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.llm.shared import BROADCAST_BYTES

#: Hex digits of the digest that rules and expressions are joined on.
PREFIX_DIGITS = 8
#: Copies of each rule in the shuffled join, so that a very common expression is dealt to several tasks.
SALTS = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; '' for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the host's end up to ? # or the end; '' for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def prepare_rules(rules: DataFrame) -> DataFrame:
    """rules: host, path, verdict -> with rule text, digest, digest prefix, labels, path length; exact repeats once.

    Rules with a null or empty host, or a null path, fit nothing and go.  Of
    contrary verdicts for one rule, block holds.
    """
    text = F.concat("host", "path")
    return (
        rules.select(F.translate("host", UPPER, LOWER).alias("host"), "path", "verdict")
        .where((F.col("host") != "") & F.col("path").isNotNull() & F.col("verdict").isin("allow", "block"))
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumns({"rule": text, "digest": F.sha2(F.concat("host", F.lit("\0"), "path"), 256), "labels": F.size(F.split("host", r"\.")), "path_length": F.length("path")})
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per input row: page_id, host, path, rule (null if none fits), verdict (`default` if none fits).

    Null or malformed URLs have an empty host and path and get the default.
    Repeated rows stay repeated.  Other columns don't matter.  Only a host suffix with as many labels and a path
    prefix as long as some one rule has are expanded: no others can match, so
    very long hosts and paths cost no more than short ones, and many rules of a
    few shapes no more than one of each.  Without rules, or without pages, there
    is nothing to match and every page, if any, gets the default.
    """
    ruled = prepare_rules(rules)
    shape = ruled.agg(F.to_json(F.sort_array(F.collect_set(F.struct("labels", "path_length")))).alias("pairs"), F.count("*").alias("n"), F.sum(F.length("rule")).alias("chars")).first()
    small = (shape["chars"] or 0) + 160 * shape["n"] <= broadcast_bytes
    pages = pages.select("page_id", F.col(url).alias("_url")).withColumns({"host": url_host(F.col("_url")), "path": url_path(F.col("_url"))})
    # one literal array, however many rules there are
    pairs = F.from_json(F.lit(shape["pairs"]), "array<struct<labels:int,path_length:int>>")
    suffix = lambda p: F.call_function("substring_index", F.col("host"), F.lit("."), -p["labels"])
    fits = F.filter(pairs, lambda p: F.length("path") >= p["path_length"])
    grid = F.array_distinct(F.transform(fits, lambda p: F.struct(suffix(p).alias("h"), F.substr("path", F.lit(1), p["path_length"]).alias("p"))))
    # the first element stands for the row itself, so that rows without candidates stay and repeats can be counted
    one = F.array(F.struct(F.lit(None).cast("string").alias("h"), F.lit(None).cast("string").alias("p")))
    wide = pages.select("page_id", "_url", "host", "path", F.explode(F.concat(one, F.when(F.col("host") != "", grid).otherwise(F.slice(one, 1, 0)))).alias("e"))
    wide = wide.withColumn("e_digest", F.sha2(F.concat("e.h", F.lit("\0"), "e.p"), 256)).withColumn("e_prefix", F.substring("e_digest", 1, PREFIX_DIGITS))
    side = ruled.select("prefix", "digest", "rule", "verdict", F.length("rule").alias("size"), F.length("host").alias("host_size"))
    if small:
        met = wide.join(F.broadcast(side), F.col("e_prefix") == F.col("prefix"), "left")
    else:
        salted = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        wide = wide.withColumn("e_salt", F.pmod(F.xxhash64("page_id", "_url"), F.lit(SALTS)).cast("int"))
        met = wide.join(salted, (F.col("e_prefix") == F.col("prefix")) & (F.col("e_salt") == F.col("salt")), "left")
    fits = F.col("digest") == F.col("e_digest")
    best = F.max(F.when(fits, F.struct("size", "host_size", "verdict", "rule"))).alias("best")
    # one row per page leaves each task: the expressions of a page are neighbours there
    grouped = met.groupBy("page_id", "_url", "host", "path").agg(best, F.count_if(F.col("e.h").isNull()).alias("n"))
    return grouped.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("_copy"),
    ).drop("_copy")
