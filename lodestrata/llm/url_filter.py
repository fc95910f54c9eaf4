"""URL filters: each URL becomes host-suffix and path-prefix expressions that are looked up by hash.

A rule is host + path, such as `example.org/en/1`: it fits the host and its subdomains if the URL's
path starts with the rule's. A URL is expanded into every host suffix of as many labels as some rule
has, times every path prefix of a length that some rule has, so nothing that a rule could fit is left
out. Expressions meet the rules on the first 8 hex digits of their SHA-256 (an equi-join), then
the full digests and the verdict of the longest rule decide; of equally long ones, block before
allow, then by code point.

Defined cases: a null URL, or one without `://`, has an empty host and path and fits no rule. URLs
that no rule fits get `default`. Each input row gives one row, repeated rows too. An empty rule
table, or rules that are null, fit nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import small_side

HASH_DIGITS = 8
#: Copies of each rule, and parts of each hot expression, where the rules are too many to broadcast.
SALTS = 32
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: The rules of the registered query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


def with_host_and_path(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.regexp_extract(url, URL_PARTS, 1)
    return pages.select(
        "page_id",
        F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.regexp_extract(url, URL_PARTS, 2).alias("path"),
    )


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of each page."""
    keyed = (
        rules.select(F.concat("host", "path").alias("rule"), F.col("verdict").alias("rule_verdict"), "host", "path")
        .where(F.col("rule").isNotNull() & F.col("rule_verdict").isNotNull())
        .dropDuplicates()
    )
    # How deep hosts and how long paths of rules are: one row, a few distinct numbers.
    shape = keyed.agg(
        F.count("*").alias("n"),
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"),
        F.collect_set(F.length("path")).alias("lengths"),
    ).first()
    split = with_host_and_path(pages)
    if not shape.n:
        return split.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.split("host", r"\.")
    suffixes = F.array_compact(
        F.array(*[
            F.when(F.size(labels) >= k, F.array_join(F.slice(labels, F.size(labels) - k + 1, F.lit(k)), ".")) for k in sorted(shape.labels)
        ])
    )
    prefixes = F.array_compact(
        F.array(*[F.when(F.length("path") >= k, F.substring("path", 1, k)) for k in sorted(shape.lengths)])
    )
    both = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    exploded = (
        split.withColumn("row", F.monotonically_increasing_id())
        .withColumn("expression", F.explode_outer(both))
        .withColumn("digest", _digest(F.col("expression")))
        .withColumn("key", F.substring("digest", 1, HASH_DIGITS))
    )
    lookup = keyed.select("rule", "rule_verdict", _digest(F.col("rule")).alias("rule_digest")).withColumn(
        "key", F.substring("rule_digest", 1, HASH_DIGITS)
    )
    on = ["key"]
    if small_side(lookup, shape.n) is lookup:
        exploded = exploded.withColumn("salt", F.pmod("row", F.lit(SALTS)))
        lookup = lookup.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        on = ["key", "salt"]
    else:
        lookup = small_side(lookup, shape.n)
    fits = F.col("digest") == F.col("rule_digest")
    rank = F.when(
        fits,
        F.struct(F.length("rule").alias("len"), (F.col("rule_verdict") == "block").alias("block"), F.col("rule"), F.col("rule_verdict")),
    )
    return (
        exploded.join(lookup, on, "left")
        .groupBy("row", "page_id", "host", "path")
        .agg(F.max(rank).alias("best"))
        .select(
            "page_id",
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.coalesce(F.col("best.rule_verdict"), F.lit(default)).alias("verdict"),
        )
    )
