"""URL rules by hashed host-suffix and path-prefix expressions (DataFrame functions only).

A URL expands into every pair of a host suffix (cut at dots) and a path prefix whose length some rule has.
Expressions meet rules in an equi-join on a short prefix of their SHA-256; pairs that met are confirmed by the
full digest, and the longest rule decides (equal length: block before allow, then the rule text).

URLs are made distinct before they are expanded, so a hot URL is expanded once.  The rule side of the join is
broadcast only if Spark finds it below its own size threshold; otherwise both sides are shuffled, and adaptive
execution splits hot hash prefixes.

Defined results: a null URL, or one without ``://``, has empty host and path; an empty host fits no rule; a
path that is empty starts with no rule path; without a rule the verdict is ``allow``; repeated rules count once;
repeated pages give repeated rows; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm.store import LOWER, UPPER

HASH_PREFIX = 8  # hex digits, 32 bits
DEFAULT_VERDICT = "allow"


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule, action) from ("net/", "block") pairs, as a table held in the plan."""
    part = F.split("e", " ")
    texts = [f"{action} {rule}" for rule, action in rules]
    table = spark.range(1).select(F.explode(F.split(F.lit("\n".join(texts)), "\n")).alias("e"))
    return table.select(part[1].alias("rule"), part[0].alias("action")).filter("rule IS NOT NULL")


def url_parts(url):
    """Host (A-Z lower-cased) and path of a URL column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """id, host, path, rule (null without one) and verdict of every row; ``rules`` has rule and action."""
    host, path = url_parts(F.col(url))
    rows = pages.select(F.col(id_col).alias(id_col), host.alias("host"), path.alias("path"))
    known = (rules.groupBy("rule").agg(F.max("action").alias("action"))  # block sorts after allow
             .withColumn("_digest", F.sha2("rule", 256)).withColumn("_hash", F.left("_digest", F.lit(HASH_PREFIX))))
    # one array as a scalar subquery: at most as many numbers as the longest rule path has characters
    lengths = known.select(F.array_sort(F.collect_set(F.length("rule") - F.instr("rule", "/") + 1)).alias("_lengths")).scalar()
    # only as many labels as the deepest rule host has can decide, so a host of any length gives a bounded number of suffixes
    deepest = known.select(F.max(F.size(F.split(F.substring_index("rule", "/", 1), r"\."))).alias("_deepest")).scalar()
    urls = rows.filter("host <> '' AND path <> ''").select("host", "path").distinct()
    every = F.split("host", r"\.")
    urls = urls.withColumn("_labels", F.slice(every, F.greatest(F.lit(1), F.size(every) - F.coalesce(deepest, F.lit(1)) + 1), F.size(every)))
    labels = F.col("_labels")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    expanded = (urls.select("host", "path", F.explode(suffixes).alias("_suffix"))
                .select("host", "path", "_suffix", F.explode(lengths).alias("_length"))
                .filter(F.col("_length") <= F.length("path"))
                .select("host", "path", F.sha2(F.concat("_suffix", F.substring("path", F.lit(1), F.col("_length"))), 256).alias("_full"))
                .withColumn("_hash", F.left("_full", F.lit(HASH_PREFIX))))
    met = expanded.join(known, "_hash").filter(F.col("_full") == F.col("_digest"))
    # fits of one URL: at most labels x rule path lengths rows
    best = (met.groupBy("host", "path")
            .agg(F.max(F.struct(F.length("rule").alias("n"), F.col("action"), F.col("rule"))).alias("_best")))
    return (rows.join(best, ["host", "path"], "left")
            .select(id_col, "host", "path", F.col("_best.rule").alias("rule"),
                    F.coalesce("_best.action", F.lit(DEFAULT_VERDICT)).alias("verdict")))
