"""Digests, resumable runs, ordered contracts and text checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from gridwright.functions.columns import hash_u32


def content_digest(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Order-free SHA-256 of the rows of each group.

    Repeated rows are counted first.  Row digests then fall into 2^24 leaf buckets by prefix, leaves into
    2^12 middle buckets, and those into one root a group; each level digests its sorted children, and a
    bucket is a hash share of the distinct rows whatever the group sizes are.
    """
    by = list(by)
    row = F.sha2(F.to_json(F.struct(*[F.col(c).alias(c) for c in sorted(cols)]), {"ignoreNullFields": "false"}), 256)
    counted = df.select(*by, row.alias("_h")).groupBy(*by, "_h").agg(F.count(F.lit(1)).alias("_c"))
    line = F.concat_ws(":", "_h", F.col("_c").cast("string"))
    # three levels: 2^24 leaf buckets, 2^12 middle buckets, one root a group
    level = counted.groupBy(*by, F.substring("_h", 1, 6).alias("_p")).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("_d"), F.sum("_c").alias("rows"))
    pair = F.concat_ws(":", "_p", "_d")
    level = level.groupBy(*by, F.substring("_p", 1, 3).alias("_p")).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list(pair)), "\n"), 256).alias("_d"), F.sum("rows").alias("rows"))
    return level.groupBy(*by).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list(pair)), "\n"), 256).alias("digest"), F.sum("rows").alias("rows"))


def file_digests(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths)).select(
        F.regexp_extract("path", "[^/]+$", 0).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def run_fingerprint(runs: DataFrame, run_id: str, cols: Sequence[str]) -> DataFrame:
    """One digest per run over its configuration values, in sorted column order."""
    body = F.to_json(F.struct(*[F.col(c).alias(c) for c in sorted(cols)]), {"ignoreNullFields": "false"})
    return runs.withColumn("fingerprint", F.sha2(body, 256))


def pending_runs(runs: DataFrame, status: DataFrame, key: str = "run_id", contract: str = "fingerprint") -> DataFrame:
    """PENDING, DONE, or DRIFT (completed under another contract) for each run."""
    done = status.filter("status = 'COMPLETE'").select(key, F.col(contract).alias("_c")).distinct()
    per = done.groupBy(key).agg(F.collect_set("_c").alias("_cs"))  # contracts a run has completed under: a few
    joined = runs.join(per, key, "left")
    state = F.when(F.col("_cs").isNull(), "PENDING").when(
        (F.size("_cs") == 1) & F.array_contains("_cs", F.col(contract)), "DONE").otherwise("DRIFT")
    return joined.withColumn("state", state).drop("_cs")


def frozen_then_score(predictions: DataFrame, truth, keys: Sequence[str]) -> DataFrame:
    """Check every prediction contract, then read the truth.

    ``truth`` is a function returning the truth table, called only after the check action passed.
    """
    from gridwright.operators.contracts import aligned_join, require
    from gridwright.functions.columns import reasons
    if "observed_dbm" in predictions.columns:
        raise ValueError("predictions must not carry labels")
    check = predictions.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("pred").isNull() | F.isnan("pred")).alias("empty"),
        F.count_distinct(*keys).alias("ids"))
    require(check.withColumn("violations", reasons(
        (F.col("rows") == 0, "NO_ROWS"), (F.col("empty") > 0, "EMPTY_PREDICTION"), (F.col("ids") != F.col("rows"), "REPEATED_ID"))))
    return aligned_join(predictions, truth(), list(keys))


def contiguous_chunks(chunks: DataFrame, by: Sequence[str], total: Column) -> DataFrame:
    """Chunks cover 0..total without gap or overlap.

    Sorted intervals tile the range exactly when their starts and stops pair up: every stop but the
    last is another chunk's start.  That is a set comparison, so no window walks a long series.
    """
    starts = chunks.select(*by, F.col("start").alias("at"), F.lit(1).alias("s"), F.lit(0).alias("e"))
    stops = chunks.select(*by, F.col("stop").alias("at"), F.lit(0).alias("s"), F.lit(1).alias("e"))
    edges = starts.unionByName(stops).groupBy(*by, "at").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    ends = chunks.groupBy(*by).agg(
        F.min("start").alias("first"), F.max("stop").alias("last"), F.sum(F.col("stop") - F.col("start")).alias("covered"),
        F.count_if(F.col("stop") <= F.col("start")).alias("empty_chunks"), F.max(total).alias("total"))
    bad = edges.join(ends.select(*by, "first", "last"), list(by)).groupBy(*by).agg(F.count_if(
        ~(((F.col("s") == 1) & (F.col("e") == 1)) | ((F.col("at") == F.col("first")) & (F.col("s") == 1) & (F.col("e") == 0))
          | ((F.col("at") == F.col("last")) & (F.col("s") == 0) & (F.col("e") == 1)))).alias("breaks"))
    ok = (F.col("breaks") == 0) & (F.col("empty_chunks") == 0) & (F.col("first") == 0) & (F.col("last") == F.col("total"))
    return ends.join(bad, list(by)).select(*by, "first", "last", "covered", "breaks", ok.alias("complete"))


def material_arms(objects: DataFrame, seeds: DataFrame) -> DataFrame:
    """(arm_id, kind, object, label): uniform, semantic, and one label shuffle per seed.

    ``objects(object, label, conductor)`` is the catalog of one scene; shuffles permute the labels of
    its non-conductors by hash order, conductors stay.
    """
    uniform = objects.select(F.lit("uniform").alias("arm_id"), F.lit("uniform").alias("kind"), "object",
                             F.when(F.col("conductor"), F.col("label")).otherwise("concrete").alias("label"))
    semantic = objects.select(F.lit("semantic").alias("arm_id"), F.lit("semantic").alias("kind"), "object", "label")
    free = objects.filter(~F.col("conductor"))
    pairs = free.withColumn("_k", F.lit(1)).join(seeds.withColumn("_k", F.lit(1)), "_k").drop("_k")
    arm = F.concat(F.lit("shuffle_"), F.col("seed").cast("string"))
    # a scene catalog is a handful of objects
    target = pairs.select("seed", "object", F.row_number().over(W.partitionBy("seed").orderBy("object")).alias("pos"))
    source = pairs.select("seed", "label", F.row_number().over(W.partitionBy("seed").orderBy(
        hash_u32(F.concat_ws("|", F.col("seed").cast("string"), F.col("object"))), "object")).alias("pos"))
    shuffled = target.join(source, ["seed", "pos"]).select(arm.alias("arm_id"), F.lit("label_shuffle").alias("kind"), "object", "label")
    fixed = objects.filter("conductor").withColumn("_k", F.lit(1)).join(seeds.withColumn("_k", F.lit(1)), "_k").select(
        arm.alias("arm_id"), F.lit("label_shuffle").alias("kind"), "object", "label")
    return uniform.unionByName(semantic).unionByName(shuffled).unionByName(fixed)


# Labels and patterns of text that must not be released.
SENSITIVE_PATTERNS = (
    ("Windows absolute path", r"(?i)(?<![A-Z0-9_])[A-Z]:[\\/]"),
    ("home absolute path", r"(?m)(?<![\w.])/(?:home|Users)/[A-Za-z0-9_.-]+/"),
    ("private key", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("AWS access key", r"\bAKIA[0-9A-Z]{16}\b"),
    ("credential assignment",
     r"(?i)\b(?:api[_-]?key|access[_-]?token|secret[_-]?key|password)\s*[:=]\s*['\"]?(?!placeholder|example|changeme)[A-Za-z0-9_./+=-]{12,}"),
)


def sensitive_text_scan(df: DataFrame, text: str, patterns: Sequence[tuple[str, str]] = SENSITIVE_PATTERNS) -> DataFrame:
    """Rows whose whole text matches a pattern, with the labels that hit, in pattern order."""
    hits = F.filter(F.array(*[F.when(F.col(text).rlike(p), F.lit(label)) for label, p in patterns]), lambda v: v.isNotNull())
    return df.withColumn("findings", hits).filter(F.size("findings") > 0)


def condition_status(runs: DataFrame, counts: DataFrame, failures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """COMPLETE, INSUFFICIENT_BUFFERED_TRAINING_SUPPORT or FAILED with the reason, per requested run."""
    j = runs.join(counts, [k for k in keys if k in counts.columns], "left").join(failures, list(keys), "left")
    short = F.coalesce(F.col("available_n"), F.lit(0)) < F.col("budget")
    status = F.when(short, "INSUFFICIENT_BUFFERED_TRAINING_SUPPORT").when(F.col("failure").isNotNull(), "FAILED").otherwise("COMPLETE")
    reason = F.when(short, F.concat(F.lit("requested="), F.col("budget").cast("string"), F.lit("; available="),
                                    F.coalesce(F.col("available_n"), F.lit(0)).cast("string"), F.lit("; budget_not_reduced"))
                    ).when(F.col("failure").isNotNull(), F.col("failure")).otherwise("")
    return j.select(*keys, F.coalesce("available_n", F.lit(0)).alias("available_n"), status.alias("status"), reason.alias("reason"))
