"""Exact quantiles for groups of any size.

The built-in ``percentile`` keeps every distinct value of a group in one buffer, which a group holding
a third of the table cannot afford.  ``exact_quantiles`` narrows in steps: the bounded
``percentile_approx`` sketch brackets each wanted rank, the bracket is counted in ``BUCKETS`` equal
buckets (with one more on either side, so that a rank outside its bracket is found all the same), and only
the values of the one or two buckets that hold the rank are counted one by one, unless a bucket holds a
single value.  Counters are added up in each task before the exchange.  A window sees the buckets of one
rank, or the distinct values of one bucket: about a millionth of a large group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from gridwright.session import settle

SKETCH_ACCURACY = 10_000
BRACKET_MARGIN = 8.0  # sketch errors on either side of the wanted rank
BUCKETS = 1024
BROADCAST_ROWS = 50_000  # groups of a table that is sent to every executor


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    *,
    lower: bool = False,
    rank: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """One row per ``by`` group with the quantiles of the non-null ``value``.

    Linear interpolation between neighbouring ranks; ``lower=True`` takes the rank floor(p·(n-1))
    itself (for p = 0.5 the lower median).  ``rank`` replaces p·(n-1) by another 0-based rank of n that
    lies within a rank or two of it.
    """
    by = list(by)
    # three passes read these rows: settled, so that what feeds them runs once
    rows = settle(df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull()))
    margin = BRACKET_MARGIN / SKETCH_ACCURACY
    brackets = []
    for p in probs:
        brackets += [max(0.0, p - margin), min(1.0, p + margin)]
    sketch = rows.groupBy(*by).agg(
        F.count("_v").alias("_n"), F.percentile_approx("_v", F.array(*[F.lit(b) for b in brackets]), SKETCH_ACCURACY).alias("_cut"))

    def bucket_of(v: Column, low: Column, high: Column) -> Column:
        return (F.when(v < low, -1).when(v > high, BUCKETS).when(low == high, 0)
                .when(~(high - low < float("inf")), F.when(v < high, 0).otherwise(1))  # an infinite or NaN edge
                .otherwise(F.least(F.lit(BUCKETS - 1), F.floor((v - low) / (high - low) * BUCKETS))).cast("int"))

    # buckets are in the order of the values, so a group has few different lists of them: one row a value, not one a rank
    # (a column an expression: a lambda over an array of edges is interpreted, row by row)
    buckets = F.array(*[bucket_of(F.col("_v"), F.col("_cut")[2 * i], F.col("_cut")[2 * i + 1]) for i in range(len(probs))])
    lists = (
        _attach(rows, sketch, by).select(*by, "_n", "_v", buckets.alias("_e"))
        .groupBy(*by, "_n", "_e").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
    )
    counted = lists.select(*by, "_n", "_c", "_from", "_to", F.posexplode("_e").alias("_i", "_b")).groupBy(*by, "_n", "_i", "_b").agg(
        F.sum("_c").alias("_c"), F.min("_from").alias("_from"), F.max("_to").alias("_to"))
    p = F.element_at(F.array(*[F.lit(float(q)) for q in probs]), F.col("_i") + 1)
    target = rank(F.col("_n")) if rank else p * (F.col("_n") - 1)

    def found(table: DataFrame, keys: list[str], order: str, base: Column) -> DataFrame:
        """Rows that hold the lower or the upper rank, with both as ``_low`` and ``_high``."""
        upto = F.sum("_c").over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)) + base
        t = table.withColumn("_upto", upto)
        holds = lambda r: (F.col("_upto") > r) & (F.col("_upto") - F.col("_c") <= r)
        t = t.withColumn("_low", holds(F.floor("_t"))).withColumn("_high", holds(F.ceil("_t")))
        return t.filter(F.col("_low") | F.col("_high"))

    held = found(counted.withColumn("_t", target), [*by, "_i"], "_b", F.lit(0)).withColumn("_base", F.col("_upto") - F.col("_c"))
    one = held.filter("_from = _to").select(*by, "_i", "_t", F.col("_from").alias("_v"), "_low", "_high")
    # at most two ranges a rank
    ranges = held.filter("_from < _to").groupBy(*by).agg(F.collect_list(F.struct("_i", "_b", "_t", "_base", "_from", "_to")).alias("_r"))
    # most rows lie in no range: they leave by plain comparisons, before any lambda
    some = F.lit(False)
    for j in range(2 * len(probs)):
        some = some | F.coalesce(F.col("_v").between(F.get("_r", F.lit(j))["_from"], F.get("_r", F.lit(j))["_to"]), F.lit(False))
    inside = _attach(rows, ranges, by).filter(some).select(*by, "_v", F.explode(F.filter("_r", lambda r: (F.col("_v") >= r["_from"]) & (F.col("_v") <= r["_to"]))).alias("_e"))
    values = inside.select(*by, "_v", "_e._i", "_e._b", "_e._t", "_e._base").groupBy(*by, "_i", "_b", "_t", "_base", "_v").agg(F.count(F.lit(1)).alias("_c"))
    several = found(values, [*by, "_i", "_b"], "_v", F.col("_base")).select(*by, "_i", "_t", "_v", "_low", "_high")
    picked = one.unionByName(several).groupBy(*by, "_i").agg(
        F.first("_t").alias("_t"), F.max(F.when(F.col("_low"), F.col("_v"))).alias("_lo"), F.max(F.when(F.col("_high"), F.col("_v"))).alias("_hi"))
    fraction = F.col("_t") - F.floor("_t")
    blend = F.col("_lo") if lower else F.col("_lo") + (F.col("_hi") - F.col("_lo")) * fraction
    picked = picked.withColumn("_q", blend)
    return picked.groupBy(*by).agg(
        *[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(name) for i, name in enumerate(names)]
    )


def group_median(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    return exact_quantiles(df, by, value, [0.5], [name])


def _attach(rows: DataFrame, table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join a one-row-per-group table back, null-safe.

    Spark estimates a table by its compressed files, and millions of rows with few different values are a file of a few
    hundred kilobytes, so it would take ``rows`` for the small side and send them through the driver.  The table is
    counted instead: up to ``BROADCAST_ROWS`` groups are broadcast, more are joined by a shuffle of both sides.
    """
    if not by:
        return rows.crossJoin(F.broadcast(table))  # a global aggregate: exactly one row
    renamed = table if hasattr(table, "settled_at") else settle(table)
    few = renamed.count() <= BROADCAST_ROWS
    match: Column | None = None
    for c in by:
        renamed = renamed.withColumnRenamed(c, f"_b_{c}")
        test = F.col(c).eqNullSafe(F.col(f"_b_{c}"))
        match = test if match is None else match & test
    return rows.join(renamed.hint("broadcast" if few else "merge"), match).drop(*[f"_b_{c}" for c in by])


attach = _attach
