"""Exact global positions without a single-task window.

``row_number() over (order by ...)`` moves every row of a partition key into one task.  Here rows are
range-partitioned on the full sort key instead, numbered inside each range piece, and shifted by the
row counts of the earlier pieces.  A key that owns most of the table is simply cut into many pieces.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from gridwright.functions.quantiles import BROADCAST_ROWS
from gridwright.session import settle


def global_position(
    df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "position", keep: Sequence[str] | None = None
) -> DataFrame:
    """Add ``name``: the 1-based position of each row inside its ``by`` group under ``order``.

    ``order`` should end in a unique column, so that the result is the same on every run.  ``keep`` names the columns beside
    ``by`` that the result needs (all by default); the others are left behind once the rows are in order.
    """
    keys = [F.col(c) for c in by]
    placed = settle(
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("_slot", F.monotonically_increasing_id())
        .select(*([*by, *keep, "_slot"] if keep is not None else ["*"]))
    )
    piece = F.shiftright("_slot", 33)
    pieces = (
        placed.groupBy(*keys, piece.alias("_piece"))
        .agg(F.min("_slot").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    )
    # one row per (group, range piece): bounded by groups + partitions
    earlier = W.partitionBy(*by).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    shift = pieces.select(
        *keys, "_piece",
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    # few rows that Spark's estimate does not know to be few: it would deal the whole table to meet them
    shift = settle(shift)
    shift = shift.hint("broadcast" if shift.count() <= BROADCAST_ROWS else "merge")
    joined = placed.withColumn("_piece", piece)
    if by:
        renamed = shift.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("_piece").alias("_at_piece"), "_shift")
        match = F.col("_piece") == F.col("_at_piece")
        for c in by:
            match = match & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        joined = joined.join(renamed, match).drop(*[f"_k_{c}" for c in by], "_at_piece")
    else:
        joined = joined.join(shift, "_piece")
    return joined.withColumn(name, F.col("_slot") + F.col("_shift")).drop("_slot", "_piece", "_shift")


def first_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column], rows: int = 1) -> DataFrame:
    """The ``rows`` leading rows of each group.

    A constant row limit on ``row_number`` is applied before the exchange as well
    (``WindowGroupLimit``), so a hot group ships at most ``rows`` rows per upstream task.
    """
    window = W.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") <= rows).drop("_rn")
