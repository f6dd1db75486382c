"""Method selection inside each outer-training set, with a status row for every condition.

A condition is a split key, an outer split and a budget.  Its training rows are the first ``budget`` rows, in a given
order, of those outside the outer fold; they fall into inner folds.  All conditions are one membership table, so every inner
and outer fit of all of them is one neighbour join, and a condition that cannot be fitted is a row with its reason
instead of a failed job.  Outer test rows are predicted by the winner only and never score a method.

Defined results: a budget larger than the pool is not cut down but reported; an inner fold with fewer than
``MIN_FIT`` rows to fit or ``MIN_VALID`` to validate is not used, and a condition with fewer than ``MIN_FOLDS`` used folds selects
nothing; rows with a null fold belong to no fold and no pool; ties of methods go to the lesser name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.quantiles import attach
from gridwright.functions.ranking import global_position
from gridwright.operators import interp, knn, score
from gridwright.session import settle

MIN_FIT, MIN_VALID, MIN_FOLDS = 8, 2, 2
NEIGHBOURS = 128

# A candidate maps matrices (query, rank) of distances and values to its predictions.
CANDIDATES: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "IDW_8_1": lambda d, v: interp.idw_values(d, v, 8, 1.0),
    "IDW_16_2": lambda d, v: interp.idw_values(d, v, 16, 2.0),
    "IDW_32_2": lambda d, v: interp.idw_values(d, v, 32, 2.0),
    "NW_25": lambda d, v: interp.gaussian_values(d, v, 25.0),
    "NW_50": lambda d, v: interp.gaussian_values(d, v, 50.0),
    "ADAPTIVE_16": lambda d, v: interp.adaptive_values(d, v, 16),
    "MEDIAN_16": lambda d, v: interp.median_values(d, v, 16, 1.0),
}


def training_sets(points: DataFrame, by: Sequence[str], splits: Sequence[int], budgets: Sequence[int | None], order: Sequence[Column]) -> DataFrame:
    """(by…, split, budget, pool_n, columns of ``points``): the rows of every condition; budget 0 stands for None, all rows."""
    by = list(by)
    pool = points.withColumn("split", F.explode(F.array(*[F.lit(int(s)) for s in splits]))).filter(F.col("outer") != F.col("split"))
    placed = global_position(pool.filter(F.col("inner").isNotNull()), [*by, "split"], [*order, F.col("point_id")], "_at")
    sizes = placed.groupBy(*by, "split").agg(F.count(F.lit(1)).alias("pool_n"))
    rows = attach(placed, sizes, [*by, "split"]).withColumn("budget", F.explode(F.array(*[F.lit(int(b or 0)) for b in budgets])))
    return rows.filter((F.col("budget") == 0) | ((F.col("budget") <= F.col("pool_n")) & (F.col("_at") <= F.col("budget")))).drop("_at")


def condition_folds(train: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by…, split, budget, valid_fold, fit_n, valid_n, usable) of the inner folds."""
    key = [*by, "split", "budget"]
    folds = train.groupBy(*key, F.col("inner").alias("valid_fold")).agg(F.count(F.lit(1)).alias("valid_n"))
    total = folds.groupBy(*key).agg(F.sum("valid_n").alias("_n"))
    fit = (F.col("_n") - F.col("valid_n")).alias("fit_n")
    return folds.join(total, key).select(*key, "valid_fold", fit, "valid_n", ((F.col("fit_n") >= MIN_FIT) & (F.col("valid_n") >= MIN_VALID)).alias("usable"))


def condition_status(points: DataFrame, train: DataFrame, by: Sequence[str], splits: Sequence[int], budgets: Sequence[int | None]) -> DataFrame:
    """(by…, split, budget, train_n, test_n, usable_folds, status) with one row for every condition, feasible or not."""
    by = list(by)
    key = [*by, "split", "budget"]
    keys = points.select(*by).distinct() if by else points.limit(1).select()
    grid = keys.withColumn("split", F.explode(F.array(*[F.lit(int(s)) for s in splits]))).withColumn(
        "budget", F.explode(F.array(*[F.lit(int(b or 0)) for b in budgets])))
    tests = points.groupBy(*by, F.col("outer").cast("int").alias("split")).agg(F.count(F.lit(1)).alias("test_n"))
    folds = condition_folds(train, by).groupBy(*key).agg(F.sum("valid_n").alias("train_n"), F.count_if("usable").alias("usable_folds"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    rows = grid.join(folds, key, "left").join(tests, [*by, "split"], "left").select(*key, *[zero(c) for c in ("train_n", "test_n", "usable_folds")])
    return rows.withColumn("status", F.when(F.col("train_n") == 0, "budget_exceeds_pool").when(F.col("test_n") == 0, "no_test_rows").when(
        F.col("usable_folds") < MIN_FOLDS, "too_few_inner_folds").otherwise("selected"))


def nested_selection(points: DataFrame, by: Sequence[str], splits: Sequence[int], budgets: Sequence[int | None], order: Sequence[Column],
                     target: str = "observed_dbm", candidates: dict | None = None, strict: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(status, choice, predictions) of all conditions.

    ``points`` has by…, point_id, x, y, outer, inner and the target.  ``choice`` gives the winning method of a condition with its
    pooled inner errors, ``predictions`` its outer test rows.  ``strict`` raises when a condition has fewer than
    ``MIN_FOLDS`` usable folds.
    """
    by, candidates = list(by), candidates or CANDIDATES
    key = [*by, "split", "budget"]
    points = points.select(*by, "point_id", "x", "y", F.col("outer").cast("int").alias("outer"), F.col("inner").cast("int").alias("inner"), F.col(target).cast("double").alias("_v"))
    train = settle(training_sets(points, by, splits, budgets, order))
    status = settle(condition_status(points, train, by, splits, budgets))
    if strict:
        short = status.filter(F.col("status") == "too_few_inner_folds").select(*key, "usable_folds").limit(5).collect()
        if short:
            raise ValueError(f"fewer than {MIN_FOLDS} usable inner folds: {[tuple(r) for r in short]}")
    ready = status.filter("status = 'selected'").select(*key)
    folds = condition_folds(train, by).filter("usable").join(ready, key).select(*key, "valid_fold")
    many = settle(train.join(folds, key))
    fold = [*key, "valid_fold"]
    # all candidates are numbers of a query by the time its neighbours are ranked
    places = {name: f"_p{i}" for i, name in enumerate(candidates)}
    reduce = (lambda d, carried: [fit(d, carried["_v"]) for fit in candidates.values()], list(places.values()))
    near = lambda q, t, keys: settle(knn.knn_join(q, t, NEIGHBOURS, keys, carry=["_v"], reduce=reduce))
    inner = near(many.filter("inner = valid_fold"), many.filter("inner <> valid_fold"), fold)
    tests = points.withColumnRenamed("outer", "split").join(ready, [*by, "split"])
    outer = near(tests, train.join(ready, key), key)

    def predicted(wide: DataFrame, keys: list[str]) -> DataFrame:
        observed = points.select(*by, "point_id", F.col("_v").alias("observed_dbm"))
        # rows of one id are one prediction; dealt by id, as the join needs it
        once = wide.withColumnRenamed("query_id", "point_id").repartition(*by, "point_id").groupBy(*keys, "point_id").agg(*[F.avg(c).alias(c) for c in places.values()])
        rows = once.join(observed, [*by, "point_id"])
        each = F.explode(F.array(*[F.struct(F.col(c).alias("pred"), F.lit(name).alias("method")) for name, c in places.items()])).alias("_e")
        return rows.select(*keys, "point_id", "observed_dbm", each).select(*keys, "point_id", "_e.pred", "_e.method", "observed_dbm")

    choice = settle(score.choose_params(score.cv_score(predicted(inner, fold), key, ["method"], "valid_fold"), key, ["method"]))
    return status, choice, predicted(outer, key).join(choice.select(*key, "method"), [*key, "method"])
