"""A frozen campaign: outer splits x nested budgets x repeats as one membership table, scored afterwards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.operators import contracts, interp, knn, lineage, score, splits
from gridwright.session import settle

RUN = ["band", "outer_fold", "mode", "repeat", "budget"]


def membership(points: DataFrame, modes: Sequence[str], folds: Sequence[int], budgets: Sequence[int], repeats: int, seed: int,
               n_folds: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train: RUN, point_id), (test: band, outer_fold, mode, point_id), (status per run)."""
    base = ["band", "outer_fold", "mode"]
    roles = None
    for mode in modes:
        for fold in folds:
            part = splits.outer_splits(points, ["band"], mode, fold, n_folds, seed).withColumn("outer_fold", F.lit(fold)).withColumn("mode", F.lit(mode))
            roles = part if roles is None else roles.unionByName(part)
    roles = settle(roles)
    pool = roles.filter("role = 'pool'").select(*base, "point_id").join(points.select("band", "point_id", "x", "y"), ["band", "point_id"])
    pool = settle(pool.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))))
    order = settle(splits.spatial_order(pool, [*base, "repeat"], seed))
    train, status = splits.nested_prefixes(order, [*base, "repeat"], budgets)
    return train.select(*RUN, "point_id"), roles.filter("role = 'test'").select(*base, "point_id"), status


def run(points: DataFrame, modes: Sequence[str], folds: Sequence[int], budgets: Sequence[int], repeats: int, seed: int,
        k: int = 16, power: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(metrics per run, status per run) of the inverse-distance baseline; labels join last."""
    train, test, status = membership(points, modes, folds, budgets, repeats, seed)
    xyl = points.select("band", "point_id", "x", "y", "observed_dbm")
    train = settle(train.join(xyl, ["band", "point_id"]))
    runs = status.filter("status = 'COMPLETE'").select(*RUN)
    asked = settle(test.join(runs, ["band", "outer_fold", "mode"]).join(xyl.drop("observed_dbm"), ["band", "point_id"]))
    nbrs = knn.knn_join(asked, train, k, RUN, carry=["observed_dbm"])
    pred = settle(interp.idw(nbrs, [*RUN, "query_id"], "observed_dbm", k, power).withColumnRenamed("query_id", "point_id"))
    scored = pred.join(xyl.select("band", "point_id", "observed_dbm"), ["band", "point_id"])
    metrics = score.error_metrics(scored.withColumn("method", F.lit("IDW")), [*RUN, "method"], quantiles=False)
    return metrics, status
