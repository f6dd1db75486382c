"""The lattice of all modes and folds against one split at a time."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridwright.operators import splits


def test_lattice_equals_single_splits(spark):
    rng = np.random.default_rng(21)
    p = pd.DataFrame({"band": rng.choice(["a", "b"], 240), "point_id": range(240), "x": rng.uniform(0, 400, 240), "y": rng.uniform(0, 300, 240)})
    df = spark.createDataFrame(p)
    all_ = splits.split_lattice(df, ["band"], ["infill", "spatial30", "spatial60"], 3, 7).toPandas()
    assert len(all_) == 240 * 9 and not all_.duplicated(["band", "mode", "outer_fold", "point_id"]).any()
    for mode, fold in (("infill", 2), ("spatial60", 0)):
        one = splits.outer_splits(df, ["band"], mode, fold, 3, 7).toPandas().sort_values("point_id").reset_index(drop=True)
        same = all_[(all_["mode"] == mode) & (all_.outer_fold == fold)].sort_values("point_id").reset_index(drop=True)
        assert list(one.role) == list(same.role) and np.allclose(one.nearest_m, same.nearest_m, equal_nan=True)
    assert splits.split_lattice(df.filter(F.lit(False)), ["band"], ["spatial30"], 3, 7).count() == 0


def asked_rows(monkeypatch):
    asked, whole = [], splits.nearest_distance
    def counted(query, *args, **kw):
        asked.append(query.count())
        return whole(query, *args, **kw)
    monkeypatch.setattr(splits, "nearest_distance", counted)
    return asked


def crowd(spark, copies):
    """60 coordinates of one band, each ``copies`` times."""
    rng = np.random.default_rng(4)
    at = pd.DataFrame({"x": rng.integers(0, 400, 60).astype(float), "y": rng.integers(0, 300, 60).astype(float)}).drop_duplicates()
    p = pd.concat([at] * copies, ignore_index=True)
    return len(at), spark.createDataFrame(p.assign(band="a", point_id=range(len(p))))


def test_lattice_asks_once_for_a_coordinate(spark, monkeypatch):
    places, df = crowd(spark, 5)
    asked = asked_rows(monkeypatch)
    all_ = splits.split_lattice(df, ["band"], ["infill", "spatial30"], 3, 7).toPandas()
    assert asked == [places * 2 * 2]
    one = splits.outer_splits(df, ["band"], "spatial30", 1, 3, 7).toPandas().sort_values("point_id").reset_index(drop=True)
    same = all_[(all_["mode"] == "spatial30") & (all_.outer_fold == 1)].sort_values("point_id").reset_index(drop=True)
    assert list(one.role) == list(same.role) and np.allclose(one.nearest_m, same.nearest_m, equal_nan=True)


def test_designs_ask_once_for_a_coordinate(spark, monkeypatch):
    places, train = crowd(spark, 5)
    query = train.filter("point_id % 9 = 0").withColumn("x", F.col("x") + 3.5)
    asked = asked_rows(monkeypatch)
    audit, members = splits.matched_designs(train, query, ["band"], "spatial30", 11, candidates=2)
    members = members.toPandas()
    assert asked[0] == places * 2 * 2 and asked[1] == places * 2  # buffer: two other folds each; then each as valid once
    # plain pandas: distances of valid to fit points, quantiles over points
    xy = train.toPandas().set_index("point_id")
    def nearest(a, b):
        return np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)).min(1)
    q = query.toPandas()[["x", "y"]].to_numpy()
    target = np.quantile(np.log1p(nearest(q, xy[["x", "y"]].to_numpy())), [0.1, 0.25, 0.5, 0.75, 0.9])
    assert (members[members.role == "valid"].groupby("candidate").size() == len(xy)).all()
    for row in audit.collect():
        d = []
        for _, m in members[members.candidate == row["candidate"]].groupby("fold"):
            v, f = (xy.loc[m.point_id[m.role == r], ["x", "y"]].to_numpy() for r in ("valid", "fit"))
            far = nearest(f, v)
            assert far.min() >= 30
            d.append(nearest(v, f))
        got = np.quantile(np.log1p(np.concatenate(d)), [0.1, 0.25, 0.5, 0.75, 0.9])
        assert np.isclose(row["mismatch"], np.abs(got - target).mean())


def test_points_are_not_broadcast_to_meet_their_cells(spark):
    from gridwright.session import settle
    # few bytes, many rows: a file of this table is below Spark's broadcast threshold
    points = settle(spark.range(200_000).selectExpr("'a' as band", "id as point_id", "cast(id % 300 as double) as x", "1D as y"))
    folds = splits.balanced_cell_folds(points, ["band"], 3, 10.0, 7)
    folded = splits.fold_points(points, folds, ["band"], 10.0)
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and "BuildRight" in plan
    assert folded.count() == 200_000
