"""The attenuation field by Spark rounds: equal to the dense solve, and optimal on a grid that has none."""

import numpy as np
import pandas as pd

from gridwright.operators import rays


def rays_of(spark, n, side, keys, seed):
    rng = np.random.default_rng(seed)
    at = rng.uniform(0, side, (n, 2))
    pts = pd.DataFrame({"s": [keys[i % len(keys)] for i in range(n)], "point_id": range(n), "x": at[:, 0], "y": at[:, 1], "tx_x": side * 0.43, "tx_y": side * 0.57,
                        "r": rng.normal(-6, 5, n)})
    return spark.createDataFrame(pts)


def test_rounds_equal_the_dense_solve(spark, monkeypatch):
    grid = rays.GridSpec(0.0, 0.0, 1.0, 8, 8)
    points = rays_of(spark, 300, 8.0, ["a", "b", "c"], 1)
    seg = rays.segment_cells(points, ["s"], grid)
    dense = rays.influence_field(seg, points, ["s"], "r", grid).toPandas()
    monkeypatch.setattr(rays, "MAX_CELLS", 0)
    rounds = rays.influence_field(seg, points, ["s"], "r", grid, tolerance=1e-3).toPandas()
    both = dense.merge(rounds, on=["s", "cell_id"])
    assert len(both) == len(dense) == len(rounds) and (both.attenuation_db_x == 0).any() and (both.attenuation_db_x < -0.1).any()
    assert (both.attenuation_db_x - both.attenuation_db_y).abs().max() < 0.02
    assert (both.intercept_db_x - both.intercept_db_y).abs().max() < 0.02


def test_large_grid_meets_the_optimality_conditions(spark):
    grid = rays.GridSpec(0.0, 0.0, 1.0, 50, 50)  # more cells than one task would solve
    points = rays_of(spark, 1500, 50.0, ["a"], 2)
    seg = rays.segment_cells(points, [], grid)
    field = rays.influence_field(seg, points, [], "r", grid, tolerance=0.02).toPandas()
    pieces, y = seg.toPandas(), points.toPandas().set_index("point_id").r
    cells = pd.Series(range(len(field)), index=field.cell_id)
    a = np.zeros((len(y), len(cells)))
    a[pieces.point_id, cells[pieces.cell_id]] = pieces.frac
    w, b = field.attenuation_db.to_numpy(), field.intercept_db.iloc[0]
    left = y.to_numpy() - b - a @ w
    assert abs(left.mean()) < 1e-9  # the free intercept
    g = 5 * w - a.T @ left
    diag = (a * a).sum(0) - a.sum(0) ** 2 / len(y) + 5
    assert w.min() >= -20 and w.max() <= 0 and (w < 0).sum() > 100 and (w == 0).sum() > 100
    assert np.abs(w - np.clip(w - g / diag, -20, 0)).max() < 0.0201


def test_no_rays(spark, monkeypatch):
    monkeypatch.setattr(rays, "MAX_CELLS", 0)
    grid = rays.GridSpec(0.0, 0.0, 1.0, 8, 8)
    points = rays_of(spark, 3, 8.0, ["a"], 1)
    assert rays.influence_field(rays.segment_cells(points, ["s"], grid).filter("false"), points, ["s"], "r", grid).count() == 0


def test_pieces_are_not_exchanged(spark):
    points = spark.range(200).selectExpr("concat('s', id % 2) as s", "id as point_id", "cast(id % 17 as double) as x", "cast(id % 13 as double) as y", "0.1D as tx_x", "0.2D as tx_y", "1D as r")
    grid = rays.GridSpec(0.0, 0.0, 1.0, 17, 13)
    seg = rays.segment_cells(points, ["s"], grid)
    joined = seg.join(points.select("s", "point_id", "r").hint("merge"), ["s", "point_id"])
    plan = joined._jdf.queryExecution().executedPlan().toString()
    # a point becomes many pieces: points are dealt once before that, and neither the sum per cell nor the join deals pieces
    assert plan.count("hashpartitioning") == 2 and "cell_id" not in "".join(line.split("hashpartitioning")[1] for line in plan.splitlines() if "hashpartitioning" in line)
