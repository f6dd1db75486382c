"""Composite-likelihood search and kriging with its parameters, against dense systems."""

from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridwright.operators import knn, kriging

GRID = ((10.0, 40.0, 160.0), (0.5, 1.0), (0.01, 0.3))


def dense_matern(a, b, length):
    r = np.linalg.norm((a[:, None] - b[None]) / np.asarray(length), axis=2)
    return (1 + np.sqrt(3) * r) * np.exp(-np.sqrt(3) * r)


def dense_loglik(xy, y, length, signal, noise):
    k = signal * dense_matern(xy, xy, length) + (noise + kriging.JITTER) * np.eye(len(y))
    return -0.5 * (y @ np.linalg.solve(k, y) + np.linalg.slogdet(k)[1] + len(y) * np.log(2 * np.pi))


def field(rng, n, length, noise):
    xy = rng.uniform(0, 300, (n, 2))
    return xy, rng.multivariate_normal(np.zeros(n), dense_matern(xy, xy, length) + noise * np.eye(n)) * 6 - 80


def neighbours(spark, splits, k):
    """splits: name -> (train xy, train values, query xy)."""
    train = pd.concat([pd.DataFrame({"s": s, "point_id": range(len(v)), "x": xy[:, 0], "y": xy[:, 1], "v": v}) for s, (xy, v, _) in splits.items()])
    query = pd.concat([pd.DataFrame({"s": s, "point_id": range(len(q)), "x": q[:, 0], "y": q[:, 1]}) for s, (_, _, q) in splits.items()])
    t, q = spark.createDataFrame(train), spark.createDataFrame(query)
    n = knn.knn_join(q, t, k, ["s"], carry=["v", "x", "y"]).withColumnsRenamed({"x": "tx", "y": "ty"})
    at = q.select("s", F.col("point_id").alias("query_id"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    spread = t.groupBy("s").agg(F.avg("v").alias("center"), F.stddev_pop("v").alias("scale"))
    return n.join(at, ["s", "query_id"]).join(spread, "s")


@pytest.fixture(scope="module")
def two_splits():
    rng = np.random.default_rng(11)
    return {"east": (*field(rng, 70, (20, 120), 0.05), rng.uniform(0, 300, (25, 2))), "north": (*field(rng, 9, (80, 15), 0.2), rng.uniform(0, 300, (8, 2)))}


def dense_scores(nbrs, grid):
    rows, out = nbrs.toPandas().sort_values(["s", "query_id", "rank"]), {}
    for s, part in rows.groupby("s"):
        blocks = [(b[["tx", "ty"]].to_numpy(), ((b.v - b.center) / b.scale).to_numpy()) for _, b in part.dropna(subset=["v"]).groupby("query_id")]
        lengths, signals, noises = grid
        out[s] = [sum(dense_loglik(x, y, length, g, n) for x, y in blocks)
                  for length, g, n in product(product(lengths, repeat=2), signals, noises)]
    return out


def test_every_grid_point_equals_the_dense_sum(spark, two_splits):
    n = neighbours(spark, two_splits, 12)
    n = n.withColumn("v", F.when(F.expr("not (s = 'east' and query_id % 5 = 0 and rank > 7)"), F.col("v")))  # blocks of several sizes
    table = kriging.block_table(n, ["s"], "query_id", "v", ("tx", "ty"), "center", "scale").withColumns(kriging.shared_grid(*GRID))
    got = kriging.likelihoods(table.repartition(3), ["s"]).toPandas().sort_values(["s", "at"])
    want = dense_scores(n, GRID)
    for s, part in got.groupby("s"):
        assert np.allclose(part.loglik, want[s], rtol=1e-9) and len(part) == len(want[s])
        assert set(part.blocks) == {len(two_splits[s][2])}
    assert set(got[got.s == "north"].rows) == {8 * 9}


def test_the_best_point_of_each_split(spark, two_splits):
    n = neighbours(spark, two_splits, 12)
    points = list(product(product(GRID[0], repeat=2), *GRID[1:]))
    want = {s: points[int(np.argmax(v))] for s, v in dense_scores(n, GRID).items()}
    got = {r.s: r for r in kriging.search(n, ["s"], "query_id", "v", grid=kriging.shared_grid(*GRID), refine=False).collect()}
    assert {s: (tuple(r.length), r.signal, r.noise) for s, r in got.items()} == want
    finer = {r.s: r for r in kriging.search(n, ["s"], "query_id", "v", grid=kriging.shared_grid(*GRID)).collect()}
    for s, r in finer.items():
        around = [v * f for v, f in product(got[s].length, kriging.NEAR)]
        assert r.loglik >= got[s].loglik - 1e-6 and all(min(abs(v - a) for a in around) < 1e-9 for v in r.length)
        one = dense_scores(n.filter(F.col("s") == s), ((r.length[0],), (r.signal,), (r.noise,)))[s][0] if r.length[0] == r.length[1] else None
        assert one is None or np.isclose(one, r.loglik)


def test_long_and_short_axis_are_found_and_help(spark):
    rng = np.random.default_rng(12)
    xy, v = field(rng, 900, (15, 150), 0.05)
    n = neighbours(spark, {"a": (xy[:600], v[:600], xy[600:])}, 40)
    best = kriging.search(n, ["s"], "query_id", "v")
    row = best.first()
    assert 8 < row.length[0] < 30 and 70 < row.length[1] < 320 and row.blocks == 300 and row.rows == 12000
    truth = v[600:]
    error = lambda b: np.sqrt(np.mean((kriging.fitted_kriging(n, ["s"], "query_id", "v", b).toPandas().sort_values("query_id").pred.to_numpy() - truth) ** 2))
    fixed = best.withColumn("length", F.array(F.lit(50.0), F.lit(50.0))).withColumn("signal", F.lit(1.0)).withColumn("noise", F.lit(0.05))
    assert error(best) < 0.97 * error(fixed)


def test_prediction_uses_the_parameters_of_its_split(spark, two_splits):
    n = neighbours(spark, two_splits, 9)
    best = spark.createDataFrame([("east", [20.0, 120.0], 0.7, 0.04), ("north", [90.0, 10.0], 1.3, 0.2)], "s string, length array<double>, signal double, noise double")
    got = kriging.fitted_kriging(n, ["s"], "query_id", "v", best).toPandas().set_index(["s", "query_id"])
    rows = n.toPandas().sort_values("rank")
    for (s, q), b in rows.groupby(["s", "query_id"]):
        p = best.filter(F.col("s") == s).first() if q == 0 else p  # rows come in the order of their split
        x, y = b[["tx", "ty"]].to_numpy(), ((b.v - b.center)).to_numpy()
        k = p.signal * dense_matern(x, x, p.length) + (p.noise + 1e-8) * np.eye(len(y))
        c = p.signal * dense_matern(b[["qx", "qy"]].to_numpy()[:1], x, p.length)[0]
        w = np.linalg.solve(k, c)
        assert np.isclose(got.pred[(s, q)], b.center.iloc[0] + w @ y) and np.isclose(got.latent_var[(s, q)], max(p.signal - w @ c, 0) * b.scale.iloc[0] ** 2)


def test_odd_rows(spark):
    kind = "s string, query_id long, rank int, train_id long, v double, tx double, ty double, center double, scale double, _y int, lengths int"
    rows = [(None, 1, 1, 1, 5.0, 0.0, 0.0, 5.0, 0.0, 1, 1), (None, 2, 1, 1, 6.0, 0.0, 0.0, 5.0, 0.0, 1, 1),  # null split, no spread, one row a block
            ("b", 1, 1, 1, 1.0, 3.0, 3.0, 1.0, 1.0, 1, 1), ("b", 1, 2, 2, 1.0, 3.0, 3.0, 1.0, 1.0, 1, 1),  # two rows at one place
            ("gone", 1, 1, 1, None, 0.0, 0.0, 0.0, 1.0, 1, 1)]
    got = {r.s: r for r in kriging.search(spark.createDataFrame(rows, kind), ["s"], "query_id", "v", refine=False).collect()}
    assert set(got) == {None, "b"} and all(np.isfinite(r.loglik) for r in got.values())
    finer = kriging.search(spark.createDataFrame(rows, kind), ["s"], "query_id", "v", grid=kriging.shared_grid(*GRID)).collect()
    assert {r.s for r in finer} == {None, "b"}
    assert list(got["b"].length) == [5.0, 5.0]  # every length scores alike here: the first wins
    assert kriging.search(spark.createDataFrame(rows, kind).filter("false"), ["s"], "query_id", "v").count() == 0


def test_likelihoods_need_no_eigenvectors(monkeypatch):
    rng = np.random.default_rng(8)
    x, y = np.floor(rng.uniform(0, 9, (5, 12, 2))), rng.normal(0, 1, (5, 12))  # some rows share a place
    lengths, signals, noises = np.array([(3.0, 8.0), (40.0, 2.0)]), np.array([0.3, 2.0]), np.array([0.001, 0.2, 1.5])
    dense = np.zeros((2, 2, 3))
    for (i, length), (j, s), (k, n) in product(enumerate(lengths), enumerate(signals), enumerate(noises)):
        for a, b in zip(x, y):
            z = np.sqrt(3.0) * np.sqrt((((a[:, None] - a[None]) / length) ** 2).sum(-1))
            cov = s * (1 + z) * np.exp(-z) + (n + kriging.JITTER) * np.eye(12)
            dense[i, j, k] -= 0.5 * (b @ np.linalg.solve(cov, b) + np.linalg.slogdet(cov)[1] + 12 * np.log(2 * np.pi))
    assert kriging._sytrd() is not None
    with monkeypatch.context() as m:
        m.setattr(np.linalg, "eigh", None)
        assert np.allclose(kriging.block_likelihoods(x, y, lengths, signals, noises, "matern32"), dense, rtol=1e-9)
    monkeypatch.setattr(kriging, "_sytrd", lambda: None)  # a NumPy whose library has other names
    assert np.allclose(kriging.block_likelihoods(x, y, lengths, signals, noises, "matern32"), dense, rtol=1e-9)
