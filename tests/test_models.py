import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridwright.operators import calibrate, contracts, experts, interp, knn, labels, lineage, raster, rays, regions, score, stacking


def test_scoring_pair_joins_by_id(spark):
    p = spark.createDataFrame([("b", 1.0), ("a", 3.0)], "point_id string, pred double")
    t = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "point_id string, observed_dbm double")
    m = score.error_metrics(lineage.frozen_then_score(p, lambda: t, ["point_id"]), []).first()
    assert m.mae_db == 1.0 and m.rmse_db == 1.0
    with pytest.raises(contracts.ContractError):
        lineage.frozen_then_score(p, lambda: t.limit(1), ["point_id"])


def test_kriging_equals_dense_solution(spark):
    rng = np.random.default_rng(1)
    xy, y = rng.uniform(0, 200, (60, 2)), rng.normal(0, 7, 60)
    q = rng.uniform(0, 200, (15, 2))
    f = lambda a, s: pd.DataFrame({"point_id": range(s, s + len(a)), "x": a[:, 0], "y": a[:, 1]})
    t = f(xy, 0).assign(v=y)
    n = knn.knn_join(spark.createDataFrame(f(q, 100)), spark.createDataFrame(t), 60, carry=["v", "x", "y"]).withColumnsRenamed({"x": "tx", "y": "ty"})
    n = n.join(spark.createDataFrame(f(q, 100)).select(F.col("point_id").alias("query_id"), F.col("x").alias("qx"), F.col("y").alias("qy")), "query_id")
    n = n.withColumn("m", F.lit(float(y.mean()))).withColumn("dev", F.lit(float(y.std())))
    got = interp.local_kriging(n, ["query_id"], {"p": "v"}, (50.0, 50.0), 1.0, 0.05, centers={"p": "m"}, variance="s", scale="dev").toPandas().sort_values("query_id")
    cov = lambda a, b: (lambda z: (1 + z) * np.exp(-z))(np.sqrt(3) * np.linalg.norm((a[:, None] - b[None]) / 50, axis=2))
    k = cov(xy, xy) + np.eye(60) * (0.05 + 1e-8)
    c = cov(q, xy)
    assert np.allclose(got.p, y.mean() + c @ np.linalg.solve(k, y - y.mean()), atol=1e-6)
    # the same process stated in the target's unit
    own = y.var() * c
    assert np.allclose(got.s, y.var() - (own * np.linalg.solve(y.var() * k, own.T).T).sum(1), atol=1e-6)


def test_supported_calibration_reaches_the_bounded_optimum(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-110, -60, 200)
    y = 0.6 * x - 20 + rng.standard_t(2, 200)
    df = spark.createDataFrame(pd.DataFrame({"s": 0, "raw": x, "los": True, "observed_dbm": y}))
    r = calibrate.supported_calibration(df, ["s"]).first()
    cost = lambda a, b: (2 * (np.sqrt(1 + ((a * (x - r.center) + b - y) / 5) ** 2) - 1)).sum()
    best = cost(r.slope, r.bias)
    for da, db in [(0.003, 0), (-0.003, 0), (0, 0.05), (0, -0.05)]:
        assert cost(r.slope + da, r.bias + db) >= best - 1e-9
    assert r.n == 200 and abs(r.center - np.median(x)) < 1e-9


def test_stack_prefers_the_exact_expert(spark):
    rng = np.random.default_rng(3)
    y = rng.normal(-80, 5, 60)
    rows = [(i, f"m{j}", float(v if j == 2 else v + rng.normal(0, 3) + j), float(v)) for i, v in enumerate(y) for j in range(4)]
    df = spark.createDataFrame(rows, "point_id long, method string, pred double, observed_dbm double").withColumn("s", F.lit(0))
    w = stacking.stack_weights(df, ["s"], ["m0", "m1", "m2", "m3"]).first()
    assert abs(w.w2 - 1) < 1e-6 and abs(w.bias) < 1e-6 and abs(w.w0 + w.w1 + w.w2 + w.w3 - 1) < 1e-9


def test_confidence_model_is_non_negative_optimum(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 2, (300, 4))
    y = 1 + 2 * x[:, 0] - 1.5 * x[:, 1] + rng.normal(0, 0.1, 300)
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(t=y, s=0))
    r = stacking.confidence_model(df, ["s"], list("abcd"), "t").first()
    k = np.array([r.intercept, r.k0, r.k1, r.k2, r.k3])
    design = np.column_stack([np.ones(300), x / np.array([r.s0, r.s1, r.s2, r.s3])])
    g = design.T @ (design @ k - y)
    g[1:] += k[1:]
    assert (k[1:] >= 0).all() and k[2] == 0 and abs(g[0]) < 1e-6 and (g[1:] > -1e-6).all() and (np.abs(g[1:] * k[1:]) < 1e-5).all()


def test_segments_conserve_length_and_field_finds_the_attenuation(spark):
    rng = np.random.default_rng(5)
    p = pd.DataFrame({"point_id": range(300), "x": rng.uniform(0, 400, 300), "y": rng.uniform(0, 300, 300), "tx_x": 10.0, "tx_y": 20.0, "s": 0})
    p["distance"] = np.hypot(p.x - 10, p.y - 20)
    grid = rays.GridSpec(0.0, 0.0, 100.0, 4, 3)
    df = spark.createDataFrame(p)
    seg = rays.segment_cells(df, ["s"], grid)
    assert rays.conservation(seg, df, ["s"], 100.0).first()[0] < 1e-9
    wall = seg.groupBy("s", "point_id").agg((F.sum(F.when(F.col("cell_id") == 5, F.col("frac")).otherwise(0.0)) * -6.0 + 3.0).alias("r"))
    field = rays.influence_field(seg, wall, ["s"], "r", grid, ridge=1e-6).toPandas().set_index("cell_id")
    assert abs(field.attenuation_db[5] + 6) < 1e-2 and field.attenuation_db.drop(5).abs().max() < 1e-2
    assert abs(field.intercept_db.iloc[0] - 3) < 1e-2


def test_roof_levels_two_modes(spark):
    h = [10.2] * 60 + [11.1] * 20 + [25.4] * 50 + [40.0] * 5
    df = spark.createDataFrame([(1, v) for v in h] + [(2, 9.0)] * 10, "zone int, height double")
    assert {r.zone: list(r.levels) for r in raster.roof_levels(df).collect()} == {1: [10.0, 25.0]}


def test_rectangle_is_one_component_and_morphology(spark):
    cells = spark.createDataFrame([(1, r, c) for r in range(20, 100) for c in range(25, 105)], "zone int, row long, col long")
    assert regions.components(cells, ["zone"], tile=16).select("component").distinct().count() == 1
    assert regions.erode(cells, ["zone"], 2).count() == 76 * 76
    assert regions.zone_boundary(cells, ["zone"]).count() == 80 * 80 - 78 * 78


def test_uniform_voxels_make_every_facade_glass(spark):
    vox = spark.createDataFrame([(x, y, z, 8, 255, 10) for x in range(-1, 6) for y in range(-1, 6) for z in range(-1, 6)], "ix int, iy int, iz int, label int, confidence int, count int")
    tri = lambda f, s, a, b, c: (f, s, a, b, c)
    faces = spark.createDataFrame(
        [tri(0, "f1", (0., 0., 0.), (4., 0., 0.), (4., 0., 4.)), tri(1, "f1", (0., 0., 0.), (4., 0., 4.), (0., 0., 4.)), tri(2, "f2", (4., 0., 0.), (4., 4., 0.), (4., 4., 4.))],
        "fid long, surface_id string, a struct<x:double,y:double,z:double>, b struct<x:double,y:double,z:double>, c struct<x:double,y:double,z:double>")
    s = labels.surface_samples(faces).withColumn("surface_type", F.lit("facade"))
    rows = labels.surface_votes(labels.nearest_voxel(s, labels.voxel_consensus(vox), 1.0, 1)).collect()
    assert {r.label for r in rows} == {"glass_facade"} and all(r.status == "AUTO_ACCEPTED_VISUAL_PRIOR" for r in rows)


def test_isolation_rule(spark):
    df = spark.createDataFrame([("fit", 1.0), ("query", 2.0)], "role string, observed_dbm double")
    assert [r.observed_dbm for r in experts.isolate_labels(df).orderBy("role").collect()] == [1.0, None]


def test_idw_grid_equals_one_idw_each(spark):
    rng = np.random.default_rng(8)
    rows = [(q, t, t + 1, 0.0 if q == 3 and t < 2 else float(d), float(rng.normal())) for q in range(12)
            for t, d in enumerate(np.sort(rng.uniform(0.1, 50, 3 if q == 5 else 20)))]
    n = spark.createDataFrame(rows, "query_id long, train_id long, rank int, d double, v double")
    plan = interp.idw_grid(n, ["query_id"], "v", [4, 16], [1.0, 2.0])
    # neighbour rows are not repeated per combination: the only explode is the reader's
    assert "Generate" not in plan._jdf.queryExecution().executedPlan().toString()
    got = {(r["query_id"], g["k"], g["power"]): g["pred"] for r in plan.collect() for g in r["_grid"]}
    for k in (4, 16):
        for p in (1.0, 2.0):
            for r in interp.idw(n, ["query_id"], "v", k, p).collect():
                assert np.isclose(got[r["query_id"], k, p], r["pred"], rtol=1e-12)


def test_squared_distance_builds_no_array_of_components():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3, 7, 6))
    got = interp.squared_distance(x[:, :, None, :], x[:, None, :, :])
    assert np.allclose(got, ((x[:, :, None, :] - x[:, None, :, :]) ** 2).sum(-1), rtol=1e-14)
