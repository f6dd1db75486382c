"""Nested selection against plain NumPy, and its status rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridwright.operators import nested


def table(n=90, seed=3):
    rng = np.random.default_rng(seed)
    x, y = rng.uniform(0, 100, (2, n))
    return pd.DataFrame({"band": "a", "point_id": range(n), "x": x, "y": y, "observed_dbm": np.sin(x / 20) * 8 + y / 10 + rng.normal(0, 1, n), "outer": np.arange(n) % 3, "inner": np.arange(n) // 3 % 3})


def idw(t, q, k, power):
    d = np.hypot(q.x.to_numpy()[:, None] - t.x.to_numpy(), q.y.to_numpy()[:, None] - t.y.to_numpy())
    at = np.argsort(d, axis=1, kind="stable")[:, :k]
    w = 1 / np.maximum(np.take_along_axis(d, at, 1), 1e-6) ** power
    return (w * t.observed_dbm.to_numpy()[at]).sum(1) / w.sum(1)


def test_winner_and_predictions(spark):
    p = table()
    some = {k: nested.CANDIDATES[k] for k in ("IDW_8_1", "IDW_16_2", "IDW_32_2")}
    status, choice, answer = nested.nested_selection(spark.createDataFrame(p), ["band"], range(3), [30, None, 61], [-F.col("point_id")], candidates=some)
    rows = {(r.split, r.budget): r for r in status.collect()}
    assert len(rows) == 9
    assert all(r.status == ("budget_exceeds_pool" if b == 61 else "selected") and r.test_n == 30 and r.train_n == {30: 30, 0: 60, 61: 0}[b] for (_, b), r in rows.items())
    won = {(r.split, r.budget): (r.method, r.rmse) for r in choice.collect()}
    got = answer.toPandas()
    assert set(won) == {(s, b) for s in range(3) for b in (30, 0)} and len(got) == 6 * 30
    for (s, b), (method, rmse) in won.items():
        t = p[p.outer != s].sort_values("point_id", ascending=False).head(b or 60).sort_values("point_id")
        losses = {}
        for name in some:
            k, power = map(int, name.split("_")[1:])
            e = np.concatenate([idw(t[t.inner != f], t[t.inner == f], k, power) - t[t.inner == f].observed_dbm for f in range(3)])
            losses[name] = np.sqrt((e ** 2).mean())
        assert method == min(losses, key=losses.get) and abs(rmse - losses[method]) < 1e-9
        k, power = map(int, method.split("_")[1:])
        q = p[p.outer == s]
        mine = got[(got.split == s) & (got.budget == b)].sort_values("point_id")
        assert np.allclose(mine.pred, idw(t, q, k, power)) and set(mine.method) == {method}


def test_too_few_folds(spark):
    p = table(30).assign(inner=lambda f: np.where(f.point_id < 25, 0, 1))
    df = spark.createDataFrame(p)
    status = nested.nested_selection(df, ["band"], [0, 7], [None], [])[0].collect()
    # 16 rows in one fold and 4 in the other: the first leaves too few to fit
    assert {(r.split, r.train_n, r.usable_folds, r.status) for r in status} == {(0, 20, 1, "too_few_inner_folds"), (7, 30, 1, "no_test_rows")}
    one = df.withColumn("inner", F.lit(0))
    status, choice, answer = nested.nested_selection(one, ["band"], [0], [None, 12], [])
    assert {(r.budget, r.usable_folds, r.status) for r in status.collect()} == {(0, 0, "too_few_inner_folds"), (12, 0, "too_few_inner_folds")}
    assert choice.count() == 0 and answer.count() == 0
    with pytest.raises(ValueError, match="usable inner folds"):
        nested.nested_selection(one, ["band"], [0], [None], [], strict=True)


@pytest.mark.parametrize("budget", [65_536, 40])
def test_candidates_equal_the_interpolators_without_neighbour_rows(spark, monkeypatch, budget):
    from gridwright.operators import interp, knn
    rng = np.random.default_rng(6)
    p = pd.DataFrame({"band": np.where(np.arange(260) % 3 == 0, "a", "b"), "point_id": range(260), "x": rng.integers(0, 30, 260) * 4.0, "y": rng.integers(0, 30, 260) * 4.0,
                      "v": np.where(np.arange(260) % 11 == 0, np.nan, rng.normal(0, 3, 260).round(1))})
    df = spark.createDataFrame(p).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    q, t = df.filter("point_id % 2 = 0"), df.filter("point_id % 2 = 1 or point_id < 20")
    monkeypatch.setattr(knn, "CANDIDATE_ROWS", budget)
    rows = knn.knn_join(q, t, 128, ["band"], carry=["v"])
    by = ["band", "query_id"]
    plain = {"IDW_8_1": interp.idw(rows, by, "v", 8, 1.0), "IDW_16_2": interp.idw(rows, by, "v", 16, 2.0), "IDW_32_2": interp.idw(rows, by, "v", 32, 2.0),
             "NW_25": interp.gaussian_nw(rows, by, "v", 25.0), "NW_50": interp.gaussian_nw(rows, by, "v", 50.0),
             "ADAPTIVE_16": interp.adaptive_gaussian(rows, by, "v", 16), "MEDIAN_16": interp.weighted_median(rows, by, "v", 16, 1.0)}
    fits = nested.CANDIDATES
    wide = knn.knn_join(q, t, 128, ["band"], carry=["v"], reduce=(lambda d, c: [f(d, c["v"]) for f in fits.values()], list(fits)))
    assert wide.columns == ["band", "query_id", *fits]
    got = wide.toPandas().set_index(by).sort_index()
    assert len(got) == q.count() and set(plain) == set(fits)
    for name, table in plain.items():
        want = table.toPandas().set_index(by).sort_index()["pred"]
        assert np.allclose(got[name].reindex(want.index), want, rtol=1e-9, equal_nan=True), name


def test_rows_of_one_id_are_one_prediction(spark):
    p = table()
    twice = spark.createDataFrame(pd.concat([p, p[p.point_id < 30]]))
    _, choice, answer = nested.nested_selection(twice, ["band"], range(3), [None], [])
    assert choice.count() == 3
    assert {(r.point_id, r["count"]) for r in answer.groupBy("point_id").count().collect()} == {(i, 2 if i < 30 else 1) for i in range(90)}
