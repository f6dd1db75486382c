import numpy as np
import pandas as pd
import pytest

from gridwright.operators import knn


def brute(q, t, k, feats=("x", "y"), same=False):
    out = {}
    for _, a in q.iterrows():
        d = np.sqrt(sum((t[f].to_numpy() - a[f]) ** 2 for f in feats))
        order = np.lexsort((t["point_id"].to_numpy(), d))
        if same:
            order = [i for i in order if t["point_id"].iloc[i] != a["point_id"]]
        out[a["point_id"]] = [(t["point_id"].iloc[i], round(d[i], 9)) for i in order[:k]]
    return out


def run(spark, q, t, k, feats=("x", "y"), **kw):
    r = knn.knn_join(spark.createDataFrame(q), spark.createDataFrame(t), k, feats=feats, **kw).toPandas()
    r = r.sort_values(["query_id", "rank"])
    return {key: [(i, round(d, 9)) for i, d in zip(g["train_id"], g["d"])] for key, g in r.groupby("query_id")}


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(0, 1000, (n, 2))
    xy[: n // 3] = [500, 400] + rng.integers(0, 6, (n // 3, 2))  # a third of the rows in one small cell
    return pd.DataFrame({"point_id": rng.permutation(n), "x": xy[:, 0], "y": xy[:, 1], "z": rng.uniform(0, 5, n)})


@pytest.mark.parametrize("k,budget", [(7, 65_536), (7, 100), (65, 65_536), (128, 200)])
def test_matches_brute_force_with_a_hot_cell(spark, monkeypatch, k, budget):
    monkeypatch.setattr(knn, "CANDIDATE_ROWS", budget)
    p = clustered(900, 1)
    q, t = p.iloc[::4], p.drop(p.index[::4])
    assert run(spark, q, t, k) == brute(q, t, k)


@pytest.mark.parametrize("k", [8, 65, 128])
def test_sparse_queries_meet_few_train_blocks(spark, monkeypatch, k):
    kept = []
    plain = knn.settle
    monkeypatch.setattr(knn, "settle", lambda df: kept.append(plain(df)) or kept[-1])
    t, q = clustered(20_000, 6), clustered(30, 7)
    q.loc[:, ["x", "y"]] = np.random.default_rng(8).uniform(0, 1000, (30, 2))
    got = run(spark, q, t, k)
    assert got == brute(q, t, k)
    train, links = kept[0].count(), kept[-1].groupBy("q_block").agg({"n": "sum"}).toPandas()
    assert links["sum(n)"].mean() <= 20_000 / 5 and kept[-1].count() < 0.2 * len(links) * train


def test_axes_of_few_values_prune_as_well(spark, monkeypatch):
    """A flag that is far apart must not make every box wide: blocks are laid out along all axes."""
    kept = []
    plain = knn.settle
    monkeypatch.setattr(knn, "settle", lambda df: kept.append(plain(df)) or kept[-1])
    rng = np.random.default_rng(9)
    p = pd.DataFrame({"point_id": np.arange(14_000), "x": rng.uniform(0, 3, 14_000), "y": rng.uniform(0, 3, 14_000),
                      "c": rng.integers(0, 4, 14_000) / 1.0, "f": rng.integers(0, 2, 14_000) * 3.0})
    q, t, f = p.iloc[:200], p.iloc[200:], ("x", "y", "c", "f")
    assert run(spark, q, t, 8, f) == brute(q, t, 8, f)
    train, links = kept[0].count(), kept[-1].groupBy("q_block").count().toPandas()
    assert links["count"].mean() < 0.35 * train


def test_a_query_without_coordinates_is_an_error(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0)], "point_id long, x double, y double")
    for x in (None, float("nan")):
        q = spark.createDataFrame([(9, x, 1.0)], "point_id long, x double, y double")
        for call in (lambda: knn.knn_join(q, t, 1), lambda: knn.buffer_exclude(q, t, 5.0)):
            with pytest.raises(Exception, match="query row without x"):
                call().collect()


def test_one_coordinate_holds_everything(spark):
    t = pd.DataFrame({"point_id": range(500), "x": 1.0, "y": 2.0})
    q = pd.DataFrame({"point_id": [900, 901], "x": [1.0, 50.0], "y": [2.0, 60.0]})
    assert run(spark, q, t, 4) == brute(q, t, 4)


def test_three_features_and_own_row_excluded(spark):
    p = clustered(300, 2)
    f = ("x", "y", "z")
    assert run(spark, p, p, 3, f, exclude_same_id=True) == brute(p, p, 3, f, same=True)


def test_more_neighbours_than_rows_and_far_queries(spark):
    t = clustered(5, 3)
    q = pd.DataFrame({"point_id": [10], "x": [-1e5], "y": [1e6], "z": [0.0]})
    got = run(spark, q, t, 20)
    assert got == brute(q, t, 20) and len(got[10]) == 5


def test_splits_do_not_mix_and_buffer(spark):
    p = clustered(400, 4)
    p["s"] = np.where(p.index % 2 == 0, "a", "b")
    q, t = p.iloc[::5], p.drop(p.index[::5])
    r = knn.knn_join(spark.createDataFrame(q), spark.createDataFrame(t), 3, ["s"]).toPandas()
    for s in "ab":
        want = brute(q[q.s == s], t[t.s == s], 3)
        part = r[r.s == s].sort_values("rank")
        assert {k: list(zip(g["train_id"], g["d"].round(9))) for k, g in part.groupby("query_id")} == want
    kept = knn.buffer_exclude(spark.createDataFrame(t), spark.createDataFrame(q), 25.0, ["s"]).toPandas()
    for _, row in kept.iterrows():
        near = np.hypot(q[q.s == row.s].x - row.x, q[q.s == row.s].y - row.y).min()
        assert row.kept == (near >= 25.0) and abs(near - row.nearest_m) < 1e-9
