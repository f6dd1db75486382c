import numpy as np
import pytest

from gridwright.operators import vectors


def brute(q, t, k, same=False):
    out = {}
    for i, v, s in q:
        rows = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(v, w)))), j) for j, w, u in t if u == s and not (same and i == j))[:k]
        if rows:
            out[i] = [(j, round(d, 9)) for d, j in rows]
    return out


def run(spark, q, t, k, **kw):
    make = lambda rows: spark.createDataFrame(rows, "point_id long, embedding array<double>, s string")
    rows = vectors.vector_knn(make(q), make(t), k, **kw).collect()
    assert all(sorted(r.rank for r in rows if r.query_id == i) == list(range(1, n + 1)) for i, n in
               ((i, sum(r.query_id == i for r in rows)) for i in {r.query_id for r in rows}))
    return {i: [(r.train_id, round(r.d, 9)) for r in sorted((r for r in rows if r.query_id == i), key=lambda r: r.rank)] for i in {r.query_id for r in rows}}


def clouds(n, width, seed, keys=1):
    """Points around a few centres; a third of the rows are one and the same vector."""
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(9, width))[rng.integers(0, 9, n)] + 0.1 * rng.normal(size=(n, width))
    m[: n // 3] = m[0]
    return [(int(i), v.tolist(), f"k{j}") for i, v, j in zip(rng.permutation(n), m, rng.integers(0, keys, n))]


@pytest.mark.parametrize("k,width,values", [(5, 64, 4 << 20), (40, 17, 17 * 50), (1, 2, 4 << 20)])
def test_against_brute_force_with_copies(spark, monkeypatch, k, width, values):
    monkeypatch.setattr(vectors, "PART_VALUES", values)
    rows = clouds(500, width, k)
    q, t = rows[::3], [r for i, r in enumerate(rows) if i % 3]
    assert run(spark, q, t, k) == brute([(i, v, "") for i, v, _ in q], [(i, v, "") for i, v, _ in t], k)


def test_own_row_left_out_and_split_keys(spark):
    rows = clouds(240, 12, 3, keys=3)
    assert run(spark, rows, rows, 4, by=["s"], exclude_same_id=True) == brute(rows, rows, 4, same=True)


def test_small_splits_and_odd_rows(spark):
    q = [(1, [0.0, 0.0], "a"), (2, [1.0, 1.0], "b"), (3, [1.0, 1.0], "c")]
    t = [(10, [3.0, 4.0], "a"), (11, None, "a"), (12, [float("nan"), 0.0], "a"), (13, [None, 0.0], "b"), (14, [1.0, 1.0], "b")]
    assert run(spark, q, t, 5, by=["s"]) == {1: [(10, 5.0)], 2: [(14, 0.0)]}
    assert run(spark, q, [], 5) == {} and run(spark, [], t[:1], 5) == {}
    for bad in ([(1, None, "a")], [(1, [1.0], "a")], [(1, [1.0, float("inf")], "a")]):
        with pytest.raises(Exception, match="finite components"):
            run(spark, bad, t[:1], 1)
    with pytest.raises(ValueError):
        run(spark, q, [(1, [1.0], "a"), (2, [1.0, 2.0], "a")], 1)


def test_most_pairs_are_never_ranked(spark):
    rng = np.random.default_rng(5)
    m = 20 * rng.normal(size=(20, 64))[rng.integers(0, 20, 3000)] + rng.normal(size=(3000, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "point_id long, embedding array<double>")
    cost = vectors.search_cost(df, df, 5).first()
    assert cost.all_pairs == 9_000_000 and cost.ranked_pairs < 0.1 * cost.all_pairs


def test_a_block_is_shipped_once_to_a_tile(spark):
    """One cloud that no bound can prune: blocks meet tiles of blocks, not one another."""
    m = np.random.default_rng(7).normal(size=(3000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "_id long, embedding array<double>")
    links, qb, tb, _ = vectors._search(df, df, 5, [], "embedding", "_id", "_id", 5)
    assert links.count() < 0.2 * qb.count() * tb.count()
