"""Embedding near-duplicates against brute force."""

import math

import numpy as np
import pytest

from gridwright.llm import embedding_dedup as ed
from gridwright.llm import queries


def brute(rows, threshold=0.93):
    """rows: (id, vector, label); (links per row, least id reachable) in row order."""
    def ok(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    link = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            (_, a, la), (_, b, lb) = rows[i], rows[j]
            if la == lb and ok(a, la) and ok(b, lb) and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                link[i, j] = link[j, i] = a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold
    least = [r[0] for r in rows]
    for _ in range(n):
        new = [min([least[i], *(least[j] for j in np.flatnonzero(link[i]))]) for i in range(n)]
        if new == least:
            break
        least = new
    return link.sum(1).tolist(), least


def clouds(seed, groups, size, dim=16):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        centre = rng.normal(size=dim)
        for _ in range(rng.integers(1, size)):
            out.append(centre + rng.normal(size=dim) * rng.choice([0.05, 0.1, 0.25]))
    order = rng.permutation(len(out))
    return [(int(i), [float(x) for x in np.float32(out[k])], int(k % 2)) for i, k in enumerate(order)]


@pytest.mark.parametrize("block", [512, 7])
def test_clouds_against_brute_force(spark, frame, monkeypatch, block):
    monkeypatch.setattr(ed, "BLOCK", block)
    rows = clouds(1, 30, 20)
    held_rows, held = ed.classes(frame(rows, "vec_id long, embedding array<float>, label int"))
    pivots = ed.choose_pivots(held, held.count())
    found = ed.verified(ed.postings(held, pivots), len(pivots[16]), block=block).groupBy("cid").sum("links").collect()
    links, _ = brute(rows)
    assert sum(r["sum(links)"] for r in found) >= 0.97 * sum(links)  # recall of links, none invented below
    by_id = dict(zip([r[0] for r in rows], links))
    assert all(r["sum(links)"] <= by_id[int(r["cid"].split(":")[0])] for r in found)


def test_query_of_op6_reaches_recall(spark, tmp_path):
    # planted neighbours in the given table's shape: the table itself has no links at this size
    rng = np.random.default_rng(4)
    base = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    rows = [(r.vec_id, list(r.embedding), r.label) for r in base]
    for k, r in enumerate(base[:150]):
        v = np.array(r.embedding) / np.linalg.norm(r.embedding)
        rows.append((10_000 + k, [float(x) for x in np.float32(v + rng.normal(size=64) * 0.045)], r.label))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in queries.QUERIES["op6_pivot_permutation"](spark, str(tmp_path)).collect()}
    links, least = brute(rows)
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(links) > 100
    assert all(got[i].n_links <= n for (i, _, _), n in zip(rows, links))
    assert sum(got[i].component_id == c for (i, _, _), c in zip(rows, least)) >= 0.98 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("spread", [0.02, 0.035, 0.045])
def test_recall_of_a_group_of_a_third(frame, spread):
    # 600 of 1,800 rows in one group, hundreds of pivots drawn
    rng = np.random.default_rng(8)
    centre = rng.normal(size=64)
    centre /= np.linalg.norm(centre)
    m = np.vstack([centre + rng.normal(size=(600, 64)) * spread, rng.normal(size=(1200, 64))])
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    links = int((unit @ unit.T >= 0.93).sum()) - len(m)
    _, held = ed.classes(frame([(i, v.tolist(), 1) for i, v in enumerate(m)], "vec_id long, embedding array<double>, label int"))
    pivots = ed.choose_pivots(held, 250 * 250)
    assert len(pivots[64]) > 300
    found = ed.verified(ed.postings(held, pivots), len(pivots[64])).agg({"links": "sum"}).first()[0]
    assert 0.98 * links <= found <= links and links > 500


def test_pivots_are_chosen_without_a_window(frame, monkeypatch):
    ranked = []
    monkeypatch.setattr(ed.F, "row_number", lambda: ranked.append(1) or ed.F.lit(1), raising=True)
    rng = np.random.default_rng(3)
    _, held = ed.classes(frame([(i, rng.normal(size=3 + i % 2 * 61).tolist(), 1) for i in range(60)], "vec_id long, embedding array<double>, label int"))
    wanted = {3: set(), 64: set()}
    for dim, rows in wanted.items():
        first = sorted(held.filter(f"dim = {dim}").selectExpr("xxhash64(vector) AS h", "cid", "vector").collect())[:6]
        rows |= {tuple(v) for v in ed.thinned(ed._unit(np.array([r.vector for r in first])), 0.93)}
    assert {d: {tuple(v) for v in p} for d, p in ed.choose_pivots(held, 9).items()} == wanted and not ranked


def test_one_pivot_left(frame):
    rows = [(i, [1.0, i / 1000], 1) for i in range(20)]
    assert {r.n_links for r in ed.near_duplicates(frame(rows, "vec_id long, embedding array<double>, label int")).collect()} == {19}


def test_odd_rows(frame):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, nan], 1), (7, [inf, 1.0], 1),
            (8, [1.0, None], 1), (9, [1.0, 0.0], None), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [1e-30, 0.0], 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in
                 ed.near_duplicates(frame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, cid int")).collect())
    links, least = brute(rows)
    assert got == sorted((r[0], n, c, r[0] == c) for r, n, c in zip(rows, links, least))
    assert ed.near_duplicates(frame([], "vec_id long, embedding array<float>, label int")).count() == 0
