"""Two-stage registration: the branch and bound search against scoring every candidate."""

import numpy as np
import pytest

from gridwright.operators import raster

ROWS, COLS = 60, 70


def plain_score(x, y, rot, s, dc, dr, dist):
    a = np.radians(rot)
    c = np.rint((COLS - 1) / 2 + s * (np.cos(a) * x - np.sin(a) * y) + dc).astype(int)
    r = np.rint((ROWS - 1) / 2 - s * (np.sin(a) * x + np.cos(a) * y) + dr).astype(int)
    inside = (c >= 0) & (c < COLS) & (r >= 0) & (r < ROWS)
    if inside.mean() < 0.85:
        return 1e6
    v = dist[r[inside], c[inside]]
    return np.median(v) + 0.35 * np.percentile(v, 80) + 20 * (1 - inside.mean())


def plain_stage(x, y, dist, centre, axes):
    out, at = [], 0
    for rot in axes[0]:
        for s in axes[1]:
            for dc in axes[2]:
                for dr in axes[2]:
                    pose = (centre[0] + rot, centre[1] + s, centre[2] + dc, centre[3] + dr)
                    out.append((plain_score(x, y, *pose, dist), at, pose))
                    at += 1
    return min(out)


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(4)
    edges = np.zeros((ROWS, COLS), bool)
    edges[12, 15:45] = edges[40, 15:45] = edges[12:41, 15] = edges[12:41, 44] = True
    er, ec = np.nonzero(edges)
    rr, cc = np.mgrid[:ROWS, :COLS]
    dist = np.sqrt(((rr[..., None] - er) ** 2 + (cc[..., None] - ec) ** 2).min(-1).astype(float))
    table = spark.createDataFrame([(r, c, float(dist[r, c])) for r in range(ROWS) for c in range(COLS)], "row long, col long, distance double")
    plans = {}
    for name, (rot, s, dc, dr) in {"a": (2.0, 1.0, -6.0, -4.0), "b": (-2.0, 1.05, 10.0, 10.0)}.items():
        pick = rng.integers(0, len(er), 150)
        u, v = ec[pick] - (COLS - 1) / 2 - dc, (ROWS - 1) / 2 + dr - er[pick]
        a = np.radians(rot)
        plans[name] = ((np.cos(a) * u + np.sin(a) * v) / s, (-np.sin(a) * u + np.cos(a) * v) / s)
    rows = [(k, float(x), float(y)) for k, p in plans.items() for x, y in zip(*p)]
    return dist, table, plans, spark.createDataFrame(rows, "band string, x double, y double")


COARSE = ([-4.0, -2.0, 0.0, 2.0, 4.0], [0.95, 1.0, 1.05], [-20, -10, 0, 10, 20, 30])
FINE = ([-0.5, 0.0, 0.5], [-0.01, 0.0, 0.01], [-8, -6, -4, -2, 0, 2, 4, 6, 8])


def test_both_stages_find_the_first_minimum(spark, scene):
    dist, table, plans, samples = scene
    found = {r.band: r for r in raster.register_plans(samples, table, ROWS, COLS, 1.0, ["band"], COARSE, FINE).collect()}
    for k, (x, y) in plans.items():
        one = plain_stage(x, y, dist, (0.0, 0.0, 0.0, 0.0), COARSE)
        two = plain_stage(x, y, dist, one[2], FINE)
        score, at, pose = two if two[0] < one[0] else one
        r = found[k]
        assert (r.candidate, r.stage) == (at, 2 if two[0] < one[0] else 1) and abs(r.score - score) < 1e-9
        assert np.allclose((r.rotation, r.scale, r.dcol, r.drow), pose) and score < 2.0


def test_few_candidates_are_scored(spark, scene):
    _, table, _, samples = scene
    centre = spark.createDataFrame([(k, 0.0, 0.0, 0.0, 0.0) for k in "ab"], "band string, rotation double, scale double, dcol double, drow double")
    _, count = raster.search_stage(samples, table, ROWS, COLS, centre, (COARSE[0], COARSE[1], raster.COARSE[2]), ["band"])
    for r in count.collect():
        assert r.candidates == 5 * 3 * 289 and r.scored < r.candidates / 2


def test_nothing_to_place_and_odd_shifts(spark, scene):
    _, table, _, samples = scene
    assert raster.register_plans(samples.filter("false"), table, ROWS, COLS, 1.0, ["band"], COARSE, FINE).count() == 0
    with pytest.raises(ValueError, match="even"):
        raster.register_plans(samples, table, ROWS, COLS, 1.0, ["band"], (COARSE[0], COARSE[1], [0, 5]), FINE)
