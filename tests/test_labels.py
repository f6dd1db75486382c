from pyspark.sql import functions as F

from gridwright.operators import labels


def test_vertices_are_resolved_without_a_broadcast(spark):
    faces = spark.range(50).selectExpr("id as fid", "array(id, id + 1, id + 3) as v", "concat('n', id) as name")
    vertices = spark.range(60).selectExpr("id as vid", "id * 1D as x", "id * 2D as y", "id * 3D as z")
    found = labels.resolve_vertices(faces, vertices)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().sparkPlan().toString()
    rows = found.select("fid", "name", "a.x", F.col("b.y"), F.col("c.z")).collect()
    assert {tuple(r) for r in rows} == {(i, f"n{i}", i, 2.0 * (i + 1), 3.0 * (i + 3)) for i in range(50)}


def test_a_name_is_spelled_plainly_once_a_face(spark):
    faces = spark.createDataFrame([(1, "Glass Facade"), (2, "curtain-wall"), (3, "misc"), (4, None)], "fid long, name string").selectExpr(
        "*", "1D as nz", "0D as gz", "0D as z_lo", "1D as z_hi")
    for made in (labels.geometry_evidence(faces, F.col("name")), labels.label_ground(faces, labels.category_from_name(F.col("name")), threshold=-1.0)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("lower(name") == 1
    found = labels.geometry_evidence(faces, F.col("name")).filter("source = 'existing_mesh_semantic'")
    assert {r.entity_id for r in found.collect()} == {"face:1", "face:2"}


def test_ring_vertices_are_exchanged_once(spark, monkeypatch):
    monkeypatch.setattr(labels, "RING_RUN", 4, raising=False)
    sizes = {0: 1, 1: 4, 2: 7, 3: 8, None: 3}
    rows = [(ring, i, 10.0 * (ring or 0) + i, None if i == 5 else float(i * i)) for ring, n in sizes.items() for i in range(n)]
    rings = spark.createDataFrame(rows, "ring_id bigint, seq bigint, x double, y double")
    edges = labels.ring_edges(rings)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    at = {(r, s): (x, y) for r, s, x, y in rows}
    want = {(r, s, x, y, *at[r, (s + 1) % sizes[r]]) for r, s, x, y in rows if r is not None}
    assert edges.columns == ["ring_id", "seq", "x", "y", "x2", "y2"]
    assert {tuple(r) for r in edges.collect()} == want and edges.count() == len(want)
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_positions_do_not_deal_the_rows_again(spark):
    from gridwright.functions.ranking import global_position
    rows = spark.range(5000).selectExpr("id % 7 as g", "(id * 37) % 5003 as v", "id as unused")
    placed = global_position(rows, ["g"], [F.col("v")], "pos", ["v"])
    assert placed.columns == ["g", "v", "pos"]
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    for _, part in placed.toPandas().groupby("g"):
        part = part.sort_values("v")
        assert list(part.pos) == list(range(1, len(part) + 1))
