from pyspark.sql import functions as F

from gridwright import fixtures as fx
from gridwright.operators import labels
from gridwright.queries import load


def test_boxes_are_spread_over_tasks_and_made_once(spark, tmp_path):
    spark.range(1, 401).selectExpr("id as p_partkey", "cast(id % 50 + 1 as int) as p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    boxes = fx.boxes(spark, str(tmp_path))
    # one file is not one task: all that is made of a part before the next exchange would be done there
    assert boxes.select(F.spark_partition_id()).distinct().count() == 8
    plan = boxes._jdf.queryExecution().optimizedPlan().toString()
    assert "p_size" not in plan.split("Generate explode")[0]  # no coordinate is computed behind the explode
    assert boxes.count() == 400 * 12 - 400 // 7
    edges = labels.edge_audit(boxes)
    assert {tuple(r) for r in edges.select("edges", "non_manifold_edges").distinct().collect()} == {(18, 0), (18, 3)}


def test_edge_corners_round_half_to_even(spark):
    corner = lambda x: F.struct(F.lit(x).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    faces = spark.range(1).select(F.lit(1).alias("part_id"), corner(0.5e-6).alias("a"), corner(1.5e-6).alias("b"), corner(-2.5e-6).alias("c"))
    found = {e for r in labels.mesh_edges(faces).collect() for e in (r.edge_a.x, r.edge_b.x)}
    assert found == {0, 2, -2}


def test_confidence_model_is_fitted_for_every_method(spark, tmp_path):
    events = spark.range(1, 2001).selectExpr("id as event_id", "id % 97 as user_id", "cast(id % 83 as double) as value", "timestamp '2024-01-01' as ts", "'view' as event_type")
    events.write.parquet(f"{tmp_path}/events.parquet")
    model = load()["confidence_model_a31"](spark, str(tmp_path)).toPandas()
    assert set(zip(model.band, model.method)) == {(b, f"M{i}") for b in ("n41", "n79") for i in range(10)}
    assert (model[[f"k{i}" for i in range(4)]] >= 0).all(axis=None)
