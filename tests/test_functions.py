import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridwright.functions import columns, quantiles
from gridwright.functions.ranking import global_position


@pytest.mark.parametrize("accuracy,margin,buckets", [(10_000, 8.0, 1024), (50, 1.0, 4), (5, 0.0, 2)])
def test_quantiles_equal_numpy(spark, monkeypatch, accuracy, margin, buckets):
    # the last two miss brackets and leave many values in a bucket
    monkeypatch.setattr(quantiles, "SKETCH_ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "BRACKET_MARGIN", margin)
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    rng = np.random.default_rng(5)
    p = pd.DataFrame({"g": rng.choice(["a", "b", "hot"], 3000, p=[0.1, 0.2, 0.7]), "v": rng.normal(0, 1, 3000).round(2)})
    p.loc[p.index[:900], "v"] = 0.25  # many ties
    probs = [0.0, 0.2, 0.5, 0.9, 1.0]
    got = quantiles.exact_quantiles(spark.createDataFrame(p), ["g"], "v", probs, list("mnopq")).toPandas().set_index("g")
    for g, part in p.groupby("g"):
        assert np.allclose(got.loc[g, list("mnopq")].astype(float), np.quantile(part.v, probs))


def test_quantiles_with_infinite_values(spark):
    v = [float("-inf"), 1.0, 2.0, 3.0, float("inf")]
    row = quantiles.exact_quantiles(spark.createDataFrame([(x,) for x in v], "v double"), [], "v", [0.25, 0.5, 0.75], list("abc"), lower=True).first()
    assert (row.a, row.b, row.c) == (1.0, 2.0, 3.0)


def test_global_position_is_row_number(spark):
    rng = np.random.default_rng(6)
    p = pd.DataFrame({"g": rng.choice(["a", "b", "hot"], 2000, p=[0.1, 0.2, 0.7]), "v": rng.integers(0, 20, 2000), "id": range(2000)})
    got = global_position(spark.createDataFrame(p), ["g"], [F.desc("v"), F.col("id")], "n").toPandas()
    p = p.sort_values(["g", "v", "id"], ascending=[True, False, True])
    p["n"] = p.groupby("g").cumcount() + 1
    assert got.sort_values("id")["n"].tolist() == p.sort_values("id")["n"].tolist()


def test_bad_values_raise(spark):
    df = spark.createDataFrame([("maybe", "ft", 3.0, 1.0)], "b string, u string, lo double, hi double")
    for c in (columns.normalize_bool(F.col("b")), columns.unit_scale(F.col("u")), columns.bounded_pair(F.col("lo"), F.col("hi"))):
        with pytest.raises(Exception):
            df.select(c).collect()


def test_attach_never_broadcasts_the_rows(spark):
    from gridwright.functions.quantiles import attach
    from gridwright.session import settle
    # many rows of few values: a file far smaller than its rows
    rows = settle(spark.range(400_000).selectExpr("if(id % 3 = 0, null, id % 2) as k", "cast(id % 11 = 0 as double) as v"))
    joined = attach(rows, rows.groupBy("k").agg(F.collect_set("v").alias("seen"), *[f("v").alias(f.__name__) for f in (F.min, F.max, F.count)]), ["k"])
    assert joined.count() == 400_000 and joined.columns == ["k", "v", "seen", "min", "max", "count"]
    plan = joined._jdf.queryExecution().sparkPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan


def test_attach_of_many_groups_is_a_shuffle(spark, monkeypatch):
    from gridwright.functions import quantiles
    monkeypatch.setattr(quantiles, "BROADCAST_ROWS", 3)
    rows = spark.range(100).selectExpr("if(id % 5 = 0, null, id % 5) as k", "id")
    joined = quantiles.attach(rows, rows.groupBy("k").agg(F.max("id").alias("top")), ["k"])
    assert {(r.k, r.id, r.top) for r in joined.collect()} == {(i % 5 or None, i, 95 + i % 5) for i in range(100)}
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().sparkPlan().toString()


def test_settle_keeps_generated_methods_compiled(spark):
    from gridwright.session import HUGE_METHOD_KEY, settle
    spark.conf.unset(HUGE_METHOD_KEY)
    settle(spark.range(3))
    assert int(spark.conf.get(HUGE_METHOD_KEY)) <= 8000
