"""Views over the driver's tables that stand for measured points, gains, meshes and labels.

Integer arithmetic only, so that Spark and the SQL oracle agree bit for bit.  Every view is a
projection of whole tables; nothing is sampled.  The SQL text of the same views is in ``queries.views``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.session import spread

# Fixed transmitter positions of the two bands.
TX = {"n41": (134.0, 45.0, 37.0), "n79": (137.0, 188.0, 17.0)}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "events")
        .selectExpr(
            "event_id as point_id", "user_id", "value", "ts",
            "(user_id*37)%1000 + (event_id*17)%97 as ix",
            "(user_id*61)%800 + (event_id*29)%89 as iy",
        )
        .selectExpr(
            "point_id",
            "cast(ix as double) as x", "cast(iy as double) as y", "1.5D as z",
            "case when point_id%2=0 then 'n41' else 'n79' end as band",
            "case when (ix*31+iy*17)%5=0 then 'query' else 'train' end as role",
            "user_id%50 as trajectory_group",
            "lpad(cast(month(ts)*100+day(ts) as string),4,'0') as date",
            "-60D - value/10D as observed_dbm",
            "point_id%3=0 as los",
        )
    )


def split_points(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(train, query) of :func:`points`, labels kept on the query side for scoring only."""
    p = points(spark, sf)
    return p.filter("role = 'train'"), p.filter("role = 'query'")


def configs(spark: SparkSession) -> DataFrame:
    return spark.range(13).selectExpr(
        "cast(id as int) as config_ord",
        "case when id=0 then 'AUTO_BASE' when id<10 then concat('S4W_', lpad(cast(id as string),2,'0')) "
        "else concat('S5_', lpad(cast(id as string),2,'0')) end as config_id",
        "case when id=0 then 'BASE' when id<10 then 'S4W' else 'S5' end as family",
    )


def tx_distance() -> F.Column:
    def norm(t):
        return F.sqrt(
            (F.col("x") - t[0]) * (F.col("x") - t[0])
            + (F.col("y") - t[1]) * (F.col("y") - t[1])
            + (F.col("z") - t[2]) * (F.col("z") - t[2])
        )
    return F.when(F.col("band") == "n41", norm(TX["n41"])).otherwise(norm(TX["n79"]))


def gains(spark: SparkSession, sf: str) -> DataFrame:
    """Long table (point_id, band, config_id, family, gain_db NULL = no path, los); 13 rows a point."""
    p = points(spark, sf).withColumn("d3", tx_distance())
    wide = p.withColumn("config_ord", F.explode(F.sequence(F.lit(0), F.lit(12))))
    wide = wide.join(F.broadcast(configs(spark)), "config_ord")  # 13 fixed rows
    gain = F.expr(
        "case when point_id%11=0 then null else -30D - 20D*log10(greatest(d3,1D)) "
        "- 0.5D*config_ord*(case when los then 0 else 1 end) "
        "+ ((point_id*7+config_ord*13)%11-5)/2D end"
    )
    return wide.select("point_id", "band", "config_ord", "config_id", "family", gain.alias("gain_db"), "los")


def base_gain(spark: SparkSession, sf: str) -> DataFrame:
    """points with the neutral configuration's gain as ``raw``."""
    return points(spark, sf).withColumn("d3", tx_distance()).withColumn(
        "raw",
        F.expr(
            "case when point_id%11=0 then null else -30D - 20D*log10(greatest(d3,1D)) "
            "+ ((point_id*7)%11-5)/2D end"
        ),
    )


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Long expert matrix: ten methods per point."""
    p = points(spark, sf).withColumn("method_ord", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return p.selectExpr(
        "point_id", "band", "date", "trajectory_group", "role", "x", "y",
        "method_ord", "concat('M', cast(method_ord as string)) as method", "observed_dbm",
        "observed_dbm + ((point_id*(2*method_ord+3))%21-10)/2D + 0.1D*method_ord as pred",
        "trajectory_group % 5 as outer_fold",
    )


def variants(spark: SparkSession, sf: str) -> DataFrame:
    """Four source variants of three methods per point (factorial input)."""
    b = base_gain(spark, sf).withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(2))))
    b = b.selectExpr(
        "point_id", "band", "date", "trajectory_group", "trajectory_group % 5 as outer_fold",
        "element_at(array('U2','WEDT_P','ONETWIN'), m+1) as method",
        "'AUTO_BASE' as config_id", "observed_dbm", "raw is not null as path_available",
        "raw + m as base", "coalesce(raw + m, -85D) as base_fill",
        "raw + m + ((point_id*5)%9-4)/2D as idw",
        "coalesce(raw + m + ((point_id*5)%9-4)/2D, -80D - point_id%7) as idw_fill",
    )
    return b.selectExpr(
        "point_id", "band", "date", "trajectory_group", "outer_fold", "method", "config_id",
        "observed_dbm", "path_available",
        "stack(4, 'BASE', base, 'BASE_MEAN_FILL', base_fill, 'IDW', idw, 'IDW_FILL', idw_fill) "
        "as (variant, predicted_dbm)",
    )


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Campaign metric table: one row per run key and method."""
    p = predictions(spark, sf).selectExpr(
        "*", "element_at(array('infill','spatial30','spatial60'), cast(point_id%3 as int)+1) as mode",
        "element_at(array(30,100,300,1000,2500), cast((point_id div 3)%5 as int)+1) as budget",
        "cast((point_id div 15)%4 as int) as repeat", "pred-observed_dbm as e",
    )
    return p.groupBy("band", "outer_fold", "mode", "budget", "repeat", "method").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs("e")).alias("mae_db"),
        F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rmse_db"),
        F.avg("e").alias("bias_db"),
    )


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "l_partkey%2000 + l_quantity/100D as x",
        "cast((l_suppkey%1000)*10 + l_linenumber as double) as y",
        "l_extendedprice/2000D as z",
    )


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr(
        "concat('face:', cast(event_id%2000 as string)) as entity_id", "'face' as level",
        "case event_type when 'view' then 'wall' when 'click' then 'roof' when 'purchase' then 'glass' "
        "when 'signup' then 'ground' else 'water' end as category",
        "element_at(array('photo','texture','annotation','geometry','existing_mesh_semantic'), "
        "cast(event_id%5 as int)+1) as source",
        "((event_id*31)%100)/100D as confidence", "((event_id*53)%100)/100D as reliability",
    )


def voxels(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "cast(l_partkey%40 as int) as ix", "cast(l_suppkey%40 as int) as iy",
        "cast(l_linenumber as int) as iz", "cast(l_quantity as int)%10 as label",
        "cast(l_orderkey%256 as int) as confidence", "cast(1+l_partkey%100 as int) as count",
    )


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey as sample_id", "o_custkey%300 as surface_id",
        "element_at(array('roof','facade','base'), cast((o_custkey%300)%3 as int)+1) as surface_type",
        "(o_orderkey*7)%60+0.5D as px", "(o_orderkey*11)%60+0.5D as py", "o_orderkey%9+0.5D as pz",
    )


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Unit boxes as (part_id, name, fid, vertex corner 0..7) triangles: twelve per part."""
    # The twelve triangles of a box over corners numbered x + 2y + 4z.
    faces = [
        (0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4),
        (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5),
    ]
    tri = F.array(*[F.struct(F.lit(i).alias("t"), F.array(*[F.lit(c) for c in f]).alias("c")) for i, f in enumerate(faces)])
    # corners are made before the explode: behind it they would be computed anew wherever a coordinate is used
    corner = lambda f, j: F.struct(
        (F.expr("2*(p_partkey%100)") + f["c"][j] % 2).cast("double").alias("x"),
        (F.expr("2*(p_partkey div 100)") + F.floor(f["c"][j] / 2) % 2).cast("double").alias("y"),
        (F.col("p_size").cast("double") * F.floor(f["c"][j] / 4)).cast("double").alias("z"),
    )
    made = F.transform(tri, lambda f: F.struct(f["t"].alias("t"), corner(f, 0).alias("a"), corner(f, 1).alias("b"), corner(f, 2).alias("c")))
    p = spread(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey").select(F.col("p_partkey").alias("part_id"), F.explode(made).alias("f"))
    p = p.filter(~((F.col("part_id") % 7 == 0) & (F.col("f.t") == 3)))
    names = "array('Glass-Facade','curtain wall','Roof Metal','road_01','grass','limestone','ground','misc')"
    return p.select(
        (F.col("part_id") * 12 + F.col("f.t")).alias("fid"), "part_id",
        F.expr(f"element_at({names}, cast(part_id%8 as int)+1)").alias("name"),
        "f.a", "f.b", "f.c",
    )


def paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr("l_partkey as receiver", "l_discount as re", "l_tax as im")


def embedding_xyz(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id", "label",
        *[f"cast(embedding[{i}] as double)*100D as {n}" for i, n in enumerate(("x", "y", "z"))],
    )
