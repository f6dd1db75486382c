"""Queries that write derived tables to a scratch folder beside the checkpoints and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridwright import fixtures as fx
from gridwright.functions.ranking import global_position
from gridwright.operators import labels, raster
from gridwright.queries.registry import query
from gridwright.session import ensure_checkpoint_dir, settle
from gridwright.sources import meshes, tables


def scratch(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


@query("read_points_s1_k1", "SELECT CAST(point_id AS VARCHAR) AS point_id, x, y, z, band, role, CASE WHEN role='train' THEN observed_dbm END AS observed_dbm FROM f_points")
def _(spark, sf):
    p = fx.points(spark, sf).withColumn("point_id", F.col("point_id").cast("string")).withColumn(
        "observed_dbm", F.when(F.col("role") == "train", F.col("observed_dbm")))
    path = scratch(spark)
    tables.write_result(p.select([f.name for f in tables.POINT_SCHEMA.fields]), path, fmt="csv")
    return tables.read_points(spark, path, check=False)


def written_mesh(spark, sf) -> str:
    f = settle(global_position(fx.boxes(spark, sf), [], [F.col("fid")], "_pos").withColumn("n", F.col("_pos") - 1))
    corner = lambda k, s: F.struct((F.col("n") * 3 + k).alias("vid"), *[F.col(f"{s}.{ax}").alias(ax) for ax in "xyz"])
    verts = f.select(F.explode(F.array(*[corner(k, s) for k, s in enumerate("abc")])).alias("_v")).select("_v.*")
    faces = f.select(F.col("n").alias("fid"), F.col("name").alias("object"), F.concat(F.lit("mat"), F.col("part_id") % 3).alias("material"),
                     F.array(*[F.col("n") * 3 + k for k in range(3)]).alias("v"))
    path = scratch(spark)
    meshes.write_mesh_lines(meshes.mesh_lines(verts, faces), path)
    return path


@query("scan_mesh_s4_k2", """SELECT CAST(3*count(*) AS BIGINT) AS vertex_count, min(least(ax,bx,cx)) AS min_x, max(greatest(ax,bx,cx)) AS max_x, min(least(ay,"by",cy)) AS min_y, max(greatest(ay,"by",cy)) AS max_y,
 min(least(az,bz,cz)) AS min_z, max(greatest(az,bz,cz)) AS max_z, count(*) AS triangle_count FROM f_boxes""")
def _(spark, sf):
    path = written_mesh(spark, sf)
    return raster.mesh_stats(meshes.scan_vertices(spark, path), meshes.scan_face_tokens(spark, path))


@query("read_obj_s5_w7", """SELECT row_number() OVER (ORDER BY fid)-1 AS fid, name AS object, 'mat'||part_id%3 AS material, ax, ay, az, bx, "by" AS b_y, bz, cx, cy, cz FROM f_boxes""")
def _(spark, sf):
    v, f = meshes.read_obj(spark, written_mesh(spark, sf), as_one=True)
    r = labels.resolve_vertices(f.select("fid", "object", "material", "v"), v)
    return r.select("fid", "object", "material", *[F.col(f"{s}.{ax}").alias("b_y" if s + ax == "by" else f"{s}{ax}") for s in "abc" for ax in "xyz"])


@query("read_voxels_s6", "SELECT ix, iy, iz, label, confidence, count FROM f_voxels")
def _(spark, sf):
    def little(c, size):
        h = F.lpad(F.hex(F.col(c)), 2 * size, "0")
        return F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(size))])
    record = F.unhex(F.concat(little("ix", 4), little("iy", 4), little("iz", 4), little("label", 1), little("confidence", 1), little("count", 2)))
    return meshes.unpack_voxels(fx.voxels(spark, sf).select(record.alias("record")))


@query("write_manifest_k3", """SELECT 'scene.v1' AS schema, CAST(count(*) AS VARCHAR) AS scene_id, '1' AS version, 'events' AS first_input, 'faces' AS first_output FROM events""")
def _(spark, sf):
    path = scratch(spark)
    n = fx.table(spark, sf, "events").count()
    tables.write_manifest(tables.manifest(spark, str(n), "1", {"points": "p", "events": "e"}, {"parts": "x", "faces": "y"}, "scene.v1"), path)
    m = spark.read.schema("schema string, scene_id string, version string, inputs map<string,string>, outputs map<string,string>").json(path)
    return m.select("schema", "scene_id", "version", F.map_keys("inputs")[0].alias("first_input"), F.map_keys("outputs")[0].alias("first_output"))
