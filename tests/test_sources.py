import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwright.operators import contracts
from gridwright.operators.labels import resolve_vertices, triangle_geometry, valid_triangles
from gridwright.sources import meshes, tables

OBJ = """# comment
o House One
v 0 0 0
v 4 0 0
v 4 3 0
v 0 3 0
usemtl glass
f 1/1 2/2 3/3 4/4
g annex
v 0 0 5
v 4 0 5
v 4 3 5
usemtl brick
f -3 -2 -1
f 1 1 2
"""


def test_obj_state_is_carried_across_splits(spark, tmp_path):
    path = tmp_path / "m.obj"
    path.write_text(OBJ)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40")  # several splits for one small file
    try:
        v, f = meshes.read_obj(spark, str(path), 0.5)
        v, f = v.orderBy("vid").collect(), f.orderBy("fid").collect()
        assert meshes.scan_vertices(spark, str(path)).count() == 7
        assert meshes.scan_face_tokens(spark, str(path)).agg(F.sum(F.greatest(F.lit(0), F.col("tokens") - 3))).first()[0] == 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.vid for r in v] == list(range(7)) and v[2].x == 2.0
    assert [(r.fid, r.object, r.material, list(r.v)) for r in f] == [
        (0, "House One", "glass", [0, 1, 2]), (1, "House One", "glass", [0, 2, 3]), (2, "annex", "brick", [4, 5, 6]), (3, "annex", "brick", [0, 0, 1])]


def test_mesh_round_trip_and_degenerate_faces(spark, tmp_path):
    path = tmp_path / "m.obj"
    path.write_text(OBJ)
    v, f = meshes.read_obj(spark, str(path))
    geo = triangle_geometry(resolve_vertices(f, v))
    assert valid_triangles(geo).count() == 3 and abs(geo.agg(F.sum("area")).first()[0] - 18.0) < 1e-9
    out = str(tmp_path / "out")
    meshes.write_mesh_lines(meshes.mesh_lines(v, f), out)
    v2, f2 = meshes.read_obj(spark, out, as_one=True)
    text = [r.value for r in spark.read.text(out).collect()]
    assert sum(t.startswith("o ") for t in text) == 2 and sum(t.startswith("usemtl ") for t in text) == 2
    assert v2.count() == 7 and f2.count() == 4


def test_bad_vertex_line_raises(spark, tmp_path):
    (tmp_path / "b.obj").write_text("v 1 2\n")
    with pytest.raises(Exception):
        meshes.scan_vertices(spark, str(tmp_path / "b.obj")).collect()


def test_ply(spark, tmp_path):
    (tmp_path / "m.ply").write_text("ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nelement face 1\nend_header\n"
                                    "0 0 0\n1 0 0\n1 1 0\n0 1 0\n4 0 1 2 3\n")
    v, f = meshes.read_ply(spark, str(tmp_path / "m.ply"))
    assert v.count() == 4 and [list(r.v) for r in f.orderBy("fid").collect()] == [[0, 1, 2], [0, 2, 3]]


def test_voxel_records(spark, tmp_path):
    a = np.array([(1, -2, 3, 8, 255, 10), (4, 5, 6, 7, 1, 65535)], dtype=meshes.VOXEL_RECORD)
    a.tofile(tmp_path / "v.bin")
    assert sorted(tuple(r) for r in meshes.read_voxels(spark, str(tmp_path / "v.bin")).collect()) == [tuple(int(x) for x in r) for r in a.tolist()]


def test_points_csv_contract(spark, tmp_path):
    s = tables.synthetic_points(spark, 84, 60)
    assert s.filter("role='train'").count() == 60 and s.filter("observed_dbm is null").count() == 24
    out = str(tmp_path / "p")
    cols = [f.name for f in tables.POINT_SCHEMA.fields]
    tables.write_result(s.select(cols), out + ".parquet")
    assert tables.read_points(spark, out + ".parquet").count() == 84
    with pytest.raises(Exception):
        tables.write_result(s.select(cols), out + ".parquet")  # target exists
    s.select([c if c != "observed_dbm" else F.col("truth_dbm").alias("observed_dbm") for c in cols]).write.option("header", True).csv(out)
    with pytest.raises(contracts.ContractError):
        tables.read_points(spark, out)  # query labels present


def test_annotations_configs_manifest(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"face_labels": {"0": "wall", "3": {"category": "roof", "confidence": 0.5}}}))
    rows = tables.read_annotations(spark, str(tmp_path / "a.json"), 4).orderBy("face_id").collect()
    assert [tuple(r) for r in rows] == [(0, "wall", 1.0), (3, "roof", 0.5)]
    with pytest.raises(Exception):
        tables.read_annotations(spark, str(tmp_path / "a.json"), 2).collect()
    cat = tables.config_catalog(spark)
    assert cat.count() == 13 and cat.filter("family='S4W'").count() == 9
    (tmp_path / "c.json").write_text(json.dumps([{"id": "AUTO_BASE", "family": "BASE", "groups": {}}, {"id": "a", "family": "S4W", "groups": {"facade": {"eps": 3.0, "sigma": 0.1}, "glass": "glass"}}], indent=1))
    g = {r.config_id: r.groups for r in tables.read_configs(spark, str(tmp_path / "c.json")).collect()}
    assert g["a"]["facade"].eps == 3.0 and g["a"]["glass"].label == "glass"
    m = tables.manifest(spark, "s", "1", {"b": "2", "a": "1"}, {}, "scene.v1")
    tables.write_manifest(m, str(tmp_path / "man"))
    assert list(json.loads(next((tmp_path / "man").glob("*.json")).read_text())["inputs"]) == ["a", "b"]


def test_image_tiles(spark, tmp_path):
    # an uncompressed 2x2 bitmap, bottom row first, BGR
    px = bytes([1, 2, 3, 4, 5, 6, 0, 0, 7, 8, 9, 10, 11, 12, 0, 0])
    head = b"BM" + (54 + 16).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little")
    head += (2).to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    (tmp_path / "t_10_20.bmp").write_bytes(head + px)
    rows = {(r.row, r.col): (r.r, r.g, r.b) for r in tables.plan_pixels(spark, str(tmp_path)).collect()}
    assert rows == {(10, 20): (9, 8, 7), (10, 21): (12, 11, 10), (11, 20): (3, 2, 1), (11, 21): (6, 5, 4)}
