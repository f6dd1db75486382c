"""Mesh and voxel files: distributed text scans with carried-forward state, packed records, line writers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

FILE, BLOCK, SLOT = "_file", "_block", "_slot"


def read_lines(spark: SparkSession, path: str, as_one: bool = False) -> DataFrame:
    """Text lines with their file, split offset, and order inside the split.

    ``as_one`` reads the part files of a folder, in name order, as a single file.

    A split is read front to back by one task, so (file, offset, slot) is the file order whatever task
    reads it, and a split is at most ``spark.sql.files.maxPartitionBytes`` long.
    """
    name, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    file, block = (F.lit(""), F.struct(name.alias("f"), start.alias("s"))) if as_one else (name, start)
    return spark.read.text(path).select("value", file.alias(FILE), block.alias(BLOCK), F.monotonically_increasing_id().alias(SLOT))


def fill_forward(lines: DataFrame, last: dict[str, Column], count: dict[str, Column]) -> DataFrame:
    """Add, per line, the latest non-NULL value of each ``last`` expression and the running sum of each
    ``count`` expression up to and including it, in file order.

    Two passes: inside a split by a window, across splits by the splits' own totals.
    """
    t = lines.withColumns({f"_l_{n}": e for n, e in last.items()} | {f"_c_{n}": e.cast("bigint") for n, e in count.items()})
    tails = t.groupBy(FILE, BLOCK).agg(
        *[F.max_by(F.col(f"_l_{n}"), F.when(F.col(f"_l_{n}").isNotNull(), F.col(SLOT))).alias(f"_l_{n}") for n in last],
        *[F.sum(f"_c_{n}").alias(f"_c_{n}") for n in count])
    before = W.partitionBy(FILE).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)  # one row per split
    carried = tails.select(
        F.col(FILE).alias("_f"), F.col(BLOCK).alias("_b"),
        *[F.last(f"_l_{n}", ignorenulls=True).over(before).alias(f"_pl_{n}") for n in last],
        *[F.coalesce(F.sum(f"_c_{n}").over(before), F.lit(0)).alias(f"_pc_{n}") for n in count])
    inside = W.partitionBy(FILE, BLOCK).orderBy(SLOT).rowsBetween(W.unboundedPreceding, 0)  # one split
    t = t.withColumns(
        {f"_l_{n}": F.last(f"_l_{n}", ignorenulls=True).over(inside) for n in last}
        | {f"_c_{n}": F.sum(f"_c_{n}").over(inside) for n in count})
    t = t.join(carried, (F.col(FILE) == F.col("_f")) & (F.col(BLOCK) == F.col("_b"))).drop("_f", "_b")
    t = t.withColumns({n: F.coalesce(f"_l_{n}", f"_pl_{n}") for n in last} | {n: F.col(f"_c_{n}") + F.col(f"_pc_{n}") for n in count})
    return t.drop(*[f"{p}_{n}" for n in last for p in ("_l", "_pl")], *[f"{p}_{n}" for n in count for p in ("_c", "_pc")])


def _tokens(value: Column) -> Column:
    return F.filter(F.split(F.trim(value), r"\s+"), lambda t: t != "")


def scan_vertices(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z of every vertex line; a vertex line with fewer than four fields is an error."""
    raw = spark.read.text(path).filter(F.col("value").rlike(r"^v[ \t]"))
    t = raw.withColumn("_t", F.split(F.trim("value"), r"\s+"))
    bad = F.raise_error(F.concat(F.lit("invalid vertex line: "), "value")).cast("double")
    return t.select(*[F.coalesce(F.when(F.size("_t") >= 4, F.col("_t")[i].try_cast("double")), bad).alias(c) for i, c in ((1, "x"), (2, "y"), (3, "z"))])


def scan_face_tokens(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path).filter(F.col("value").rlike(r"^f[ \t]"))
    return raw.select(F.size(F.split(F.trim("value"), r"\s+")).alias("tokens"))


def read_obj(spark: SparkSession, path: str, scale: float = 1.0, as_one: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices: vid from 0, x, y, z), (faces: fid, object, material, v ARRAY of 3, line corners).

    Objects and materials carry forward along the file; negative indices count back from the vertices
    read so far; polygons become fans.
    """
    lines = read_lines(spark, path, as_one).withColumn("_t", _tokens(F.col("value"))).filter(F.size("_t") > 0)
    word = F.lower(F.col("_t")[0])
    n = F.size("_t")
    vertex, face = (word == "v") & (n >= 4), (word == "f") & (n >= 4)
    name = F.array_join(F.slice("_t", 2, F.greatest(n - 1, F.lit(0))), " ")
    lines = fill_forward(
        lines, {"object": F.when(word.isin("o", "g") & (n >= 2), name), "material": F.when((word == "usemtl") & (n >= 2), name)},
        {"seen": vertex, "line_faces": F.when(face, n - 3).otherwise(0)})
    finite = lambda c: F.when(F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)), c * scale).otherwise(
        F.raise_error(F.concat(F.lit("non-finite vertex: "), "value")).cast("double"))
    vertices = lines.filter(vertex).select(
        (F.col("seen") - 1).alias("vid"), *[finite(F.col("_t")[i].try_cast("double")).alias(c) for i, c in ((1, "x"), (2, "y"), (3, "z"))])
    index = lambda tok: F.split(tok, "/")[0].try_cast("bigint")
    resolve = lambda tok: F.when(index(tok) < 0, F.col("seen") + index(tok)).otherwise(index(tok) - 1)
    poly = F.transform(F.slice("_t", 2, n - 1), resolve)
    f = lines.filter(face).withColumn("_p", poly)
    out_of_range = F.exists("_p", lambda i: i.isNull() | (i < 0) | (i >= F.col("seen")))
    f = f.withColumn("_p", F.when(out_of_range, F.raise_error(F.concat(F.lit("face index out of range: "), "value")).cast("array<bigint>")).otherwise(F.col("_p")))
    fan = F.transform(F.sequence(F.lit(1), F.size("_p") - 2), lambda i: F.array(
        F.col("_p")[0], F.element_at("_p", (i + 1).cast("int")), F.element_at("_p", (i + 2).cast("int"))))
    faces = f.select((F.col("line_faces") - (F.size("_p") - 2)).alias("_first"), F.coalesce("object", F.lit("scene")).alias("object"),
                     F.coalesce("material", F.lit("unassigned")).alias("material"), F.size("_p").alias("corners"), F.posexplode(fan).alias("_k", "v"))
    return vertices, faces.select((F.col("_first") + F.col("_k")).alias("fid"), "object", "material", "v", "corners")


def read_ply(spark: SparkSession, path: str, scale: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """ASCII PLY: the same two tables; the header's counts place vertex and face lines."""
    lines = fill_forward(read_lines(spark, path), {}, {"line_no": F.lit(1)})
    head_end = lines.filter(F.trim("value") == "end_header").agg(F.min("line_no").alias("_h"))
    meta = lines.filter(F.trim("value").rlike("^(ply|format |element (vertex|face) )")).crossJoin(F.broadcast(head_end)).filter("line_no < _h")  # one row
    number = lambda what: F.max(F.when(F.trim("value").startswith(f"element {what} "), F.split(F.trim("value"), r"\s+")[2].cast("bigint")))
    h = meta.agg(F.max("_h").alias("_h"), number("vertex").alias("_nv"), number("face").alias("_nf"),
                 F.max(F.when(F.trim("value").startswith("format "), F.split(F.trim("value"), r"\s+")[1])).alias("fmt")).first()
    if h is None or h["_h"] is None or h["_nv"] is None or h["_nf"] is None:
        raise ValueError("PLY header must end and declare vertex and face counts")
    if h["fmt"] != "ascii":
        raise ValueError("only ASCII PLY is supported")
    start, nv, nf = h["_h"], h["_nv"], h["_nf"]
    body = lines.filter(F.col("line_no") > start).withColumn("_i", F.col("line_no") - start - 1).withColumn("_t", _tokens(F.col("value")))
    bad = lambda kind: F.raise_error(F.concat(F.lit("invalid PLY line: "), "value")).cast(kind)
    vertices = body.filter(F.col("_i") < nv).select(F.col("_i").alias("vid"), *[
        F.coalesce(F.when(F.size("_t") >= 3, F.col("_t")[i].try_cast("double") * scale), bad("double")).alias(c) for i, c in enumerate("xyz")])
    # the region test is repeated at the error, because a later filter may be pushed below it
    region = (F.col("_i") >= nv) & (F.col("_i") < nv + nf)
    f = body.filter(region).withColumn("_n", F.col("_t")[0].try_cast("int")).withColumn(
        "_p", F.transform(F.slice("_t", 2, F.greatest("_n", F.lit(0))), lambda t: t.try_cast("bigint")))
    wrong = F.col("_n").isNull() | (F.size("_p") != F.col("_n")) | F.exists("_p", lambda i: i.isNull() | (i < 0) | (i >= nv))
    f = f.withColumn("_p", F.when(region & wrong, bad("array<bigint>")).otherwise(F.col("_p")))
    fan = F.transform(F.sequence(F.lit(1), F.size("_p") - 2), lambda i: F.array(
        F.col("_p")[0], F.element_at("_p", (i + 1).cast("int")), F.element_at("_p", (i + 2).cast("int"))))
    fans = f.filter(F.size("_p") >= 3).select((F.col("_i") - nv).alias("_i"), F.size("_p").alias("corners"), F.posexplode(fan).alias("_k", "v"))
    from gridwright.functions.ranking import global_position
    placed = global_position(fans, [], [F.col("_i"), F.col("_k")], "_pos")
    return vertices, placed.select((F.col("_pos") - 1).alias("fid"), F.lit("scene").alias("object"), F.lit("unassigned").alias("material"), "v", "corners")


# One packed voxel record, little-endian, 16 bytes.
VOXEL_RECORD = np.dtype([("ix", "<i4"), ("iy", "<i4"), ("iz", "<i4"), ("label", "u1"), ("confidence", "u1"), ("count", "<u2")])


def _joined(records: Iterator[bytes], size: int = 4096) -> Iterator[tuple[bytearray]]:
    while part := b"".join(islice(records, size)):
        yield (bytearray(part),)


def read_voxels(spark: SparkSession, path: str) -> DataFrame:
    """Packed records; the fixed record length lets a file be read by many tasks."""
    records = spark.sparkContext.binaryRecords(path, VOXEL_RECORD.itemsize)
    return unpack_voxels(spark.createDataFrame(records.mapPartitions(_joined), "record binary"))


def unpack_voxels(raw: DataFrame) -> DataFrame:
    """``raw(record BINARY)``, each a whole number of sixteen-byte records -> voxel columns."""
    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            a = np.frombuffer(b"".join(bytes(r) for r in f["record"]), dtype=VOXEL_RECORD)
            yield pd.DataFrame({n: a[n].astype("int32") for n in VOXEL_RECORD.names})

    return raw.mapInPandas(unpack, "ix int, iy int, iz int, label int, confidence int, count int")


def mesh_lines(vertices: DataFrame, faces: DataFrame, digits: int = 6) -> DataFrame:
    """(section, line_no, line): v lines, then f lines with o / usemtl lines where the group changes.

    ``faces(fid, object, material, v)`` with consecutive fids; a change is seen by joining fid - 1.
    """
    number = f"%.{digits}f"
    vl = vertices.select(F.lit(0).alias("section"), F.col("vid").alias("line_no"), F.lit(0).alias("part"),
                         F.format_string(f"v {number} {number} {number}", "x", "y", "z").alias("line"))
    before = faces.select((F.col("fid") + 1).alias("fid"), F.col("object").alias("_po"), F.col("material").alias("_pm"))
    t = faces.join(before, "fid", "left")
    new = lambda a, b: ~F.col(a).eqNullSafe(F.col(b))
    rows = F.filter(F.array(
        F.when(new("object", "_po"), F.struct(F.lit(0).alias("part"), F.concat(F.lit("o "), "object").alias("line"))),
        F.when(new("material", "_pm"), F.struct(F.lit(1).alias("part"), F.concat(F.lit("usemtl "), "material").alias("line"))),
        F.struct(F.lit(2).alias("part"), F.concat_ws(" ", F.lit("f"), F.transform("v", lambda i: (i + 1).cast("string"))).alias("line")),
    ), lambda r: r.isNotNull())
    fl = t.select(F.lit(1).alias("section"), F.col("fid").alias("line_no"), F.explode(rows).alias("_r")).select("section", "line_no", "_r.part", "_r.line")
    return vl.unionByName(fl)


def write_mesh_lines(lines: DataFrame, path: str) -> None:
    """Range-sorted part files; their concatenation in name order is the mesh file."""
    lines.orderBy("section", "line_no", "part").select("line").write.mode("errorifexists").text(path)
