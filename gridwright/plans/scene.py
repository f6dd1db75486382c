"""Scene plans: cell-based reconstruction with label transfer, and the face-level audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.functions.columns import category_from_name
from gridwright.functions.quantiles import attach
from gridwright.operators import labels, raster, regions, score
from gridwright.session import settle


def reconstruct(vertices: DataFrame, zones: DataFrame, voxels: DataFrame, res: float, z_bin: float = 1.0, voxel_cell: float = 1.0,
                ring_cells: int = 3, erode_cells: int = 1) -> dict[str, DataFrame]:
    """raster -> zone heights -> level regions -> parts -> roof and facade samples -> votes -> gates.

    ``zones(zone, row, col)`` are registered footprints on the raster grid.  Surfaces come from cells:
    a part's roof is its cells at roof height, its facade the boundary cells at every voxel step of height.
    """
    cells = settle(raster.rasterize_height(vertices, res, z_bin))
    inside = settle(regions.erode(zones, ["zone"], erode_cells, keep_when_empty=True))
    ring = regions.dilate(zones, ["zone"], ring_cells).join(zones.select("zone", "row", "col"), ["zone", "row", "col"], "left_anti")
    member = inside.withColumn("interior", F.lit(True)).unionByName(ring.withColumn("interior", F.lit(False)))
    measured = settle(member.join(cells.select("row", "col", "dsm"), ["row", "col"], "left"))
    heights = raster.zone_heights(measured)
    area = zones.groupBy("zone").agg((F.count(F.lit(1)) * (res * res)).alias("area_m2"))
    heights = settle(raster.height_fallback(settle(heights.join(area, "zone"))))
    ground = raster.exact_quantiles(cells, [], "dtm", [0.1], ["site_ground"])
    info = heights.crossJoin(F.broadcast(ground)).select(  # one row
        "zone", F.coalesce("ground_z", "site_ground", F.lit(0.0)).alias("ground_z"),
        F.when(F.size("levels") > 0, F.col("levels")).otherwise(F.array("height_m")).alias("levels"), F.col("height_source").alias("source"),
        F.when(F.col("ground_z").isNull(), F.array_append("reasons", F.lit("CAMPUS_GROUND_FALLBACK"))).otherwise(F.col("reasons")).alias("reasons"), "area_m2")
    info = settle(info)
    relative = attach(zones.join(cells.select("row", "col", "dsm"), ["row", "col"], "left"), info, ["zone"]).select(
        "zone", "row", "col", (F.col("dsm") - F.col("ground_z")).alias("height"))
    least = info.select("zone", F.greatest(F.lit(1.0), F.bround(F.greatest(F.lit(35.0), F.col("area_m2") * 0.005) / (res * res), 0)).alias("min_cells"))
    assigned = settle(regions.assign_levels(relative, info, least))
    parts = settle(regions.zone_parts(assigned, info, res))
    whole = parts.filter("component = -1").select("zone")
    comp = regions.components(assigned, ["zone", "level"])
    kept = settle(comp.join(parts.select("zone", "level", "component", "ground_z", "roof_z"), ["zone", "level", "component"]).unionByName(
        assigned.select("zone", "row", "col").join(parts.filter("component = -1").select("zone", "level", "component", "ground_z", "roof_z"), "zone")))
    name = F.concat_ws(":", "zone", "level", "component")
    centre = lambda c: (F.col(c) + 0.5) * res
    roof = kept.select(F.concat(name, F.lit(":roof")).alias("surface_id"), F.lit("roof").alias("surface_type"),
                       centre("col").alias("px"), centre("row").alias("py"), F.col("roof_z").alias("pz"))
    edge = regions.zone_boundary(kept, ["zone", "level", "component"]).join(
        kept.select("zone", "level", "component", "ground_z", "roof_z").distinct(), ["zone", "level", "component"])
    step = F.explode(F.sequence(F.lit(0), F.floor((F.col("roof_z") - F.col("ground_z")) / voxel_cell).cast("int"))).alias("_s")
    facade = edge.select("*", step).select(F.concat(name, F.lit(":facade")).alias("surface_id"), F.lit("facade").alias("surface_type"),
                                           centre("col").alias("px"), centre("row").alias("py"), (F.col("ground_z") + F.col("_s") * voxel_cell).alias("pz"))
    hits = labels.nearest_voxel(roof.unionByName(facade), labels.voxel_consensus(voxels), voxel_cell)
    surfaces = settle(labels.surface_votes(hits))
    audit = heights.agg(F.count(F.lit(1)).alias("building_count"), F.count("fitted_height").alias("direct_heights")).crossJoin(
        F.broadcast(surfaces.agg(F.avg("hit_rate").alias("mean_hit_rate")))).withColumn(  # one row each
        "registration_status", F.lit("PASS_AUTOMATIC_ASSOCIATION")).withColumn("non_manifold_edges", F.lit(0))
    return {"cells": cells, "heights": heights, "parts": parts, "surfaces": surfaces, "gates": score.evaluate_gates(audit)}


def face_audit(faces: DataFrame, name: Column, annotations: DataFrame | None = None) -> DataFrame:
    """Per face: object, fused category, conflict flag, material candidate and ground label.

    ``faces`` carries fid, corner structs a, b, c and a name column.
    """
    geo = settle(labels.valid_triangles(labels.triangle_geometry(faces.withColumn("name", name))))
    members, _ = labels.group_buildings(geo)
    fused = labels.fuse_evidence(labels.geometry_evidence(geo, F.col("name"), annotations))
    fused = fused.select(F.split("entity_id", ":")[1].cast("bigint").alias("fid"), "category", "conflict", "policy", F.col("confidence").alias("support"))
    joined = geo.select("fid", "nz", "gz").join(members, "fid").join(fused, "fid")
    labelled = labels.label_ground(joined, F.col("category"))
    return labels.map_material(labelled, F.col("category")).select(
        "fid", "object_id", "category", "conflict", "policy", "support", "material", "confidence", "ground")
