"""Faces, surfaces, voxels and evidence: geometry, label votes, fusion and mesh audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from gridwright.functions.columns import category_from_name
from gridwright.functions.quantiles import BROADCAST_ROWS, attach, exact_quantiles
from gridwright.functions.ranking import global_position
from gridwright.operators.score import _with
from gridwright.session import settle


def resolve_vertices(faces: DataFrame, vertices: DataFrame, key: str = "fid", indices: str = "v") -> DataFrame:
    """faces(key…, v ARRAY of three vertex ids) -> corner structs a, b, c, by one join instead of three.

    Both joins are sorted merges: faces grow out of rows by ``explode``, which Spark's size estimate does not see, so
    left to itself it sends a whole vertex table through the driver.
    """
    rest = [c for c in faces.columns if c not in (key, indices)]
    flat = faces.select(key, F.posexplode(indices).alias("_p", "vid"))
    joined = flat.join(vertices.select("vid", F.struct("x", "y", "z").alias("_v")).hint("merge"), "vid")
    corners = joined.groupBy(key).agg(*[
        F.max(F.when(F.col("_p") == i, F.col("_v"))).alias(n) for i, n in enumerate("abc")])
    return faces.select(key, *rest).join(corners.hint("merge"), key) if rest else corners


def triangle_geometry(faces: DataFrame) -> DataFrame:
    """Unit normal, centroid, area and z range from corner structs a, b, c."""
    e = {f"{s}{ax}": F.col(f"{s}.{ax}") - F.col(f"a.{ax}") for s in "bc" for ax in "xyz"}
    nx = e["by"] * e["cz"] - e["bz"] * e["cy"]
    ny = e["bz"] * e["cx"] - e["bx"] * e["cz"]
    nz = e["bx"] * e["cy"] - e["by"] * e["cx"]
    t = faces.withColumns({"_nx": nx, "_ny": ny, "_nz": nz}).withColumn(
        "_n", F.sqrt(F.col("_nx") * F.col("_nx") + F.col("_ny") * F.col("_ny") + F.col("_nz") * F.col("_nz")))
    unit = lambda c: F.when(F.col("_n") == 0, 0.0).otherwise(F.col(c) / F.col("_n"))
    mid = lambda ax: (F.col(f"a.{ax}") + F.col(f"b.{ax}") + F.col(f"c.{ax}")) / 3.0
    return t.withColumns({
        "nx": unit("_nx"), "ny": unit("_ny"), "nz": unit("_nz"), "area": F.col("_n") * 0.5,
        "gx": mid("x"), "gy": mid("y"), "gz": mid("z"),
        "z_lo": F.least("a.z", "b.z", "c.z"), "z_hi": F.greatest("a.z", "b.z", "c.z"),
    }).drop("_nx", "_ny", "_nz", "_n")


def valid_triangles(faces: DataFrame, min_area: float = 1e-12) -> DataFrame:
    return faces.filter(F.col("area") > min_area)


# Visual category -> engineering material.
MATERIAL_OF = {
    "wall": "concrete", "concrete": "concrete", "limestone": "limestone", "stone": "stone_paving",
    "stone_paving": "stone_paving", "walkway": "stone_paving", "glass": "glass", "glass_facade": "glass",
    "curtain_wall": "glass", "roof": "metal_roof", "metal": "metal_roof", "metal_roof": "metal_roof", "road": "asphalt",
    "asphalt": "asphalt", "water": "water", "vegetation": "vegetation", "grass": "vegetation", "soil": "terrain",
    "ground": "terrain", "terrain": "terrain",
}


def map_material(df: DataFrame, category: Column, overrides: DataFrame | None = None) -> DataFrame:
    """Add material, confidence and provenance; ``overrides(material, permittivity, conductivity)`` holds
    bounded ranges and marks the row as configured."""
    table = F.create_map(*[F.lit(v) for pair in MATERIAL_OF.items() for v in pair])
    name = F.coalesce(table[F.lower(F.trim(category))], F.lit("unknown"))
    out = df.withColumn("material", name)
    if overrides is not None:
        out = out.join(overrides, "material", "left")
        tuned = F.col("permittivity").isNotNull() | F.col("conductivity").isNotNull()
    else:
        kind = "struct<lo:double,hi:double>"
        out = out.withColumn("permittivity", F.lit(None).cast(kind)).withColumn("conductivity", F.lit(None).cast(kind))
        tuned = F.lit(False)
    return out.withColumn("confidence", F.when(F.col("material") == "unknown", 0.0).otherwise(0.65)).withColumn(
        "provenance", F.when(tuned, "CONFIGURED_EFFECTIVE_PARAMETER_RANGE_NOT_PHYSICAL_TRUTH").otherwise("UNCALIBRATED_VISUAL_ENGINEERING_PRIOR"))


def low_rank_value(df: DataFrame, value: str) -> DataFrame:
    """One row ``low_z``: the value at 0-based rank floor(n / 5) of the ascending order."""
    return exact_quantiles(df, [], value, [0.2], ["low_z"], lower=True, rank=lambda n: F.least(n - 1, F.floor(n / 5)))


def label_ground(faces: DataFrame, category: Column, normal_z: str = "nz", centroid_z: str = "gz", threshold: float | None = None) -> DataFrame:
    """Add ``ground``: category rules first, then horizontal low faces become terrain."""
    if threshold is None:
        t = faces.crossJoin(F.broadcast(low_rank_value(faces, centroid_z).select((F.col("low_z") + 1.0).alias("_low"))))  # one row
    else:
        t = faces.withColumn("_low", F.lit(float(threshold)))
    t = t.withColumn("_c", F.lower(F.trim(F.coalesce(category, F.lit("")))))
    c = F.col("_c")
    rule = (
        F.when(c.isin("road", "asphalt"), "road").when(c.isin("walkway", "stone", "stone_paving", "paving"), "walkway")
        .when(c == "water", "water").when(c.isin("vegetation", "grass"), "vegetation").when(c.isin("ground", "terrain", "soil"), "terrain")
        .when((F.abs(normal_z) >= 0.85) & (F.col(centroid_z) <= F.col("_low")), "terrain").otherwise("unknown"))
    return t.withColumn("ground", rule).drop("_low", "_c")


def geometry_evidence(faces: DataFrame, name: Column, annotations: DataFrame | None = None) -> DataFrame:
    """(entity_id, level, category, source, confidence, reliability) from names, face geometry, annotations."""
    box = faces.agg(F.min("z_lo").alias("_z0"), F.max("z_hi").alias("_z1"))
    t = faces.crossJoin(F.broadcast(box)).withColumn(  # one row
        "_low", F.col("_z0") + F.greatest(F.lit(1.0), (F.col("_z1") - F.col("_z0")) * 0.05))
    flat, steep = F.abs("nz") >= 0.85, F.abs("nz") <= 0.35
    ground = F.col("gz") <= F.col("_low")
    entity = F.concat(F.lit("face:"), F.col("fid").cast("string"))
    item = lambda cat, src, conf, rel: F.struct(cat.alias("category"), F.lit(src).alias("source"), conf.alias("confidence"), F.lit(rel).alias("reliability"))
    geo = item(
        F.when(flat & ground, "ground").when(flat, "roof").when(steep, "wall").otherwise("other_surface"), "geometry",
        F.when(flat & ground, 0.75).when(flat, 0.60).when(steep, 0.65).otherwise(0.40), 0.70)
    t = t.withColumn("_known", category_from_name(name))
    known = F.col("_known")
    named = F.when(known.isNotNull(), item(known, "existing_mesh_semantic", F.lit(0.95), 0.95))
    rows = t.select(entity.alias("entity_id"), F.lit("face").alias("level"), F.explode(F.array_compact(F.array(named, geo))).alias("_e"))
    out = rows.select("entity_id", "level", "_e.*")
    if annotations is not None:
        out = out.unionByName(annotations.select(
            F.concat(F.lit("face:"), F.col("face_id").cast("string")).alias("entity_id"), F.lit("face").alias("level"), "category",
            F.lit("annotation").alias("source"), "confidence", F.lit(1.0).alias("reliability")))
    return out


def fuse_evidence(evidence: DataFrame) -> DataFrame:
    """Per entity: winning category or conflict, support, margin, policy, sources, level.

    Scores add per (entity, category) before anything is gathered; an entity then has as many rows as
    categories.  ``level`` is the alphabetically largest level name, as specified.
    """
    ok = F.col("confidence").between(0, 1) & F.col("reliability").between(0, 1)
    checked = F.when(ok, F.col("confidence") * F.col("reliability")).otherwise(
        F.raise_error(F.lit("confidence and reliability must lie in [0, 1]")).cast("double"))
    per = evidence.withColumn("_s", checked).groupBy("entity_id", "category").agg(
        F.sum("_s").alias("score"), F.collect_set("source").alias("_src"), F.max("level").alias("_lvl"))  # five sources
    t = per.groupBy("entity_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("ns"), F.col("category").alias("c")))).alias("_r"),
        F.sum("score").alias("_sum"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_src")))).alias("sources"), F.max("_lvl").alias("level"))
    total = F.when(F.col("_sum") == 0, 1.0).otherwise(F.col("_sum"))
    best = -F.col("_r")[0]["ns"]
    second = F.coalesce(-F.get("_r", F.lit(1))["ns"], F.lit(0.0))
    t = t.withColumn("best_score", best).withColumn("share", best / total).withColumn("margin", (best - second) / total)
    conflict = (F.col("best_score") < 0.35) | (F.col("share") < 0.55) | (F.col("margin") < 0.10)
    top = F.lower(F.col("_r")[0]["c"])
    # Category -> reconstruction policy.
    policy = (
        F.when(top.isin("glass", "glass_facade", "curtain_wall"), "merge_component")
        .when(top.isin("wall", "concrete", "limestone", "stone", "roof", "metal_roof"), "regularize_plane")
        .when(top.isin("edge", "frame", "window_frame", "detail"), "preserve_detail")
        .when(top.isin("ground", "road", "asphalt", "water", "vegetation", "walkway"), "keep_boundary").otherwise("manual_review"))
    return t.select(
        "entity_id", "level", F.when(conflict, "unknown").otherwise(F.col("_r")[0]["c"]).alias("category"),
        F.col("share").alias("confidence"), F.when(conflict, "manual_review").otherwise(policy).alias("policy"), "sources",
        conflict.alias("conflict"), F.when(conflict, F.transform("_r", lambda r: r["c"])).alias("conflict_categories"),
        "best_score", "margin")


def group_buildings(faces: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """(members: fid, object_id), (objects: object_id, source_name, face_count, height_m).

    Object ids are made safe for files; equal ids get _2, _3 … in name order.
    """
    source = F.when(F.trim(F.coalesce(name, F.lit(""))) == "", "scene").otherwise(F.trim(name))
    t = faces.withColumn("source_name", source)
    per = t.groupBy("source_name").agg(F.count(F.lit(1)).alias("face_count"), (F.max("z_hi") - F.min("z_lo")).alias("height_m"))
    plain = F.regexp_replace(F.regexp_replace("source_name", r"[^\p{L}\p{N}_-]", "_"), "^_+|_+$", "")
    per = per.withColumn("_safe", F.when(plain == "", "scene").otherwise(plain))
    per = global_position(per, ["_safe"], [F.col("source_name")], "_pos")
    objects = per.select(
        F.when(F.col("_pos") == 1, F.col("_safe")).otherwise(F.concat_ws("_", "_safe", F.col("_pos").cast("string"))).alias("object_id"),
        "source_name", "face_count", "height_m")
    members = t.select("fid", "source_name").join(objects.select("source_name", "object_id"), "source_name").select("fid", "object_id")
    return members, objects


def mesh_edges(faces: DataFrame, part: str = "part_id") -> DataFrame:
    """(part, edge_a, edge_b): the three undirected edges of each triangle on coordinates rounded to 1e-6."""
    key = lambda s: F.struct(*[F.rint(F.col(f"{s}.{ax}") * 1e6).cast("bigint").alias(ax) for ax in "xyz"])  # half to even
    pair = lambda a, b: F.struct(F.least(a, b).alias("edge_a"), F.greatest(a, b).alias("edge_b"))
    return faces.select(part, *[key(s).alias(s) for s in "abc"]).select(part, F.explode(F.array(pair("a", "b"), pair("b", "c"), pair("c", "a"))).alias("_e")).select(part, "_e.*")


def edge_audit(faces: DataFrame, part: str = "part_id") -> DataFrame:
    """Per part: edges not shared by exactly two of its triangles."""
    per = mesh_edges(faces, part).groupBy(part, "edge_a", "edge_b").agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(part).agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("_n") != 2).alias("non_manifold_edges"))


def shared_edges(faces: DataFrame, part: str = "part_id") -> DataFrame:
    """One row: edges that occur in more than one part."""
    per = mesh_edges(faces, part).groupBy("edge_a", "edge_b").agg(F.min(part).alias("_a"), F.max(part).alias("_b"))
    return per.agg(F.count_if(F.col("_a") != F.col("_b")).alias("cross_part_edges"))


# --- voxels and surfaces --------------------------------------------------------------------------

# Label number -> class name.
CLASSES = ("unknown_surface", "water", "grass", "soil", "vegetation", "asphalt", "roof_surface", "concrete_exterior_wall",
           "glass_facade", "other_building_surface")
# Labels a surface type accepts; base surfaces take the last list.
ALLOWED = {"facade": (7, 8, 9), "roof": (6, 7, 9)}
ALLOWED_OTHER = (7, 9)
# Label without votes, and material slot of a label.
FALLBACK = {"roof": "roof_surface", "facade": "other_building_surface", "base": "structural_base"}
SLOT = {
    "glass_facade": "AUTO_GLASS_VISUAL_PRIOR", "concrete_exterior_wall": "AUTO_CONCRETE_VISUAL_PRIOR",
    "other_building_surface": "AUTO_OTHER_BUILDING_VISUAL_PRIOR", "roof_surface": "AUTO_ROOF_VISUAL_PRIOR",
    "structural_base": "AUTO_STRUCTURAL_BASE",
}


def voxel_consensus(records: DataFrame) -> DataFrame:
    """(ix, iy, iz, label, confidence, count): the best-supported label of each voxel."""
    key = ["ix", "iy", "iz"]
    n, c = F.greatest(F.lit(1), F.col("count")).cast("bigint"), F.greatest(F.lit(1), F.col("confidence")).cast("bigint")
    per = records.groupBy(*key, "label").agg(
        F.sum(n * c).alias("_score"), F.sum(F.col("count").cast("bigint")).alias("_count"),
        F.sum(F.col("confidence").cast("bigint") * n).alias("_conf"))
    best = per.groupBy(*key).agg(F.max(F.struct("_score", (-F.col("label")).alias("_nl"), "_count", "_conf")).alias("_b"))
    return best.select(
        *key, (-F.col("_b._nl")).alias("label"),
        F.bround(F.col("_b._conf") / F.greatest(F.lit(1), F.col("_b._count")), 0).cast("bigint").alias("confidence"),
        F.least(F.lit(65535), F.col("_b._count")).alias("count"))


def nearest_voxel(samples: DataFrame, voxels: DataFrame, cell: float = 1.0, radius: int = 2) -> DataFrame:
    """Best voxel within ``radius`` cells by (distance, -count, -confidence, label); NULLs when none.

    The answer depends on the sample's cell only, so the search runs once per distinct cell.
    """
    keyed = samples.withColumns({f"_{a}": F.floor(F.col(f"p{a}") / cell).cast("bigint") for a in "xyz"})
    cells = keyed.select("_x", "_y", "_z").distinct()
    span = range(-radius, radius + 1)
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in span for b in span for c in span])
    reach = cells.select("*", F.explode(offsets).alias("_o")).select(
        "_x", "_y", "_z", (F.col("_x") + F.col("_o.a")).alias("ix"), (F.col("_y") + F.col("_o.b")).alias("iy"), (F.col("_z") + F.col("_o.c")).alias("iz"),
        (F.sqrt((F.col("_o.a") * F.col("_o.a") + F.col("_o.b") * F.col("_o.b") + F.col("_o.c") * F.col("_o.c")).cast("double")) * cell).alias("distance"))
    best = reach.join(voxels, ["ix", "iy", "iz"]).groupBy("_x", "_y", "_z").agg(F.min(F.struct(
        "distance", (-F.col("count")).alias("nc"), (-F.col("confidence")).alias("nf"), "label")).alias("_b"))
    return keyed.join(best, ["_x", "_y", "_z"], "left").select(
        *samples.columns, F.col("_b.label").alias("label"), (-F.col("_b.nf")).alias("confidence"), (-F.col("_b.nc")).alias("count"),
        F.col("_b.distance").alias("distance")).drop("_x", "_y", "_z")


def surface_votes(hits: DataFrame, surface: str = "surface_id", kind: str = "surface_type", min_hit_rate: float = 0.35,
                  min_confidence: float = 0.45, min_share: float = 0.60) -> DataFrame:
    """Label, confidence, status and reasons of each surface from its samples' voxel hits."""
    allowed = F.lit(False)
    for t, labels in ALLOWED.items():
        allowed = allowed | ((F.col(kind) == t) & F.col("label").isin(*labels))
    allowed = allowed | (~F.col(kind).isin(*ALLOWED) & F.col("label").isin(*ALLOWED_OTHER))
    quality = F.col("confidence") / 255.0
    w = F.greatest(F.lit(1), F.least(F.col("count"), F.lit(100))) * quality / (1.0 + F.col("distance"))
    sizes = hits.groupBy(surface, kind).agg(F.count(F.lit(1)).alias("samples"), F.count("label").alias("hits"))
    per = hits.filter(F.col("label").isNotNull() & allowed).groupBy(surface, kind, "label").agg(
        F.sum(w).alias("vote"), F.avg(quality).alias("_mean"))
    top = per.groupBy(surface, kind).agg(
        F.sum("vote").alias("_total"), F.max(F.struct("vote", (-F.col("label")).alias("nl"), "_mean")).alias("_b"))
    t = sizes.join(top, [surface, kind], "left")
    voted = F.col("_b").isNotNull()
    names = F.array(*[F.lit(c) for c in CLASSES])
    mapped = lambda table, k: F.create_map(*[F.lit(v) for p in table.items() for v in p])[k]
    t = t.withColumn("hit_rate", F.when(F.col("samples") > 0, F.col("hits") / F.col("samples")).otherwise(0.0))
    t = t.withColumn("share", F.when(voted & (F.col("_total") > 0), F.col("_b.vote") / F.col("_total")).otherwise(0.0))
    t = t.withColumn("confidence", F.when(voted, F.col("hit_rate") * F.col("share") * F.col("_b._mean")).when(
        F.col(kind).isin("roof", "facade"), 0.25).otherwise(0.10))
    t = t.withColumn("label", F.when(voted, F.element_at(names, (-F.col("_b.nl")).cast("int") + 1)).otherwise(
        F.coalesce(mapped(FALLBACK, F.col(kind)), F.lit("unknown_surface"))))
    from gridwright.functions.columns import reasons
    t = t.withColumn("reasons", reasons(
        (~voted, "NO_COMPATIBLE_SOURCE_SEMANTIC_VOTES"), (F.col("hit_rate") < min_hit_rate, "SOURCE_ASSOCIATION_COVERAGE_LOW"),
        (F.col("share") < min_share, "SOURCE_LABEL_PURITY_LOW"), (F.col("confidence") < min_confidence, "COMBINED_CONFIDENCE_LOW")))
    slot = F.coalesce(mapped(SLOT, F.col("label")), F.concat(F.lit("AUTO_"), F.upper(F.col(kind)), F.lit("_REVIEW_REQUIRED")))
    return t.select(
        surface, kind, "label", slot.alias("slot"), "confidence", "hit_rate", "share", "samples",
        F.when(F.size("reasons") == 0, "AUTO_ACCEPTED_VISUAL_PRIOR").otherwise("REVIEW_REQUIRED").alias("status"), "reasons")


def surface_samples(faces: DataFrame, surface: str = "surface_id", maximum: int = 400) -> DataFrame:
    """Corners, centroid and edge middles of a surface's triangles, each point once, evenly thinned to
    ``maximum``: pick floor(i·n/maximum) of the n points in face order."""
    mid = lambda *s: F.struct(*[(sum((F.col(f"{k}.{ax}") for k in s), F.lit(0.0)) / float(len(s))).alias(ax) for ax in "xyz"])
    point = F.posexplode(F.array(mid("a"), mid("b"), mid("c"), mid("a", "b", "c"), mid("a", "b"), mid("b", "c"), mid("c", "a"))).alias("_j", "_p")
    rows = faces.select(surface, "fid", point).groupBy(surface, F.col("_p.x").alias("px"), F.col("_p.y").alias("py"), F.col("_p.z").alias("pz")).agg(
        F.min(F.col("fid") * 7 + F.col("_j")).alias("_ord"))
    n = rows.groupBy(surface).agg(F.count(F.lit(1)).alias("_n"))
    placed = attach(global_position(rows, [surface], [F.col("_ord")], "_pos"), n, [surface])
    p = F.col("_pos") - 1
    i = F.ceil(p * maximum / F.col("_n"))
    chosen = (F.col("_n") <= maximum) | ((i < maximum) & (F.floor(i * F.col("_n") / maximum) == p))
    return placed.filter(chosen).select(surface, "px", "py", "pz", F.col("_pos").alias("position"))


RING_RUN = 65_536  # consecutive vertices of a ring that one window sees


def ring_edges(rings: DataFrame, ring: str = "ring_id") -> DataFrame:
    """Each vertex with its successor, the last with the first; ``seq`` counts the vertices of a ring from 0.

    A window sees ``RING_RUN`` vertices of a ring, so vertices are exchanged once and a long ring is many windows; only the
    first vertex of each run is joined to the last of the run before.
    """
    n = rings.groupBy(ring).agg(F.count(F.lit(1)).alias("_n"))
    heads = settle(rings.filter(F.col("seq") % RING_RUN == 0).select(ring, F.col("seq").alias("_next"), F.col("x").alias("_hx"), F.col("y").alias("_hy")))
    rows = attach(rings.filter(F.col(ring).isNotNull() & F.col("seq").isNotNull()), n, [ring])
    run = W.partitionBy(ring, F.floor(F.col("seq") / RING_RUN)).orderBy("seq")
    rows = rows.withColumns({"_next": (F.col("seq") + 1) % F.col("_n"), "_lx": F.lead("x").over(run), "_ly": F.lead("y").over(run)})
    rows = rows.join(heads.hint("broadcast" if heads.count() <= BROADCAST_ROWS else "merge"), [ring, "_next"], "left")
    inside = F.col("_next") % RING_RUN != 0
    after = [F.when(inside, F.col(f"_l{c}")).otherwise(F.col(f"_h{c}")).alias(f"{c}2") for c in "xy"]
    return rows.select(ring, "seq", *[c for c in rings.columns if c not in (ring, "seq")], *after)


def ring_area(rings: DataFrame, ring: str = "ring_id") -> DataFrame:
    return ring_edges(rings, ring).groupBy(ring).agg((F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")) / 2.0).alias("signed_area"))


def boundary_samples(rings: DataFrame, spacing: float, ring: str = "ring_id") -> DataFrame:
    """Points along every ring edge, at most ``spacing`` apart, starting at each vertex."""
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    count = F.greatest(F.lit(1), F.ceil(F.sqrt(dx * dx + dy * dy) / spacing).cast("int"))
    e = ring_edges(rings, ring).withColumn("_n", count).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return e.select(ring, "seq", "step", (F.col("x") + dx * (F.col("step") / F.col("_n"))).alias("x"), (F.col("y") + dy * (F.col("step") / F.col("_n"))).alias("y"))
