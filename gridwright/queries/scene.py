"""Queries over rasters, regions, meshes, voxels and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright import fixtures as fx
from gridwright.functions import columns as col
from gridwright.functions.quantiles import attach
from gridwright.operators import labels, raster, regions, score
from gridwright.queries.registry import query
from gridwright.session import settle
from gridwright.sources import meshes, tables

RES = 20.0


def cells(spark, sf):
    return raster.rasterize_height(fx.vertices(spark, sf), RES, 1.0)


def zones(spark, sf):
    return cells(spark, sf).selectExpr("*", "(row div 10)*1000 + col div 10 as zone",
                                       "(row%10 between 2 and 7) and (col%10 between 2 and 7) as interior")


@query("mesh_stats_a1", """SELECT count(*) AS vertex_count, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z,
 (SELECT CAST(sum(greatest(0, 4+l_linenumber%3-3)) AS BIGINT) FROM lineitem) AS triangle_count FROM f_vertices""")
def _(spark, sf):
    faces = fx.table(spark, sf, "lineitem").selectExpr("cast(4+l_linenumber%3 as bigint) as tokens")
    return raster.mesh_stats(fx.vertices(spark, sf), faces)


@query("rasterize_height_a2", "SELECT * FROM f_cells")
def _(spark, sf):
    return cells(spark, sf)


@query("grid_to_world_p3", """SELECT row, col, x0+(col+0.5e0)*20e0 AS wx, y1-(row+0.5e0)*20e0 AS wy FROM f_cells, f_bounds""")
def _(spark, sf):
    v = fx.vertices(spark, sf)
    b = v.agg(F.min("x").alias("x0"), F.max("y").alias("y1"))
    wx, wy = col.grid_to_world(F.col("col"), F.col("row"), F.col("x0"), F.col("y1"), RES)
    return cells(spark, sf).crossJoin(F.broadcast(b)).select("row", "col", wx.alias("wx"), wy.alias("wy"))  # one row


@query("plan_to_grid_p3", """SELECT point_id, (400-1)/2e0+3e0+0.5e0*(cos(radians(7.5e0))*x-sin(radians(7.5e0))*y) AS gc, (600-1)/2e0-2e0-0.5e0*(sin(radians(7.5e0))*x+cos(radians(7.5e0))*y) AS gr FROM f_points""")
def _(spark, sf):
    gc, gr = col.plan_to_grid(F.col("x"), F.col("y"), F.lit(7.5), F.lit(0.5), F.lit(3.0), F.lit(-2.0), 600, 400)
    return fx.points(spark, sf).select("point_id", gc.alias("gc"), gr.alias("gr"))


@query("raster_lookup_j6", """WITH p AS (SELECT point_id, CAST(round_even(x/20e0-3e0,0) AS BIGINT) AS col, CAST(round_even(y/20e0-2e0,0) AS BIGINT) AS row FROM f_points)
 SELECT point_id, p.row, p.col, p.col BETWEEN 0 AND 39 AND p.row BETWEEN 0 AND 34 AS inside, dsm FROM p LEFT JOIN f_cells c ON c.row=p.row AND c.col=p.col""")
def _(spark, sf):
    return raster.raster_lookup(fx.points(spark, sf), cells(spark, sf), 35, 40, F.col("x") / 20.0 - 3.0, F.col("y") / 20.0 - 2.0).select("point_id", "row", "col", "inside", "dsm")


@query("zonal_join_j7", """SELECT zone, count(*) FILTER (interior) AS interior_cells, count(*) FILTER (NOT interior) AS ring_cells, avg(CASE WHEN interior THEN dsm END) AS mean_roof FROM f_zones GROUP BY zone""")
def _(spark, sf):
    z = zones(spark, sf)
    member = z.select("zone", "row", "col", "interior")
    return member.join(cells(spark, sf), ["row", "col"]).groupBy("zone").agg(
        F.count_if("interior").alias("interior_cells"), F.count_if(~F.col("interior")).alias("ring_cells"), F.avg(F.when(F.col("interior"), F.col("dsm"))).alias("mean_roof"))


HEIGHTS = """WITH g AS (SELECT zone, quantile_cont(CASE WHEN NOT interior THEN dsm END,0.2) AS ground_z, count(*) FILTER (interior) AS interior_cells, count(*) FILTER (NOT interior) AS ground_cells FROM f_zones GROUP BY zone),
 h AS (SELECT zone, dsm-ground_z AS h FROM f_zones JOIN g USING (zone) WHERE interior),
 q AS (SELECT zone, quantile_cont(h,0.65) AS fitted_height, quantile_cont(h,0.9)-quantile_cont(h,0.1) AS spread, count(*) AS n FROM h WHERE h BETWEEN 3 AND 80 GROUP BY zone)"""


@query("zone_heights_a3", HEIGHTS + """ SELECT zone, ground_z, interior_cells, ground_cells, fitted_height, spread, coalesce(n,0) AS roof_cells, CASE WHEN interior_cells>0 THEN coalesce(n,0)/CAST(interior_cells AS DOUBLE) ELSE 0e0 END AS coverage,
 coalesce(CASE WHEN ground_cells<50 THEN 'LOCAL_GROUND_COVERAGE_LOW,' END,'')||coalesce(CASE WHEN interior_cells=0 OR coalesce(n,0)/CAST(interior_cells AS DOUBLE)<0.3 THEN 'ROOF_COVERAGE_LOW,' END,'')||CASE WHEN fitted_height IS NULL THEN 'NO_PLAUSIBLE_ROOF_HEIGHT,' ELSE '' END AS first_reasons FROM g LEFT JOIN q USING (zone)""")
def _(spark, sf):
    t = raster.zone_heights(settle(zones(spark, sf)))
    shown = F.filter("reasons", lambda r: r != "MULTI_LEVEL_ROOF")
    return t.select("zone", "ground_z", "interior_cells", "ground_cells", "fitted_height", "spread", "roof_cells", "coverage",
                    F.array_join(F.transform(shown, lambda r: F.concat(r, F.lit(","))), "").alias("first_reasons"))


@query("roof_levels_a4")
def _(spark, sf):
    # zones of 40 x 40 cells hold enough roof samples for a histogram
    z = cells(spark, sf).selectExpr("(row div 40)*1000 + col div 40 as zone", "dsm - 5D as height")
    return raster.roof_levels(z)


@query("height_fallback_a5", HEIGHTS + """, a AS (SELECT zone, interior_cells*400e0 AS area_m2, fitted_height FROM g LEFT JOIN q USING (zone)), m AS (SELECT coalesce(quantile_cont(fitted_height,0.5),16e0) AS m FROM a)
 SELECT zone, coalesce(fitted_height, ((CASE WHEN area_m2>=8000 THEN 24e0 WHEN area_m2>=3000 THEN 20e0 WHEN area_m2>=1000 THEN 16e0 ELSE 10e0 END)+m)/2) AS height_m,
  CASE WHEN fitted_height IS NULL THEN 'automatic_area_class_fallback' ELSE 'lidar_local_ground_and_roof_modes' END AS height_source FROM a, m""")
def _(spark, sf):
    t = settle(raster.zone_heights(settle(zones(spark, sf))).withColumn("area_m2", F.col("interior_cells") * 400.0))
    return raster.height_fallback(t).select("zone", "height_m", "height_source")


GRID = "n AS (SELECT CAST(greatest(1,ceil((y1-y0)/20e0)) AS BIGINT) AS rows, CAST(greatest(1,ceil((x1-x0)/20e0)) AS BIGINT) AS cols FROM f_bounds)"
EDGES = f"""WITH {GRID}, s AS (SELECT quantile_cont(rep,0.01) AS lo, quantile_cont(rep,0.99) AS hi FROM f_cells),
 p AS (SELECT row, col, round_even(greatest(0,least(1,(rep-lo)/(greatest(hi,lo+1e0)-lo)))*254e0+1e0,0) AS v FROM f_cells, s),
 k AS (SELECT DISTINCT row+a AS row, col+b AS col FROM f_cells, (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) o(a,b), n WHERE row+a BETWEEN 0 AND rows-1 AND col+b BETWEEN 0 AND cols-1),
 f AS (SELECT k.row, k.col, coalesce(c.v,0) AS c, coalesce(u.v,0) AS u, coalesce(d.v,0) AS d, coalesce(l.v,0) AS l, coalesce(r.v,0) AS r FROM k LEFT JOIN p c ON c.row=k.row AND c.col=k.col LEFT JOIN p u ON u.row=k.row-1 AND u.col=k.col
  LEFT JOIN p d ON d.row=k.row+1 AND d.col=k.col LEFT JOIN p l ON l.row=k.row AND l.col=k.col-1 LEFT JOIN p r ON r.row=k.row AND r.col=k.col+1),
 g AS (SELECT row, col, CASE WHEN col=0 THEN r-c WHEN col=cols-1 THEN c-l ELSE (r-l)/2 END AS gx, CASE WHEN row=0 THEN d-c WHEN row=rows-1 THEN c-u ELSE (d-u)/2 END AS gy FROM f, n),
 m AS (SELECT row, col, sqrt(gx*gx+gy*gy) AS magnitude FROM g WHERE gx<>0 OR gy<>0)"""


@query("height_edges_g5", EDGES + " SELECT row, col, magnitude FROM m WHERE magnitude >= (SELECT quantile_cont(magnitude,0.75) FROM m)")
def _(spark, sf):
    v = fx.vertices(spark, sf)
    rows, cols = raster.grid_shape(v, RES)
    return raster.height_edges(settle(cells(spark, sf)), rows, cols)


@query("silhouette_iou_a25", """WITH p AS (SELECT row, col FROM f_zones WHERE interior), t AS (SELECT row, col FROM f_cells WHERE dsm>=40),
 c AS (SELECT (SELECT count(*) FROM p) AS plan_cells, (SELECT count(*) FROM t) AS candidate_cells, (SELECT count(*) FROM p JOIN t USING (row, col)) AS overlap_cells)
 SELECT *, overlap_cells/CAST(plan_cells+candidate_cells-overlap_cells AS DOUBLE) AS iou, overlap_cells/CAST(plan_cells AS DOUBLE) AS plan_supported_ratio, overlap_cells/CAST(candidate_cells AS DOUBLE) AS candidate_inside_plan_ratio FROM c""")
def _(spark, sf):
    z = zones(spark, sf)
    return score.silhouette(z.filter("interior"), z, 40.0, "dsm")


def mask(spark, sf):
    """Tall cells, keyed by zone."""
    return zones(spark, sf).filter("dsm >= 30").select("zone", "row", "col")


KERNEL3 = "(VALUES " + ",".join(f"({a},{b})" for a, b in regions.ellipse(3)) + ") o(a,b)"


@query("dilate_g2", f"SELECT DISTINCT zone, row+a AS row, col+b AS col FROM (SELECT * FROM f_zones WHERE dsm>=30), {KERNEL3}")
def _(spark, sf):
    return regions.dilate(settle(mask(spark, sf)), ["zone"], 3)


KERNEL1 = "(VALUES " + ",".join(f"({a},{b})" for a, b in regions.ellipse(1)) + ") o(a,b)"


@query("erode_g2", f"""WITH m AS (SELECT row//20 AS zone, row, col FROM f_cells)
 SELECT zone, row, col FROM (SELECT m.zone, m.row, m.col, count(k.row) AS hits FROM m, {KERNEL1} LEFT JOIN m k ON k.zone=m.zone AND k.row=m.row+a AND k.col=m.col+b GROUP BY ALL) WHERE hits={len(regions.ellipse(1))}""")
def _(spark, sf):
    m = settle(cells(spark, sf).selectExpr("row div 20 as zone", "row", "col"))
    return regions.erode(m, ["zone"], 1)


@query("zone_boundary_g6", f"""WITH m AS (SELECT row//20 AS zone, row, col FROM f_cells)
 SELECT zone, row, col FROM (SELECT m.zone, m.row, m.col, count(k.row) AS hits FROM m, {KERNEL1} LEFT JOIN m k ON k.zone=m.zone AND k.row=m.row+a AND k.col=m.col+b GROUP BY ALL) WHERE hits<{len(regions.ellipse(1))}""")
def _(spark, sf):
    m = settle(cells(spark, sf).selectExpr("row div 20 as zone", "row", "col"))
    return regions.zone_boundary(m, ["zone"])


@query("connected_components_g1", """WITH RECURSIVE m AS (SELECT zone, row, col, row*2147483648+col AS id FROM f_zones WHERE dsm>=30),
 e AS (SELECT a.zone, a.id AS u, b.id AS v FROM m a JOIN m b ON a.zone=b.zone AND abs(a.row-b.row)<=1 AND abs(a.col-b.col)<=1),
 r AS (SELECT zone, id, id AS root FROM m UNION SELECT r.zone, e.v, r.root FROM r JOIN e ON e.zone=r.zone AND e.u=r.id AND r.root<e.v)
 SELECT zone, id//2147483648 AS row, id%2147483648 AS col, min(root) AS component FROM r GROUP BY zone, id""")
def _(spark, sf):
    # small tiles, so that components really cross tile borders here
    return regions.components(mask(spark, sf), ["zone"], tile=16)


@query("component_area_g1", """WITH RECURSIVE m AS (SELECT zone, row, col, row*2147483648+col AS id FROM f_zones WHERE dsm>=30),
 e AS (SELECT a.zone, a.id AS u, b.id AS v FROM m a JOIN m b ON a.zone=b.zone AND abs(a.row-b.row)<=1 AND abs(a.col-b.col)<=1),
 r AS (SELECT zone, id, id AS root FROM m UNION SELECT r.zone, e.v, r.root FROM r JOIN e ON e.zone=r.zone AND e.u=r.id AND r.root<e.v),
 c AS (SELECT zone, id, min(root) AS component FROM r GROUP BY zone, id)
 SELECT zone, component, count(*) AS cells, count(*)*400e0 AS area_m2 FROM c GROUP BY zone, component HAVING count(*)>=3""")
def _(spark, sf):
    lab = regions.components(mask(spark, sf), ["zone"])
    return regions.drop_small(lab, ["zone"], 3).groupBy("zone", "component").agg(F.first("cells").alias("cells")).withColumn("area_m2", F.col("cells") * 400.0)


@query("distance_raster_g3", """WITH e AS (SELECT row, col FROM f_cells WHERE dsm>=51), g AS (SELECT r AS row, c AS col FROM range(40) a(r), range(50) b(c))
 SELECT g.row, g.col, min(sqrt(CAST((g.row-e.row)*(g.row-e.row)+(g.col-e.col)*(g.col-e.col) AS DOUBLE))) AS distance FROM g, e GROUP BY g.row, g.col""")
def _(spark, sf):
    return regions.distance_raster(cells(spark, sf).filter("dsm >= 51"), 40, 50)


LEVELS3 = [5.0, 20.0, 40.0]


def level_input(spark, sf):
    c = cells(spark, sf).selectExpr("row div 12 as zone", "row", "col", "case when (row*7+col*3)%5=0 then null else rep end as height")
    c = settle(c)
    z = c.select("zone").distinct()
    lv = z.withColumn("levels", F.array(*[F.lit(v) for v in LEVELS3]))
    return c, lv, z.withColumn("min_cells", F.lit(2))


ASSIGN = """WITH RECURSIVE c AS (SELECT row//12 AS zone, row, col, row*2147483648+col AS id, CASE WHEN (row*7+col*3)%5=0 THEN NULL ELSE rep END AS height FROM f_cells),
 l AS (SELECT *, CASE WHEN height IS NULL THEN NULL WHEN abs(height-5)<=abs(height-20) THEN 0 WHEN abs(height-20)<=abs(height-40) THEN 1 ELSE 2 END AS lv FROM c),
 e AS (SELECT a.zone, a.lv, a.id AS u, b.id AS v FROM l a JOIN l b ON a.zone=b.zone AND a.lv=b.lv AND abs(a.row-b.row)<=1 AND abs(a.col-b.col)<=1),
 r AS (SELECT zone, lv, id, id AS root FROM l WHERE lv IS NOT NULL UNION SELECT r.zone, r.lv, e.v, r.root FROM r JOIN e ON e.zone=r.zone AND e.lv=r.lv AND e.u=r.id AND r.root<e.v),
 k AS (SELECT zone, lv, id, min(root) AS comp FROM r GROUP BY zone, lv, id), s AS (SELECT *, count(*) OVER (PARTITION BY zone, lv, comp) AS n FROM k),
 kept AS (SELECT zone, id//2147483648 AS row, id%2147483648 AS col, lv AS level FROM s WHERE n>=2),
 rest AS (SELECT zone, row, col FROM c WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.zone=c.zone AND kept.row=c.row AND kept.col=c.col)),
 near AS (SELECT zone, row, col, level FROM (SELECT rest.zone, rest.row, rest.col, level, row_number() OVER (PARTITION BY rest.zone, rest.row, rest.col ORDER BY (rest.row-kept.row)*(rest.row-kept.row)+(rest.col-kept.col)*(rest.col-kept.col), level) AS rn FROM rest JOIN kept ON kept.zone=rest.zone) WHERE rn=1),
 a AS (SELECT * FROM kept UNION ALL SELECT * FROM near UNION ALL SELECT zone, row, col, 2 FROM rest WHERE zone NOT IN (SELECT zone FROM kept))"""


@query("assign_levels_g4", ASSIGN + " SELECT zone, row, col, CAST(level AS INTEGER) AS level FROM a")
def _(spark, sf):
    c, lv, m = level_input(spark, sf)
    return regions.assign_levels(c, lv, m)


@query("zone_parts_g7", ASSIGN + """, e2 AS (SELECT a.zone, a.level, a.row*2147483648+a.col AS u, b.row*2147483648+b.col AS v FROM a JOIN a b ON a.zone=b.zone AND a.level=b.level AND abs(a.row-b.row)<=1 AND abs(a.col-b.col)<=1),
 r2 AS (SELECT zone, level, row*2147483648+col AS id, row*2147483648+col AS root FROM a UNION SELECT r2.zone, r2.level, e2.v, r2.root FROM r2 JOIN e2 ON e2.zone=r2.zone AND e2.level=r2.level AND e2.u=r2.id AND r2.root<e2.v),
 k2 AS (SELECT zone, level, id, min(root) AS component FROM r2 GROUP BY zone, level, id),
 p AS (SELECT zone, level, component, count(*) AS cells, count(*)*400e0 AS area_m2 FROM k2 GROUP BY zone, level, component HAVING count(*)*400e0>=2000e0),
 w AS (SELECT zone, 2 AS level, -1 AS component, count(*) AS cells, count(*)*400e0 AS area_m2 FROM a WHERE zone NOT IN (SELECT zone FROM p) GROUP BY zone)
 SELECT zone, level, component, cells, area_m2, 2e0+(CASE level WHEN 0 THEN 5e0 WHEN 1 THEN 20e0 ELSE 40e0 END) AS roof_z FROM (SELECT * FROM p UNION ALL SELECT * FROM w)""")
def _(spark, sf):
    c, lv, m = level_input(spark, sf)
    info = lv.selectExpr("zone", "2D as ground_z", "levels", "'lidar_local_ground_and_roof_modes' as source", "cast(array() as array<string>) as reasons")
    parts = regions.zone_parts(settle(regions.assign_levels(c, lv, m)), info, RES, min_area=2000.0)
    return parts.select("zone", "level", "component", "cells", "area_m2", "roof_z")


@query("zone_ids_w9", """WITH z AS (SELECT zone, col*20e0 AS x, -row*20e0 AS y FROM f_zones), m AS (SELECT zone, avg(y) AS my, avg(x) AS mx FROM z GROUP BY zone), b AS (SELECT (min(x)+max(x))/2 AS cx, (min(y)+max(y))/2 AS cy FROM z)
 SELECT zone, 'PLAN_BUILDING_'||CASE WHEN n<10 THEN '0'||n ELSE ''||n END AS building_id, mx-cx AS mean_x, my-cy AS mean_y FROM (SELECT *, row_number() OVER (ORDER BY my DESC, mx, zone) AS n FROM m), b""")
def _(spark, sf):
    return regions.zone_ids(zones(spark, sf).selectExpr("zone", "col*20D as x", "-row*20D as y"))


@query("plan_mask_s9", """WITH p AS (SELECT l_orderkey%300 AS row, l_partkey%400 AS col, 140+l_suppkey%130 AS r, 100+l_partkey%140 AS g, 50+l_orderkey%160 AS b FROM lineitem)
 SELECT row, col FROM p WHERE r>160 AND r<245 AND g>120 AND g<220 AND b>70 AND b<190 AND r-g>10 AND g-b>10 AND col>=5 AND col<390 AND row>=10 AND row<280""")
def _(spark, sf):
    px = fx.table(spark, sf, "lineitem").selectExpr("l_orderkey%300 as row", "l_partkey%400 as col", "140+l_suppkey%130 as r", "100+l_partkey%140 as g", "50+l_orderkey%160 as b")
    return tables.plan_mask(px, crop=(5, 10, 390, 280))


RINGS = """WITH v AS (SELECT l_suppkey%40 AS ring_id, l_partkey*1e0 AS x, l_extendedprice AS y, row_number() OVER (PARTITION BY l_suppkey%40 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate)-1 AS seq FROM lineitem),
 e AS (SELECT ring_id, seq, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM v WINDOW w AS (PARTITION BY ring_id ORDER BY seq))"""


def rings(spark, sf):
    from gridwright.functions.ranking import global_position
    v = fx.table(spark, sf, "lineitem").selectExpr("l_suppkey%40 as ring_id", "l_partkey*1D as x", "l_extendedprice as y", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "y", "l_shipdate")]
    return global_position(v, ["ring_id"], order, "seq", ["x", "y"]).select("ring_id", (F.col("seq") - 1).alias("seq"), "x", "y")


@query("ring_edges_w8", RINGS + " SELECT ring_id, seq, x, y, x2, y2 FROM e")
def _(spark, sf):
    return labels.ring_edges(rings(spark, sf))


@query("ring_area_w8", RINGS + " SELECT ring_id, sum(x*y2-x2*y)/2 AS signed_area FROM e GROUP BY ring_id")
def _(spark, sf):
    return labels.ring_area(rings(spark, sf))


@query("boundary_samples_w8", RINGS + """, n AS (SELECT *, CAST(greatest(1, ceil(sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y))/20000e0)) AS BIGINT) AS n FROM e)
 SELECT ring_id, seq, CAST(k AS INTEGER) AS step, x+(x2-x)*(CAST(k AS DOUBLE)/n) AS x, y+(y2-y)*(CAST(k AS DOUBLE)/n) AS y FROM n, range(20) t(k) WHERE k<n""")
def _(spark, sf):
    return labels.boundary_samples(rings(spark, sf), 20000.0)


ALIGN_ROT, ALIGN_SCALE, ALIGN_SHIFT = [-2.0, 0.0, 2.0], [0.045, 0.05], [-5.0, 0.0, 5.0]


@query("alignment_score_a26", f"""WITH b AS (SELECT x-550e0 AS x, y-450e0 AS y FROM f_points WHERE band='n41'),
 k AS (SELECT (i*2+j)*9+u*3+v AS candidate, [-2e0,0e0,2e0][i+1] AS rot, [0.045e0,0.05e0][j+1] AS s, [-5e0,0e0,5e0][u+1] AS dc, [-5e0,0e0,5e0][v+1] AS dr FROM range(3) a(i), range(2) c(j), range(3) d(u), range(3) f(v)),
 h AS (SELECT candidate, CAST(round_even((50-1)/2e0+dc+s*(cos(radians(rot))*x-sin(radians(rot))*y),0) AS BIGINT) AS col, CAST(round_even((40-1)/2e0+dr-s*(sin(radians(rot))*x+cos(radians(rot))*y),0) AS BIGINT) AS row FROM b, k),
 e AS (SELECT row, col FROM f_cells WHERE dsm>=51), r AS (SELECT DISTINCT row, col FROM h WHERE row BETWEEN 0 AND 39 AND col BETWEEN 0 AND 49),
 d AS (SELECT r.row, r.col, min(sqrt(CAST((r.row-e.row)*(r.row-e.row)+(r.col-e.col)*(r.col-e.col) AS DOUBLE))) AS d FROM r, e GROUP BY ALL),
 s AS (SELECT candidate, avg(CASE WHEN h.row BETWEEN 0 AND 39 AND h.col BETWEEN 0 AND 49 THEN 1e0 ELSE 0e0 END) AS coverage, quantile_cont(d,0.5) AS m, quantile_cont(d,0.8) AS p FROM h LEFT JOIN d ON d.row=h.row AND d.col=h.col GROUP BY candidate)
 SELECT candidate, CASE WHEN coverage<0.85 THEN 1e6 ELSE m+0.35e0*p+20e0*(1-coverage) END AS score, coverage, CASE WHEN coverage<0.85 THEN 1e6 ELSE p END AS p80 FROM s""")
def _(spark, sf):
    b = fx.points(spark, sf).filter("band='n41'").selectExpr("x-550D as x", "y-450D as y")
    dist = regions.distance_raster(cells(spark, sf).filter("dsm >= 51"), 40, 50)
    cand = raster.candidate_grid(spark, ALIGN_ROT, ALIGN_SCALE, ALIGN_SHIFT)
    return raster.alignment_scores(cand, b, dist, 40, 50)


def register_stage(n: int, centre: str, axes: tuple) -> str:
    """SQL of one stage over every candidate: o<n> has the first minimum of each band."""
    rot, scale, shift = ("[" + ",".join(f"{float(v)!r}e0" for v in a) + "]" for a in axes)
    nr, ns, nt = map(len, axes)
    pick = "min(d) FILTER (up>{f}({q}e0*(ins-1)))"
    line = lambda q: f"{pick.format(f='floor', q=q)}+({pick.format(f='ceil', q=q)}-{pick.format(f='floor', q=q)})*any_value({q}e0*(ins-1)-floor({q}e0*(ins-1)))"
    return f"""p{n} AS (SELECT k.band, i*{ns}+j AS pose, k.rotation+{rot}[i+1] AS rot, k.scale+{scale}[j+1] AS s, k.dcol, k.drow FROM {centre} k, range({nr}) a(i), range({ns}) c(j)),
 q{n} AS (SELECT band, pose, CAST(round_even((nc-1)/2e0+0e0+s*(cos(radians(rot))*x-sin(radians(rot))*y),0) AS BIGINT) AS col,
   CAST(round_even((nr-1)/2e0+0e0-s*(sin(radians(rot))*x+cos(radians(rot))*y),0) AS BIGINT) AS row, count(*) AS n FROM b JOIN p{n} USING (band), w GROUP BY ALL),
 m{n} AS (SELECT band, pose, (pose*{nt}+u)*{nt}+v AS candidate, rot AS rotation, s AS scale, dcol+{shift}[u+1] AS dcol, drow+{shift}[v+1] AS drow FROM p{n}, range({nt}) uu(u), range({nt}) vv(v)),
 h{n} AS (SELECT m.band, m.candidate, dist.d, CAST(sum(q.n) AS BIGINT) AS n FROM q{n} q JOIN m{n} m ON q.band=m.band AND q.pose=m.pose LEFT JOIN dist ON dist.row=q.row+CAST(m.drow AS BIGINT) AND dist.col=q.col+CAST(m.dcol AS BIGINT) GROUP BY ALL),
 t{n} AS (SELECT band, candidate, sum(n) AS al, coalesce(sum(CASE WHEN d IS NOT NULL THEN n END),0) AS ins FROM h{n} GROUP BY ALL),
 l{n} AS (SELECT h.band, h.candidate, h.d, t.ins, sum(h.n) OVER (PARTITION BY h.band, h.candidate ORDER BY h.d) AS up FROM h{n} h JOIN t{n} t ON h.band=t.band AND h.candidate=t.candidate WHERE h.d IS NOT NULL AND t.ins>=0.85e0*t.al),
 v{n} AS (SELECT band, candidate, {line("0.5")} AS md, {line("0.8")} AS p8 FROM l{n} GROUP BY ALL),
 z{n} AS (SELECT t.band, t.candidate, t.ins/CAST(t.al AS DOUBLE) AS coverage, coalesce(v.md+0.35e0*v.p8+20e0*(1e0-t.ins/CAST(t.al AS DOUBLE)),1e6) AS score, coalesce(v.p8,1e6) AS p80 FROM t{n} t LEFT JOIN v{n} v ON t.band=v.band AND t.candidate=v.candidate),
 o{n} AS (SELECT {n} AS stage, band, candidate, score, coverage, p80, rotation, scale, dcol, drow FROM (SELECT z.*, row_number() OVER (PARTITION BY z.band ORDER BY z.score, z.candidate) AS rn FROM z{n} z) z JOIN m{n} m USING (band, candidate) WHERE rn=1)"""


NOMINAL = 0.05  # cells a metre


@query("register_plans_a26", f"""WITH b AS (SELECT band, x-550e0 AS x, y-450e0 AS y FROM f_points), k0 AS (SELECT DISTINCT band, 0e0 AS rotation, 0e0 AS scale, 0e0 AS dcol, 0e0 AS drow FROM b),
 w AS (SELECT max(row)+1 AS nr, max(col)+1 AS nc FROM f_cells), ed AS (SELECT row, col FROM f_cells WHERE dsm>=51),
 g1 AS (SELECT unnest(range(nr)) AS row, nc FROM w), gd AS (SELECT row, unnest(range(nc)) AS col FROM g1),
 dist AS (SELECT g.row, g.col, min(sqrt(CAST((g.row-e.row)*(g.row-e.row)+(g.col-e.col)*(g.col-e.col) AS DOUBLE))) AS d FROM gd g, ed e GROUP BY g.row, g.col),
 {register_stage(1, "k0", (raster.COARSE[0], [NOMINAL * v for v in raster.COARSE[1]], raster.COARSE[2]))},
 {register_stage(2, "o1", raster.FINE)}
 SELECT band, stage, candidate, score, coverage, p80, rotation, scale, dcol, drow FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY score, stage) AS pick FROM (SELECT * FROM o1 UNION ALL SELECT * FROM o2)) WHERE pick=1""")
def _(spark, sf):
    """Both bands, both stages, all 23,409 + 5,103 candidates of each, on the raster of the table."""
    c = cells(spark, sf)
    size = c.agg(F.max("row") + 1, F.max("col") + 1).first()
    samples = fx.points(spark, sf).selectExpr("band", "x-550D as x", "y-450D as y")
    return raster.register_plans(samples, settle(regions.distance_raster(c.filter("dsm >= 51"), *size)), *size, NOMINAL, ["band"])


# --- faces ----------------------------------------------------------------------------------------

def face_geometry(spark, sf):
    return labels.valid_triangles(labels.triangle_geometry(fx.boxes(spark, sf)))


@query("triangle_geometry_p4", "SELECT fid, nx, ny, nz, area, gx, gy, gz FROM f_facegeo")
def _(spark, sf):
    return face_geometry(spark, sf).select("fid", "nx", "ny", "nz", "area", "gx", "gy", "gz")


@query("resolve_face_vertices_j10", "SELECT fid, ax, ay, az, bx, \"by\" AS b_y, bz, cx, cy, cz FROM f_boxes")
def _(spark, sf):
    f = fx.boxes(spark, sf)
    # split the boxes into an indexed mesh, then resolve the indices again
    key = lambda s: F.concat_ws(",", F.col("part_id"), F.col(f"{s}.x"), F.col(f"{s}.y"), F.col(f"{s}.z"))
    faces = f.select("fid", F.array(key("a"), key("b"), key("c")).alias("v"))
    verts = f.select(F.explode(F.array(*[F.struct(key(s).alias("vid"), f"{s}.x", f"{s}.y", f"{s}.z") for s in "abc"])).alias("_v")).select("_v.*").distinct()
    r = labels.resolve_vertices(faces, verts)
    return r.select("fid", *[F.col(f"{s}.{ax}").alias("b_y" if s + ax == "by" else f"{s}{ax}") for s in "abc" for ax in "xyz"])


CATEGORY = """CASE WHEN n LIKE '%glass%' THEN 'glass' WHEN n LIKE '%curtain%' THEN 'glass' WHEN n LIKE '%water%' THEN 'water' WHEN n LIKE '%asphalt%' THEN 'asphalt' WHEN n LIKE '%road%' THEN 'asphalt'
 WHEN n LIKE '%vegetation%' THEN 'vegetation' WHEN n LIKE '%grass%' THEN 'vegetation' WHEN n LIKE '%limestone%' THEN 'limestone' WHEN n LIKE '%stone%' THEN 'stone' WHEN n LIKE '%concrete%' THEN 'concrete'
 WHEN n LIKE '%metal%' THEN 'metal_roof' WHEN n LIKE '%roof%' THEN 'roof' WHEN n LIKE '%soil%' THEN 'soil' WHEN n LIKE '%terrain%' THEN 'ground' WHEN n LIKE '%ground%' THEN 'ground' END"""


@query("category_from_name_p5", f"""SELECT fid, {CATEGORY} AS category, n LIKE '%ground%' OR n LIKE '%terrain%' OR n LIKE '%road%' OR n LIKE '%asphalt%' OR n LIKE '%water%' OR n LIKE '%vegetation%' AS is_ground FROM (SELECT fid, replace(replace(lower(name),'-','_'),' ','_') AS n FROM f_boxes)""")
def _(spark, sf):
    return fx.boxes(spark, sf).select("fid", col.category_from_name(F.col("name")).alias("category"), col.is_ground_name(F.col("name")).alias("is_ground"))


MATERIAL = "CASE " + " ".join(f"WHEN c='{k}' THEN '{v}'" for k, v in labels.MATERIAL_OF.items()) + " ELSE 'unknown' END"


@query("map_material_p6", f"""SELECT entity_id, category, {MATERIAL} AS material, CASE WHEN {MATERIAL}='unknown' THEN 0e0 ELSE 0.65e0 END AS confidence, 'UNCALIBRATED_VISUAL_ENGINEERING_PRIOR' AS provenance
 FROM (SELECT entity_id, category, lower(trim(category)) AS c FROM f_evidence)""")
def _(spark, sf):
    e = fx.evidence(spark, sf).select("entity_id", "category")
    return labels.map_material(e, F.col("category")).select("entity_id", "category", "material", "confidence", "provenance")


@query("bounded_override_p7", """SELECT p_partkey, CASE WHEN p_partkey%3=0 THEN NULL ELSE p_size*0.1e0 END AS lo, CASE WHEN p_partkey%3=0 THEN NULL ELSE p_size*0.1e0+p_partkey%5 END AS hi FROM part""")
def _(spark, sf):
    p = fx.table(spark, sf, "part").selectExpr("p_partkey", "case when p_partkey%3=0 then null else p_size*0.1D end as a", "case when p_partkey%3=0 then null else p_size*0.1D+p_partkey%5 end as b")
    return p.select("p_partkey", col.bounded_pair(F.col("a"), F.col("b")).alias("r")).select("p_partkey", "r.lo", "r.hi")


@query("label_ground_p8", f"""WITH c AS (SELECT fid, nz, gz, {CATEGORY} AS c FROM (SELECT *, replace(replace(lower(name),'-','_'),' ','_') AS n FROM f_facegeo)),
 t AS (SELECT gz+1 AS low FROM (SELECT gz, row_number() OVER (ORDER BY gz)-1 AS r, count(*) OVER () AS n FROM c) WHERE r=least(n-1,n//5))
 SELECT fid, CASE WHEN c IN ('road','asphalt') THEN 'road' WHEN c IN ('walkway','stone','stone_paving','paving') THEN 'walkway' WHEN c='water' THEN 'water' WHEN c IN ('vegetation','grass') THEN 'vegetation' WHEN c IN ('ground','terrain','soil') THEN 'terrain'
  WHEN abs(nz)>=0.85 AND gz<=low THEN 'terrain' ELSE 'unknown' END AS ground FROM c, t""")
def _(spark, sf):
    return labels.label_ground(face_geometry(spark, sf), col.category_from_name(F.col("name"))).select("fid", "ground")


EVIDENCE = f"""WITH b AS (SELECT min(z_lo) AS z0, max(z_hi) AS z1 FROM f_facegeo), t AS (SELECT *, z0+greatest(1,(z1-z0)*0.05e0) AS low, replace(replace(lower(name),'-','_'),' ','_') AS n FROM f_facegeo, b),
 ev AS (SELECT 'face:'||fid AS entity_id, 'face' AS level, {CATEGORY} AS category, 'existing_mesh_semantic' AS source, 0.95e0 AS confidence, 0.95e0 AS reliability FROM t WHERE {CATEGORY} IS NOT NULL
 UNION ALL SELECT 'face:'||fid, 'face', CASE WHEN abs(nz)>=0.85 AND gz<=low THEN 'ground' WHEN abs(nz)>=0.85 THEN 'roof' WHEN abs(nz)<=0.35 THEN 'wall' ELSE 'other_surface' END, 'geometry',
  CASE WHEN abs(nz)>=0.85 AND gz<=low THEN 0.75e0 WHEN abs(nz)>=0.85 THEN 0.6e0 WHEN abs(nz)<=0.35 THEN 0.65e0 ELSE 0.4e0 END, 0.7e0 FROM t)"""


@query("geometry_evidence_p9", EVIDENCE + " SELECT * FROM ev")
def _(spark, sf):
    return labels.geometry_evidence(face_geometry(spark, sf), F.col("name"))


@query("read_annotations_s7", """SELECT doc_id AS face_id, CASE WHEN quality=1 THEN 'wall' ELSE 'roof' END AS category, CASE WHEN toxic=1 THEN 0.5e0 ELSE 1e0 END AS confidence FROM labels""")
def _(spark, sf):
    # one JSON document per row here; the reader feeds the same parser from files
    doc = fx.table(spark, sf, "labels").select(F.create_map(
        F.col("doc_id").cast("string"), F.expr("case when toxic=1 then to_json(struct(case when quality=1 then 'wall' else 'roof' end as category, 0.5D as confidence)) else case when quality=1 then 'wall' else 'roof' end end")).alias("face_labels"))
    return tables.explode_annotations(doc)


@query("fuse_evidence_a8", """WITH s AS (SELECT entity_id, category, sum(confidence*reliability) AS s FROM f_evidence GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY s DESC, category) AS rn, sum(s) OVER (PARTITION BY entity_id) AS t0, coalesce(nth_value(s,2) OVER (PARTITION BY entity_id ORDER BY s DESC, category ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING),0) AS second FROM s),
 b AS (SELECT entity_id, category, s, CASE WHEN t0=0 THEN 1 ELSE t0 END AS t, second FROM r WHERE rn=1),
 c AS (SELECT *, s<0.35e0 OR s/t<0.55e0 OR (s-second)/t<0.1e0 AS conflict FROM b)
 SELECT entity_id, CASE WHEN conflict THEN 'unknown' ELSE category END AS category, s/t AS confidence, s AS best_score, (s-second)/t AS margin, conflict,
  CASE WHEN conflict THEN 'manual_review' WHEN category='glass' THEN 'merge_component' WHEN category IN ('wall','roof') THEN 'regularize_plane' ELSE 'keep_boundary' END AS policy,
  (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT source AS x FROM f_evidence e WHERE e.entity_id=c.entity_id)) AS sources FROM c""")
def _(spark, sf):
    return labels.fuse_evidence(fx.evidence(spark, sf)).select(
        "entity_id", "category", "confidence", "best_score", "margin", "conflict", "policy", F.array_join("sources", ",").alias("sources"))


@query("group_buildings_a9", """SELECT CASE WHEN n=1 THEN safe ELSE safe||'_'||n END AS object_id, source_name, face_count, height_m FROM (SELECT *, row_number() OVER (PARTITION BY safe ORDER BY source_name) AS n FROM (
 SELECT name AS source_name, replace(name,' ','_') AS safe, count(*) AS face_count, max(z_hi)-min(z_lo) AS height_m FROM (SELECT * REPLACE (CASE WHEN part_id%16=1 THEN 'curtain_wall' ELSE name END AS name) FROM f_facegeo) GROUP BY name))""")
def _(spark, sf):
    f = face_geometry(spark, sf).withColumn("name", F.expr("case when part_id%16=1 then 'curtain_wall' else name end"))
    return labels.group_buildings(f)[1]


EDGE = """WITH c AS (SELECT part_id, UNNEST([{'p':printf('%010d,%010d,%010d',CAST(ax*1e6 AS BIGINT),CAST(ay*1e6 AS BIGINT),CAST(az*1e6 AS BIGINT)),'q':printf('%010d,%010d,%010d',CAST(bx*1e6 AS BIGINT),CAST("by"*1e6 AS BIGINT),CAST(bz*1e6 AS BIGINT))},
  {'p':printf('%010d,%010d,%010d',CAST(bx*1e6 AS BIGINT),CAST("by"*1e6 AS BIGINT),CAST(bz*1e6 AS BIGINT)),'q':printf('%010d,%010d,%010d',CAST(cx*1e6 AS BIGINT),CAST(cy*1e6 AS BIGINT),CAST(cz*1e6 AS BIGINT))},
  {'p':printf('%010d,%010d,%010d',CAST(cx*1e6 AS BIGINT),CAST(cy*1e6 AS BIGINT),CAST(cz*1e6 AS BIGINT)),'q':printf('%010d,%010d,%010d',CAST(ax*1e6 AS BIGINT),CAST(ay*1e6 AS BIGINT),CAST(az*1e6 AS BIGINT))}]) AS e FROM f_boxes),
 k AS (SELECT part_id, least(e.p,e.q) AS p, greatest(e.p,e.q) AS q FROM c)"""


@query("edge_audit_a10", EDGE + " SELECT part_id, count(*) AS edges, count(*) FILTER (n<>2) AS non_manifold_edges FROM (SELECT part_id, p, q, count(*) AS n FROM k GROUP BY ALL) GROUP BY part_id")
def _(spark, sf):
    return labels.edge_audit(fx.boxes(spark, sf))


@query("shared_edges_a10", EDGE + " SELECT count(*) AS cross_part_edges FROM (SELECT p, q FROM k GROUP BY p, q HAVING count(DISTINCT part_id)>1)")
def _(spark, sf):
    return labels.shared_edges(fx.boxes(spark, sf))


CONSENSUS = """cons AS (SELECT ix, iy, iz, label, CAST(round_even(conf/CAST(greatest(1,cnt) AS DOUBLE),0) AS BIGINT) AS confidence, CAST(least(65535,cnt) AS BIGINT) AS count FROM (SELECT *, row_number() OVER (PARTITION BY ix, iy, iz ORDER BY score DESC, label) AS rn FROM (
 SELECT ix, iy, iz, label, sum(greatest(1,count)*greatest(1,confidence)) AS score, sum(count) AS cnt, sum(confidence*greatest(1,count)) AS conf FROM f_voxels GROUP BY ALL)) WHERE rn=1)"""


@query("voxel_consensus_a6", f"WITH {CONSENSUS} SELECT * FROM cons")
def _(spark, sf):
    return labels.voxel_consensus(fx.voxels(spark, sf))


HITS = f"""WITH {CONSENSUS}, s AS (SELECT *, CAST(floor(px) AS BIGINT) AS bx, CAST(floor(py) AS BIGINT) AS b_y, CAST(floor(pz) AS BIGINT) AS bz FROM f_samples),
 o AS (SELECT a, b, c FROM range(-2,3) x(a), range(-2,3) y(b), range(-2,3) z(c)), d AS (SELECT DISTINCT bx, b_y, bz FROM s),
 n AS (SELECT * FROM (SELECT bx, b_y, bz, label, confidence, count, sqrt(CAST(a*a+b*b+c*c AS DOUBLE)) AS distance, row_number() OVER (PARTITION BY bx, b_y, bz ORDER BY a*a+b*b+c*c, -count, -confidence, label) AS rn FROM d, o JOIN cons ON ix=bx+a AND iy=b_y+b AND iz=bz+c) WHERE rn=1),
 h AS (SELECT s.sample_id, surface_id, surface_type, n.label, n.confidence, n.count, n.distance FROM s LEFT JOIN n ON n.bx=s.bx AND n.b_y=s.b_y AND n.bz=s.bz)"""


@query("nearest_voxel_j5", HITS + " SELECT sample_id, label, confidence, count, distance FROM h")
def _(spark, sf):
    return labels.nearest_voxel(fx.samples(spark, sf), labels.voxel_consensus(fx.voxels(spark, sf))).select("sample_id", "label", "confidence", "count", "distance")


@query("surface_votes_a7", HITS + """, v AS (SELECT surface_id, surface_type, label, sum(greatest(1,least(count,100))*(confidence/255e0)/(1e0+distance)) AS vote, avg(confidence/255e0) AS mean FROM h
  WHERE label IS NOT NULL AND ((surface_type='facade' AND label IN (7,8,9)) OR (surface_type='roof' AND label IN (6,7,9)) OR (surface_type='base' AND label IN (7,9))) GROUP BY ALL),
 t AS (SELECT * FROM (SELECT *, sum(vote) OVER (PARTITION BY surface_id) AS total, row_number() OVER (PARTITION BY surface_id ORDER BY vote DESC, label) AS rn FROM v) WHERE rn=1),
 z AS (SELECT surface_id, surface_type, count(*) AS samples, count(label)/CAST(count(*) AS DOUBLE) AS hit_rate FROM h GROUP BY ALL),
 r AS (SELECT z.*, t.label AS lb, coalesce(vote/total,0e0) AS share, CASE WHEN t.label IS NOT NULL THEN hit_rate*(vote/total)*mean WHEN z.surface_type IN ('roof','facade') THEN 0.25e0 ELSE 0.1e0 END AS confidence FROM z LEFT JOIN t ON t.surface_id=z.surface_id)
 SELECT surface_id, surface_type, samples, hit_rate, share, confidence, CASE lb WHEN 6 THEN 'roof_surface' WHEN 7 THEN 'concrete_exterior_wall' WHEN 8 THEN 'glass_facade' WHEN 9 THEN 'other_building_surface' ELSE CASE surface_type WHEN 'roof' THEN 'roof_surface' WHEN 'facade' THEN 'other_building_surface' ELSE 'structural_base' END END AS label,
  CASE WHEN lb IS NOT NULL AND hit_rate>=0.35 AND share>=0.6 AND confidence>=0.45 THEN 'AUTO_ACCEPTED_VISUAL_PRIOR' ELSE 'REVIEW_REQUIRED' END AS status FROM r""")
def _(spark, sf):
    hits = labels.nearest_voxel(fx.samples(spark, sf), labels.voxel_consensus(fx.voxels(spark, sf)))
    return labels.surface_votes(hits).select("surface_id", "surface_type", "samples", "hit_rate", "share", "confidence", "label", "status")


@query("surface_sample_cap_t4", """WITH f AS (SELECT part_id%50 AS s, * FROM f_boxes), p AS (
 """ + " UNION ALL ".join(f"SELECT s, fid*7+{j} AS o, {x} AS px, {y} AS py, {z} AS pz FROM f" for j, (x, y, z) in enumerate([
    ("ax", "ay", "az"), ("bx", '"by"', "bz"), ("cx", "cy", "cz"), ("(ax+bx+cx)/3e0", '(ay+"by"+cy)/3e0', "(az+bz+cz)/3e0"),
    ("(ax+bx)/2e0", '(ay+"by")/2e0', "(az+bz)/2e0"), ("(bx+cx)/2e0", '("by"+cy)/2e0', "(bz+cz)/2e0"), ("(cx+ax)/2e0", "(cy+ay)/2e0", "(cz+az)/2e0")])) + """),
 d AS (SELECT s, px, py, pz, min(o) AS o FROM p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY o) AS pos, count(*) OVER (PARTITION BY s) AS n FROM d)
 SELECT s AS surface_id, px, py, pz, pos AS position FROM r WHERE n<=400 OR EXISTS (SELECT 1 FROM range(400) t(i) WHERE (i*n)//400=pos-1)""")
def _(spark, sf):
    return labels.surface_samples(fx.boxes(spark, sf).withColumn("surface_id", F.col("part_id") % 50))


@query("path_power_p15", "SELECT receiver, CASE WHEN sum(re*re+im*im)>0 THEN 10e0*log10(sum(re*re+im*im)) END AS power_db, count(*) AS paths FROM f_paths GROUP BY receiver")
def _(spark, sf):
    p = fx.paths(spark, sf).groupBy("receiver").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("_p"), F.count(F.lit(1)).alias("paths"))
    return p.select("receiver", col.path_power_db(F.col("_p")).alias("power_db"), "paths")


@query("distinct_receivers_a34", """WITH u AS (SELECT x, y, z, row_number() OVER (ORDER BY x, y, z)-1 AS receiver_id FROM (SELECT DISTINCT x, y, z FROM f_points)) SELECT point_id, receiver_id FROM f_points JOIN u USING (x, y, z)""")
def _(spark, sf):
    return tables.distinct_receivers(fx.points(spark, sf))[1]


@query("label_counts_k4", "SELECT category, count(*) AS n FROM f_evidence GROUP BY category")
def _(spark, sf):
    return tables.label_counts(fx.evidence(spark, sf), "category")


@query("evaluate_gates_a35", """SELECT true AS footprints, true AS registration, CAST((SELECT count(DISTINCT part_id) FROM f_boxes WHERE part_id%4<>0) AS DOUBLE)/(SELECT count(DISTINCT part_id) FROM f_boxes)>=0.75 AS height, false AS geometry, true AS materials, 'NO_GO' AS status""")
def _(spark, sf):
    f = fx.boxes(spark, sf)
    m = labels.edge_audit(f).agg(F.sum("non_manifold_edges").alias("non_manifold_edges"), F.count(F.lit(1)).alias("building_count"), F.count_if(F.col("part_id") % 4 != 0).alias("direct_heights"))
    return score.evaluate_gates(m.withColumn("registration_status", F.lit("PASS_AUTOMATIC_ASSOCIATION")).withColumn("mean_hit_rate", F.lit(0.6)))


@query("mesh_lines_k2", """WITH f AS (SELECT *, row_number() OVER (ORDER BY fid)-1 AS n FROM f_boxes), g AS (SELECT n, name, 'mat'||part_id%3 AS m, part_id, lag(name) OVER (ORDER BY n) AS pn, lag('mat'||part_id%3) OVER (ORDER BY n) AS pm FROM f)
 SELECT 1 AS section, n AS line_no, 0 AS part, 'o '||name AS line FROM g WHERE pn IS NULL OR pn<>name UNION ALL SELECT 1, n, 1, 'usemtl '||m FROM g WHERE pm IS NULL OR pm<>m
 UNION ALL SELECT 1, n, 2, 'f '||(3*n+1)||' '||(3*n+2)||' '||(3*n+3) FROM g""")
def _(spark, sf):
    from gridwright.functions.ranking import global_position
    f = global_position(fx.boxes(spark, sf), [], [F.col("fid")], "_pos").withColumn("n", F.col("_pos") - 1)
    f = settle(f)
    faces = f.select(F.col("n").alias("fid"), F.col("name").alias("object"), F.concat(F.lit("mat"), F.col("part_id") % 3).alias("material"),
                     F.array(F.col("n") * 3, F.col("n") * 3 + 1, F.col("n") * 3 + 2).alias("v"))
    none = f.select(F.col("n").alias("vid"), F.col("a.x").alias("x"), F.col("a.y").alias("y"), F.col("a.z").alias("z")).limit(0)
    return meshes.mesh_lines(none, faces).selectExpr("section", "line_no", "part", "line")
