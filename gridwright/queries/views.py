"""SQL text of the fixture views (see ``gridwright.fixtures``) for the oracle side."""


VIEWS: dict[str, str] = {}

VIEWS["f_points"] = """
SELECT point_id, CAST(ix AS DOUBLE) AS x, CAST(iy AS DOUBLE) AS y, CAST(1.5 AS DOUBLE) AS z,
  CASE WHEN point_id%2=0 THEN 'n41' ELSE 'n79' END AS band,
  CASE WHEN (ix*31+iy*17)%5=0 THEN 'query' ELSE 'train' END AS role,
  user_id%50 AS trajectory_group,
  lpad(CAST(month(ts)*100+day(ts) AS VARCHAR),4,'0') AS date,
  -60e0 - value/10e0 AS observed_dbm, point_id%3=0 AS los
FROM (SELECT event_id AS point_id, user_id, value, ts,
  (user_id*37)%1000 + (event_id*17)%97 AS ix, (user_id*61)%800 + (event_id*29)%89 AS iy FROM events)"""

VIEWS["f_train"] = "SELECT * FROM f_points WHERE role='train'"
VIEWS["f_query"] = "SELECT * FROM f_points WHERE role='query'"

VIEWS["f_base"] = """
SELECT *, CASE WHEN point_id%11=0 THEN NULL ELSE -30e0 - 20e0*log10(greatest(d3,1e0)) + ((point_id*7)%11-5)/2e0 END AS raw
FROM (SELECT *, CASE WHEN band='n41'
  THEN sqrt((x-134e0)*(x-134e0)+(y-45e0)*(y-45e0)+(z-37e0)*(z-37e0))
  ELSE sqrt((x-137e0)*(x-137e0)+(y-188e0)*(y-188e0)+(z-17e0)*(z-17e0)) END AS d3 FROM f_points)"""

VIEWS["f_configs"] = """
SELECT CAST(c AS INTEGER) AS config_ord,
  CASE WHEN c=0 THEN 'AUTO_BASE' WHEN c<10 THEN 'S4W_'||lpad(CAST(c AS VARCHAR),2,'0')
       ELSE 'S5_'||lpad(CAST(c AS VARCHAR),2,'0') END AS config_id,
  CASE WHEN c=0 THEN 'BASE' WHEN c<10 THEN 'S4W' ELSE 'S5' END AS family
FROM range(13) t(c)"""

VIEWS["f_gains"] = """
SELECT point_id, band, config_ord, config_id, family, los,
  CASE WHEN point_id%11=0 THEN NULL ELSE -30e0 - 20e0*log10(greatest(d3,1e0))
    - 0.5e0*config_ord*(CASE WHEN los THEN 0 ELSE 1 END) + ((point_id*7+config_ord*13)%11-5)/2e0 END AS gain_db
FROM f_base, f_configs"""

VIEWS["f_pred"] = """
SELECT point_id, band, date, trajectory_group, role, x, y, CAST(m AS INTEGER) AS method_ord, 'M'||m AS method,
  observed_dbm, observed_dbm + ((point_id*(2*m+3))%21-10)/2e0 + 0.1e0*m AS pred, trajectory_group%5 AS outer_fold
FROM f_points, range(10) t(m)"""

VIEWS["f_variants"] = """
SELECT b.point_id, band, date, trajectory_group, trajectory_group%5 AS outer_fold,
  (CASE m WHEN 0 THEN 'U2' WHEN 1 THEN 'WEDT_P' ELSE 'ONETWIN' END) AS method, 'AUTO_BASE' AS config_id,
  observed_dbm, raw IS NOT NULL AS path_available, variant,
  CASE variant WHEN 'BASE' THEN raw+m WHEN 'BASE_MEAN_FILL' THEN coalesce(raw+m,-85e0)
    WHEN 'IDW' THEN raw+m+((point_id*5)%9-4)/2e0
    ELSE coalesce(raw+m+((point_id*5)%9-4)/2e0, -80e0-point_id%7) END AS predicted_dbm
FROM f_base b, range(3) t(m), (VALUES ('BASE'),('BASE_MEAN_FILL'),('IDW'),('IDW_FILL')) v(variant)"""

VIEWS["f_arms"] = """
SELECT point_id, band, method, date, trajectory_group, outer_fold, config_id, observed_dbm, path_available, arm,
  arm IN ('R1_MEAN','R1_SIGNAL_IDW') AS residual_idw,
  CASE WHEN arm IN ('R0_MEAN','R1_MEAN') THEN 'mean' ELSE 'signal_idw' END AS no_path_fill,
  predicted_dbm, predicted_dbm-observed_dbm AS error_db
FROM (SELECT w.*, arm, CASE arm WHEN 'R0_MEAN' THEN bm
     WHEN 'R0_SIGNAL_IDW' THEN CASE WHEN path_available THEN b ELSE f END
     WHEN 'R1_MEAN' THEN CASE WHEN path_available THEN i ELSE bm END ELSE f END AS predicted_dbm
  FROM (SELECT point_id, band, method, any_value(date) AS date, any_value(trajectory_group) AS trajectory_group,
     any_value(outer_fold) AS outer_fold, any_value(config_id) AS config_id, any_value(observed_dbm) AS observed_dbm,
     any_value(path_available) AS path_available,
     max(CASE WHEN variant='BASE' THEN predicted_dbm END) AS b, max(CASE WHEN variant='BASE_MEAN_FILL' THEN predicted_dbm END) AS bm,
     max(CASE WHEN variant='IDW' THEN predicted_dbm END) AS i, max(CASE WHEN variant='IDW_FILL' THEN predicted_dbm END) AS f
     FROM f_variants GROUP BY point_id, band, method) w,
  (VALUES ('R0_MEAN'),('R0_SIGNAL_IDW'),('R1_MEAN'),('R1_SIGNAL_IDW')) a(arm))"""

VIEWS["f_runs"] = """
SELECT band, outer_fold, mode, budget, repeat, method, count(*) AS n, avg(abs(e)) AS mae_db, sqrt(avg(e*e)) AS rmse_db, avg(e) AS bias_db
FROM (SELECT *, pred-observed_dbm AS e,
   CASE point_id%3 WHEN 0 THEN 'infill' WHEN 1 THEN 'spatial30' ELSE 'spatial60' END AS mode,
   CASE (point_id//3)%5 WHEN 0 THEN 30 WHEN 1 THEN 100 WHEN 2 THEN 300 WHEN 3 THEN 1000 ELSE 2500 END AS budget,
   CAST((point_id//15)%4 AS INTEGER) AS repeat FROM f_pred)
GROUP BY band, outer_fold, mode, budget, repeat, method"""

VIEWS["f_vertices"] = """
SELECT l_partkey%2000 + l_quantity/100e0 AS x, CAST((l_suppkey%1000)*10 + l_linenumber AS DOUBLE) AS y,
  l_extendedprice/2000e0 AS z FROM lineitem"""

VIEWS["f_bounds"] = "SELECT min(x) AS x0, max(y) AS y1, max(x) AS x1, min(y) AS y0 FROM f_vertices"

VIEWS["f_cells"] = """
SELECT row, col, min(z) AS dtm, quantile_disc(floor(z), 0.5) AS rep, max(z) AS dsm FROM (
 SELECT z, CAST(least(greatest(1, ceil((x1-x0)/20e0))-1, floor((x-x0)/20e0)) AS BIGINT) AS col,
  CAST(least(greatest(1, ceil((y1-y0)/20e0))-1, floor((y1-y)/20e0)) AS BIGINT) AS row FROM f_vertices, f_bounds) GROUP BY row, col"""

VIEWS["f_zones"] = """
SELECT *, (row//10)*1000+col//10 AS zone, (row%10 BETWEEN 2 AND 7) AND (col%10 BETWEEN 2 AND 7) AS interior FROM f_cells"""

VIEWS["f_evidence"] = """
SELECT 'face:'||(event_id%2000) AS entity_id, 'face' AS level,
  CASE event_type WHEN 'view' THEN 'wall' WHEN 'click' THEN 'roof' WHEN 'purchase' THEN 'glass' WHEN 'signup' THEN 'ground' ELSE 'water' END AS category,
  CASE event_id%5 WHEN 0 THEN 'photo' WHEN 1 THEN 'texture' WHEN 2 THEN 'annotation' WHEN 3 THEN 'geometry' ELSE 'existing_mesh_semantic' END AS source,
  ((event_id*31)%100)/100e0 AS confidence, ((event_id*53)%100)/100e0 AS reliability FROM events"""

VIEWS["f_voxels"] = """
SELECT CAST(l_partkey%40 AS INTEGER) AS ix, CAST(l_suppkey%40 AS INTEGER) AS iy, l_linenumber AS iz, CAST(l_quantity AS INTEGER)%10 AS label,
  CAST(l_orderkey%256 AS INTEGER) AS confidence, CAST(1+l_partkey%100 AS INTEGER) AS count FROM lineitem"""

VIEWS["f_samples"] = """
SELECT o_orderkey AS sample_id, o_custkey%300 AS surface_id,
  CASE (o_custkey%300)%3 WHEN 0 THEN 'roof' WHEN 1 THEN 'facade' ELSE 'base' END AS surface_type,
  (o_orderkey*7)%60+0.5e0 AS px, (o_orderkey*11)%60+0.5e0 AS py, o_orderkey%9+0.5e0 AS pz FROM orders"""

VIEWS["f_boxtri"] = """
SELECT * FROM (VALUES (0,0,2,1),(1,1,2,3),(2,4,5,6),(3,5,7,6),(4,0,1,4),(5,1,5,4),(6,2,6,3),(7,3,6,7),(8,0,4,2),(9,2,4,6),(10,1,3,5),(11,3,7,5)) t(t,ca,cb,cc)"""

VIEWS["f_boxes"] = """
SELECT p_partkey*12+t AS fid, p_partkey AS part_id,
  CASE p_partkey%8 WHEN 0 THEN 'Glass-Facade' WHEN 1 THEN 'curtain wall' WHEN 2 THEN 'Roof Metal' WHEN 3 THEN 'road_01'
   WHEN 4 THEN 'grass' WHEN 5 THEN 'limestone' WHEN 6 THEN 'ground' ELSE 'misc' END AS name,
  """ + ",\n  ".join(
    f"CAST(2*(p_partkey%100)+c{v}%2 AS DOUBLE) AS {v}x, CAST(2*(p_partkey//100)+(c{v}//2)%2 AS DOUBLE) AS {v}y, CAST(p_size*(c{v}//4) AS DOUBLE) AS {v}z"
    for v in "abc") + """
FROM part, f_boxtri WHERE NOT (p_partkey%7=0 AND t=3)"""

VIEWS["f_facegeo"] = """
SELECT fid, part_id, name, nx/norm AS nx, ny/norm AS ny, nz/norm AS nz, norm*0.5e0 AS area,
  (ax+bx+cx)/3e0 AS gx, (ay+"by"+cy)/3e0 AS gy, (az+bz+cz)/3e0 AS gz, least(az,bz,cz) AS z_lo, greatest(az,bz,cz) AS z_hi FROM (
 SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS norm FROM (SELECT *,
  ("by"-ay)*(cz-az)-(bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay)-("by"-ay)*(cx-ax) AS nz FROM f_boxes))
WHERE norm*0.5e0 > 1e-12"""

VIEWS["f_paths"] = "SELECT l_partkey AS receiver, l_discount AS re, l_tax AS im FROM lineitem"

VIEWS["f_emb"] = """
SELECT vec_id, label, CAST(embedding[1] AS DOUBLE)*100e0 AS x, CAST(embedding[2] AS DOUBLE)*100e0 AS y, CAST(embedding[3] AS DOUBLE)*100e0 AS z FROM embeddings"""

# all neighbour candidates of each query in its band, ranked by (d, train id), up to 128
VIEWS["f_nbr"] = """
SELECT * FROM (SELECT q.band, q.point_id AS query_id, q.date AS q_date, q.x AS qx, q.y AS qy, q.los AS q_los, q.observed_dbm AS q_obs,
   t.point_id AS train_id, t.date AS t_date, t.x AS tx, t.y AS ty, t.los AS t_los, t.observed_dbm AS v,
   sqrt((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)) AS d,
   row_number() OVER (PARTITION BY q.band, q.point_id ORDER BY sqrt((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)), t.point_id) AS rank
  FROM f_query q JOIN f_train t ON q.band=t.band) WHERE rank<=128"""

VIEWS["f_nw50"] = """
SELECT band, query_id, CASE WHEN sum(w)<=1e-12 THEN min_by(v,rank) ELSE sum(w*v)/greatest(sum(w),1e-12) END AS pred
FROM (SELECT *, exp(-0.5e0*((d/50e0)*(d/50e0))) AS w FROM f_nbr) GROUP BY band, query_id"""


def h32(text: str) -> str:
    """SQL: first 32 bits of md5."""
    return f"CAST('0x'||substr(md5({text}),1,8) AS BIGINT)"


def s32(text: str) -> str:
    """SQL: first 32 bits of sha256."""
    return f"CAST('0x'||substr(sha256({text}),1,8) AS BIGINT)"


METRICS = """count(*) AS total_n, count(e) AS predicted_n, CAST(count(e) AS DOUBLE)/greatest(count(*),1) AS coverage,
 sqrt(avg(e*e)) AS rmse_db, avg(abs(e)) AS mae_db, max(abs(e)) AS max_abs_db, avg(e) AS bias_db,
 count(*) FILTER (abs(e)>8) AS gt8_n, avg(CASE WHEN abs(e)>8 THEN 1e0 WHEN e IS NULL THEN NULL ELSE 0e0 END) AS gt8_rate,
 count(*) FILTER (abs(e)>10) AS gt10_n, avg(CASE WHEN abs(e)>10 THEN 1e0 WHEN e IS NULL THEN NULL ELSE 0e0 END) AS gt10_rate,
 count(*) FILTER (abs(e)>15) AS gt15_n, avg(CASE WHEN abs(e)>15 THEN 1e0 WHEN e IS NULL THEN NULL ELSE 0e0 END) AS gt15_rate,
 quantile_cont(abs(e),0.5) AS median_abs_db, quantile_cont(abs(e),0.9) AS p90_abs_db,
 quantile_cont(abs(e),0.95) AS p95_abs_db, quantile_cont(abs(e),0.99) AS p99_abs_db"""
