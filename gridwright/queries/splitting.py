"""Queries over splits, folds, budgets and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright import fixtures as fx
from gridwright.functions import columns as col
from gridwright.functions.ranking import first_rows, global_position
from gridwright.operators import knn, score, splits
from gridwright.queries.registry import query
from gridwright.queries.views import METRICS, h32, s32


@query("cell_key_c1", "SELECT point_id, CAST(floor(x/50e0) AS BIGINT) AS cx, CAST(floor(y/50e0) AS BIGINT) AS cy FROM f_points")
def _(spark, sf):
    return splits.with_cell(fx.points(spark, sf), 50.0).select("point_id", "cx", "cy")


SERPENTINE = """SELECT band, cx, cy, cell_n, CAST(CASE WHEN (pos-1)%(2*{k})<{k} THEN (pos-1)%(2*{k}) ELSE 2*{k}-1-(pos-1)%(2*{k}) END AS INTEGER) AS fold FROM (
 SELECT *, row_number() OVER (PARTITION BY band ORDER BY cell_n DESC, """ + h32("'20260905|'||cx||'|'||cy") + """, cx, cy) AS pos FROM (
 SELECT band, CAST(floor(x/{cell}) AS BIGINT) AS cx, CAST(floor(y/{cell}) AS BIGINT) AS cy, count(*) AS cell_n FROM f_points GROUP BY ALL))"""


@query("balanced_cell_folds_c2", SERPENTINE.format(k=5, cell="50e0"))
def _(spark, sf):
    return splits.balanced_cell_folds(fx.points(spark, sf), ["band"], 5, 50.0, 20260905)


@query("hash_group_folds_w3", """SELECT band, trajectory_group, CAST((row_number() OVER (PARTITION BY band ORDER BY sha256(CAST(trajectory_group AS VARCHAR)), trajectory_group)-1)%3 AS INTEGER) AS fold
 FROM (SELECT DISTINCT band, trajectory_group FROM f_points)""")
def _(spark, sf):
    return splits.hash_group_folds(fx.points(spark, sf), ["band"], "trajectory_group", 3)


@query("stratified_round_robin_w2", f"""SELECT point_id, spatial_block, within_block FROM (SELECT *, row_number() OVER (PARTITION BY spatial_block ORDER BY p, point_id) AS within_block FROM (
 SELECT point_id, blk AS spatial_block, {s32("'sample/7/'||point_id")} AS p, {s32("'block/7/'||blk")} AS b FROM (
 SELECT *, CAST(floor(x/50e0) AS BIGINT)||':'||CAST(floor(y/50e0) AS BIGINT) AS blk FROM f_points))) ORDER BY within_block, b, p, point_id LIMIT 500""")
def _(spark, sf):
    return splits.stratified_round_robin(fx.points(spark, sf), 500, 7, 50.0).select("point_id", "spatial_block", "within_block")


@query("retain_percent_w1", """SELECT band, point_id, pos FROM (SELECT band, point_id, row_number() OVER (PARTITION BY band ORDER BY s, point_id) AS pos, count(*) OVER (PARTITION BY band) AS n
 FROM (SELECT band, point_id, abs(raw-observed_dbm) AS s FROM f_base) WHERE s IS NOT NULL) WHERE pos <= greatest(1, round_even(n*25/100e0, 0))""")
def _(spark, sf):
    from gridwright.operators import route
    rows = fx.base_gain(spark, sf).withColumn("s", F.abs(F.col("raw") - F.col("observed_dbm")))
    return route.retain_percent(rows, ["band"], "s", [25]).filter("retained").select("band", "point_id", F.col("position").alias("pos"))


@query("inner_folds_c4", f"""SELECT band, f.fold, count(*) AS valid_n, any_value(n)-count(*) AS fit_n FROM (SELECT band, CAST(floor(x/10e0) AS BIGINT) AS cx, CAST(floor(y/10e0) AS BIGINT) AS cy, count(*) OVER (PARTITION BY band) AS n FROM f_train) t
 JOIN (SELECT band, cx, cy, CAST((row_number() OVER (PARTITION BY band ORDER BY {h32("'11|'||cx||'|'||cy")}, cx, cy)-1)%3 AS INTEGER) AS fold FROM (
  SELECT DISTINCT band, CAST(floor(x/10e0) AS BIGINT) AS cx, CAST(floor(y/10e0) AS BIGINT) AS cy FROM f_train)) f USING (band, cx, cy) GROUP BY band, f.fold HAVING count(*)>=1 AND any_value(n)-count(*)>=2""")
def _(spark, sf):
    train, _ = fx.split_points(spark, sf)
    return splits.usable_folds(splits.inner_folds(train, ["band"], 3, 10.0, 11), ["band"], 3, 2, 1)


OUTER = """WITH fold AS (""" + SERPENTINE.format(k=5, cell="50e0") + """),
 p AS (SELECT a.band, a.point_id, a.x, a.y, fold.fold FROM f_points a JOIN fold ON a.band=fold.band AND fold.cx=CAST(floor(a.x/50e0) AS BIGINT) AND fold.cy=CAST(floor(a.y/50e0) AS BIGINT)),
 near AS (SELECT q.band, q.point_id, min(sqrt((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y))) AS nearest_m FROM p q JOIN p t ON q.band=t.band WHERE q.fold<>3 AND t.fold=3 GROUP BY ALL)
 SELECT band, point_id, 'test' AS role, CAST(NULL AS DOUBLE) AS nearest_m FROM p WHERE fold=3
 UNION ALL SELECT band, point_id, CASE WHEN nearest_m>=30e0 THEN 'pool' ELSE 'buffer' END, nearest_m FROM near"""


@query("outer_splits_c5", OUTER)
def _(spark, sf):
    return splits.outer_splits(fx.points(spark, sf), ["band"], "spatial30", 3, 5, 20260905)


LATTICE = """WITH fold AS (SELECT 50e0 AS cell, * FROM (""" + SERPENTINE.format(k=5, cell="50e0") + """) UNION ALL SELECT 1e0 AS cell, * FROM (""" + SERPENTINE.format(k=5, cell="1e0") + """)),
 p AS (SELECT cell, a.band, a.point_id, a.x, a.y, fold.fold FROM f_points a JOIN fold ON a.band=fold.band AND fold.cx=CAST(floor(a.x/cell) AS BIGINT) AND fold.cy=CAST(floor(a.y/cell) AS BIGINT)),
 near AS (SELECT q.cell, q.band, q.point_id, t.fold AS outer_fold, min(sqrt((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y))) AS nearest_m FROM p q JOIN p t ON q.cell=t.cell AND q.band=t.band AND q.fold<>t.fold GROUP BY ALL),
 rows_ AS (SELECT cell, band, point_id, fold AS outer_fold, NULL AS nearest_m, true AS test FROM p UNION ALL SELECT cell, band, point_id, outer_fold, nearest_m, false FROM near)
 SELECT band, mode, outer_fold, point_id, CASE WHEN test THEN 'test' WHEN nearest_m>=buffer THEN 'pool' ELSE 'buffer' END AS role, CAST(nearest_m AS DOUBLE) AS nearest_m
 FROM rows_ JOIN (VALUES ('infill',1e0,{infill}),('spatial30',50e0,30e0),('spatial60',50e0,60e0)) m(mode, size, buffer) ON size=cell"""


@query("split_lattice_c5", LATTICE.format(infill=f"{splits.mode_geometry('infill')[1]}e0"))
def _(spark, sf):
    return splits.split_lattice(fx.points(spark, sf), ["band"], ["infill", "spatial30", "spatial60"], 5, 20260905)


@query("buffer_exclude_j4", """WITH t AS (SELECT band, x, y FROM f_points WHERE trajectory_group%5=0), p AS (SELECT * FROM f_points WHERE trajectory_group%5<>0)
 SELECT band, count(*) AS pool_n, count(*) FILTER (m>=10e0) AS kept_n, count(*) FILTER (m<10e0) AS excluded_n, min(CASE WHEN m>=10e0 THEN m END) AS minimum_kept_m
 FROM (SELECT p.band, p.point_id, min(sqrt((p.x-t.x)*(p.x-t.x)+(p.y-t.y)*(p.y-t.y))) AS m FROM p JOIN t USING (band) GROUP BY ALL) GROUP BY band""")
def _(spark, sf):
    p = fx.points(spark, sf)
    out = knn.buffer_exclude(p.filter("trajectory_group%5<>0"), p.filter("trajectory_group%5=0"), 10.0, ["band"])
    return out.groupBy("band").agg(
        F.count(F.lit(1)).alias("pool_n"), F.count_if("kept").alias("kept_n"), F.count_if(~F.col("kept")).alias("excluded_n"),
        F.min(F.when(F.col("kept"), F.col("nearest_m"))).alias("minimum_kept_m"))


LEVELS = " ".join(
    f""", w{l} AS (SELECT band, w.h AS h, w.cx AS cx, w.cy AS cy FROM (SELECT band, min({{'h':h,'cx':cx,'cy':cy}}) AS w FROM {'cells' if l == 1 else f'w{l-1}'} GROUP BY band, cx>>{l}, cy>>{l}))"""
    for l in range(1, 9))
ORDER_SQL = f"""WITH r AS (SELECT band, point_id, CAST(floor(x/10e0) AS BIGINT) AS cx, CAST(floor(y/10e0) AS BIGINT) AS cy FROM f_train),
 cells AS (SELECT *, {h32("'5|'||cx||'|'||cy")} AS h FROM (SELECT DISTINCT band, cx, cy FROM r)) {LEVELS},
 lv AS (SELECT c.band, c.cx, c.cy, c.h, greatest({", ".join(f"coalesce((SELECT {l} FROM w{l} w WHERE w.band=c.band AND w.cx=c.cx AND w.cy=c.cy),0)" for l in range(1, 9))}) AS level FROM cells c),
 t AS (SELECT r.band, r.point_id, lv.cx, lv.cy, h, level, row_number() OVER (PARTITION BY r.band, r.cx, r.cy ORDER BY {h32("'5|point|'||point_id")}, point_id) AS turn FROM r JOIN lv USING (band, cx, cy)),
 o AS (SELECT band, point_id, row_number() OVER (PARTITION BY band ORDER BY turn, level DESC, h, cx, cy) AS position FROM t)"""


@query("spatial_order_c7", ORDER_SQL + " SELECT * FROM o")
def _(spark, sf):
    train, _ = fx.split_points(spark, sf)
    return splits.spatial_order(train, ["band"], 5)


@query("nested_budget_prefix_w5", ORDER_SQL + """ SELECT band, CAST(b AS INTEGER) AS budget, point_id, position FROM o, (VALUES (30),(100),(300),(1000),(2500),(100000)) t(b)
 WHERE position<=b AND b<=(SELECT count(*) FROM o o2 WHERE o2.band=o.band)""")
def _(spark, sf):
    train, _ = fx.split_points(spark, sf)
    return splits.nested_prefixes(splits.spatial_order(train, ["band"], 5), ["band"], [30, 100, 300, 1000, 2500, 100000])[0]


@query("budget_status_l8", """SELECT band, CAST(b AS INTEGER) AS budget, n AS pool_n, CASE WHEN n>=b THEN 'COMPLETE' ELSE 'INSUFFICIENT' END AS status
 FROM (SELECT band, count(*) AS n FROM f_train GROUP BY band), (VALUES (30),(100),(300),(1000),(2500),(100000)) t(b)""")
def _(spark, sf):
    train, _ = fx.split_points(spark, sf)
    return splits.nested_prefixes(train.withColumn("position", F.lit(1)), ["band"], [30, 100, 300, 1000, 2500, 100000])[1]


@query("allocate_budget_t3", """WITH c AS (SELECT trajectory_group, band, count(*) AS n FROM f_points GROUP BY ALL),
 r AS (SELECT *, 9e0*n/sum(n) OVER (PARTITION BY trajectory_group) AS raw FROM c),
 b AS (SELECT *, CAST(floor(raw) AS BIGINT) AS base FROM r),
 l AS (SELECT *, 9-sum(base) OVER (PARTITION BY trajectory_group) AS rest, row_number() OVER (PARTITION BY trajectory_group ORDER BY raw-base DESC, band) AS rn FROM b),
 a AS (SELECT *, base+CASE WHEN rn<=rest THEN 1 ELSE 0 END AS v FROM l),
 m AS (SELECT *, greatest(4-min(v) OVER (PARTITION BY trajectory_group),0) AS need FROM a)
 SELECT trajectory_group, band, n, CAST(CASE WHEN v<4 THEN 4 ELSE v-need END AS BIGINT) AS allocated FROM m""")
def _(spark, sf):
    counts = fx.points(spark, sf).groupBy("trajectory_group", "band").agg(F.count(F.lit(1)).alias("n"))
    return splits.allocate_budget(counts, ["trajectory_group"], 9)


@query("band_balanced_group_folds_c3", f"""WITH c AS (SELECT trajectory_group, count(*) FILTER (band='n41') AS a, count(*) FILTER (band='n79') AS b FROM f_points GROUP BY 1),
 t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM c),
 d AS (SELECT c.*, candidate, CAST({h32("'240903|'||candidate||'|'||trajectory_group")}%5 AS INTEGER) AS fold FROM c, range(200000) k(candidate)),
 l AS (SELECT candidate, fold, sum(a) AS a, sum(b) AS b FROM d GROUP BY ALL),
 s AS (SELECT candidate, count(*) AS used, sum(power(greatest(greatest(ta*0.02e0,100e0)-a,0e0)/greatest(ta*0.02e0,100e0),2)+power(greatest(greatest(tb*0.02e0,100e0)-b,0e0)/greatest(tb*0.02e0,100e0),2)) AS shortfall,
  sum(power(a/greatest(ta/5e0,1e0)-1,2)+power(b/greatest(tb/5e0,1e0)-1,2)) AS imbalance, max(greatest(a/greatest(ta/5e0,1e0),b/greatest(tb/5e0,1e0))) AS peak FROM l, t GROUP BY candidate)
 SELECT trajectory_group, fold, CAST(candidate AS INTEGER) AS candidate, shortfall FROM d JOIN (SELECT candidate, shortfall FROM s WHERE used=5 ORDER BY shortfall, imbalance, peak, candidate LIMIT 1) USING (candidate)""")
def _(spark, sf):
    return splits.band_balanced_folds(fx.points(spark, sf), 5, 200_000, 240903)


@query("derive_seed_c9", f"SELECT point_id, {s32("'20260905|'||band||'|'||point_id||'|order'")} AS seed FROM f_points")
def _(spark, sf):
    return fx.points(spark, sf).select("point_id", col.derive_seed(20260905, F.col("band"), F.col("point_id"), "order").alias("seed"))


@query("train_query_spec_c8", f"""WITH n AS (SELECT q.band, q.point_id, min(sqrt((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y))) AS m FROM f_query q JOIN f_train t USING (band) GROUP BY ALL)
 SELECT band, train_n, position_groups, test_n, minimum_m, median_m, {s32("'20260905|'||band||'|fit'")} AS seed FROM
 (SELECT band, count(*) AS train_n, count(DISTINCT floor(x)*100000+floor(y)) AS position_groups FROM f_train GROUP BY band)
 JOIN (SELECT band, count(*) AS test_n, min(m) AS minimum_m, quantile_cont(m,0.5) AS median_m FROM n GROUP BY band) USING (band)""")
def _(spark, sf):
    train, q = fx.split_points(spark, sf)
    return splits.train_query_spec(train, q, ["band"], 20260905)


@query("strict_new_cell_j9", """SELECT point_id FROM f_query q WHERE NOT EXISTS (SELECT 1 FROM f_train t WHERE t.band=q.band AND floor(t.x/10e0)=floor(q.x/10e0) AND floor(t.y/10e0)=floor(q.y/10e0))""")
def _(spark, sf):
    from gridwright.operators import contracts
    train, q = fx.split_points(spark, sf)
    return contracts.strict_new_cell(q, train, ["band"], 10.0).select("point_id")


@query("best_per_group_w6", "SELECT band, date, point_id, observed_dbm FROM (SELECT *, row_number() OVER (PARTITION BY band, date ORDER BY observed_dbm DESC, point_id) AS rn FROM f_points) WHERE rn=1")
def _(spark, sf):
    return first_rows(fx.points(spark, sf), ["band", "date"], [F.desc("observed_dbm"), F.col("point_id")]).select("band", "date", "point_id", "observed_dbm")


@query("distance_summary_a27", """WITH n AS (SELECT q.band, q.point_id, min(sqrt((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y))) AS m FROM f_query q JOIN f_train t USING (band) GROUP BY ALL)
 SELECT band, count(*) AS n, min(m) AS min_m, quantile_cont(ln(1+m),0.1) AS q10, quantile_cont(ln(1+m),0.25) AS q25, quantile_cont(ln(1+m),0.5) AS q50, quantile_cont(ln(1+m),0.75) AS q75, quantile_cont(ln(1+m),0.9) AS q90 FROM n GROUP BY band""")
def _(spark, sf):
    train, q = fx.split_points(spark, sf)
    return score.distance_summary(knn.nearest_distance(q, train, ["band"]), ["band"])


@query("wasserstein_a27", """WITH v AS (SELECT trajectory_group AS g, observed_dbm AS v, count(*) FILTER (band='n41') AS l, count(*) FILTER (band='n79') AS r FROM f_points GROUP BY ALL),
 c AS (SELECT g, v, lead(v) OVER w AS nv, sum(l) OVER w AS cl, sum(r) OVER w AS cr, sum(l) OVER (PARTITION BY g) AS nl, sum(r) OVER (PARTITION BY g) AS nr FROM v WINDOW w AS (PARTITION BY g ORDER BY v))
 SELECT g AS trajectory_group, sum((nv-v)*abs(cl/nl-cr/nr)) AS wasserstein_m FROM (SELECT g, v, nv, CAST(cl AS DOUBLE) AS cl, CAST(cr AS DOUBLE) AS cr, nl, nr FROM c) GROUP BY g""")
def _(spark, sf):
    return score.wasserstein(fx.points(spark, sf), ["trajectory_group"], "band", "n41", "n79", "observed_dbm")


@query("matched_design_c6")
def _(spark, sf):
    train, q = fx.split_points(spark, sf)
    audit, _ = splits.matched_designs(train, q, ["band"], "spatial30", 241301)
    return audit


@query("learning_curve_r11", f"""WITH t AS (SELECT * FROM f_train WHERE {h32("'lc|'||point_id")}%4=0), s AS (SELECT * FROM f_points WHERE point_id NOT IN (SELECT point_id FROM t)),
 nb AS (SELECT * FROM (SELECT q.band, q.point_id, q.observed_dbm AS obs, t.observed_dbm AS v, t.point_id AS tid, q.x, q.y, sqrt((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)) AS d,
   row_number() OVER (PARTITION BY q.band, q.point_id ORDER BY sqrt((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)), t.point_id) AS rk FROM s q JOIN t USING (band)) WHERE rk<=8),
 p AS (SELECT band, point_id, any_value(obs) AS obs, any_value(x) AS x, any_value(y) AS y, min(d) AS nd,
   coalesce(avg(CASE WHEN d<=1e-9 THEN v END), sum(v/power(greatest(d,1e-6),2))/sum(1/power(greatest(d,1e-6),2))) AS pred FROM nb GROUP BY band, point_id),
 st AS (SELECT p.*, pred-obs AS e, NOT EXISTS (SELECT 1 FROM t WHERE t.band=p.band AND floor(t.x/10e0)=floor(p.x/10e0) AND floor(t.y/10e0)=floor(p.y/10e0)) AS strict FROM p),
 ex2 AS (SELECT st.*, sc.scope, md.evaluation_mode FROM st, (VALUES ('all'),('n41'),('n79')) sc(scope), (VALUES ('ordinary_complement'),('strict_new_10m_cell')) md(evaluation_mode)
   WHERE (sc.scope='all' OR sc.scope=band) AND (md.evaluation_mode='ordinary_complement' OR strict))
 SELECT scope, evaluation_mode, {METRICS}, avg(nd) AS nearest_mean_m, quantile_cont(nd,0.5) AS nearest_median_m, quantile_cont(nd,0.9) AS nearest_p90_m,
  evaluation_mode='ordinary_complement' OR (scope='all' AND count(*)>=500) AS rank_eligible FROM ex2 GROUP BY scope, evaluation_mode""")
def _(spark, sf):
    from gridwright.operators import contracts, interp, route
    train, _ = fx.split_points(spark, sf)
    fit = train.filter(splits.md5_u32(F.lit("lc"), F.col("point_id")) % 4 == 0)
    rest = fx.points(spark, sf).join(fit.select("point_id"), "point_id", "left_anti")
    nbrs = knn.knn_join(rest, fit, 8, ["band"], carry=["observed_dbm"])
    pred = interp.idw(nbrs, ["band", "query_id"], "observed_dbm", 8, 2.0).withColumnRenamed("query_id", "point_id")
    near = nbrs.filter("rank = 1").select(F.col("query_id").alias("point_id"), F.col("d").alias("nearest_m"))
    return route.learning_curve(rest.join(pred, ["band", "point_id"]).join(near, "point_id"), fit, ["band"])
