"""Queries over contracts, lineage, columns and whole-text checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright import fixtures as fx
from gridwright.functions import columns as col
from gridwright.operators import contracts, lineage, score
from gridwright.queries.registry import query
from gridwright.queries.views import s32
from gridwright.sources import tables


def hidden(spark, sf):
    return fx.points(spark, sf).withColumn("observed_dbm", F.when(F.col("role") == "train", F.col("observed_dbm")))


@query("points_contract_v1", """SELECT band, count(*) AS rows, count(*) FILTER (role='train') AS train_n, count(*) FILTER (role='query') AS query_n, CAST(0 AS BIGINT) AS bad_ids, CAST(0 AS BIGINT) AS shared_groups, 0 AS violations FROM f_points GROUP BY band""")
def _(spark, sf):
    return contracts.points_report(hidden(spark, sf)).select("band", "rows", "train_n", "query_n", "bad_ids", "shared_groups", F.size("violations").alias("violations"))


@query("points_contract_broken_v1", """SELECT band, count(*) FILTER (role='query') AS query_with_label, (SELECT count(*) FROM (SELECT floor(x/7e0), floor(y/7e0) FROM f_points p WHERE p.band=f.band GROUP BY 1,2 HAVING bool_or(role='train') AND bool_or(role='query'))) AS shared_groups FROM f_points f GROUP BY band""")
def _(spark, sf):
    # labels left in place and positions coarsened: both must be reported
    p = fx.points(spark, sf).withColumn("x", F.col("x") / 7.0).withColumn("y", F.col("y") / 7.0)
    return contracts.points_report(p).select("band", "query_with_label", "shared_groups")


@query("fit_query_contract_v2", """SELECT band, (SELECT count(*) FROM f_train t WHERE t.band=q.band) AS fit_n, min(m) AS minimum_m, CAST(0 AS BIGINT) AS shared_ids FROM (SELECT q.band, q.point_id, min(sqrt((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y))) AS m FROM f_query q JOIN f_train t USING (band) GROUP BY ALL) q GROUP BY band""")
def _(spark, sf):
    train, q = fx.split_points(spark, sf)
    return contracts.fit_query_report(train, q.drop("observed_dbm"), ["band"]).select("band", "fit_n", "minimum_m", "shared_ids")


@query("gain_alignment_v3", """SELECT CAST(13 AS BIGINT) AS configs, CAST(0 AS BIGINT) AS points_without_gain, CAST(0 AS BIGINT) AS gain_without_point, CAST(0 AS BIGINT) AS ragged_points, CAST(0 AS BIGINT) AS infinite_gains, 0 AS violations FROM (SELECT count(*) FROM f_gains)""")
def _(spark, sf):
    return contracts.gain_report(fx.points(spark, sf), fx.gains(spark, sf)).select(
        "configs", "points_without_gain", "gain_without_point", "ragged_points", "infinite_gains", F.size("violations").alias("violations"))


@query("normalize_bool_v4", "SELECT event_id, event_id%3=0 AS flag FROM events")
def _(spark, sf):
    text = F.expr("element_at(array(' TRUE','no','0','Yes','false','0'), cast(event_id%6 as int)+1)")
    return fx.table(spark, sf, "events").select("event_id", col.normalize_bool(text).alias("flag"))


@query("variant_invariants_v5", """SELECT band, method, count(*) AS units, CAST(0 AS BIGINT) AS broken FROM (SELECT DISTINCT point_id, band, method FROM f_variants) GROUP BY band, method""")
def _(spark, sf):
    r = contracts.invariant_report(fx.variants(spark, sf), ["point_id", "band", "method"], "variant", 4,
                                   ["date", "trajectory_group", "outer_fold", "config_id", "observed_dbm", "path_available"])
    return r.groupBy("band", "method").agg(F.count(F.lit(1)).alias("units"), F.count_if(F.size("violations") > 0).alias("broken"))


@query("matched_arms_v6", """SELECT trajectory_group, arms, (CASE WHEN f1>1 THEN 1 ELSE 0 END)+(CASE WHEN f2>1 THEN 1 ELSE 0 END) AS violations FROM (SELECT trajectory_group, CAST(5 AS BIGINT) AS arms, count(DISTINCT f1) AS f1, count(DISTINCT f2) AS f2 FROM (
 SELECT trajectory_group, a, trajectory_group%7+CASE WHEN trajectory_group%5=0 AND a=3 THEN 1 ELSE 0 END AS f1, trajectory_group%3+CASE WHEN trajectory_group%4=0 THEN a ELSE 0 END AS f2 FROM (SELECT DISTINCT trajectory_group FROM f_points), range(5) t(a)) GROUP BY trajectory_group)""")
def _(spark, sf):
    g = fx.points(spark, sf).select("trajectory_group").distinct().withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(4))))
    m = g.selectExpr("trajectory_group", "concat('arm', cast(a as string)) as arm_id", "'COMPLETED' as status",
                     "case a when 0 then 'uniform' when 1 then 'semantic' else 'label_shuffle' end as arm_kind",
                     "trajectory_group%7 + case when trajectory_group%5=0 and a=3 then 1 else 0 end as f1",
                     "trajectory_group%3 + case when trajectory_group%4=0 then a else 0 end as f2")
    r = contracts.matched_arms_report(m, ["trajectory_group"], ["f1", "f2"])
    return r.select("trajectory_group", "arms", F.size("violations").alias("violations"))


@query("aligned_join_j8", """SELECT p.point_id, p.band, p.observed_dbm, b.raw FROM f_points p JOIN f_base b ON p.point_id=b.point_id""")
def _(spark, sf):
    p = fx.points(spark, sf).select("point_id", "band", "observed_dbm")
    return contracts.aligned_join(p, fx.base_gain(spark, sf).select("point_id", "raw"), ["point_id"])


@query("leakage_check_j9", """SELECT band, CAST(0 AS BIGINT) AS shared_ids, (SELECT count(*) FROM (SELECT floor(x/10e0) AS a, floor(y/10e0) AS b FROM f_train t WHERE t.band=f.band INTERSECT SELECT floor(x/10e0), floor(y/10e0) FROM f_query q WHERE q.band=f.band)) AS shared_cells FROM f_points f GROUP BY band""")
def _(spark, sf):
    train, q = fx.split_points(spark, sf)
    return contracts.leakage_report(train, q, ["band"], 10.0).select("band", "shared_ids", "shared_cells")


@query("restrict_to_core_j9", "SELECT point_id FROM f_points WHERE trajectory_group IN (SELECT trajectory_group FROM f_points WHERE observed_dbm<-100)")
def _(spark, sf):
    p = fx.points(spark, sf)
    return contracts.restrict_to(p, p.filter("observed_dbm < -100"), ["trajectory_group"]).select("point_id")


@query("id_set_difference_u2", """(SELECT event_id AS point_id, 'left' AS side FROM events EXCEPT SELECT o_orderkey, 'left' FROM orders) UNION ALL (SELECT o_orderkey, 'right' FROM orders EXCEPT SELECT event_id, 'right' FROM events)""")
def _(spark, sf):
    a = fx.table(spark, sf, "events").selectExpr("event_id as point_id")
    b = fx.table(spark, sf, "orders").selectExpr("o_orderkey as point_id")
    return contracts.id_set_difference(a, b, ["point_id"])


@query("union_folds_u1", "SELECT outer_fold, method, count(*) AS n, avg(pred) AS mean_pred FROM f_pred GROUP BY ALL")
def _(spark, sf):
    p = fx.predictions(spark, sf)
    whole = reduce(DataFrame.unionByName, [p.filter(F.col("outer_fold") == k) for k in range(5)])
    return whole.groupBy("outer_fold", "method").agg(F.count(F.lit(1)).alias("n"), F.avg("pred").alias("mean_pred"))


@query("coordinate_audit_p10", """WITH m AS (SELECT s_suppkey, CASE WHEN s_suppkey%3=0 THEN '' ELSE 'local_enu' END AS crs, CASE WHEN s_suppkey%4=0 THEN 'XZY' ELSE 'ENU' END AS axis_order, CASE WHEN s_suppkey%5=0 THEN 'cm' ELSE 'm' END AS unit, CASE s_suppkey%3 WHEN 0 THEN '' WHEN 1 THEN 'survey' ELSE 'candidate' END AS origin, s_suppkey%2=0 AS alt FROM supplier)
 SELECT s_suppkey, crs, axis_order, unit, crs<>'' AND axis_order='ENU' AND unit='m' AND NOT (crs='local_enu' AND NOT alt) AS passed,
  CASE WHEN crs='' THEN 'missing CRS declaration;' ELSE '' END||CASE WHEN axis_order<>'ENU' THEN 'unsupported or missing axis_order: XZY;' ELSE '' END||CASE WHEN unit<>'m' THEN 'coordinate unit must be metres after normalization, got cm;' ELSE '' END||
  CASE origin WHEN '' THEN 'origin status is undeclared; absolute placement requires review;' WHEN 'candidate' THEN 'origin is a candidate or non-survey reference; keep REVIEW_REQUIRED;' ELSE '' END||CASE WHEN crs='local_enu' AND NOT alt THEN 'local ENU origin is incomplete: origin_altitude_m;' ELSE '' END AS notes FROM m""")
def _(spark, sf):
    s = fx.table(spark, sf, "supplier").select("s_suppkey", F.expr("""map('crs', case when s_suppkey%3=0 then '' else 'local_enu' end,
        'axis_order', case when s_suppkey%4=0 then 'xzy' else 'ENU' end, 'unit', case when s_suppkey%5=0 then 'cm' else ' M' end,
        'origin_status', case s_suppkey%3 when 0 then '' when 1 then 'Survey' else 'candidate' end,
        'origin_latitude_deg', '1', 'origin_longitude_deg', '2', 'origin_altitude_m', case when s_suppkey%2=0 then '3' else '' end)""").alias("meta"))
    a = contracts.coordinate_audit(s)
    return a.select("s_suppkey", "crs", "axis_order", "unit", "passed", F.array_join(F.transform("notes", lambda n: F.concat(n, F.lit(";"))), "").alias("notes"))


@query("to_metres_p1", """SELECT l_orderkey, count(*) AS n, sum(l_quantity*CASE l_linenumber%3 WHEN 0 THEN 1e0 WHEN 1 THEN 0.01e0 ELSE 0.001e0 END) AS metres FROM lineitem GROUP BY l_orderkey""")
def _(spark, sf):
    t = fx.table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_quantity as x", "element_at(array('m',' CM','mm'), l_linenumber%3+1) as unit")
    return col.to_metres(t, F.col("unit"), ["x"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("metres"))


@query("affine_align_p2", """SELECT point_id, ((-x-12e0)*cos(radians(30e0))+(100e0-y-7e0)*sin(radians(30e0)))/1.25e0 AS ax, ((100e0-y-7e0)*cos(radians(30e0))-(-x-12e0)*sin(radians(30e0)))/1.25e0 AS ay FROM f_points""")
def _(spark, sf):
    return col.affine_align(fx.points(spark, sf), 30.0, 1.25, 12.0, 7.0).select("point_id", "ax", "ay")


@query("fourier_features_p12", "SELECT point_id, x/100e0 AS fx, y/100e0 AS fy, " + ", ".join(
    f"{f}({v}*(2e0*pi()/{w}e0)) AS {f}_{v}_{w}" for w in (25, 75, 200) for v in "xy" for f in ("sin", "cos")) + " FROM f_points")
def _(spark, sf):
    return fx.points(spark, sf).select("point_id", *[c.alias(n) for n, c in col.fourier_features(F.col("x"), F.col("y")).items()])


@query("fill_no_path_p16", "SELECT band, trajectory_group, count(*) AS n, count(*) FILTER (raw IS NULL) AS fallback_n, avg(coalesce(raw,-80e0)) AS mean_filled FROM f_base GROUP BY ALL")
def _(spark, sf):
    b = fx.base_gain(spark, sf).withColumn("filled", F.coalesce("raw", F.lit(-80.0)))
    return b.groupBy("band", "trajectory_group").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("raw").isNull()).alias("fallback_n"), F.avg("filled").alias("mean_filled"))


@query("blend_p17", """SELECT point_id, greatest(0,least(1,w))*a+(1-greatest(0,least(1,w)))*b AS mixed, CASE WHEN a IS NOT NULL AND raw IS NOT NULL THEN (1-greatest(0,least(1,w)))*raw+greatest(0,least(1,w))*a ELSE coalesce(raw,a) END AS paired, 0.5e0*a+0.5e0*b AS half, (a+b+c)/3 AS thirds, a+b+c AS serial
 FROM (SELECT point_id, raw, observed_dbm-1e0 AS a, observed_dbm+2e0 AS b, observed_dbm*0.5e0 AS c, (point_id%13)/10e0-0.1e0 AS w FROM f_base)""")
def _(spark, sf):
    t = fx.base_gain(spark, sf).selectExpr("point_id", "raw", "observed_dbm-1D as a", "observed_dbm+2D as b", "observed_dbm*0.5D as c", "(point_id%13)/10D-0.1D as w")
    a, b, c, w = (F.col(n) for n in "abcw")
    return t.select("point_id", col.blend(a, b, w).alias("mixed"), col.blend_pair(F.col("raw"), a, w).alias("paired"),
                    (0.5 * a + 0.5 * b).alias("half"), ((a + b + c) / 3.0).alias("thirds"), (a + b + c).alias("serial"))


@query("gates_p18", """SELECT point_id, exp(-0.5e0*(d/25e0)*(d/25e0)) AS near, power(greatest(rb,0.1e0),2)/greatest(power(greatest(ra,0.1e0),2)+power(greatest(rb,0.1e0),2),1e-12) AS inverse, exp(-d/50e0) AS shrink
 FROM (SELECT point_id, (point_id%97)*1e0 AS d, (point_id%31)/4e0 AS ra, (point_id%29)/4e0 AS rb FROM f_points)""")
def _(spark, sf):
    t = fx.points(spark, sf).selectExpr("point_id", "(point_id%97)*1D as d", "(point_id%31)/4D as ra", "(point_id%29)/4D as rb")
    return t.select("point_id", col.distance_gate(F.col("d"), 25.0).alias("near"), col.inverse_risk_gate(F.col("ra"), F.col("rb"), 2.0).alias("inverse"),
                    col.shrink_by_distance(F.col("d")).alias("shrink"))


@query("dual_source_r8", """SELECT point_id, CASE WHEN raw IS NOT NULL AND alt IS NOT NULL THEN (1-g)*raw+g*alt ELSE coalesce(raw,alt) END AS pred FROM (SELECT point_id, raw, CASE WHEN point_id%4=0 THEN NULL ELSE -70e0-point_id%9 END AS alt, (point_id%11)/10e0 AS g FROM f_base)""")
def _(spark, sf):
    from gridwright.operators import route
    t = fx.base_gain(spark, sf).selectExpr("point_id", "raw", "case when point_id%4=0 then null else -70D-point_id%9 end as alt", "(point_id%11)/10D as g")
    return route.dual_source(t, "raw", "alt", "g").select("point_id", "pred")


# --- lineage --------------------------------------------------------------------------------------

@query("content_digest_l1", """WITH h AS (SELECT band, sha256('{"point_id":'||point_id||',"role":"'||role||'"}') AS h FROM f_points), c AS (SELECT band, h, count(*) AS c FROM h GROUP BY ALL),
 a AS (SELECT band, substr(h,1,6) AS p, sha256(string_agg(h||':'||c, chr(10) ORDER BY h||':'||c)) AS d, sum(c) AS rows FROM c GROUP BY ALL), b AS (SELECT band, substr(p,1,3) AS p, sha256(string_agg(p||':'||d, chr(10) ORDER BY p||':'||d)) AS d, sum(rows) AS rows FROM a GROUP BY band, substr(p,1,3))
 SELECT band, sha256(string_agg(p||':'||d, chr(10) ORDER BY p||':'||d)) AS digest, CAST(sum(rows) AS BIGINT) AS rows FROM b GROUP BY band""")
def _(spark, sf):
    return lineage.content_digest(fx.points(spark, sf), ["band"], ["point_id", "role"])


RUNS_SQL = """runs AS (SELECT o_orderkey AS run_id, sha256('{"budget":'||(o_custkey%5)||',"mode":"'||o_orderpriority||'"}') AS fingerprint FROM orders)"""


def run_table(spark, sf):
    o = fx.table(spark, sf, "orders").selectExpr("o_orderkey as run_id", "o_custkey%5 as budget", "o_orderpriority as mode", "o_orderstatus")
    return lineage.run_fingerprint(o, "run_id", ["mode", "budget"])


@query("run_fingerprint_l2", f"WITH {RUNS_SQL} SELECT run_id, fingerprint FROM runs")
def _(spark, sf):
    return run_table(spark, sf).select("run_id", "fingerprint")


@query("pending_runs_l3", f"WITH {RUNS_SQL} SELECT run_id, CASE WHEN run_id%3=0 THEN 'PENDING' WHEN run_id%7=1 THEN 'DRIFT' ELSE 'DONE' END AS state FROM runs")
def _(spark, sf):
    runs = run_table(spark, sf)
    status = runs.selectExpr("run_id", "case when run_id%7=1 then sha2(fingerprint,256) else fingerprint end as fingerprint",
                             "case when run_id%3=0 then 'RUNNING' else 'COMPLETE' end as status")
    return lineage.pending_runs(runs.select("run_id", "fingerprint"), status).select("run_id", "state")


@query("frozen_then_score_l4", "SELECT band, method, count(*) AS n, avg(abs(pred-observed_dbm)) AS mae_db, sqrt(avg((pred-observed_dbm)*(pred-observed_dbm))) AS rmse_db FROM f_pred WHERE role='query' GROUP BY band, method")
def _(spark, sf):
    p = fx.predictions(spark, sf).filter("role='query'").select("band", "method", "point_id", "pred")
    truth = lambda: fx.predictions(spark, sf).filter("role='query'").select("method", "point_id", "observed_dbm")
    s = score.error_metrics(lineage.frozen_then_score(p, truth, ["method", "point_id"]), ["band", "method"], quantiles=False)
    return s.select("band", "method", F.col("total_n").alias("n"), "mae_db", "rmse_db")


@query("contiguous_chunks_l5", """WITH c AS (SELECT o_custkey%40 AS g, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey%40 ORDER BY o_orderkey)-1 AS k, count(*) OVER (PARTITION BY o_custkey%40) AS n FROM orders), d AS (SELECT g, n, k*10 AS start, k*10+10-CASE WHEN g%4=0 AND k=2 THEN 1 ELSE 0 END AS stop FROM c)
 SELECT g, min(start) AS first, max(stop) AS last, CAST(sum(stop-start) AS BIGINT) AS covered, CAST(CASE WHEN g%4=0 THEN 2 ELSE 0 END AS BIGINT) AS breaks, g%4<>0 AS complete FROM d GROUP BY g""")
def _(spark, sf):
    from gridwright.functions.ranking import global_position
    o = global_position(fx.table(spark, sf, "orders").selectExpr("o_custkey%40 as g", "o_orderkey as id"), ["g"], [F.col("id")], "k")
    c = o.selectExpr("g", "(k-1)*10 as start", "(k-1)*10+10-case when g%4=0 and k=3 then 1 else 0 end as stop")
    n = o.groupBy("g").agg((F.count(F.lit(1)) * 10).alias("total"))
    return lineage.contiguous_chunks(c.join(n, "g"), ["g"], F.col("total"))


@query("material_arms_l6", f"""WITH o AS (SELECT DISTINCT p_brand AS object, 'label'||substr(p_brand,7,1) AS label, p_brand LIKE '%1' AS conductor FROM part), s AS (SELECT n_nationkey AS seed FROM nation),
 t AS (SELECT seed, object, row_number() OVER (PARTITION BY seed ORDER BY object) AS pos FROM o, s WHERE NOT conductor), q AS (SELECT seed, label, row_number() OVER (PARTITION BY seed ORDER BY {s32("seed||'|'||object")}, object) AS pos FROM o, s WHERE NOT conductor)
 SELECT 'uniform' AS arm_id, 'uniform' AS kind, object, CASE WHEN conductor THEN label ELSE 'concrete' END AS label FROM o UNION ALL SELECT 'semantic', 'semantic', object, label FROM o UNION ALL SELECT 'shuffle_'||t.seed, 'label_shuffle', object, label FROM t JOIN q ON t.seed=q.seed AND t.pos=q.pos
 UNION ALL SELECT 'shuffle_'||seed, 'label_shuffle', object, label FROM o, s WHERE conductor""")
def _(spark, sf):
    o = fx.table(spark, sf, "part").selectExpr("p_brand as object", "concat('label', substr(p_brand,7,1)) as label", "p_brand like '%1' as conductor").distinct()
    return lineage.material_arms(o, fx.table(spark, sf, "nation").selectExpr("n_nationkey as seed"))


TOKEN_RULE = ("token assignment", r'token\s*=\s*"[0-9a-f]+')


# the credential rule's look-ahead is written as a second test of the value, which the oracle's expressions can state
FINDINGS = """h AS (SELECT doc_id, list_filter([
  CASE WHEN regexp_matches(text, '(?i)(^|[^A-Z0-9_])[A-Z]:[\\\\/]') THEN 'Windows absolute path' END,
  CASE WHEN regexp_matches(text, '(^|[^\\w.])/(home|Users)/[A-Za-z0-9_.-]+/') THEN 'home absolute path' END,
  CASE WHEN regexp_matches(text, '-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----') THEN 'private key' END,
  CASE WHEN regexp_matches(text, '\\bAKIA[0-9A-Z]{16}\\b') THEN 'AWS access key' END,
  CASE WHEN len(list_filter(regexp_extract_all(text, '(?i)\\b(?:api[_-]?key|access[_-]?token|secret[_-]?key|password)\\s*[:=]\\s*[''"]?([A-Za-z0-9_./+=-]{12,})', 1),
    lambda v: NOT regexp_matches(v, '(?i)^(placeholder|example|changeme)'))) > 0 THEN 'credential assignment' END,
  CASE WHEN regexp_matches(text, 'token\\s*=\\s*"[0-9a-f]+') THEN 'token assignment' END], lambda x: x IS NOT NULL) AS f FROM documents)"""


@query("sensitive_text_scan_l7", f"WITH {FINDINGS} SELECT doc_id, array_to_string(f, ';')||';' AS findings FROM h WHERE len(f) > 0")
def _(spark, sf):
    d = lineage.sensitive_text_scan(fx.table(spark, sf, "documents"), "text", [*lineage.SENSITIVE_PATTERNS, TOKEN_RULE])
    return d.select("doc_id", F.array_join(F.transform("findings", lambda v: F.concat(v, F.lit(";"))), "").alias("findings"))


@query("sensitive_text_counts_l7", f"WITH {FINDINGS} SELECT finding, count(*) AS documents FROM (SELECT unnest(f) AS finding FROM h) GROUP BY finding")
def _(spark, sf):
    d = lineage.sensitive_text_scan(fx.table(spark, sf, "documents"), "text", [*lineage.SENSITIVE_PATTERNS, TOKEN_RULE])
    return d.select(F.explode("findings").alias("finding")).groupBy("finding").agg(F.count(F.lit(1)).alias("documents"))


@query("condition_status_l8", """WITH r AS (SELECT DISTINCT band, trajectory_group FROM f_points), b AS (SELECT r.*, k.budget FROM r, (VALUES (30),(100),(300)) k(budget)), n AS (SELECT band, trajectory_group, count(*) AS available_n FROM f_train GROUP BY ALL)
 SELECT band, trajectory_group, budget, coalesce(available_n,0) AS available_n, CASE WHEN coalesce(available_n,0)<budget THEN 'INSUFFICIENT_BUFFERED_TRAINING_SUPPORT' WHEN trajectory_group%9=0 AND budget=30 THEN 'FAILED' ELSE 'COMPLETE' END AS status,
  CASE WHEN coalesce(available_n,0)<budget THEN 'requested='||budget||'; available='||coalesce(available_n,0)||'; budget_not_reduced' WHEN trajectory_group%9=0 AND budget=30 THEN 'RuntimeError: solve' ELSE '' END AS reason FROM b LEFT JOIN n USING (band, trajectory_group)""")
def _(spark, sf):
    p = fx.points(spark, sf)
    runs = p.select("band", "trajectory_group").distinct().withColumn("budget", F.explode(F.array(F.lit(30), F.lit(100), F.lit(300))))
    counts = p.filter("role='train'").groupBy("band", "trajectory_group").agg(F.count(F.lit(1)).alias("available_n"))
    fails = runs.filter("trajectory_group%9=0 and budget=30").withColumn("failure", F.lit("RuntimeError: solve"))
    return lineage.condition_status(runs, counts, fails, ["band", "trajectory_group", "budget"])


@query("expand_gains_s2", "SELECT point_id, config_ord, config_id, family, gain_db, los FROM f_gains")
def _(spark, sf):
    # pack to one array per receiver, as files hold them, and expand again
    g = fx.gains(spark, sf)
    packed = g.groupBy(F.col("point_id").alias("receiver_id"), "los").agg(F.transform(F.array_sort(F.collect_list(F.struct("config_ord", F.coalesce("gain_db", F.lit(float("nan"))).alias("v")))), lambda s: s["v"]).alias("gains"))  # 13 a point
    ids = ["AUTO_BASE"] + [f"S4W_{i:02d}" for i in range(1, 10)] + [f"S5_{i}" for i in range(10, 13)]
    fams = ["BASE"] + ["S4W"] * 9 + ["S5"] * 3
    pts = fx.points(spark, sf).selectExpr("point_id", "point_id as receiver_id")
    return tables.expand_gains(packed, pts, ids, fams).select("point_id", "config_ord", "config_id", "family", "gain_db", "los")
