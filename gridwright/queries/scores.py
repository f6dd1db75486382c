"""Queries over prediction tables: metrics, factorial comparison, campaign summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright import fixtures as fx
from gridwright.operators import score
from gridwright.queries.registry import query
from gridwright.queries.views import METRICS, h32


@query("error_metrics_a11", f"SELECT band, method, {METRICS} FROM (SELECT *, pred-observed_dbm AS e FROM f_pred) GROUP BY band, method")
def _(spark, sf):
    return score.error_metrics(fx.predictions(spark, sf), ["band", "method"])


@query("cv_score_a18", """SELECT band, role, method, CAST(sum(n) AS BIGINT) AS n, sqrt(sum(sse)/sum(n)) AS rmse, sum(sae)/sum(n) AS mae
 FROM (SELECT band, role, method, outer_fold, count(*) AS n, sum((pred-observed_dbm)*(pred-observed_dbm)) AS sse, sum(abs(pred-observed_dbm)) AS sae
  FROM f_pred GROUP BY ALL) GROUP BY band, role, method""")
def _(spark, sf):
    return score.cv_score(fx.predictions(spark, sf), ["band", "role"], ["method"], "outer_fold")


@query("cv_score_fold_mean_a18", """SELECT band, method, CAST(sum(n) AS BIGINT) AS n, avg(sqrt(sse/n)) AS rmse, avg(sae/n) AS mae
 FROM (SELECT band, method, outer_fold, count(*) AS n, sum((pred-observed_dbm)*(pred-observed_dbm)) AS sse, sum(abs(pred-observed_dbm)) AS sae
  FROM f_pred GROUP BY ALL) GROUP BY band, method""")
def _(spark, sf):
    return score.cv_score(fx.predictions(spark, sf), ["band"], ["method"], "outer_fold", how="fold_mean")


@query("choose_params_a18", """SELECT band, role, method, rmse, mae FROM (SELECT *, row_number() OVER (PARTITION BY band, role ORDER BY rmse, mae, method) AS rn FROM (
 SELECT band, role, method, sqrt(avg((pred-observed_dbm)*(pred-observed_dbm))) AS rmse, avg(abs(pred-observed_dbm)) AS mae FROM f_pred GROUP BY ALL)) WHERE rn=1""")
def _(spark, sf):
    return score.choose_params(score.cv_score(fx.predictions(spark, sf), ["band", "role"], ["method"], "outer_fold"), ["band", "role"], ["method"])


UNIT = ["point_id", "band", "method"]
KEEP = ["date", "trajectory_group", "outer_fold", "config_id", "observed_dbm", "path_available"]


def arms(spark, sf):
    return score.factorial_recombine(fx.variants(spark, sf), UNIT, KEEP)


@query("factorial_recombine_a19", "SELECT * FROM f_arms")
def _(spark, sf):
    return arms(spark, sf)


@query("factorial_metrics_a20", """SELECT scope, support, method, arm, count(*) AS n, sqrt(avg(e*e)) AS rmse_db, avg(abs(e)) AS mae_db,
 max(abs(e)) AS max_abs_db, avg(e) AS bias_db, count(*) FILTER (abs(e)>10) AS gt10_n, avg(CASE WHEN abs(e)>10 THEN 1e0 ELSE 0e0 END) AS gt10_rate,
 count(*) FILTER (abs(e)>15) AS gt15_n, avg(CASE WHEN abs(e)>15 THEN 1e0 ELSE 0e0 END) AS gt15_rate,
 quantile_cont(abs(e),0.5) AS median_abs_db, quantile_cont(abs(e),0.9) AS p90_abs_db, quantile_cont(abs(e),0.95) AS p95_abs_db, quantile_cont(abs(e),0.99) AS p99_abs_db
 FROM (SELECT *, error_db AS e, unnest(['all', band]) AS scope FROM f_arms) a,
 (VALUES ('all_points'),('path_available'),('no_path')) s(support)
 WHERE support='all_points' OR (support='path_available')=path_available GROUP BY scope, support, method, arm""")
def _(spark, sf):
    return score.factorial_metrics(arms(spark, sf))


CONTRASTS = """UNNEST([{{'c':'residual_idw_gain_mean_fill','g':r0m-r1m}}, {{'c':'residual_idw_gain_signal_fill','g':r0s-r1s}},
 {{'c':'residual_idw_main_gain','g':0.5e0*((r0m-r1m)+(r0s-r1s))}}, {{'c':'signal_fill_gain_residual_off','g':r0m-r0s}},
 {{'c':'signal_fill_gain_residual_on','g':r1m-r1s}}, {{'c':'signal_fill_main_gain','g':0.5e0*((r0m-r0s)+(r1m-r1s))}},
 {{'c':'interaction_residual_gain_signal_minus_mean','g':(r0s-r1s)-(r0m-r1m)}}]) AS u"""
PIVOT = ", ".join(f"max(CASE WHEN arm='{a}' THEN {{m}} END) AS {n}" for a, n in
                  (("R0_MEAN", "r0m"), ("R0_SIGNAL_IDW", "r0s"), ("R1_MEAN", "r1m"), ("R1_SIGNAL_IDW", "r1s")))


@query("factorial_contrasts_a21", f"""SELECT band, method, u.c AS contrast, u.g AS gain_db FROM (SELECT band, method, {CONTRASTS.format()} FROM (
 SELECT band, method, {PIVOT.format(m='r')} FROM (SELECT band, method, arm, sqrt(avg(error_db*error_db)) AS r FROM f_arms GROUP BY ALL) GROUP BY band, method))""")
def _(spark, sf):
    m = score.pooled_score(arms(spark, sf), ["band", "method", "arm"], "predicted_dbm")
    return score.contrasts(m.withColumn("r", F.sqrt(F.col("sse") / F.col("n"))), ["band", "method"], "r")


@query("cluster_bootstrap_a22", f"""WITH s AS (SELECT band, method, trajectory_group, arm, count(*) AS n, sum(error_db*error_db) AS sse, sum(abs(error_db)) AS sae FROM f_arms GROUP BY ALL),
 c AS (SELECT band, method, trajectory_group, row_number() OVER (PARTITION BY band, method ORDER BY trajectory_group) AS slot, count(*) OVER (PARTITION BY band, method) AS m
   FROM (SELECT DISTINCT band, method, trajectory_group FROM s)),
 p AS (SELECT band, method, m, draw, {h32("'20260905|'||band||'|'||method||'|'||draw||'|'||slot")} % m + 1 AS pick FROM c, range(10000) t(draw)),
 b AS (SELECT p.band, p.method, p.draw, s.arm, sum(n) AS n, sum(sse) AS sse, sum(sae) AS sae FROM p JOIN c ON p.band=c.band AND p.method=c.method AND p.pick=c.slot
   JOIN s ON s.band=c.band AND s.method=c.method AND s.trajectory_group=c.trajectory_group GROUP BY ALL),
 bm AS (SELECT band, method, draw, metric, {PIVOT.format(m='v')} FROM (SELECT band, method, draw, arm, 'rmse_db' AS metric, sqrt(sse/n) AS v FROM b UNION ALL SELECT band, method, draw, arm, 'mae_db', sae/n FROM b) GROUP BY band, method, draw, metric),
 bc AS (SELECT band, method, draw, metric, {CONTRASTS.format()} FROM bm),
 pt AS (SELECT band, method, arm, sum(n) AS n, sum(sse) AS sse, sum(sae) AS sae FROM s GROUP BY ALL),
 pm AS (SELECT band, method, metric, {PIVOT.format(m='v')} FROM (SELECT band, method, arm, 'rmse_db' AS metric, sqrt(sse/n) AS v FROM pt UNION ALL SELECT band, method, arm, 'mae_db', sae/n FROM pt) GROUP BY band, method, metric),
 pc AS (SELECT band, method, metric, {CONTRASTS.format()} FROM pm)
 SELECT pc.band, pc.method, pc.metric, pc.u.c AS contrast, pc.u.g AS gain_db, lo AS ci_low_db, hi AS ci_high_db, m AS clusters
 FROM pc JOIN (SELECT band, method, metric, u.c AS c, quantile_cont(u.g,0.025) AS lo, quantile_cont(u.g,0.975) AS hi FROM bc GROUP BY ALL) q
  ON pc.band=q.band AND pc.method=q.method AND pc.metric=q.metric AND pc.u.c=q.c
 JOIN (SELECT DISTINCT band, method, m FROM c) k ON k.band=pc.band AND k.method=pc.method""")
def _(spark, sf):
    return score.cluster_bootstrap(arms(spark, sf), ["band", "method"], "trajectory_group", "arm", 10_000, 20260905)


@query("paired_delta_a23", """SELECT a.band, a.outer_fold, a.mode, a.budget, a.repeat, a.mae_db-b.mae_db AS delta_mae_db, a.rmse_db-b.rmse_db AS delta_rmse_db,
 a.bias_db-b.bias_db AS delta_bias_db, 'M3_minus_M7' AS comparison FROM f_runs a JOIN f_runs b USING (band, outer_fold, mode, budget, repeat) WHERE a.method='M3' AND b.method='M7'""")
def _(spark, sf):
    return score.paired_delta(fx.runs(spark, sf), "M3", "M7", "M3_minus_M7", ["mae_db", "rmse_db", "bias_db"])


@query("paired_common_feasible_a23", """WITH k AS (SELECT band, outer_fold, mode, budget, repeat FROM f_runs WHERE method IN ('M1','M2') AND n>=2 AND mae_db<=2.7e0 GROUP BY ALL HAVING count(DISTINCT method)=2)
 SELECT a.band, a.outer_fold, a.mode, a.budget, a.repeat, a.mae_db-b.mae_db AS delta_mae_db, 'M1_minus_M2' AS comparison
 FROM f_runs a JOIN f_runs b USING (band, outer_fold, mode, budget, repeat) JOIN k USING (band, outer_fold, mode, budget, repeat) WHERE a.method='M1' AND b.method='M2'""")
def _(spark, sf):
    runs = fx.runs(spark, sf)
    keys = score.common_keys(runs, ["M1", "M2"], (F.col("n") >= 2) & (F.col("mae_db") <= 2.7))
    return score.paired_delta(runs.join(keys, list(score.RUN_KEYS), "left_semi"), "M1", "M2", "M1_minus_M2", ["mae_db"])


SUMMARY = """SELECT band, outer_fold, mode, budget, method, count(DISTINCT repeat) AS repeats, min_by(n, repeat) AS n, avg(mae_db) AS mae_mean, stddev_samp(mae_db) AS mae_sd,
 avg(rmse_db) AS rmse_mean, stddev_samp(rmse_db) AS rmse_sd, avg(bias_db) AS bias_mean FROM f_runs GROUP BY band, outer_fold, mode, budget, method"""


@query("campaign_summary_a24", SUMMARY)
def _(spark, sf):
    return score.summary(fx.runs(spark, sf))


@query("budget_summary_a24", f"""SELECT band, budget, method, count(*) AS conditions, avg(mae_mean) AS macro_mae, max(mae_mean) AS worst_mae,
 avg(rmse_mean) AS macro_rmse, max(rmse_mean) AS worst_rmse FROM ({SUMMARY}) GROUP BY band, budget, method""")
def _(spark, sf):
    return score.budget_summary(score.summary(fx.runs(spark, sf)))


TARGET = """SELECT band, outer_fold, mode, budget, method, avg(mae_db) AS mean_mae_db, max(mae_db) AS worst_repeat_mae_db,
 avg(CASE WHEN mae_db<=2.6e0 THEN 1e0 ELSE 0e0 END) AS hit_fraction, avg(mae_db)-2.6e0 AS mean_gap_db, max(mae_db)-2.6e0 AS worst_gap_db FROM f_runs GROUP BY ALL"""


@query("target_hits_a24", TARGET)
def _(spark, sf):
    return score.target_table(fx.runs(spark, sf), 2.6)


@query("smallest_budget_a24", f"""SELECT band, outer_fold, mode, method, min(CASE WHEN mean_mae_db<=2.6e0 THEN budget END) AS minimum_budget,
 min(mean_mae_db) AS best_mae_db, min(mean_gap_db) AS best_gap_db FROM ({TARGET}) GROUP BY ALL""")
def _(spark, sf):
    return score.smallest_budget(score.target_table(fx.runs(spark, sf), 2.6), 2.6)


@query("scheme_coverage_a36", """SELECT band, outer_fold, mode, budget, scheme, count(DISTINCT repeat) AS total_repeats, count(*) FILTER (eligible) AS feasible_repeats,
 count(DISTINCT repeat)-count(*) FILTER (eligible) AS fallback_repeats FROM (
 SELECT *, CASE method WHEN 'M1' THEN 'FIXED' ELSE 'MATCHED' END AS scheme, n>=3 AS eligible FROM f_runs WHERE method IN ('M1','M2')) GROUP BY ALL""")
def _(spark, sf):
    rows = fx.runs(spark, sf).filter("method in ('M1','M2')").withColumn(
        "scheme", F.expr("case method when 'M1' then 'FIXED' else 'MATCHED' end")).withColumn("eligible", F.expr("n >= 3"))
    return score.scheme_coverage(rows)


@query("champion_t1", """SELECT band, method, rmse_db, mae_db, coverage FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY rmse_db, mae_db, method) AS rn FROM (
 SELECT band, method, 1e0 AS coverage, sqrt(avg((pred-observed_dbm)*(pred-observed_dbm))) AS rmse_db, avg(abs(pred-observed_dbm)) AS mae_db FROM f_pred GROUP BY ALL)) WHERE rn=1""")
def _(spark, sf):
    m = score.error_metrics(fx.predictions(spark, sf), ["band", "method"], quantiles=False)
    return score.champion(m, ["band"])


@query("replace_worst_two_t2", """WITH r AS (SELECT band, method, avg(abs(pred-observed_dbm)) AS oof_mae, sqrt(avg((pred-observed_dbm)*(pred-observed_dbm))) AS oof_rmse FROM f_pred WHERE role='train' GROUP BY ALL)
 SELECT band, method, oof_mae, oof_rmse, worst_rank, worst_rank<=2 AS removed FROM (SELECT *, CAST(row_number() OVER (PARTITION BY band ORDER BY oof_mae DESC, oof_rmse DESC, method) AS INTEGER) AS worst_rank FROM r)
 UNION ALL SELECT DISTINCT band, m, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS INTEGER), false FROM r, (VALUES ('MAT_A'),('MAT_B')) t(m)""")
def _(spark, sf):
    return score.replace_worst(fx.predictions(spark, sf).filter("role = 'train'"), ["MAT_A", "MAT_B"], by=["band"])


@query("common_path_mask_a33", "SELECT point_id, bool_and(gain_db IS NOT NULL) AS common_path FROM f_gains GROUP BY point_id")
def _(spark, sf):
    return score.common_path_mask(fx.gains(spark, sf))


@query("path_scopes_a33", """WITH a AS (SELECT g.config_id AS arm, p.band, p.observed_dbm, CASE WHEN config_ord=1 AND g.point_id%7=0 THEN NULL ELSE g.gain_db END AS pred,
   CASE WHEN g.point_id%7=0 THEN false ELSE g.gain_db IS NOT NULL END AS common FROM f_gains g JOIN f_points p USING (point_id) WHERE config_ord IN (0,1)),
 s AS (SELECT arm, band, 'own_path' AS scope, observed_dbm, pred AS p, 0 AS fb FROM a UNION ALL SELECT arm, band, 'common_path', observed_dbm, pred, 0 FROM a WHERE common
   UNION ALL SELECT arm, band, 'predeclared_fallback', observed_dbm, coalesce(pred,-80e0), CAST(pred IS NULL AS INTEGER) FROM a)
 SELECT arm, band, scope, count(*) AS eligible_n, count(p) AS predicted_n, CAST(count(p) AS DOUBLE)/count(*) AS coverage, sqrt(avg((p-observed_dbm)*(p-observed_dbm))) AS rmse_db,
  avg(abs(p-observed_dbm)) AS mae_db, quantile_cont(abs(p-observed_dbm),0.5) AS median_abs_db, avg(p-observed_dbm) AS bias_db, CAST(sum(fb) AS BIGINT) AS fallback_n FROM s GROUP BY arm, band, scope""")
def _(spark, sf):
    g = fx.gains(spark, sf).filter("config_ord in (0,1)").withColumn(
        "gain_db", F.expr("case when config_ord=1 and point_id%7=0 then null else gain_db end"))
    mask = score.common_path_mask(g)
    p = fx.points(spark, sf).select("point_id", "observed_dbm")
    rows = g.join(mask, "point_id").join(p, "point_id").selectExpr(
        "config_id as arm", "band", "observed_dbm", "gain_db as pred", "common_path", "-80D as fallback")
    return score.factorial_scopes(rows, ["arm", "band"], "pred", "fallback", "common_path")


@query("ensemble_r7", "SELECT point_id, avg(pred) AS mean_pred, quantile_cont(pred,0.5) AS median_pred FROM f_pred GROUP BY point_id")
def _(spark, sf):
    # ten experts a point: the built-in median is bounded here
    return fx.predictions(spark, sf).groupBy("point_id").agg(
        F.avg("pred").alias("mean_pred"), F.median("pred").alias("median_pred"))
