"""Queries over neighbour joins, interpolators, calibration and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridwright import fixtures as fx
from gridwright.functions import columns as col
from gridwright.functions.quantiles import attach
from gridwright.operators import calibrate, contracts, interp, knn, kriging, route, score, splits, vectors
from gridwright.queries.registry import query
from gridwright.queries.views import METRICS, h32
from gridwright.session import settle


def neighbours(spark, sf, k, by=("band",), carry=("observed_dbm",)):
    train, q = fx.split_points(spark, sf)
    return knn.knn_join(q, train, k, list(by), carry=list(carry)).withColumnRenamed("observed_dbm", "v")


def placed(spark, sf, k):
    """Neighbours with train (tx, ty) and query (qx, qy) coordinates."""
    n = neighbours(spark, sf, k, carry=("observed_dbm", "x", "y")).withColumnsRenamed({"x": "tx", "y": "ty"})
    _, q = fx.split_points(spark, sf)
    return n.join(q.select("band", F.col("point_id").alias("query_id"), F.col("x").alias("qx"), F.col("y").alias("qy")), ["band", "query_id"])


KEYS = ["band", "query_id"]
IDW = "coalesce(avg(CASE WHEN d<=1e-9 THEN v END), sum(v/power(greatest(d,1e-6),{p}))/sum(1e0/power(greatest(d,1e-6),{p})))"


@query("knn_join_j1", "SELECT band, query_id, train_id, CAST(rank AS INTEGER) AS rank, d, v FROM f_nbr WHERE rank<=8")
def _(spark, sf):
    return neighbours(spark, sf, 8)


@query("knn_join_skewed_j1", """WITH p AS (SELECT point_id, band, CASE WHEN point_id%3=0 THEN 500e0+point_id%10 ELSE x END AS x, CASE WHEN point_id%3=0 THEN 400e0+point_id%7 ELSE y END AS y, point_id%5=0 AS q FROM f_points)
 SELECT query_id, train_id, CAST(rank AS INTEGER) AS rank, d FROM (SELECT a.point_id AS query_id, b.point_id AS train_id, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d,
  row_number() OVER (PARTITION BY a.point_id ORDER BY sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)), b.point_id) AS rank FROM p a JOIN p b ON a.q AND NOT b.q) WHERE rank<=5""")
def _(spark, sf):
    p = fx.points(spark, sf).selectExpr(
        "point_id", "case when point_id%3=0 then 500D+point_id%10 else x end as x",
        "case when point_id%3=0 then 400D+point_id%7 else y end as y", "point_id%5=0 as q")
    return knn.knn_join(p.filter("q"), p.filter("not q"), 5).select("query_id", "train_id", "rank", "d")


@query("knn_embedding_j1", """SELECT query_id, train_id, CAST(rank AS INTEGER) AS rank, d FROM (SELECT a.vec_id AS query_id, b.vec_id AS train_id,
  sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS d,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)), b.vec_id) AS rank FROM f_emb a JOIN f_emb b ON a.vec_id<>b.vec_id) WHERE rank<=6""")
def _(spark, sf):
    e = fx.embedding_xyz(spark, sf)
    return knn.knn_join(e, e, 6, feats=("x", "y", "z"), query_id="vec_id", train_id="vec_id", exclude_same_id=True).select("query_id", "train_id", "rank", "d")


PAIR_DISTANCE = "sqrt(list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1]-z[2])*(z[1]-z[2]))))"


@query("knn_vectors_j1", f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS train_id, {PAIR_DISTANCE} AS d FROM v a JOIN v b ON a.vec_id<>b.vec_id)
 SELECT query_id, train_id, CAST(rank AS INTEGER) AS rank, d FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, train_id) AS rank FROM p) WHERE rank<=6""")
def _(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return vectors.vector_knn(e, e, 6, query_id="vec_id", train_id="vec_id", exclude_same_id=True)


@query("knn_vectors_by_label_j1", f"""WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 p AS (SELECT a.label, a.vec_id AS query_id, b.vec_id AS train_id, {PAIR_DISTANCE} AS d FROM v a JOIN v b ON a.label=b.label AND a.vec_id%4=0 AND b.vec_id%4<>0)
 SELECT label, query_id, train_id, CAST(rank AS INTEGER) AS rank, d FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, train_id) AS rank FROM p) WHERE rank<=16""")
def _(spark, sf):
    e = fx.table(spark, sf, "embeddings")
    return vectors.vector_knn(e.filter("vec_id%4=0"), e.filter("vec_id%4<>0"), 16, by=["label"], query_id="vec_id", train_id="vec_id")


@query("nearest_distance_j2", "SELECT band, query_id, d AS nearest_m FROM f_nbr WHERE rank=1")
def _(spark, sf):
    train, q = fx.split_points(spark, sf)
    return knn.nearest_distance(q, train, ["band"])


@query("knn_join_class_penalty_j3", """SELECT band, query_id, train_id, CAST(rank AS INTEGER) AS rank, d FROM (SELECT q.band, q.point_id AS query_id, t.point_id AS train_id,
  sqrt((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)+(q.c-t.c)*(q.c-t.c)) AS d,
  row_number() OVER (PARTITION BY q.band, q.point_id ORDER BY sqrt((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)+(q.c-t.c)*(q.c-t.c)), t.point_id) AS rank
  FROM (SELECT *, CASE WHEN los THEN 0e0 ELSE 40e0 END AS c FROM f_query) q JOIN (SELECT *, CASE WHEN los THEN 0e0 ELSE 40e0 END AS c FROM f_train) t ON q.band=t.band) WHERE rank<=8""")
def _(spark, sf):
    train, q = (s.withColumn("c", F.when(F.col("los"), 0.0).otherwise(40.0)) for s in fx.split_points(spark, sf))
    return knn.knn_join(q, train, 8, ["band"], feats=("x", "y", "c"))


@query("idw_metrics_by_band", f"""WITH p AS (SELECT band, query_id, any_value(q_obs) AS obs, {IDW.format(p=2)} AS pred FROM f_nbr WHERE rank<=8 GROUP BY ALL)
 SELECT band, {METRICS} FROM (SELECT band, pred-obs AS e FROM p) GROUP BY band""")
def _(spark, sf):
    _, q = fx.split_points(spark, sf)
    contracts.require(contracts.points_report(fx.points(spark, sf).withColumn(
        "observed_dbm", F.when(F.col("role") == "train", F.col("observed_dbm"))), min_train=3))
    pred = interp.idw(neighbours(spark, sf, 8), KEYS, "v", 8, 2.0).withColumnRenamed("query_id", "point_id")
    return score.error_metrics(settle(q.join(pred, ["band", "point_id"])), ["band"])


@query("idw_grid_i1_j12", f"""SELECT band, query_id, k, power, {IDW.format(p='power')} AS pred FROM f_nbr, (VALUES (8),(16),(32),(64)) a(k), (VALUES (1e0),(2e0)) b(power) WHERE rank<=k GROUP BY ALL""")
def _(spark, sf):
    grid = interp.param_grid(neighbours(spark, sf, 64), k=[8, 16, 32, 64], power=[1.0, 2.0])
    return interp.idw(grid, [*KEYS, "k", "power"], "v", F.col("k"), F.col("power"))


@query("idw_floored_i1", "SELECT band, query_id, sum(v/power(greatest(d,1e-3),2))/sum(1e0/power(greatest(d,1e-3),2)) AS pred FROM f_nbr WHERE rank<=16 GROUP BY ALL")
def _(spark, sf):
    return interp.idw(neighbours(spark, sf, 16), KEYS, "v", 16, 2.0, variant="floored")


@query("gaussian_nw_i2", "SELECT * FROM f_nw50")
def _(spark, sf):
    return interp.gaussian_nw(neighbours(spark, sf, 128), KEYS, "v", 50.0)


@query("gaussian_nw_stable_i2", """SELECT band, query_id, sum(w*v)/sum(w) AS pred FROM (SELECT *, exp(-0.5e0*(d*d-d0*d0)/2500e0) AS w FROM (SELECT *, min(d) OVER (PARTITION BY band, query_id) AS d0 FROM f_nbr)) GROUP BY ALL""")
def _(spark, sf):
    return interp.gaussian_nw(neighbours(spark, sf, 128), KEYS, "v", 50.0, stable=True)


@query("adaptive_gaussian_i3", """SELECT band, query_id, CASE WHEN sum(w)<=1e-12 THEN min_by(v,rank) ELSE sum(w*v)/sum(w) END AS pred FROM (SELECT *, exp(-0.5e0*(d/bw)*(d/bw)) AS w FROM (
  SELECT *, greatest(max(d) OVER (PARTITION BY band, query_id),1e-6) AS bw FROM f_nbr WHERE rank<=16)) GROUP BY ALL""")
def _(spark, sf):
    return interp.adaptive_gaussian(neighbours(spark, sf, 16), KEYS, "v", 16)


@query("weighted_median_i6_w4", """SELECT band, query_id, min(v) AS pred FROM (SELECT *, sum(w) OVER (PARTITION BY band, query_id ORDER BY v, train_id ROWS UNBOUNDED PRECEDING) AS c, sum(w) OVER (PARTITION BY band, query_id) AS t
  FROM (SELECT *, 1e0/power(greatest(d,1e-3),1) AS w FROM f_nbr WHERE rank<=16)) WHERE c>=0.5e0*t-1e-15 GROUP BY ALL""")
def _(spark, sf):
    return interp.weighted_median(neighbours(spark, sf, 16), KEYS, "v", 16, 1.0)


def solve_sql(n: int, source: str, keys: str, out: str) -> str:
    """Gaussian elimination of the symmetric system a{i}{j}, b{i} in plain SQL; ``out`` over x0..x{n-1}."""
    sql = source
    for p in range(n - 1):
        new = []
        for i in range(p + 1, n):
            f = f"a{min(p, i)}{max(p, i)}/a{p}{p}"
            new += [f"a{i}{j}-({f})*a{p}{j} AS a{i}{j}" for j in range(i, n)] + [f"b{i}-({f})*b{p} AS b{i}"]
        sql = f"SELECT * REPLACE ({', '.join(new)}) FROM ({sql})"
    for p in reversed(range(n)):
        rest = "".join(f"-a{p}{j}*x{j}" for j in range(p + 1, n))
        sql = f"SELECT *, (b{p}{rest})/a{p}{p} AS x{p} FROM ({sql})"
    return f"SELECT {keys}, {out} FROM ({sql})"


def normal_sql(cols, w, y, regular):
    n = len(cols)
    parts = [f"sum({w}*({cols[i]})*({cols[j]})){'+' + str(regular[i]) if i == j else ''} AS a{i}{j}" for i in range(n) for j in range(i, n)]
    parts += [f"sum({w}*({cols[i]})*{y}) AS b{i}" for i in range(n)]
    return ", ".join(parts)


@query("local_ridge_i4", solve_sql(3, f"""SELECT n.band, query_id, {normal_sql(['1e0', '(tx-qx)/sx', '(ty-qy)/sy'], 'w', 'v', ['1e-8', '1e0', '1e0'])}
  FROM (SELECT *, 1e0/power(greatest(d,1e-3),1) AS w FROM f_nbr WHERE rank<=32) n JOIN (SELECT band, greatest(stddev_pop(x),1e-3) AS sx, greatest(stddev_pop(y),1e-3) AS sy FROM f_train GROUP BY band) s ON n.band=s.band GROUP BY n.band, query_id""", "band, query_id", "x0 AS pred"))
def _(spark, sf):
    train, _ = fx.split_points(spark, sf)
    spread = train.groupBy("band").agg(F.greatest(F.stddev_pop("x"), F.lit(1e-3)).alias("sx"), F.greatest(F.stddev_pop("y"), F.lit(1e-3)).alias("sy"))
    n = attach(placed(spark, sf, 32), spread, ["band"]).selectExpr("*", "tx/sx as ax", "qx/sx as bx", "ty/sy as ay", "qy/sy as by")
    return interp.local_ridge(n, KEYS, "v", [("ax", "bx"), ("ay", "by")], 32, 1.0, 1.0)


LOCAL = """(SELECT *, exp(l-max(l) OVER (PARTITION BY band, query_id)) AS w FROM (SELECT *, -0.5e0*(d/s)*(d/s) AS l FROM (SELECT *, {s} AS s FROM f_nbr WHERE rank<=32)))"""


@query("local_kernel_i5", f"""SELECT band, query_id, greatest(lo, least(hi, sum(w*v)/sum(w))) AS pred FROM {LOCAL.format(s='50e0')} JOIN (SELECT band, min(observed_dbm) AS lo, max(observed_dbm) AS hi FROM f_train GROUP BY band) USING (band) GROUP BY band, query_id, lo, hi""")
def _(spark, sf):
    train, _ = fx.split_points(spark, sf)
    lim = train.groupBy("band").agg(F.min("observed_dbm").alias("lo"), F.max("observed_dbm").alias("hi"))
    return interp.local_kernel(attach(placed(spark, sf, 32), lim, ["band"]), KEYS, "v", F.col("lo"), F.col("hi"))


@query("local_kernel_linear_i5", solve_sql(3, f"""SELECT band, query_id, any_value(lo) AS lo, any_value(hi) AS hi, {normal_sql(['1e0', '(tx-qx)/greatest(s,5e0)', '(ty-qy)/greatest(s,5e0)'], 'w', 'v', ['0e0', '1e0', '1e0'])}
  FROM {LOCAL.format(s='greatest(max(d) OVER (PARTITION BY band, query_id),5e0)')} JOIN (SELECT band, min(observed_dbm) AS lo, max(observed_dbm) AS hi FROM f_train GROUP BY band) USING (band) GROUP BY band, query_id""", "band, query_id", "greatest(lo, least(hi, x0)) AS pred"))
def _(spark, sf):
    train, _ = fx.split_points(spark, sf)
    lim = train.groupBy("band").agg(F.min("observed_dbm").alias("lo"), F.max("observed_dbm").alias("hi"))
    return interp.local_kernel(attach(placed(spark, sf, 32), lim, ["band"]), KEYS, "v", F.col("lo"), F.col("hi"), linear=True, adaptive=True)


@query("local_kernel_physics_i5", """WITH n AS (SELECT f_nbr.*, a.raw AS tr, b.raw AS qr FROM f_nbr JOIN f_base a ON a.point_id=train_id JOIN f_base b ON b.point_id=query_id WHERE rank<=32),
 l AS (SELECT *, -0.5e0*(d/50e0)*(d/50e0)+CASE WHEN tr IS NOT NULL AND qr IS NOT NULL THEN -0.5e0*((qr-tr)/10e0)*((qr-tr)/10e0) WHEN tr IS NOT NULL OR qr IS NOT NULL THEN ln(0.25e0) ELSE 0e0 END AS l FROM n)
 SELECT band, query_id, greatest(lo, least(hi, sum(w*v)/sum(w))) AS pred FROM (SELECT *, exp(l-max(l) OVER (PARTITION BY band, query_id)) AS w FROM l) JOIN (SELECT band, min(observed_dbm) AS lo, max(observed_dbm) AS hi FROM f_train GROUP BY band) USING (band) GROUP BY band, query_id, lo, hi""")
def _(spark, sf):
    b = fx.base_gain(spark, sf)
    train, q = b.filter("role='train'"), b.filter("role='query'")
    n = knn.knn_join(q, train, 32, ["band"], carry=["observed_dbm", "raw"]).withColumnRenamed("raw", "tr")
    n = n.join(q.select("band", F.col("point_id").alias("query_id"), F.col("raw").alias("qr")), KEYS)
    lim = train.groupBy("band").agg(F.min("observed_dbm").alias("lo"), F.max("observed_dbm").alias("hi"))
    return interp.local_kernel(attach(n, lim, ["band"]), KEYS, "observed_dbm", F.col("lo"), F.col("hi"), physics=("tr", "qr"))


@query("local_kriging_i8")
def _(spark, sf):
    spread = fx.base_gain(spark, sf).filter("role='train'").groupBy("band").agg(F.stddev_pop("observed_dbm").alias("deviation"))
    near = attach(placed(spark, sf, 64), spread, ["band"])
    return interp.local_kriging(near, KEYS, {"pred": "v"}, (50.0, 50.0), 1.0, 0.05, variance="latent_var", scale="deviation")


def standardised(spark, sf):
    """64 neighbours of every query with mean and deviation of its band's train rows."""
    spread = fx.base_gain(spark, sf).filter("role='train'").groupBy("band").agg(F.avg("observed_dbm").alias("center"), F.stddev_pop("observed_dbm").alias("scale"))
    return attach(placed(spark, sf, 64), spread, ["band"])


@query("kriging_search_i8")
def _(spark, sf):
    return kriging.search(standardised(spark, sf), ["band"], "query_id", "v")


@query("fitted_kriging_i8")
def _(spark, sf):
    near = settle(standardised(spark, sf))
    return kriging.fitted_kriging(near, ["band"], "query_id", "v", kriging.search(near, ["band"], "query_id", "v"))


@query("rbf_residual_i8")
def _(spark, sf):
    return interp.local_kriging(placed(spark, sf, 64), KEYS, {"pred": "v"}, (45.0, 45.0), 1.0, 1.0, kernel="rbf")


@query("tree_regressor_i9")
def _(spark, sf):
    b = fx.base_gain(spark, sf).withColumn("raw", F.coalesce("raw", F.lit(0.0))).withColumn("los", F.col("los").cast("double"))
    one = lambda band: interp.tree_regressor(band.filter("role='train'"), band.filter("role='query'"), ["x", "y", "raw", "los"], "observed_dbm", trees=10, depth=5)
    return one(b.filter("band='n41'")).unionByName(one(b.filter("band='n79'"))).select("band", "point_id", "pred")


@query("date_only_idw_i7", f"""WITH c AS (SELECT band, date, count(*) AS n FROM f_train GROUP BY ALL),
 k AS (SELECT q.band, q.point_id AS query_id, t.observed_dbm AS v, sqrt((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)) AS d,
  row_number() OVER (PARTITION BY q.band, q.point_id ORDER BY sqrt((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)), t.point_id) AS rank
  FROM f_query q LEFT JOIN c ON c.band=q.band AND c.date=q.date JOIN f_train t ON t.band=q.band AND (coalesce(c.n,0)<2 OR t.date=q.date))
 SELECT band, query_id, {IDW.format(p=2)} AS pred FROM k WHERE rank<=16 GROUP BY ALL""")
def _(spark, sf):
    train, q = fx.split_points(spark, sf)
    n = train.groupBy("band", "date").agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 2").select("band", "date")
    dated = q.join(n, ["band", "date"], "left_semi")
    pooled = q.join(n, ["band", "date"], "left_anti")
    a = knn.knn_join(dated, train, 16, ["band", "date"], carry=["observed_dbm"]).drop("date")
    b = knn.knn_join(pooled, train, 16, ["band"], carry=["observed_dbm"])
    return interp.idw(a.unionByName(b), KEYS, "observed_dbm", 16, 2.0)


OFFS = """off AS (SELECT band, date, count(*) AS n, count(*)/(count(*)+20e0)*(quantile_cont(observed_dbm,0.5)-any_value(g)) AS offset_db FROM f_train JOIN (SELECT band, quantile_cont(observed_dbm,0.5) AS g FROM f_train GROUP BY band) USING (band) GROUP BY band, date)"""


@query("date_offsets_a17", f"WITH {OFFS} SELECT * FROM off")
def _(spark, sf):
    train, _ = fx.split_points(spark, sf)
    return calibrate.date_offsets(train, ["band"], "date", "observed_dbm", 20.0)


@query("date_center_idw_i7", f"""WITH {OFFS}, n AS (SELECT f_nbr.band, query_id, d, v-coalesce(o.offset_db,0e0) AS v, coalesce(p.offset_db,0e0) AS qo FROM f_nbr LEFT JOIN off o ON o.band=f_nbr.band AND o.date=t_date LEFT JOIN off p ON p.band=f_nbr.band AND p.date=q_date WHERE rank<=16)
 SELECT band, query_id, {IDW.format(p=2)}+any_value(qo) AS pred FROM n GROUP BY band, query_id""")
def _(spark, sf):
    train, q = fx.split_points(spark, sf)
    off = settle(calibrate.date_offsets(train, ["band"], "date", "observed_dbm", 20.0).select("band", "date", "offset_db"))
    centred = train.join(off, ["band", "date"], "left").withColumn("v", F.col("observed_dbm") - F.coalesce("offset_db", F.lit(0.0)))
    pred = interp.idw(knn.knn_join(q, centred, 16, ["band"], carry=["v"]), KEYS, "v", 16, 2.0)
    qo = q.join(off, ["band", "date"], "left").select("band", F.col("point_id").alias("query_id"), F.coalesce("offset_db", F.lit(0.0)).alias("qo"))
    return pred.join(qo, KEYS).select(*KEYS, (F.col("pred") + F.col("qo")).alias("pred"))


# --- calibration ----------------------------------------------------------------------------------

def fit_gains(spark, sf):
    """Gains of the training points with label and distance."""
    train = fx.points(spark, sf).withColumn("d3", fx.tx_distance()).filter("role='train'").select("point_id", "observed_dbm", "d3")
    return fx.gains(spark, sf).join(train, "point_id")


SELECT_BIAS = """SELECT band, family, config_id, bias, fit_rmse, fit_n FROM (SELECT *, row_number() OVER (PARTITION BY band, family ORDER BY fit_rmse, config_id) AS rn FROM (
 SELECT r.band, r.family, r.config_id, bias, count(*) AS fit_n, sqrt(avg((r.r-bias)*(r.r-bias))) AS fit_rmse FROM r JOIN (SELECT band, family, config_id, quantile_cont(r,0.5) AS bias FROM r GROUP BY ALL) b USING (band, family, config_id) GROUP BY ALL) WHERE fit_n>=100) WHERE rn=1"""
RES = "r AS (SELECT g.band, g.family, g.config_id, t.observed_dbm-g.gain_db AS r FROM f_gains g JOIN f_train t USING (point_id) WHERE g.gain_db IS NOT NULL)"


@query("select_config_a14", f"WITH {RES} {SELECT_BIAS}")
def _(spark, sf):
    return calibrate.select_config(fit_gains(spark, sf), ["band", "family"], 100)


CLASS = """WITH t AS (SELECT g.band, g.config_id, log10(greatest(b.d3,1e0)) AS l, CASE WHEN g.los THEN 0e0 ELSE 1e0 END AS n, b.observed_dbm-g.gain_db AS y FROM f_gains g JOIN f_base b USING (point_id) WHERE b.role='train' AND g.gain_db IS NOT NULL),
 q AS (SELECT t.*, l-c AS q, c FROM t JOIN (SELECT band, config_id, avg(l) AS c FROM t GROUP BY ALL) USING (band, config_id))"""
CLASS_SOLVE = solve_sql(4, f"""SELECT band, config_id, ridge, any_value(c) AS center, CAST(count(*) AS DOUBLE) AS n, {normal_sql(['1e0', 'q', 'n', 'q*n'], '1e0', 'y', ['0e0', 'ridge', 'ridge', 'ridge'])} FROM q, (VALUES (1e0),(5e0),(20e0)) k(ridge) GROUP BY band, config_id, ridge""",
                         "band, config_id, ridge, center, n", "x0 AS c0, x1 AS c1, x2 AS c2, x3 AS c3")


@query("class_ridge_a12", f"{CLASS} {CLASS_SOLVE}")
def _(spark, sf):
    return calibrate.class_ridge(fit_gains(spark, sf), ["band", "config_id"], [1.0, 5.0, 20.0])


@query("select_config_ridge_a14", f"""{CLASS}, fit AS ({CLASS_SOLVE})
 SELECT band, ridge, config_id, fit_rmse FROM (SELECT *, row_number() OVER (PARTITION BY band, ridge ORDER BY fit_rmse, config_id) AS rn FROM (
 SELECT band, ridge, config_id, sqrt(avg(power(y-(c0+c1*q+c2*q.n+c3*q*q.n),2))) AS fit_rmse FROM q JOIN fit USING (band, config_id) GROUP BY band, ridge, config_id)) WHERE rn=1""")
def _(spark, sf):
    return calibrate.select_config_ridge(fit_gains(spark, sf), ["band"], [1.0, 5.0, 20.0], 4).select("band", "ridge", "config_id", "fit_rmse")


@query("affine_trend_a13", """WITH m AS (SELECT band, count(*) AS n, avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy, avg(observed_dbm) AS b0 FROM f_train GROUP BY band),
 z AS (SELECT t.band, (x-mx)/sx AS zx, (y-my)/sy AS zy, observed_dbm AS v FROM f_train t JOIN m USING (band)),
 s AS (SELECT band, sum(zx*zx)+10 AS a, sum(zx*zy) AS b, sum(zy*zy)+10 AS c, sum(zx*v) AS p, sum(zy*v) AS q FROM z GROUP BY band)
 SELECT f.point_id, b0+(p*c-q*b)/(a*c-b*b)*(f.x-mx)/sx+(q*a-p*b)/(a*c-b*b)*(f.y-my)/sy AS trend FROM f_query f JOIN m USING (band) JOIN s USING (band)""")
def _(spark, sf):
    train, q = fx.split_points(spark, sf)
    plane = calibrate.affine_trend(train, ["band"], "observed_dbm")
    return attach(q, plane, ["band"]).select("point_id", calibrate.trend_value(F.col("x"), F.col("y")).alias("trend"))


@query("mean_offset_a15", "SELECT band, trajectory_group, avg(observed_dbm-raw) AS beta_db, count(raw) AS path_n FROM f_base WHERE role='train' GROUP BY ALL")
def _(spark, sf):
    return calibrate.mean_offset(fx.base_gain(spark, sf).filter("role='train'"), ["band", "trajectory_group"], "raw")


@query("supported_calibration_a16")
def _(spark, sf):
    return calibrate.supported_calibration(fx.base_gain(spark, sf).filter("role='train'"), ["band"])


@query("assemble_features_p11", """WITH w AS (SELECT point_id, band, quantile_cont(CASE WHEN family='BASE' THEN gain_db END,0.5) AS base, quantile_cont(CASE WHEN family='S4W' THEN gain_db END,0.5) AS s4w, quantile_cont(CASE WHEN family='S5' THEN gain_db END,0.5) AS s5 FROM f_gains GROUP BY point_id, band),
 m AS (SELECT band, quantile_cont(base,0.5) AS mb, quantile_cont(s4w,0.5) AS m4, quantile_cont(s5,0.5) AS m5 FROM w GROUP BY band)
 SELECT point_id, coalesce(base,mb,-150e0) AS base, coalesce(s4w,m4,-150e0) AS s4w, coalesce(s5,m5,-150e0) AS s5,
  CAST(base IS NULL AS INTEGER)+CAST(s4w IS NULL AS INTEGER)+CAST(s5 IS NULL AS INTEGER) AS missing_n, log10(greatest(d3,1e0)) AS log_d FROM w JOIN m USING (band) JOIN f_base USING (point_id)""")
def _(spark, sf):
    p = fx.points(spark, sf).withColumn("d3", fx.tx_distance())
    return calibrate.assemble_features(fx.gains(spark, sf), p).select("point_id", "base", "s4w", "s5", "missing_n", "log_d")


@query("robust_scale_p13", """WITH m AS (SELECT band, quantile_cont(raw,0.5) AS m FROM f_base WHERE role='train' GROUP BY band),
 f AS (SELECT b.*, m, coalesce(raw,m) AS v FROM f_base b JOIN m USING (band)),
 s AS (SELECT band, quantile_cont(abs(v-m),0.5)*1.4826e0 AS s, stddev_pop(v) AS sd FROM f WHERE role='train' GROUP BY band)
 SELECT point_id, greatest(-5e0, least(5e0, (v-m)/CASE WHEN s>1e-8 THEN s WHEN sd>1e-8 THEN sd ELSE 1 END)) AS raw FROM f JOIN s USING (band)""")
def _(spark, sf):
    b = fx.base_gain(spark, sf)
    return calibrate.robust_scale(b, F.col("role") == "train", ["band"], ["raw"]).select("point_id", "raw")


@query("standard_scale_p14", """SELECT point_id, greatest(-10e0, least(10e0, (observed_dbm-m)/s)) AS z FROM f_points JOIN (SELECT band, avg(observed_dbm) AS m, stddev_pop(observed_dbm) AS s FROM f_train GROUP BY band) USING (band)""")
def _(spark, sf):
    p = fx.points(spark, sf).withColumn("z_", F.col("observed_dbm"))
    return calibrate.standard_scale(p, F.col("role") == "train", ["band"], ["z_"]).select("point_id", F.col("z_").alias("z"))


@query("robust_source_score_a28", """WITH r AS (SELECT *, raw-3e0 AS alt FROM f_base), m AS (SELECT band, quantile_cont(observed_dbm-raw,0.5) AS m1, quantile_cont(observed_dbm-alt-point_id%3,0.5) AS m2 FROM r WHERE role='train' GROUP BY band),
 s AS (SELECT band, m1, m2, greatest(1.4826e0*quantile_cont(abs(observed_dbm-raw-m1),0.5),0.5e0) AS s1, greatest(1.4826e0*quantile_cont(abs(observed_dbm-alt-point_id%3-m2),0.5),0.5e0) AS s2 FROM r JOIN m USING (band) WHERE role='train' GROUP BY band, m1, m2),
 t AS (SELECT point_id, coalesce(abs(observed_dbm-raw-m1)/s1,1e6) AS a, coalesce(abs(observed_dbm-alt-point_id%3-m2)/s2,1e6) AS b FROM r JOIN s USING (band))
 SELECT point_id, least(a,b) AS source_score, CASE WHEN a<=b THEN 'fixed' ELSE 'alternate' END AS source FROM t""")
def _(spark, sf):
    b = fx.base_gain(spark, sf).withColumn("alt", F.expr("raw - 3D + point_id%3"))
    return calibrate.robust_source_score(b, ["band"], F.col("role") == "train", [("raw", "fixed"), ("alt", "alternate")]).select("point_id", "source_score", "source")


@query("pseudo_labels_a29", """SELECT point_id, CASE WHEN raw IS NOT NULL AND alt IS NOT NULL THEN CASE WHEN abs(observed_dbm-alt)<abs(observed_dbm-raw) THEN 1e0 ELSE 0e0 END
  WHEN raw IS NOT NULL THEN 0e0 WHEN alt IS NOT NULL THEN 1e0 END AS label FROM (SELECT *, CASE WHEN point_id%4=0 THEN NULL ELSE coalesce(raw+point_id%5-2,-70e0) END AS alt FROM f_base)""")
def _(spark, sf):
    b = fx.base_gain(spark, sf).withColumn("alt", F.expr("case when point_id%4=0 then null else coalesce(raw+point_id%5-2,-70D) end"))
    return b.select("point_id", calibrate.pseudo_labels(F.col("raw"), F.col("alt"), F.col("observed_dbm")).alias("label"))


@query("residual_hybrid_i10", f"""WITH {RES.replace('WHERE', "WHERE g.family='BASE' AND ")}, sel AS ({SELECT_BIAS}),
 phys AS (SELECT b.*, raw+bias AS ph FROM f_base b JOIN sel ON sel.band=b.band),
 nb AS (SELECT * FROM (SELECT q.band, q.point_id AS query_id, t.observed_dbm-t.ph AS v, sqrt((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)) AS d,
   row_number() OVER (PARTITION BY q.band, q.point_id ORDER BY sqrt((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)), t.point_id) AS rank FROM phys q JOIN phys t ON q.band=t.band WHERE q.role='query' AND t.role='train' AND t.ph IS NOT NULL) WHERE rank<=128),
 cor AS (SELECT band, query_id, CASE WHEN sum(w)<=1e-12 THEN min_by(v,rank) ELSE sum(w*v)/greatest(sum(w),1e-12) END AS c FROM (SELECT *, exp(-0.5e0*((d/25e0)*(d/25e0))) AS w FROM nb) GROUP BY ALL)
 SELECT p.point_id, coalesce(p.ph+0.75e0*c, nw.pred) AS pred FROM phys p JOIN cor ON cor.query_id=p.point_id JOIN f_nw50 nw ON nw.query_id=p.point_id WHERE p.role='query'""")
def _(spark, sf):
    from gridwright.operators import experts
    train, q = (fx.base_gain(spark, sf).filter(f"role='{r}'") for r in ("train", "query"))
    sel = calibrate.select_config(fit_gains(spark, sf).filter("family='BASE'"), ["band"], 100)
    return experts.residual_hybrid(train, q, sel, ["band"], 25.0, 0.75).select("point_id", "pred")


@query("influence_field_a32")
def _(spark, sf):
    from gridwright.operators import rays
    b = fx.base_gain(spark, sf).filter("role='train' and raw is not null")
    res = attach(b, calibrate.mean_offset(b, ["band"], "raw"), ["band"]).withColumn("res", F.expr("observed_dbm-raw-beta_db"))
    grid = rays.GridSpec(0.0, 0.0, 100.0, 12, 10)
    return rays.influence_field(rays.segment_cells(fx_with_tx(res), ["band"], grid), res, ["band"], "res", grid)


@query("influence_field_fine_a32")
def _(spark, sf):
    """The same field on cells of 20 m: 3,000 cells, more than one task solves."""
    from gridwright.operators import rays
    b = fx.base_gain(spark, sf).filter("role='train' and raw is not null")
    res = attach(b, calibrate.mean_offset(b, ["band"], "raw"), ["band"]).withColumn("res", F.expr("observed_dbm-raw-beta_db"))
    grid = rays.GridSpec(0.0, 0.0, 20.0, 60, 50)
    return rays.influence_field(rays.segment_cells(fx_with_tx(res), ["band"], grid), res, ["band"], "res", grid, tolerance=0.1)


def fx_with_tx(df):
    return df.withColumn("tx_x", F.when(F.col("band") == "n41", fx.TX["n41"][0]).otherwise(fx.TX["n79"][0])).withColumn(
        "tx_y", F.when(F.col("band") == "n41", fx.TX["n41"][1]).otherwise(fx.TX["n79"][1]))


@query("segment_cells_j11", """WITH p AS (SELECT point_id, x, y, CASE WHEN band='n41' THEN 134e0 ELSE 137e0 END AS a, CASE WHEN band='n41' THEN 45e0 ELSE 188e0 END AS b FROM f_points),
 d AS (SELECT *, x-a AS dx, y-b AS dy, sqrt((x-a)*(x-a)+(y-b)*(y-b)) AS len FROM p),
 c AS (SELECT point_id, 0e0 AS t FROM d UNION SELECT point_id, 1e0 FROM d UNION SELECT point_id, (i*100e0-a)/dx FROM d, range(1,12) k(i) WHERE abs(dx)>1e-12 AND (i*100e0-a)/dx BETWEEN 0 AND 1
   UNION SELECT point_id, (i*100e0-b)/dy FROM d, range(1,10) k(i) WHERE abs(dy)>1e-12 AND (i*100e0-b)/dy BETWEEN 0 AND 1),
 s AS (SELECT point_id, t AS l, lead(t) OVER (PARTITION BY point_id ORDER BY t) AS r FROM c)
 SELECT point_id, CAST(least(greatest(floor((b+0.5e0*(l+r)*dy)/100e0),0),9)*12+least(greatest(floor((a+0.5e0*(l+r)*dx)/100e0),0),11) AS BIGINT) AS cell_id, sum(len*(r-l)/100e0) AS frac
 FROM s JOIN d USING (point_id) WHERE r-l>1e-12 AND len>1e-12 GROUP BY ALL""")
def _(spark, sf):
    from gridwright.operators import rays
    return rays.segment_cells(fx_with_tx(fx.points(spark, sf)), [], rays.GridSpec(0.0, 0.0, 100.0, 12, 10)).select("point_id", "cell_id", "frac")


# --- selection and routing ------------------------------------------------------------------------

@query("select_method_r2", """WITH b AS (SELECT band, method FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY loss, method_ord) AS rn FROM (SELECT band, method, method_ord, avg(abs(pred-observed_dbm)) AS loss FROM f_pred WHERE role='train' GROUP BY ALL)) WHERE rn=1)
 SELECT point_id, f_pred.method, pred FROM f_pred JOIN b ON b.band=f_pred.band AND b.method=f_pred.method WHERE role='query'""")
def _(spark, sf):
    p = fx.predictions(spark, sf)
    chosen = route.select_method(p.filter("role='train'"), ["band"], "MAE")
    return route.apply_selection(p.filter("role='query'"), chosen, ["band"]).select("point_id", "method", "pred")


@query("risk_features_r3", """SELECT n.query_id AS point_id, ln(1+min(d)) AS f_near, ln(1+max(d)) AS f_far, any_value(s) AS f_spread, any_value(CASE WHEN raw IS NULL THEN 0e0 ELSE 1e0 END) AS f_path
 FROM (SELECT * FROM f_nbr WHERE rank<=16) n JOIN (SELECT point_id, stddev_pop(pred) AS s FROM f_pred GROUP BY 1) p ON p.point_id=n.query_id JOIN f_base b ON b.point_id=n.query_id GROUP BY n.query_id""")
def _(spark, sf):
    b = fx.base_gain(spark, sf).withColumn("has_path", F.col("raw").isNotNull())
    preds = fx.predictions(spark, sf).select("band", "point_id", "pred")
    return route.risk_features(b.filter("role='train'"), b.filter("role='query'"), preds, ["band"]).drop("band")


META = """meta AS (SELECT point_id, band, role, (x%50)/7e0+point_id*1e-7 AS f_near, (y%60)/9e0 AS f_far, (point_id%13)/3e0 AS f_spread, CASE WHEN los THEN 1e0 ELSE 0e0 END AS f_path FROM f_points)"""


@query("local_risk_weights_r4", f"""WITH {META}, m AS (SELECT band, avg(f_near) AS m1, stddev_pop(f_near) AS s1, avg(f_far) AS m2, stddev_pop(f_far) AS s2, avg(f_spread) AS m3, stddev_pop(f_spread) AS s3, avg(f_path) AS m4, stddev_pop(f_path) AS s4 FROM meta WHERE role='train' GROUP BY band),
 z AS (SELECT point_id, band, role, (f_near-m1)/s1 AS a, (f_far-m2)/s2 AS b, (f_spread-m3)/s3 AS c, (f_path-m4)/s4 AS d FROM meta JOIN m USING (band)),
 n AS (SELECT * FROM (SELECT q.band, q.point_id, t.point_id AS tid, sqrt((q.a-t.a)*(q.a-t.a)+(q.b-t.b)*(q.b-t.b)+(q.c-t.c)*(q.c-t.c)+(q.d-t.d)*(q.d-t.d)) AS dist,
   row_number() OVER (PARTITION BY q.band, q.point_id ORDER BY sqrt((q.a-t.a)*(q.a-t.a)+(q.b-t.b)*(q.b-t.b)+(q.c-t.c)*(q.c-t.c)+(q.d-t.d)*(q.d-t.d)), t.point_id) AS rk FROM z q JOIN z t ON q.band=t.band AND q.role='query' AND t.role='train') WHERE rk<=64),
 l AS (SELECT band, point_id AS tid, method, abs(pred-observed_dbm) AS loss FROM f_pred WHERE role='train'), g AS (SELECT band, method, avg(loss) AS g FROM l GROUP BY ALL),
 r AS (SELECT n.band, n.point_id, l.method, sum(w*loss)/greatest(sum(w),1e-12) AS lr, sum(w)*sum(w)/greatest(sum(w*w),1e-12) AS ess FROM (SELECT *, exp(-0.5e0*dist*dist) AS w FROM n) n JOIN l ON l.band=n.band AND l.tid=n.tid GROUP BY ALL),
 k AS (SELECT point_id, r.method, greatest((lr*ess+g*32)/(ess+32),1e-6) AS risk, ess FROM r JOIN g ON g.band=r.band AND g.method=r.method)
 SELECT point_id, method, risk, ess, 1/(risk*risk)/sum(1/(risk*risk)) OVER (PARTITION BY point_id) AS weight FROM k""")
def _(spark, sf):
    m = fx.points(spark, sf).selectExpr("point_id", "band", "role", "(x%50)/7D+point_id*1e-7D as f_near", "(y%60)/9D as f_far", "(point_id%13)/3D as f_spread", "case when los then 1D else 0D end as f_path")
    p = fx.predictions(spark, sf).filter("role='train'")
    return route.local_risk_weights(m.filter("role='train'"), p, m.filter("role='query'"), ["band"], "MAE").select("point_id", "method", "risk", "ess", "weight")


@query("risk_router_r5", """WITH r AS (SELECT point_id, method, method_ord, pred, ((point_id*(method_ord+2)*7)%97)/10e0+0.1e0 AS risk FROM f_pred WHERE role='query'),
 h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY risk, method_ord) AS rn FROM r) WHERE rn=1),
 s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY risk, method_ord) AS rn FROM r WHERE method IN ('M0','M2','M5')) WHERE rn=1),
 w AS (SELECT point_id, sum(pred/power(greatest(risk,0.25e0),2))/sum(1/power(greatest(risk,0.25e0),2)) AS soft, sum(risk/power(greatest(risk,0.25e0),2))/sum(1/power(greatest(risk,0.25e0),2)) AS soft_risk FROM r GROUP BY 1)
 SELECT h.point_id, h.pred AS hard, h.risk AS hard_risk, h.method_ord AS hard_method, soft, soft_risk, s.pred AS safe FROM h JOIN s USING (point_id) JOIN w USING (point_id)""")
def _(spark, sf):
    r = fx.predictions(spark, sf).filter("role='query'").withColumn("risk", F.expr("((point_id*(method_ord+2)*7)%97)/10D+0.1D"))
    return route.risk_router(r, [], ["M0", "M2", "M5"])


@query("blend_search_r6", """WITH t AS (SELECT point_id, band, observed_dbm, max(CASE WHEN method='M3' THEN pred END) AS a, max(CASE WHEN method='M6' THEN pred END) AS b, (point_id*13)%60/1e0 AS dist, ((point_id*5)%31)/4e0 AS ra, ((point_id*3)%29)/4e0 AS rb FROM f_pred WHERE role='train' GROUP BY ALL),
 o AS (SELECT t.*, 'weight' AS rule, p AS param, p AS g FROM t, (VALUES (0e0),(0.25e0),(0.5e0),(0.75e0),(0.9e0),(1e0)) k(p) UNION ALL SELECT t.*, 'distance', p, exp(-0.5e0*(greatest(dist,0)/p)*(greatest(dist,0)/p)) FROM t, (VALUES (10e0),(25e0),(50e0),(100e0),(200e0)) k(p)
  UNION ALL SELECT t.*, 'risk', p, power(greatest(rb,0.1e0),p)/greatest(power(greatest(ra,0.1e0),p)+power(greatest(rb,0.1e0),p),1e-12) FROM t, (VALUES (1e0),(2e0)) k(p)),
 e AS (SELECT band, rule, param, greatest(0,least(1,g))*a+(1-greatest(0,least(1,g)))*b-observed_dbm AS e FROM o)
 SELECT band, rule, param, rmse, mae FROM (SELECT *, row_number() OVER (PARTITION BY band, rule ORDER BY rmse, mae, param) AS rn FROM (SELECT band, rule, param, sqrt(avg(e*e)) AS rmse, avg(abs(e)) AS mae FROM e GROUP BY ALL)) WHERE rn=1""")
def _(spark, sf):
    p = fx.predictions(spark, sf).filter("role='train'")
    t = p.groupBy("point_id", "band", "observed_dbm").agg(F.max(F.expr("case when method='M3' then pred end")).alias("a"), F.max(F.expr("case when method='M6' then pred end")).alias("b"))
    t = t.selectExpr("*", "(point_id*13)%60/1D as dist", "((point_id*5)%31)/4D as ra", "((point_id*3)%29)/4D as rb")
    # The searched weights, gate scales and risk powers.
    return route.blend_search(t, ["band"], "a", "b", [0.0, 0.25, 0.5, 0.75, 0.9, 1.0], [10.0, 25.0, 50.0, 100.0, 200.0], [1.0, 2.0], "dist", "ra", "rb")


@query("selective_metrics_r10", f"""WITH s AS (SELECT band, point_id, raw-observed_dbm AS e, abs(raw-observed_dbm+10e0) AS s FROM f_base WHERE raw IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY s, point_id) AS pos, count(*) OVER (PARTITION BY band) AS n FROM s)
 SELECT band, p AS percent, {METRICS}, CAST(count(*) AS DOUBLE)/any_value(n) AS retention FROM r, (VALUES (10),(25),(50),(75),(90),(100)) k(p) WHERE p=100 OR pos<=greatest(1,round_even(n*p/100e0,0)) GROUP BY band, p""")
def _(spark, sf):
    b = fx.base_gain(spark, sf).filter("raw is not null").selectExpr("band", "point_id", "raw as pred", "observed_dbm", "abs(raw-observed_dbm+10D) as s")
    return route.selective_metrics(b, ["band"], "s")


FIELD = """WITH t AS (SELECT *, abs(observed_dbm+75e0) AS risk, trajectory_group%3 AS fold FROM f_train),
 n AS (SELECT * FROM (SELECT q.band, q.fold, q.point_id, q.risk AS obs, t.risk AS v, sqrt((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)) AS d,
  row_number() OVER (PARTITION BY q.band, q.point_id ORDER BY sqrt((q.x-t.x)*(q.x-t.x)+(q.y-t.y)*(q.y-t.y)), t.point_id) AS rank FROM t q JOIN t ON q.band=t.band AND q.fold<>t.fold) WHERE rank<=64),
 p AS (SELECT band, fold, point_id, k, power, any_value(obs) AS obs, """ + IDW.format(p="power") + """ AS pred FROM n, (VALUES (8),(16),(32),(64)) a(k), (VALUES (1e0),(2e0)) b(power) WHERE rank<=k GROUP BY ALL),
 best AS (SELECT band, k, power, rmse FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY rmse, k, power) AS rn FROM (SELECT band, k, power, sqrt(avg((pred-obs)*(pred-obs))) AS rmse FROM p GROUP BY ALL)) WHERE rn=1)"""


@query("risk_field_i13", FIELD + f""" SELECT n.query_id AS point_id, greatest(0.1e0, least(30e0, {IDW.format(p='any_value(power)').replace('sum(v/power(greatest(d,1e-6),any_value(power)))', 'sum(v/power(greatest(d,1e-6),power))').replace('sum(1e0/power(greatest(d,1e-6),any_value(power)))', 'sum(1e0/power(greatest(d,1e-6),power))')})) AS risk
  FROM (SELECT band, query_id, d, rank, abs(v+75e0) AS v FROM f_nbr) n JOIN best USING (band) WHERE rank<=k GROUP BY n.query_id""")
def _(spark, sf):
    train, q = fx.split_points(spark, sf)
    t = train.withColumn("risk", F.expr("abs(observed_dbm+75D)")).withColumn("fold", F.expr("trajectory_group%3"))
    best = settle(route.field_search(t, ["band"], "risk", "fold"))
    return route.field_predict(t, q, best, ["band"], "risk", 0.1, 30.0, name="risk").select("point_id", "risk")


@query("field_search_i13", FIELD + " SELECT band, 0e0 AS penalty, k, power, rmse AS inner_rmse FROM best")
def _(spark, sf):
    train, _ = fx.split_points(spark, sf)
    t = train.withColumn("risk", F.expr("abs(observed_dbm+75D)")).withColumn("fold", F.expr("trajectory_group%3"))
    return route.field_search(t, ["band"], "risk", "fold")
