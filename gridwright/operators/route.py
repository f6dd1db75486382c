"""Out-of-fold evaluation, expert selection and risk-weighted blending over long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from gridwright.functions.columns import blend, blend_pair, cell_index, distance_gate, inverse_risk_gate
from gridwright.functions.quantiles import attach, exact_quantiles
from gridwright.functions.ranking import global_position
from gridwright.operators import interp, knn
from gridwright.operators.calibrate import pseudo_labels, standard_scale
from gridwright.operators.score import _with, argmin, choose_params, cv_score, error_metrics, pooled_score
from gridwright.session import settle

# Neighbour counts and powers of the field search.
FIELD_K = (8, 16, 32, 64)
FIELD_P = (1.0, 2.0)


def retain_percent(df: DataFrame, by: Sequence[str], score: str, percents: Sequence[int], row_id: str = "point_id") -> DataFrame:
    """Repeat scored rows per percent with ``position`` and ``retained``: the max(1, round(n·p/100))
    smallest scores, ties by id; rounding is half-even."""
    scored = df.filter(F.col(score).isNotNull())
    placed = global_position(scored, by, [F.col(score), F.col(row_id)], "position")
    sizes = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    rows = attach(placed, sizes, by).withColumn("percent", F.explode(F.array(*[F.lit(int(p)) for p in percents])))
    keep = F.greatest(F.lit(1), F.bround(F.col("_n") * F.col("percent") / 100.0, 0))
    return rows.withColumn("retained", F.col("position") <= keep).drop("_n")


def select_method(oof: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """Expert with the smallest pooled OOF loss; ties by the fixed expert order."""
    s = pooled_score(oof, [*by, "method", "method_ord"])
    loss = F.col("sae") / F.col("n") if metric == "MAE" else F.sqrt(F.col("sse") / F.col("n"))
    return argmin(s.withColumn("loss", loss), by, ["loss", "method_ord"], ["method", "method_ord", "loss"])


def apply_selection(query: DataFrame, chosen: DataFrame, by: Sequence[str]) -> DataFrame:
    pick = chosen.select(*by, F.col("method").alias("_m"))
    return attach(query, pick, by).filter(F.col("method") == F.col("_m")).drop("_m")


def risk_features(train: DataFrame, query: DataFrame, preds: DataFrame, by: Sequence[str], path: str = "has_path",
                  neighbours: DataFrame | None = None) -> DataFrame:
    """Per query: log1p nearest, log1p 16th-nearest (or last) distance, spread of the experts, path flag.

    ``neighbours`` (by…, point_id, near) may hold the ordered nearest train rows, at least 16 where there are so many.
    """
    if neighbours is None:
        d = knn.knn_join(query, train, 16, by).groupBy(*by, F.col("query_id").alias("point_id")).agg(
            F.log1p(F.min("d")).alias("f_near"), F.log1p(F.max("d")).alias("f_far"))
    else:
        d = neighbours.select(*by, "point_id", F.log1p(F.col("near")[0]["d"]).alias("f_near"),
                              F.log1p(F.element_at("near", F.least(F.size("near"), F.lit(16)))["d"]).alias("f_far"))
    # ten experts a point
    s = preds.groupBy(*by, "point_id").agg(F.stddev_pop("pred").alias("f_spread"))
    return d.join(s, [*by, "point_id"]).join(
        query.select(*by, "point_id", F.col(path).cast("double").alias("f_path")), [*by, "point_id"])


FEATURES = ("f_near", "f_far", "f_spread", "f_path")


def local_risk_weights(
    meta: DataFrame, oof: DataFrame, query_meta: DataFrame, by: Sequence[str], metric: str, k: int = 64, shrink: float = 32.0,
) -> DataFrame:
    """Simplex weights per (query, method) from the kernel-averaged OOF loss of similar training rows.

    ``meta``/``query_meta`` carry :data:`FEATURES`; ``oof(by…, point_id, method, method_ord, pred, observed_dbm)``.
    """
    return local_risk_table(meta, oof, query_meta, by, [metric], k, shrink).drop("metric")


def local_risk_table(
    meta: DataFrame, oof: DataFrame, query_meta: DataFrame, by: Sequence[str], metrics: Sequence[str], k: int = 64, shrink: float = 32.0,
) -> DataFrame:
    """:func:`local_risk_weights` for several metrics (MAE, RMSE) from one neighbour table: adds ``metric``."""
    by = list(by)
    cols = list(FEATURES)
    both = meta.select(*by, "point_id", *cols, F.lit(True).alias("_fit")).unionByName(
        query_meta.select(*by, "point_id", *cols, F.lit(False).alias("_fit")))
    scaled = standard_scale(both, F.col("_fit"), by, cols, limit=None, floor=1e-12)
    names = oof.select("method", "method_ord").distinct().orderBy("method_ord", "method").collect()  # the experts, at most 52
    if len(names) > 52:
        raise ValueError("more than 52 methods")
    # one row per training row: its losses ride through the neighbour join, where the rows of a query come out together,
    # so that a query's sums are ready before any exchange
    a = F.abs(F.col("pred") - F.col("observed_dbm"))
    tests = [F.col("method").eqNullSafe(F.lit(n["method"])) & F.col("method_ord").eqNullSafe(F.lit(n["method_ord"])) for n in names]
    held = sum((F.max(F.when(t, 1.0).otherwise(0.0)) * float(1 << i) for i, t in enumerate(tests)), F.lit(0.0))
    losses = settle(oof.select(*by, "point_id", "method", "method_ord", a.alias("_a")).groupBy(*by, "point_id").agg(
        held.alias("_held"), *[F.max(F.when(t, F.col("_a"))).alias(f"_l{i}") for i, t in enumerate(tests)]))
    power = {"MAE": lambda c: c, "RMSE": lambda c: c * c}
    overall = losses.groupBy(*by).agg(*[F.avg(power[m](F.col(f"_l{i}"))).alias(f"g{i}_{m}") for i in range(len(names)) for m in metrics])
    carried = ["_held", *[f"_l{i}" for i in range(len(names))]]
    fit = scaled.filter("_fit").join(losses, [*by, "point_id"], "left")
    nbrs = knn.knn_join(scaled.filter("not _fit"), fit, k, by, feats=cols, carry=carried)
    w = F.exp(-0.5 * F.col("d") * F.col("d"))
    sums = []
    for i in range(len(names)):
        own = F.when(F.getbit(F.col("_held").cast("long"), F.lit(i)) == 1, F.col("w"))
        sums += [F.count(own).alias(f"n{i}"), F.sum(own).alias(f"w{i}"), F.sum(own * own).alias(f"ww{i}")]
        sums += [F.sum(own * power[m](F.col(f"_l{i}"))).alias(f"s{i}_{m}") for m in metrics]
    r = attach(nbrs.withColumn("w", w).groupBy(*by, "query_id").agg(*sums), overall, by)
    r = settle(r) if len(metrics) > 1 else r
    floor = F.lit(1e-12)

    def entry(i, m):
        ess = F.col(f"w{i}") * F.col(f"w{i}") / F.greatest(F.col(f"ww{i}"), floor)
        risk = (F.col(f"s{i}_{m}") / F.greatest(F.col(f"w{i}"), floor) * ess + F.col(f"g{i}_{m}") * shrink) / (ess + shrink)
        return F.when(F.col(f"n{i}") > 0, F.struct(
            F.lit(m).alias("metric"), F.lit(names[i]["method"]).alias("method"), F.lit(names[i]["method_ord"]).cast(oof.schema["method_ord"].dataType).alias("method_ord"),
            F.greatest(F.sqrt(risk) if m == "RMSE" else risk, F.lit(1e-6)).alias("risk"), ess.alias("ess")))

    out = None
    for m in metrics:
        one = r.select(*by, "query_id", F.filter(F.array(*[entry(i, m) for i in range(len(names))]), lambda e: e.isNotNull()).alias("_m"))
        total = F.aggregate("_m", F.lit(0.0), lambda t, e: t + F.coalesce(1.0 / (e["risk"] * e["risk"]), F.lit(0.0)))
        one = one.withColumn("_t", total).select(*by, "query_id", "_t", F.explode("_m").alias("_e"))
        out = one if out is None else out.unionByName(one)
    r = out.select(*by, F.col("query_id").alias("point_id"), "_t", "_e.*")
    return r.withColumn("weight", 1.0 / (F.col("risk") * F.col("risk")) / F.col("_t")).drop("_t")


def weighted_blend(preds: DataFrame, weights: DataFrame, by: Sequence[str]) -> DataFrame:
    keys = [*by, "point_id"]
    return preds.join(weights.select(*keys, "method", "weight"), [*keys, "method"]).groupBy(*keys).agg(
        F.sum(F.col("weight") * F.col("pred")).alias("pred"))


def field_search(
    points: DataFrame, by: Sequence[str], value: str, fold: str, ks: Sequence[int] = FIELD_K, powers: Sequence[float] = FIELD_P,
    penalties: Sequence[float] = (0.0,), aux: str | None = None, min_fit: int = 50, min_valid: int = 10,
) -> DataFrame:
    """Best (penalty, k, power) of an inverse-distance field of ``value`` by group-held-out RMSE.

    One neighbour table per penalty covers every k and power.  ``aux`` times the penalty is a third
    coordinate.  Folds that are too small do not count; with none left the default is (first penalty, 16, 1).
    """
    by = list(by)
    rows = points.filter(F.col(value).isNotNull())
    k_folds = rows.select(fold).distinct()
    usable = _usable(rows, by, fold, min_fit, min_valid)
    tables = []
    for penalty in penalties:
        src = rows.withColumn("_aux", (F.col(aux) * F.lit(float(penalty))) if aux and penalty > 0 else F.lit(0.0))
        feats = ("x", "y", "_aux") if aux and penalty > 0 else ("x", "y")
        valid = src.withColumn("_vf", F.col(fold))
        # a handful of folds: each training row serves every fold but its own
        fit = src.withColumnRenamed(fold, "_own").join(F.broadcast(k_folds.withColumnRenamed(fold, "_vf")), F.col("_own") != F.col("_vf"))
        n = knn.knn_join(valid, fit, max(ks), [*by, "_vf"], feats=feats, carry=[value])
        tables.append(n.withColumn("penalty", F.lit(float(penalty))))
    nbrs = tables[0]
    for t in tables[1:]:
        nbrs = nbrs.unionByName(t)
    nbrs = nbrs.join(usable.withColumnRenamed(fold, "_vf"), [*by, "_vf"], "left_semi")
    pred = interp.idw_grid(nbrs, [*by, "_vf", "query_id", "penalty"], value, ks, powers)
    scored = pred.join(rows.select(*by, F.col("point_id").alias("query_id"), F.col(value).alias("_obs")), [*by, "query_id"])
    scored = scored.select(*by, "_vf", "penalty", "_obs", F.explode("_grid").alias("_g")).select(*by, "_vf", "penalty", "_obs", "_g.*")
    s = cv_score(scored, by, ["penalty", "k", "power"], "_vf", obs="_obs")
    best = argmin(s, by, ["rmse", "penalty", "k", "power"], ["penalty", "k", "power", "rmse"])
    everyone = points.select(*by).distinct()
    return _with(everyone, best, by).select(
        *by, F.coalesce("penalty", F.lit(float(penalties[0]))).alias("penalty"), F.coalesce("k", F.lit(16)).alias("k"),
        F.coalesce("power", F.lit(1.0)).alias("power"), F.col("rmse").alias("inner_rmse"))


def _usable(rows: DataFrame, by: Sequence[str], fold: str, min_fit: int, min_valid: int) -> DataFrame:
    counts = rows.groupBy(*by, fold).agg(F.count(F.lit(1)).alias("_v"))
    total = F.sum("_v").over(W.partitionBy(*by))  # one row per fold
    return counts.withColumn("_t", total).filter((F.col("_t") - F.col("_v") >= min_fit) & (F.col("_v") >= min_valid)).select(*by, fold)


def field_predict(
    train: DataFrame, query: DataFrame, params: DataFrame, by: Sequence[str], value: str, low: float | None = None,
    high: float | None = None, aux: str | None = None, max_k: int = 64, name: str = "field",
) -> DataFrame:
    """The tuned field at the query rows, clipped; queries without neighbours take the median value."""
    by = list(by)
    fit = train.filter(F.col(value).isNotNull())
    if aux:
        scale = lambda df: attach(df, params.select(*by, "penalty"), by).withColumn("_aux", F.coalesce(F.col(aux), F.lit(0.0)) * F.col("penalty")).drop("penalty")
        fit, q, feats = scale(fit), scale(query), ("x", "y", "_aux")
    else:
        q, feats = query, ("x", "y")
    nbrs = attach(knn.knn_join(q, fit, max_k, by, feats=feats, carry=[value]), params.select(*by, "k", "power"), by)
    pred = interp.idw(nbrs, [*by, "query_id"], value, F.col("k"), F.col("power"), name=name).withColumnRenamed("query_id", "point_id")
    fallback = exact_quantiles(fit, by, value, [0.5], ["_fallback"])
    out = _with(query.select(*by, "point_id"), fallback, by).join(pred, [*by, "point_id"], "left")
    v = F.coalesce(name, "_fallback", F.lit(0.0))
    if low is not None:
        v = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), v))
    return out.select(*by, "point_id", v.alias(name))


def risk_router(risks: DataFrame, by: Sequence[str], safe: Sequence[str] = ()) -> DataFrame:
    """Hard, soft and safe routing from ``risks(by…, point_id, method, method_ord, pred, risk)``."""
    keys = [*by, "point_id"]
    r = F.greatest(F.col("risk"), F.lit(0.25))
    w = 1.0 / (r * r)
    pick = F.min(F.struct("risk", "method_ord", "pred"))
    safe_pick = F.min(F.when(F.col("method").isin(*safe), F.struct("risk", "method_ord", "pred"))) if safe else F.lit(None)
    t = risks.groupBy(*keys).agg(
        pick.alias("_h"), (F.sum(w * F.col("pred")) / F.sum(w)).alias("soft"), (F.sum(w * F.col("risk")) / F.sum(w)).alias("soft_risk"),
        *([safe_pick.alias("_s")] if safe else []))
    return t.select(*keys, F.col("_h.pred").alias("hard"), F.col("_h.risk").alias("hard_risk"), F.col("_h.method_ord").alias("hard_method"),
                    "soft", "soft_risk", *([F.col("_s.pred").alias("safe")] if safe else []))


def blend_search(df: DataFrame, by: Sequence[str], a: str, b: str, weights: Sequence[float], scales: Sequence[float],
                 powers: Sequence[float], distance: str, risk_a: str, risk_b: str) -> DataFrame:
    """Best global weight, distance-gate scale and risk power on OOF rows, each by (RMSE, MAE, label)."""
    opts = [F.struct(F.lit("weight").alias("rule"), F.lit(float(w)).alias("param"), F.lit(float(w)).alias("g")) for w in weights]
    opts += [F.struct(F.lit("distance").alias("rule"), F.lit(float(s)).alias("param"), distance_gate(F.col(distance), float(s)).alias("g")) for s in scales]
    opts += [F.struct(F.lit("risk").alias("rule"), F.lit(float(p)).alias("param"), inverse_risk_gate(F.col(risk_a), F.col(risk_b), float(p)).alias("g")) for p in powers]
    rows = df.select(*by, "observed_dbm", a, b, F.explode(F.array(*opts)).alias("_o"))
    rows = rows.select(*by, "observed_dbm", "_o.rule", "_o.param", blend(F.col(a), F.col(b), F.col("_o.g")).alias("pred"))
    s = pooled_score(rows, [*by, "rule", "param"]).select(
        *by, "rule", "param", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), (F.col("sae") / F.col("n")).alias("mae"))
    return argmin(s, [*by, "rule"], ["rmse", "mae", "param"], ["param", "rmse", "mae"])


def dual_source(df: DataFrame, fixed: str, other: str, probability: str, name: str = "pred") -> DataFrame:
    return df.withColumn(name, blend_pair(F.col(fixed), F.col(other), F.col(probability)))


def selective_metrics(df: DataFrame, by: Sequence[str], score: str, percents: Sequence[int] = (10, 25, 50, 75, 90)) -> DataFrame:
    """Accuracy of the most trusted share of rows, per percent, plus the full table."""
    kept = retain_percent(df, by, score, percents).filter("retained")
    part = error_metrics(kept, [*by, "percent"])
    full = error_metrics(df, by).withColumn("percent", F.lit(100))
    n = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    out = part.unionByName(full)
    return attach(out, n, by).withColumn("retention", F.col("total_n") / F.col("_all")).drop("_all")


def learning_curve(pred: DataFrame, train: DataFrame, by: Sequence[str], cell: float = 10.0, rank_min: int = 500) -> DataFrame:
    """Metrics by scope (band, all) x evaluation mode (all held-out rows, rows in cells without training)."""
    cells = train.select(*by, cell_index(F.col("x"), cell).alias("_cx"), cell_index(F.col("y"), cell).alias("_cy")).distinct().withColumn("_seen", F.lit(True))
    rows = pred.withColumn("_cx", cell_index(F.col("x"), cell)).withColumn("_cy", cell_index(F.col("y"), cell)).join(cells, [*by, "_cx", "_cy"], "left")
    mode = F.when(F.col("_seen").isNull(), F.array(F.lit("ordinary_complement"), F.lit("strict_new_10m_cell"))).otherwise(F.array(F.lit("ordinary_complement")))
    rows = rows.withColumn("evaluation_mode", F.explode(mode)).withColumn("scope", F.explode(F.array(F.lit("all"), F.col("band"))))
    m = error_metrics(settle(rows.select("scope", "evaluation_mode", "pred", "observed_dbm", "nearest_m")), ["scope", "evaluation_mode"], distance="nearest_m")
    return m.withColumn("rank_eligible", (F.col("evaluation_mode") == "ordinary_complement") | (
        (F.col("scope") == "all") & (F.col("total_n") >= rank_min)))
