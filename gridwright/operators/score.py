"""Accuracy metrics, factorial comparisons, summaries and selections over long prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from gridwright.functions.quantiles import attach, exact_quantiles
from gridwright.session import settle


def rate(test: Column) -> Column:
    return F.avg(test.cast("double"))


def error_metrics(
    df: DataFrame, by: Sequence[str], pred: str = "pred", obs: str = "observed_dbm",
    distance: str | None = None, quantiles: bool = True,
) -> DataFrame:
    """Per group: counts, coverage, RMSE, MAE, absolute-error quantiles, exceedances, bias."""
    by = list(by)
    valid = F.col(obs).isNotNull() & F.col(pred).isNotNull()
    if distance is not None:
        valid = valid & F.col(distance).isNotNull()
    e = F.when(valid, F.col(pred) - F.col(obs))
    rows = df.select(*by, e.alias("_e"), F.abs(e).alias("_a"), *([F.col(distance).alias("_d")] if distance else []))
    exact = [
        F.count(F.lit(1)).alias("total_n"), F.count("_e").alias("predicted_n"),
        (F.count("_e") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("coverage"),
        F.sqrt(F.avg(F.col("_e") * F.col("_e"))).alias("rmse_db"),
        F.avg("_a").alias("mae_db"), F.max("_a").alias("max_abs_db"), F.avg("_e").alias("bias_db"),
    ]
    for t in (8, 10, 15):
        exact += [F.count_if(F.col("_a") > t).alias(f"gt{t}_n"), rate(F.col("_a") > t).alias(f"gt{t}_rate")]
    if distance:
        exact.append(F.avg(F.when(F.col("_e").isNotNull(), F.col("_d"))).alias("nearest_mean_m"))
    out = rows.groupBy(*by).agg(*exact)
    if quantiles:
        q = exact_quantiles(rows, by, "_a", [0.5, 0.9, 0.95, 0.99],
                            ["median_abs_db", "p90_abs_db", "p95_abs_db", "p99_abs_db"])
        out = _with(out, q, by)
        if distance:
            d = exact_quantiles(rows.filter("_e is not null"), by, "_d", [0.5, 0.9], ["nearest_median_m", "nearest_p90_m"])
            out = _with(out, d, by)
    return out


def _with(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join of two one-row-per-group tables on null-safe keys."""
    if not by:
        return left.crossJoin(F.broadcast(right))  # one row on each side
    renamed, match = right, None
    for c in by:
        renamed = renamed.withColumnRenamed(c, f"_r_{c}")
        test = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        match = test if match is None else match & test
    return left.join(renamed, match, "left").drop(*[f"_r_{c}" for c in by])


def pooled_score(df: DataFrame, by: Sequence[str], pred: str = "pred", obs: str = "observed_dbm") -> DataFrame:
    """Sufficient statistics of the error: n, sse, sae."""
    e = F.col(pred) - F.col(obs)
    return df.groupBy(*by).agg(F.count(e).alias("n"), F.sum(e * e).alias("sse"), F.sum(F.abs(e)).alias("sae"))


def cv_score(
    df: DataFrame, by: Sequence[str], params: Sequence[str], fold: str = "fold", how: str = "pooled",
    pred: str = "pred", obs: str = "observed_dbm",
) -> DataFrame:
    """RMSE and MAE per (by, params): over pooled rows, or as the mean of the fold values."""
    folds = pooled_score(df, [*by, *params, fold], pred, obs).filter("n > 0")
    if how == "pooled":
        t = folds.groupBy(*by, *params).agg(F.sum("n").alias("n"), F.sum("sse").alias("sse"), F.sum("sae").alias("sae"))
        return t.select(*by, *params, "n", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"), (F.col("sae") / F.col("n")).alias("mae"))
    if how == "fold_mean":
        return folds.groupBy(*by, *params).agg(
            F.sum("n").alias("n"), F.avg(F.sqrt(F.col("sse") / F.col("n"))).alias("rmse"),
            F.avg(F.col("sae") / F.col("n")).alias("mae"))
    raise ValueError("how must be 'pooled' or 'fold_mean'")


def argmin(df: DataFrame, by: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """The ``keep`` columns of the row with the smallest ``order`` tuple; a plain aggregate, no window."""
    rest = [c for c in keep if c not in order]
    best = df.groupBy(*by).agg(F.min(F.struct(*order, *rest)).alias("_b"))
    return best.select(*by, *[F.col(f"_b.{c}").alias(c) for c in keep])


def choose_params(scores: DataFrame, by: Sequence[str], params: Sequence[str]) -> DataFrame:
    return argmin(scores, by, ["rmse", "mae", *params], [*params, "rmse", "mae"])


# --- factorial comparison -------------------------------------------------------------------------

# Arm -> (residual on, fill source).
ARMS = {
    "R0_MEAN": (False, "mean"), "R0_SIGNAL_IDW": (False, "signal_idw"),
    "R1_MEAN": (True, "mean"), "R1_SIGNAL_IDW": (True, "signal_idw"),
}


def factorial_recombine(df: DataFrame, unit: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Four source variants per unit -> the 2x2 arms residual correction x no-path fill."""
    names = ["BASE", "BASE_MEAN_FILL", "IDW", "IDW_FILL"]
    wide = df.groupBy(*unit).agg(
        *[F.first(c).alias(c) for c in keep],
        *[F.max(F.when(F.col("variant") == v, F.col("predicted_dbm"))).alias(v) for v in names],
    )
    path = F.col("path_available")
    value = {
        "R0_MEAN": F.col("BASE_MEAN_FILL"),
        "R0_SIGNAL_IDW": F.when(path, F.col("BASE")).otherwise(F.col("IDW_FILL")),
        "R1_MEAN": F.when(path, F.col("IDW")).otherwise(F.col("BASE_MEAN_FILL")),
        "R1_SIGNAL_IDW": F.col("IDW_FILL"),
    }
    arms = F.array(*[
        F.struct(F.lit(a).alias("arm"), F.lit(r).alias("residual_idw"), F.lit(s).alias("no_path_fill"),
                 value[a].alias("predicted_dbm"))
        for a, (r, s) in ARMS.items()
    ])
    return wide.select(*unit, *keep, F.explode(arms).alias("_a")).select(
        *unit, *keep, "_a.*", (F.col("_a.predicted_dbm") - F.col("observed_dbm")).alias("error_db"))


def with_scopes(df: DataFrame) -> DataFrame:
    """Repeat each row under scope (all, its band) x support (all, path / no path)."""
    scope = F.explode(F.array(F.lit("all"), F.col("band"))).alias("scope")
    support = F.explode(F.array(
        F.lit("all_points"), F.when(F.col("path_available"), "path_available").otherwise("no_path"))).alias("support")
    return df.select("*", scope).select("*", support)


def factorial_metrics(arms: DataFrame) -> DataFrame:
    # settled before the rows are repeated: metrics and quantiles both read them, and the recombination runs once
    rows = with_scopes(settle(arms.select("band", "path_available", "method", "arm", "predicted_dbm", "observed_dbm")))
    out = error_metrics(rows, ["scope", "support", "method", "arm"], "predicted_dbm")
    return out.drop("coverage", "gt8_n", "gt8_rate", "predicted_n").withColumnRenamed("total_n", "n")


def contrasts(df: DataFrame, by: Sequence[str], metric: str) -> DataFrame:
    """Seven positive-gain contrasts from one metric per arm."""
    wide = df.groupBy(*by).agg(*[F.max(F.when(F.col("arm") == a, F.col(metric))).alias(a) for a in ARMS])
    r0m, r0s, r1m, r1s = (F.col(a) for a in ARMS)
    rules = {
        "residual_idw_gain_mean_fill": r0m - r1m,
        "residual_idw_gain_signal_fill": r0s - r1s,
        "residual_idw_main_gain": 0.5 * ((r0m - r1m) + (r0s - r1s)),
        "signal_fill_gain_residual_off": r0m - r0s,
        "signal_fill_gain_residual_on": r1m - r1s,
        "signal_fill_main_gain": 0.5 * ((r0m - r0s) + (r1m - r1s)),
        "interaction_residual_gain_signal_minus_mean": (r0s - r1s) - (r0m - r1m),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("contrast"), v.alias("gain_db")) for n, v in rules.items()])
    return wide.select(*by, F.explode(pairs).alias("_c")).select(*by, "_c.*")


DRAW_RUN = 500


def cluster_bootstrap(
    df: DataFrame, by: Sequence[str], cluster: str, arm: str, draws: int, seed: int,
    pred: str = "predicted_dbm", obs: str = "observed_dbm", interval: tuple[float, float] = (0.025, 0.975),
) -> DataFrame:
    """Resample whole clusters; per (by, contrast, metric): point gain and percentile interval.

    Clusters are reduced to (n, sse, sae) first.  Draw ``i`` picks slot ``j``'s cluster from an md5 hash
    of (seed, by, i, j), so every engine draws the same multiset.
    """
    from gridwright.functions.ranking import global_position

    by = list(by)
    sums = settle(pooled_score(df, [*by, cluster, arm], pred, obs))
    clusters = global_position(sums.select(*by, cluster).distinct(), by, [F.col(cluster)], "slot")
    size = clusters.groupBy(*by).agg(F.count(F.lit(1)).alias("_m"))
    # picks become counts per (draw, cluster) in the task that draws them: a task holds a run of draws of all clusters of a group
    run = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // DRAW_RUN)))
    first = F.col("_run") * DRAW_RUN
    picks = (
        attach(clusters, size, by).select(*by, "slot", "_m", run.alias("_run")).repartition(*by, "_run")
        .select(*by, "slot", "_m", F.explode(F.sequence(first, F.least(first + DRAW_RUN - 1, F.lit(draws - 1)))).alias("draw"))
        .withColumn("_h", F.conv(F.substring(F.md5(F.concat_ws(
            "|", F.lit(str(seed)), *[F.col(c).cast("string") for c in by],
            F.col("draw").cast("string"), F.col("slot").cast("string"))), 1, 8), 16, 10).cast("bigint"))
        .withColumn("pick", F.col("_h") % F.col("_m") + 1)
        .groupBy(*by, "draw", "pick").agg(F.count(F.lit(1)).alias("times"))
    )
    # all arms of a cluster in one row
    each = F.struct(F.col(arm).alias("arm"), "n", "sse", "sae")
    numbered = sums.join(clusters, [*by, cluster]).groupBy(*by, F.col("slot").alias("pick")).agg(F.sort_array(F.collect_list(each)).alias("_arms"))
    boot = settle(picks.join(numbered, [*by, "pick"]).select(*by, "draw", "times", F.explode("_arms").alias("_a")).groupBy(*by, "draw", F.col("_a.arm").alias(arm)).agg(
        F.sum(F.col("times") * F.col("_a.n")).alias("n"), F.sum(F.col("times") * F.col("_a.sse")).alias("sse"),
        F.sum(F.col("times") * F.col("_a.sae")).alias("sae")))
    point = sums.groupBy(*by, arm).agg(F.sum("n").alias("n"), F.sum("sse").alias("sse"), F.sum("sae").alias("sae"))

    def gains(t: DataFrame, keys: Sequence[str]) -> DataFrame:
        t = t.select(*keys, arm, F.sqrt(F.col("sse") / F.col("n")).alias("rmse_db"), (F.col("sae") / F.col("n")).alias("mae_db"))
        parts = [contrasts(t, keys, m).withColumn("metric", F.lit(m)) for m in ("rmse_db", "mae_db")]
        return parts[0].unionByName(parts[1])

    keys = [*by, "contrast", "metric"]
    # the interval sees one value per draw: bounded by the draw count
    spread_ = gains(boot, [*by, "draw"]).groupBy(*keys).agg(
        F.percentile("gain_db", F.lit(interval[0])).alias("ci_low_db"),
        F.percentile("gain_db", F.lit(interval[1])).alias("ci_high_db"))
    return gains(point, by).join(spread_, keys).join(size.withColumnRenamed("_m", "clusters"), by)


# --- campaign tables ------------------------------------------------------------------------------

RUN_KEYS = ("band", "outer_fold", "mode", "budget", "repeat")


def paired_delta(
    metrics: DataFrame, left: str, right: str, name: str, fields: Sequence[str], keys: Sequence[str] = RUN_KEYS,
) -> DataFrame:
    """left - right per run key, by one conditional aggregate instead of a self-join."""
    side = lambda m, f: F.max(F.when(F.col("method") == m, F.col(f)))
    both = metrics.filter(F.col("method").isin(left, right)).groupBy(*keys).agg(
        F.count_distinct("method").alias("_sides"), *[(side(left, f) - side(right, f)).alias(f"delta_{f}") for f in fields])
    return both.filter("_sides = 2").drop("_sides").withColumn("comparison", F.lit(name))


def common_keys(metrics: DataFrame, methods: Sequence[str], eligible: Column, keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Run keys where all ``methods`` have an eligible row."""
    return (
        metrics.filter(F.col("method").isin(*methods) & eligible).groupBy(*keys)
        .agg(F.count_distinct("method").alias("_m")).filter(F.col("_m") == len(methods)).drop("_m")
    )


def summary(metrics: DataFrame, by: Sequence[str] = ("band", "outer_fold", "mode", "budget", "method")) -> DataFrame:
    return metrics.groupBy(*by).agg(
        F.count_distinct("repeat").alias("repeats"), F.min_by("n", "repeat").alias("n"),
        F.avg("mae_db").alias("mae_mean"), F.stddev_samp("mae_db").alias("mae_sd"),
        F.avg("rmse_db").alias("rmse_mean"), F.stddev_samp("rmse_db").alias("rmse_sd"),
        F.avg("bias_db").alias("bias_mean"))


def budget_summary(summary_df: DataFrame) -> DataFrame:
    return summary_df.groupBy("band", "budget", "method").agg(
        F.count(F.lit(1)).alias("conditions"), F.avg("mae_mean").alias("macro_mae"), F.max("mae_mean").alias("worst_mae"),
        F.avg("rmse_mean").alias("macro_rmse"), F.max("rmse_mean").alias("worst_rmse"))


def target_table(metrics: DataFrame, target: float = 4.0) -> DataFrame:
    out = metrics.groupBy("band", "outer_fold", "mode", "budget", "method").agg(
        F.avg("mae_db").alias("mean_mae_db"), F.max("mae_db").alias("worst_repeat_mae_db"),
        rate(F.col("mae_db") <= target).alias("hit_fraction"))
    return out.withColumn("mean_gap_db", F.col("mean_mae_db") - target).withColumn(
        "worst_gap_db", F.col("worst_repeat_mae_db") - target)


def smallest_budget(target_df: DataFrame, target: float = 4.0) -> DataFrame:
    return target_df.groupBy("band", "outer_fold", "mode", "method").agg(
        F.min(F.when(F.col("mean_mae_db") <= target, F.col("budget"))).alias("minimum_budget"),
        F.min("mean_mae_db").alias("best_mae_db"), F.min("mean_gap_db").alias("best_gap_db"))


def scheme_coverage(rows: DataFrame) -> DataFrame:
    """Feasible and fallback repeats per scheme; ``rows`` has scheme, repeat and eligible."""
    out = rows.groupBy("band", "outer_fold", "mode", "budget", "scheme").agg(
        F.count_distinct("repeat").alias("total_repeats"), F.count_if("eligible").alias("feasible_repeats"))
    return out.withColumn("fallback_repeats", F.col("total_repeats") - F.col("feasible_repeats"))


def champion(summary_df: DataFrame, by: Sequence[str] = (), min_coverage: float = 0.95) -> DataFrame:
    """Lowest (rmse, mae, method) among well-covered rows; else highest coverage, then lowest rmse."""
    ok = F.col("coverage") >= min_coverage
    key = F.struct(
        (~ok).cast("int").alias("poor"), F.when(ok, 0.0).otherwise(-F.col("coverage")).alias("c"),
        F.col("rmse_db").alias("rmse_db"), F.col("mae_db").alias("mae_db"), F.col("method").alias("method"),
        F.col("coverage").alias("coverage"))
    best = summary_df.groupBy(*by).agg(F.min(key).alias("_b"))
    return best.select(*by, "_b.method", "_b.rmse_db", "_b.mae_db", "_b.coverage")


def track_champion(summary_df: DataFrame, min_retention: float = 0.10) -> DataFrame:
    """Per track: full coverage unrestricted; selective tracks need the retention, ties to more of it."""
    rows = summary_df.filter((F.col("track") == "full_coverage") | (F.col("retention") >= min_retention))
    key = F.struct("rmse_db", "mae_db", (-F.col("retention")).alias("nr"), "method", "gate")
    best = rows.groupBy("track").agg(F.min(key).alias("_b"))
    return best.select("track", "_b.method", "_b.gate", "_b.rmse_db", "_b.mae_db", (-F.col("_b.nr")).alias("retention"))


def replace_worst(oof: DataFrame, new_methods: Sequence[str], drop: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """Rank experts by (-MAE, -RMSE, name), drop the worst ``drop`` and append the new names."""
    s = pooled_score(oof, [*by, "method"]).select(
        *by, "method", (F.col("sae") / F.col("n")).alias("oof_mae"), F.sqrt(F.col("sse") / F.col("n")).alias("oof_rmse"))
    # one row per expert: bounded by the size of the expert pool
    order = W.partitionBy(*by).orderBy(F.desc("oof_mae"), F.desc("oof_rmse"), "method")
    ranked = s.withColumn("worst_rank", F.row_number().over(order))
    kept = ranked.withColumn("removed", F.col("worst_rank") <= drop)
    fresh = s.select(*by).distinct().withColumn("method", F.explode(F.array(*[F.lit(m) for m in new_methods])))
    return kept.unionByName(fresh.withColumn("removed", F.lit(False)), allowMissingColumns=True)


def common_path_mask(gains: DataFrame, unit: Sequence[str] = ("point_id",), gain: str = "gain_db") -> DataFrame:
    return gains.groupBy(*unit).agg(F.bool_and(F.col(gain).isNotNull()).alias("common_path"))


def factorial_scopes(df: DataFrame, by: Sequence[str], pred: str, fallback: str, common: str) -> DataFrame:
    """Metrics of each arm on its own paths, on the common paths and with the declared fallback."""
    scope = F.explode(F.array(
        F.struct(F.lit("own_path").alias("scope"), F.lit(True).alias("inc"), F.col(pred).alias("p"), F.lit(0).alias("fb")),
        F.struct(F.lit("common_path").alias("scope"), F.col(common).alias("inc"), F.col(pred).alias("p"), F.lit(0).alias("fb")),
        F.struct(F.lit("predeclared_fallback").alias("scope"), F.lit(True).alias("inc"),
                 F.coalesce(F.col(pred), F.col(fallback)).alias("p"), F.col(pred).isNull().cast("int").alias("fb")),
    ))
    rows = df.select(*by, "observed_dbm", scope.alias("_s")).select(*by, "observed_dbm", "_s.*").filter("inc")
    keys = [*by, "scope"]
    m = error_metrics(rows, keys, "p").select(
        *keys, F.col("total_n").alias("eligible_n"), "predicted_n", "coverage", "rmse_db", "mae_db", "median_abs_db", "bias_db")
    return _with(m, rows.groupBy(*keys).agg(F.sum("fb").alias("fallback_n")), keys)


def silhouette(zone_cells: DataFrame, height_cells: DataFrame, threshold: float, height: str = "value") -> DataFrame:
    """Overlap of a cell mask with the cells at or above a height: IoU and two containment ratios."""
    plan = zone_cells.select("row", "col").distinct().withColumn("_p", F.lit(True))
    tall = height_cells.filter(F.col(height) >= threshold).select("row", "col").withColumn("_t", F.lit(True))
    c = plan.join(tall, ["row", "col"], "full_outer").agg(
        F.count("_p").alias("plan_cells"), F.count("_t").alias("candidate_cells"),
        F.count_if(F.col("_p") & F.col("_t")).alias("overlap_cells"))
    union = F.col("plan_cells") + F.col("candidate_cells") - F.col("overlap_cells")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return c.select(
        "plan_cells", "candidate_cells", "overlap_cells", ratio(F.col("overlap_cells"), union).alias("iou"),
        ratio(F.col("overlap_cells"), F.col("plan_cells")).alias("plan_supported_ratio"),
        ratio(F.col("overlap_cells"), F.col("candidate_cells")).alias("candidate_inside_plan_ratio"))


def evaluate_gates(audit: DataFrame, expected_buildings: int | None = None, min_direct: float = 0.75, min_hit: float = 0.20) -> DataFrame:
    """One audit row -> five gates and the overall PASS / NO_GO."""
    found = F.col("building_count")
    gates = {
        "footprints": (found == expected_buildings) if expected_buildings is not None else (found > 0),
        "registration": F.col("registration_status").startswith("PASS"),
        "height": F.col("direct_heights") / F.greatest(found, F.lit(1)) >= min_direct,
        "geometry": F.col("non_manifold_edges") == 0,
        "materials": F.col("mean_hit_rate") >= min_hit,
    }
    out = audit.select(*[g.alias(n) for n, g in gates.items()])
    return out.withColumn("status", F.when(
        F.col("footprints") & F.col("registration") & F.col("height") & F.col("geometry") & F.col("materials"), "PASS"
    ).otherwise("NO_GO"))


def distance_summary(df: DataFrame, by: Sequence[str], distance: str = "nearest_m") -> DataFrame:
    """Five quantiles of log1p distance, as columns q10…q90, with count, min and median."""
    probs, names = [0.10, 0.25, 0.50, 0.75, 0.90], ["q10", "q25", "q50", "q75", "q90"]
    rows = df.withColumn("_l", F.log1p(distance))
    counts = rows.groupBy(*by).agg(F.count(distance).alias("n"), F.min(distance).alias("min_m"))
    return _with(counts, exact_quantiles(rows, by, "_l", probs, names), by)


def wasserstein(df: DataFrame, by: Sequence[str], side: str, left: str, right: str, value: str) -> DataFrame:
    """1-D earth mover's distance between two samples: the area between their step functions.

    Values are counted first, then cut into 256 value buckets per group; cumulative counts run inside a
    bucket and start from the totals of the earlier buckets, so no group is walked by a single task.
    """
    by = list(by)
    counted = df.filter(F.col(side).isin(left, right)).groupBy(*by, F.col(value).alias("_v")).agg(
        F.count_if(F.col(side) == left).alias("_l"), F.count_if(F.col(side) == right).alias("_r"))
    edges = counted.groupBy(*by).agg(
        F.percentile_approx("_v", F.array(*[F.lit(i / 256) for i in range(1, 256)]), 2000).alias("_cut"),
        F.sum("_l").alias("_nl"), F.sum("_r").alias("_nr"))
    rows = attach(counted, edges, by).withColumn("_bucket", F.size(F.filter("_cut", lambda c: c < F.col("_v")))).drop("_cut")
    totals = rows.groupBy(*by, "_bucket").agg(
        F.sum("_l").alias("_bl"), F.sum("_r").alias("_br"), F.min("_v").alias("_first"))
    before = W.partitionBy(*by).orderBy("_bucket")
    past = before.rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        *by, "_bucket", F.coalesce(F.sum("_bl").over(past), F.lit(0)).alias("_cl"),
        F.coalesce(F.sum("_br").over(past), F.lit(0)).alias("_cr"), F.lead("_first").over(before).alias("_next_first"))
    local = W.partitionBy(*by, "_bucket").orderBy("_v")
    upto = local.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.join(totals, [*by, "_bucket"])
    gap = F.coalesce(F.lead("_v").over(local), F.col("_next_first")) - F.col("_v")
    height = F.abs((F.col("_cl") + F.sum("_l").over(upto)) / F.col("_nl") - (F.col("_cr") + F.sum("_r").over(upto)) / F.col("_nr"))
    return rows.select(*by, (gap * height).alias("_area")).groupBy(*by).agg(F.sum("_area").alias("wasserstein_m"))
