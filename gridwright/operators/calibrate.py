"""Calibration of simulated gains against measurements, keyed by split.

Everything is a pass of sums (or bracketed medians) per (split, configuration); the only Python is the
solve of 4x4 systems on the resulting summary rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.functions.quantiles import attach, exact_quantiles, group_median
from gridwright.operators.score import _with, argmin


def log_distance(d: Column) -> Column:
    return F.log10(F.greatest(d, F.lit(1.0)))


def mean_offset(df: DataFrame, by: Sequence[str], gain: str, obs: str = "observed_dbm", offset: Column | None = None) -> DataFrame:
    """beta = mean(obs - offset - gain) over rows with a path."""
    base = F.col(obs) - (offset if offset is not None else F.lit(0.0)) - F.col(gain)
    return df.groupBy(*by).agg(F.avg(base).alias("beta_db"), F.count(base).alias("path_n"))


def class_ridge(
    df: DataFrame, by: Sequence[str], ridges: Sequence[float], gain: str = "gain_db", distance: str = "d3",
    los: str = "los", obs: str = "observed_dbm",
) -> DataFrame:
    """Ridge of (obs - gain) on [1, q, nlos, q·nlos], q = log10 distance minus its mean; intercept free.

    One pass of sums serves every ridge; returns (by…, ridge, center, n, c0..c3).
    """
    by = list(by)
    rows = df.filter(F.col(gain).isNotNull() & F.col(obs).isNotNull()).select(
        *by, log_distance(F.col(distance)).alias("_l"), (~F.col(los)).cast("double").alias("_n"),
        (F.col(obs) - F.col(gain)).alias("_y"))
    # moments about zero; centring q afterwards is algebra on the summary row
    l, n, y = F.col("_l"), F.col("_n"), F.col("_y")
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("s1"), F.sum(l).alias("sl"), F.sum(l * l).alias("sll"), F.sum(n).alias("sn"),
        F.sum(l * n).alias("sln"), F.sum(l * l * n).alias("slln"), F.sum(y).alias("sy"), F.sum(l * y).alias("sly"),
        F.sum(n * y).alias("sny"), F.sum(l * n * y).alias("slny"))
    table = sums.withColumn("ridge", F.explode(F.array(*[F.lit(float(r)) for r in ridges])))
    schema = T.StructType([table.schema[c] for c in by] + [
        T.StructField(c, T.DoubleType()) for c in ("ridge", "center", "n", "c0", "c1", "c2", "c3")])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            g = {c: f[c].to_numpy(float) for c in ("s1", "sl", "sll", "sn", "sln", "slln", "sy", "sly", "sny", "slny", "ridge")}
            m = g["sl"] / g["s1"]
            q, qq = g["sl"] - m * g["s1"], g["sll"] - 2 * m * g["sl"] + m * m * g["s1"]
            qn, qqn = g["sln"] - m * g["sn"], g["slln"] - 2 * m * g["sln"] + m * m * g["sn"]
            qy, qny = g["sly"] - m * g["sy"], g["slny"] - m * g["sny"]
            # nlos is 0/1, so its square is itself
            rows_ = [[g["s1"], q, g["sn"], qn], [q, qq, qn, qqn], [g["sn"], qn, g["sn"], qn], [qn, qqn, qn, qqn]]
            a = np.stack([np.stack(r, axis=1) for r in rows_], axis=1)
            for i in (1, 2, 3):
                a[:, i, i] += g["ridge"]
            b = np.stack([g["sy"], qy, g["sny"], qny], axis=1)
            c = np.linalg.solve(a, b[..., None])[..., 0] if len(f) else np.empty((0, 4))
            out = f[by].copy()
            out["ridge"], out["center"], out["n"] = g["ridge"], m, g["s1"]
            for i in range(4):
                out[f"c{i}"] = c[:, i]
            yield out

    return table.mapInPandas(solve, schema)


def class_correction(distance: Column, los: Column) -> Column:
    """Correction in dB from the columns center, c0..c3 of :func:`class_ridge`."""
    q, n = log_distance(distance) - F.col("center"), (~los).cast("double")
    return F.col("c0") + F.col("c1") * q + F.col("c2") * n + F.col("c3") * q * n


def affine_trend(df: DataFrame, by: Sequence[str], target: str, ridge: float = 10.0, x: str = "x", y: str = "y") -> DataFrame:
    """Ridge plane on standardised coordinates: (by…, mx, my, sx, sy, b0, bx, by_)."""
    t = F.col(target)
    s = df.filter(t.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), F.stddev_pop(x).alias("px"),
        F.stddev_pop(y).alias("py"), F.covar_pop(x, y).alias("cxy"), F.covar_pop(x, target).alias("cxt"),
        F.covar_pop(y, target).alias("cyt"), F.avg(target).alias("b0"))
    sx = F.when(F.col("px") > 1e-10, F.col("px")).otherwise(1.0)
    sy = F.when(F.col("py") > 1e-10, F.col("py")).otherwise(1.0)
    s = s.withColumn("sx", sx).withColumn("sy", sy)
    n = F.col("n")
    # normal matrix of the standardised slopes; their means are zero, so the intercept is the target mean
    a11 = n * F.col("px") * F.col("px") / (F.col("sx") * F.col("sx")) + ridge
    a22 = n * F.col("py") * F.col("py") / (F.col("sy") * F.col("sy")) + ridge
    a12 = n * F.col("cxy") / (F.col("sx") * F.col("sy"))
    v1, v2 = n * F.col("cxt") / F.col("sx"), n * F.col("cyt") / F.col("sy")
    det = a11 * a22 - a12 * a12
    return s.select(*by, "mx", "my", "sx", "sy", "b0", ((v1 * a22 - v2 * a12) / det).alias("bx"),
                    ((v2 * a11 - v1 * a12) / det).alias("by_"))


def trend_value(x: Column, y: Column) -> Column:
    return F.col("b0") + F.col("bx") * (x - F.col("mx")) / F.col("sx") + F.col("by_") * (y - F.col("my")) / F.col("sy")


def select_config(
    gains: DataFrame, by: Sequence[str], min_n: int, gain: str = "gain_db", obs: str = "observed_dbm",
    config: str = "config_id",
) -> DataFrame:
    """Per split: the configuration with the smallest RMSE after its median bias; ties by id.

    ``gains`` holds fit rows only, restricted to one family.
    """
    keys = [*by, config]
    rows = gains.filter(F.col(gain).isNotNull() & F.col(obs).isNotNull()).withColumn("_r", F.col(obs) - F.col(gain))
    bias = group_median(rows, keys, "_r", "bias")
    e = F.col("_r") - F.col("bias")
    fitted = attach(rows.select(*keys, "_r"), bias, keys).groupBy(*keys, "bias").agg(
        F.count(F.lit(1)).alias("fit_n"), F.sqrt(F.avg(e * e)).alias("fit_rmse"))
    return argmin(fitted.filter(F.col("fit_n") >= min_n), by, ["fit_rmse", config], [config, "bias", "fit_rmse", "fit_n"])


def select_config_ridge(
    gains: DataFrame, by: Sequence[str], ridges: Sequence[float], min_n: int, gain: str = "gain_db",
    obs: str = "observed_dbm", config: str = "config_id", distance: str = "d3", los: str = "los",
) -> DataFrame:
    """As :func:`select_config` with the class ridge in place of the bias, for every ridge at once."""
    keys = [*by, config]
    fit = class_ridge(gains, keys, ridges, gain, distance, los, obs)
    rows = gains.filter(F.col(gain).isNotNull() & F.col(obs).isNotNull())
    e = F.col(obs) - F.col(gain) - class_correction(F.col(distance), F.col(los))
    coefs = ["ridge", "center", "n", "c0", "c1", "c2", "c3"]
    scored = rows.select(*keys, obs, gain, distance, los).join(fit, keys).groupBy(*keys, *coefs).agg(
        F.sqrt(F.avg(e * e)).alias("fit_rmse"))
    return argmin(scored.filter(F.col("n") >= min_n), [*by, "ridge"], ["fit_rmse", config], [config, "fit_rmse", *coefs[1:]])


def date_offsets(df: DataFrame, by: Sequence[str], date: str, value: str, shrink: float) -> DataFrame:
    """Median per date minus the overall median, shrunk by n / (n + shrink)."""
    per = exact_quantiles(df, [*by, date], value, [0.5], ["_m"])
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, date).agg(F.count(F.lit(1)).alias("n"))
    whole = exact_quantiles(df, by, value, [0.5], ["_g"])
    t = attach(_with(counts, per, [*by, date]), whole, by)
    return t.select(*by, date, "n", (F.col("n") / (F.col("n") + F.lit(float(shrink))) * (F.col("_m") - F.col("_g"))).alias("offset_db"))


def robust_scale(df: DataFrame, fit: Column, by: Sequence[str], cols: Sequence[str], limit: float = 5.0) -> DataFrame:
    """Median / 1.4826·MAD of the fit rows applied to all rows; std, then 1, when the MAD vanishes; NULL
    becomes the centre; clipped."""
    from gridwright.session import settle
    number = range(len(cols))
    unpivot = lambda values: F.explode(F.array(*[F.struct(F.lit(i).alias("i"), v.alias("v")) for i, v in enumerate(values)])).alias("_e")
    spread = lambda t, column, name: t.groupBy(*by).agg(
        *[F.max(F.when(F.col("_col") == i, F.col(column))).alias(f"{name}{i}") for i in number])
    # all columns share one long pass; one row per split and column comes back
    long = df.filter(fit).select(*by, unpivot([F.col(c) for c in cols])).select(*by, F.col("_e.i").alias("_col"), F.col("_e.v").alias("_v"))
    centre = settle(spread(exact_quantiles(long, [*by, "_col"], "_v", [0.5], ["_m"]), "_m", "_m"))
    filled = attach(df, centre, by)
    dev = [F.coalesce(F.col(c), F.col(f"_m{i}"), F.lit(0.0)) - F.coalesce(F.col(f"_m{i}"), F.lit(0.0)) for i, c in enumerate(cols)]
    long = filled.filter(fit).select(*by, unpivot(dev)).select(*by, F.col("_e.i").alias("_col"), F.col("_e.v").alias("_v"), F.abs("_e.v").alias("_a"))
    mad = exact_quantiles(long, [*by, "_col"], "_a", [0.5], ["_mad"])
    std = long.groupBy(*by, "_col").agg(F.stddev_pop("_v").alias("_sd"))
    s = 1.4826 * F.col("_mad")
    both = _with(mad, std, [*by, "_col"]).withColumn("_s", F.when(s > 1e-8, s).when(F.col("_sd") > 1e-8, F.col("_sd")).otherwise(1.0))
    scale = settle(spread(both, "_s", "_s"))
    out = attach(filled, scale, by).withColumns({
        c: F.greatest(F.lit(-limit), F.least(F.lit(limit), dev[i] / F.col(f"_s{i}"))) for i, c in enumerate(cols)})
    return out.drop(*[f"_m{i}" for i in number], *[f"_s{i}" for i in number])


def standard_scale(df: DataFrame, fit: Column, by: Sequence[str], cols: Sequence[str], limit: float | None = 10.0,
                   floor: float = 1e-10) -> DataFrame:
    """(v - mean) / population std of the fit rows; std below ``floor`` counts as 1; optionally clipped."""
    moments = []
    for c in cols:
        v = F.when(fit, F.col(c))
        moments += [F.avg(v).alias(f"_m_{c}"), F.stddev_pop(v).alias(f"_s_{c}")]
    out = attach(df, df.groupBy(*by).agg(*moments), by)
    for c in cols:
        z = (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > floor, F.col(f"_s_{c}")).otherwise(1.0)
        out = out.withColumn(c, z if limit is None else F.greatest(F.lit(-limit), F.least(F.lit(limit), z)))
    return out.drop(*[f"_{k}_{c}" for c in cols for k in ("m", "s")])


def assemble_features(gains: DataFrame, points: DataFrame) -> DataFrame:
    """Median gain per family (13 configurations a point at most), count of missing families, fills.

    A family missing at a point takes the family's median over the band, -150 when it has none.
    """
    families = ("BASE", "S4W", "S5")
    wide = gains.groupBy("point_id", "band").agg(
        *[F.median(F.when(F.col("family") == f, F.col("gain_db"))).alias(f.lower()) for f in families])
    missing = sum((F.col(f.lower()).isNull().cast("int") for f in families), F.lit(0))
    wide = wide.withColumn("missing_n", missing)
    for f in (f.lower() for f in families):
        fill = exact_quantiles(wide, ["band"], f, [0.5], ["_fill"])
        wide = attach_left(wide, fill, ["band"]).withColumn(f, F.coalesce(f, "_fill", F.lit(-150.0))).drop("_fill")
    return points.join(wide, ["point_id", "band"]).withColumn("log_d", log_distance(F.col("d3")))


def attach_left(rows: DataFrame, table: DataFrame, by: Sequence[str]) -> DataFrame:
    return _with(rows, table, by)


def supported_calibration(
    df: DataFrame, by: Sequence[str], raw: str = "raw", los: str = "los", obs: str = "observed_dbm",
    min_n: int = 20, f_scale: float = 5.0, steps: int = 30,
) -> DataFrame:
    """Robust affine map per (split, LOS state), slope in [0, 1], soft-L1 loss, by reweighted least squares.

    ``df`` holds fit rows.  Returns (by…, los, n, slope, center, bias, x_min, x_max, taper); states with
    fewer than ``min_n`` rows are absent, and their points keep the fallback.
    """
    keys = [*by, los]
    rows = df.filter(F.col(raw).isNotNull() & F.col(obs).isNotNull()).select(*keys, F.col(raw).alias("_x"), F.col(obs).alias("_y"))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("x_min"), F.max("_x").alias("x_max"))
    counts = counts.filter(F.col("n") >= min_n)
    quart = exact_quantiles(rows, keys, "_x", [0.25, 0.5, 0.75], ["_q1", "center", "_q3"])
    start = exact_quantiles(rows, keys, "_y", [0.5], ["bias"])
    state = _with(_with(counts, quart, keys), start, keys).withColumn("slope", F.lit(0.5)).withColumn(
        "taper", F.greatest(F.col("_q3") - F.col("_q1"), F.lit(1.0))).drop("_q1", "_q3")
    from gridwright.session import settle
    fixed = settle(state.select(*keys, "n", "x_min", "x_max", "center", "taper"))
    rows = settle(attach(rows, state.select(*keys, "center"), keys).select(*keys, (F.col("_x") - F.col("center")).alias("_u"), "_y"))
    current = settle(state.select(*keys, "slope", "bias"))
    for done in range(0, steps, 6):
        previous = current
        for _ in range(min(6, steps - done)):
            current = _reweighted(rows, current, keys, f_scale)
        # splits x 2 rows, written out every few steps, so the lineage stays short
        current = settle(current)
        old = previous.select(*keys, F.col("slope").alias("_os"), F.col("bias").alias("_ob"))
        moved = _with(current, old, keys).agg(F.max(F.greatest(
            F.abs(F.col("slope") - F.col("_os")), F.abs(F.col("bias") - F.col("_ob"))))).first()[0]
        if moved is None or moved < 1e-8:
            break
    return _with(fixed, current, keys)


def _reweighted(rows: DataFrame, state: DataFrame, keys: Sequence[str], f_scale: float) -> DataFrame:
    """One soft-L1 step: weighted least squares of _y on _u with the slope clipped to [0, 1]."""
    joined = attach(rows, state, keys)
    r = (F.col("slope") * F.col("_u") + F.col("bias") - F.col("_y")) / f_scale
    joined = joined.select(*keys, "_u", "_y", (1.0 / F.sqrt(1.0 + r * r)).alias("_w"))
    u, y, w = F.col("_u"), F.col("_y"), F.col("_w")
    sums = joined.groupBy(*keys).agg(
        F.sum(w).alias("sw"), F.sum(w * u).alias("su"), F.sum(w * u * u).alias("suu"), F.sum(w * y).alias("sy"),
        F.sum(w * u * y).alias("suy"))
    det = F.col("sw") * F.col("suu") - F.col("su") * F.col("su")
    slope = F.when(det > 1e-12, (F.col("sw") * F.col("suy") - F.col("su") * F.col("sy")) / det).otherwise(0.0)
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), slope))
    return sums.select(*keys, clipped.alias("slope"), ((F.col("sy") - clipped * F.col("su")) / F.col("sw")).alias("bias"))


def apply_supported(df: DataFrame, fit: DataFrame, by: Sequence[str], fallback: str, raw: str = "raw", los: str = "los",
                    name: str = "calibrated") -> DataFrame:
    """Calibrated gain, fading to ``fallback`` outside the trained gain range; fallback where no state fits."""
    joined = _with(df, fit, [*by, los])
    x = F.col(raw)
    outside = F.greatest(F.col("x_min") - x, x - F.col("x_max"), F.lit(0.0)) / F.col("taper")
    w = F.exp(-outside * outside)
    value = w * (F.col("slope") * (x - F.col("center")) + F.col("bias")) + (1.0 - w) * F.col(fallback)
    return joined.withColumn(name, F.coalesce(value, F.col(fallback))).drop("n", "x_min", "x_max", "center", "taper", "slope", "bias")


def robust_source_score(
    df: DataFrame, by: Sequence[str], fit: Column, sources: Sequence[tuple[str, str]], obs: str = "observed_dbm",
    missing: float = 1e6,
) -> DataFrame:
    """|residual - median| / max(1.4826·MAD, 0.5) per source; rows keep the better source and its score."""
    out = df
    scores = []
    for column, label in sources:
        res = df.filter(fit).withColumn("_r", F.col(obs) - F.col(column))
        centre = exact_quantiles(res, by, "_r", [0.5], ["_m"])
        dev = attach(res, centre, by).withColumn("_a", F.abs(F.col("_r") - F.col("_m")))
        mad = exact_quantiles(dev, by, "_a", [0.5], ["_mad"])
        out = attach(out, _with(centre, mad, by).select(
            *by, F.col("_m").alias(f"_m_{label}"), F.greatest(1.4826 * F.col("_mad"), F.lit(0.5)).alias(f"_s_{label}")), by)
        s = F.coalesce(F.abs(F.col(obs) - F.col(column) - F.col(f"_m_{label}")) / F.col(f"_s_{label}"), F.lit(missing))
        scores.append(F.struct(s.alias("score"), F.lit(len(scores)).alias("ord"), F.lit(label).alias("source")))
    best = F.array_min(F.array(*scores))
    return out.withColumn("source_score", best["score"]).withColumn("source", best["source"]).drop(
        *[f"_{k}_{label}" for _, label in sources for k in ("m", "s")])


def pseudo_labels(fixed: Column, other: Column, obs: Column) -> Column:
    """1 when the other source is strictly closer, 0 when not; one-sided when one is missing; else NULL."""
    a, b = F.abs(obs - fixed), F.abs(obs - other)
    return F.when(a.isNotNull() & b.isNotNull(), (b < a).cast("double")).when(a.isNotNull(), 0.0).when(b.isNotNull(), 1.0)
