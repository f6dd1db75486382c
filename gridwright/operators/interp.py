"""Spatial interpolators over the neighbour table of :mod:`gridwright.operators.knn`.

Each takes ``nbrs(by…, query_id, train_id, rank, d, value)``: at most 128 rows per query, so the
per-query aggregates and windows below are bounded.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXACT_M = 1e-9


def param_grid(nbrs: DataFrame, **axes: Sequence) -> DataFrame:
    """Repeat each neighbour row per parameter combination: the search runs on one neighbour table."""
    out = nbrs
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out


def idw(nbrs: DataFrame, by: Sequence[str], value: str, k: Column | int, power: Column | float,
        variant: str = "exact", name: str = "pred") -> DataFrame:
    """Inverse-distance mean of the ``k`` nearest.

    ``exact``: rows at distance zero answer alone, weights floored at 1e-6 m.  ``floored``: no such
    rule, weights floored at 1e-3 m.
    """
    near = nbrs.filter(F.col("rank") <= k)
    v, d = F.col(value), F.col("d")
    if variant == "floored":
        w = 1.0 / F.pow(F.greatest(d, F.lit(1e-3)), power)
        return near.groupBy(*by).agg((F.sum(w * v) / F.sum(w)).alias(name))
    if variant != "exact":
        raise ValueError("variant must be 'exact' or 'floored'")
    w = 1.0 / F.pow(F.greatest(d, F.lit(1e-6)), power)
    return near.groupBy(*by).agg(
        F.coalesce(F.avg(F.when(d <= EXACT_M, v)), F.sum(w * v) / F.sum(w)).alias(name))


def idw_grid(nbrs: DataFrame, by: Sequence[str], value: str, ks: Sequence[int], powers: Sequence[float], name: str = "pred") -> DataFrame:
    """:func:`idw` (``exact``) for every k and power: (by…, _grid) with an array of (k, power, ``name``).

    The sums of all combinations run beside each other over the neighbours as they come out of the join, so no row is
    repeated per combination and one row a query is exchanged.  A combination without neighbours is null.
    """
    v, d = F.col(value), F.col("d")
    near = nbrs.withColumns({f"_w{j}": 1.0 / F.pow(F.greatest(d, F.lit(1e-6)), float(p)) for j, p in enumerate(powers)})
    sums, made = [], []
    for i, k in enumerate(ks):
        inside = F.col("rank") <= int(k)
        sums.append(F.avg(F.when(inside & (d <= EXACT_M), v)).alias(f"_e{i}"))
        for j, p in enumerate(powers):
            w = F.when(inside, F.col(f"_w{j}"))
            sums += [F.sum(w * v).alias(f"_s{i}_{j}"), F.sum(w).alias(f"_t{i}_{j}")]
            made.append(F.struct(F.lit(int(k)).alias("k"), F.lit(float(p)).alias("power"),
                                 F.coalesce(F.col(f"_e{i}"), F.col(f"_s{i}_{j}") / F.col(f"_t{i}_{j}")).alias(name)))
    return near.groupBy(*by).agg(*sums).select(*by, F.array(*made).alias("_grid"))


def gaussian_nw(nbrs: DataFrame, by: Sequence[str], value: str, bandwidth: Column | float, stable: bool = False,
                name: str = "pred") -> DataFrame:
    """Gaussian kernel mean; vanishing total weight gives the nearest value.

    ``stable`` shifts the exponent by the nearest distance first, so that no weight vanishes.
    """
    d, v = F.col("d"), F.col(value)
    if stable:
        # exponents relative to the nearest row: the largest weight is exp(0)
        near = nbrs.withColumn("_d0", F.min("d").over(W.partitionBy(*by)))
        d0 = F.col("_d0")
        w = F.exp(-0.5 * (d * d - d0 * d0) / (F.lit(1.0) * bandwidth * bandwidth))
        return near.groupBy(*by).agg((F.sum(w * v) / F.sum(w)).alias(name))
    r = d / bandwidth
    w = F.exp(-0.5 * (r * r))
    total = F.sum(w)
    return nbrs.groupBy(*by).agg(
        F.when(total <= 1e-12, F.min_by(v, F.col("rank"))).otherwise(F.sum(w * v) / F.greatest(total, F.lit(1e-12))).alias(name))


def adaptive_gaussian(nbrs: DataFrame, by: Sequence[str], value: str, k: int, name: str = "pred") -> DataFrame:
    """Gaussian kernel whose bandwidth is the distance of the k-th neighbour."""
    near = nbrs.filter(F.col("rank") <= k)
    width = F.greatest(F.max("d").over(W.partitionBy(*by)), F.lit(1e-6))
    return gaussian_nw(near.withColumn("_bw", width), by, value, F.col("_bw"), name=name)


def weighted_median(nbrs: DataFrame, by: Sequence[str], value: str, k: int, power: float, name: str = "pred") -> DataFrame:
    """Smallest value whose cumulative inverse-distance weight reaches half of the total."""
    near = nbrs.filter(F.col("rank") <= k).withColumn("_w", 1.0 / F.pow(F.greatest("d", F.lit(1e-3)), power))
    order = W.partitionBy(*by).orderBy(value, "train_id").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("_w").over(W.partitionBy(*by).orderBy(value, "train_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    reached = near.withColumn("_c", F.sum("_w").over(order)).withColumn("_t", total).filter("_c >= 0.5D * _t")
    return reached.groupBy(*by).agg(F.min(value).alias(name))


# --- the same interpolators over matrices: (query, rank) distances and values, absent neighbours NaN in both ------------

def _weighted(w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of w·v, sum of w); a null value adds its weight only, and the first sum is NaN where all values are null."""
    null = np.isnan(v)
    return np.where(null.all(axis=1), np.nan, np.where(null, 0.0, w * v).sum(axis=1)), w.sum(axis=1)


def idw_values(d: np.ndarray, v: np.ndarray, k: int, power: float) -> np.ndarray:
    """:func:`idw` (``exact``) of every row of the matrices."""
    d, v = d[:, :k], v[:, :k]
    w = np.where(np.isnan(d), 0.0, 1.0 / np.power(np.fmax(d, 1e-6), power))
    top, total = _weighted(w, v)
    here = (d <= EXACT_M) & ~np.isnan(v)
    number = here.sum(axis=1)
    return np.where(number > 0, np.where(here, v, 0.0).sum(axis=1) / np.maximum(number, 1), top / total)


def gaussian_values(d: np.ndarray, v: np.ndarray, bandwidth: np.ndarray | float) -> np.ndarray:
    """:func:`gaussian_nw` of every row of the matrices."""
    r = d / bandwidth
    top, total = _weighted(np.where(np.isnan(d), 0.0, np.exp(-0.5 * (r * r))), v)
    return np.where(total <= 1e-12, v[:, 0], top / np.maximum(total, 1e-12))


def adaptive_values(d: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """:func:`adaptive_gaussian` of every row of the matrices."""
    d, v = d[:, :k], v[:, :k]
    return gaussian_values(d, v, np.fmax(np.fmax.reduce(d, axis=1), 1e-6)[:, None])


def median_values(d: np.ndarray, v: np.ndarray, k: int, power: float) -> np.ndarray:
    """:func:`weighted_median` of every row of the matrices; nulls come first and are no answer."""
    d, v = d[:, :k], v[:, :k]
    w = np.where(np.isnan(d), 0.0, 1.0 / np.power(np.fmax(d, 1e-3), power))
    order = np.argsort(np.where(np.isnan(d), np.inf, np.where(np.isnan(v), -np.inf, v)), axis=1, kind="stable")
    upto = np.cumsum(np.take_along_axis(w, order, 1), axis=1)
    v = np.take_along_axis(v, order, 1)
    reached = (upto >= 0.5 * upto[:, -1:]) & ~np.isnan(v)
    return np.where(reached.any(axis=1), v[np.arange(len(v)), reached.argmax(axis=1)], np.nan)


def local_ridge(
    nbrs: DataFrame, by: Sequence[str], value: str, features: Sequence[tuple[str, str]], k: int, power: float,
    ridge: float, scale: dict[str, float] | None = None, name: str = "pred",
) -> DataFrame:
    """Weighted local linear fit; the intercept at the query is the prediction.

    ``features`` pairs (train column, query column).  The normal equations are plain sums per query;
    only their small solve runs in NumPy, batched.
    """
    near = nbrs.filter(F.col("rank") <= k).withColumn("_w", 1.0 / F.pow(F.greatest("d", F.lit(1e-3)), power))
    cols = [F.lit(1.0)]
    for t, q in features:
        s = (scale or {}).get(t)
        diff = F.col(t) - F.col(q)
        cols.append(diff / F.lit(float(s)) if s else diff)
    regular = [1e-8] + [float(ridge)] * len(features)
    return _solve_intercept(near, by, value, cols, F.col("_w"), regular, name)


def _solve_intercept(near, by, value, cols, weight, regular, name):
    m = len(cols)
    sums = [F.sum(weight * cols[i] * cols[j]).alias(f"_a{i}_{j}") for i in range(m) for j in range(i, m)]
    sums += [F.sum(weight * cols[i] * F.col(value)).alias(f"_b{i}") for i in range(m)]
    table = near.groupBy(*by).agg(*sums)
    schema = T.StructType([table.schema[c] for c in by] + [T.StructField(name, T.DoubleType())])

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            a = np.empty((len(f), m, m))
            for i in range(m):
                for j in range(i, m):
                    a[:, i, j] = a[:, j, i] = f[f"_a{i}_{j}"].to_numpy(float)
            a[:, range(m), range(m)] += np.asarray(regular)
            b = np.stack([f[f"_b{i}"].to_numpy(float) for i in range(m)], axis=1)
            out = f[list(by)].copy()
            try:
                out[name] = np.linalg.solve(a, b[..., None])[:, 0, 0] if len(f) else []
            except np.linalg.LinAlgError:
                out[name] = [np.linalg.lstsq(x, y, rcond=None)[0][0] for x, y in zip(a, b)]
            yield out

    return table.mapInPandas(solve, schema)


def local_kernel(
    nbrs: DataFrame, by: Sequence[str], value: str, low: Column, high: Column, bandwidth: float = 50.0, k: int = 32,
    linear: bool = False, adaptive: bool = False, physics: tuple[str, str] | None = None,
    offsets: Sequence[tuple[str, str]] = (("tx", "qx"), ("ty", "qy")), name: str = "pred",
) -> DataFrame:
    """Gaussian kernel mean, optionally times a kernel on simulated gain, optionally locally linear;
    clipped to the train range ``[low, high]`` (columns of ``nbrs``, constant per query)."""
    near = nbrs.filter(F.col("rank") <= k)
    per = W.partitionBy(*by)
    scale = F.greatest(F.max("d").over(per), F.lit(5.0)) if adaptive else F.lit(float(bandwidth))
    near = near.withColumn("_s", scale)
    logw = -0.5 * (F.col("d") / F.greatest("_s", F.lit(1e-12))) * (F.col("d") / F.greatest("_s", F.lit(1e-12)))
    if physics is not None:
        t, q = (F.col(c) for c in physics)
        diff = (q - t) / 10.0
        logw = logw + F.when(t.isNotNull() & q.isNotNull(), -0.5 * diff * diff).when(
            t.isNotNull() | q.isNotNull(), F.log(F.lit(0.25))).otherwise(0.0)
    near = near.withColumn("_l", logw).withColumn("_w", F.exp(F.col("_l") - F.max("_l").over(per)))
    if linear:
        width = F.greatest("_s", F.lit(5.0))
        cols = [F.lit(1.0)] + [(F.col(t) - F.col(q)) / width for t, q in offsets]
        fit = _solve_intercept(near, by, value, cols, F.col("_w"), [0.0] + [1.0] * len(offsets), name)
        fit = fit.join(near.groupBy(*by).agg(F.min(low).alias("_lo"), F.max(high).alias("_hi")), list(by))
    else:
        fit = near.groupBy(*by).agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias(name), F.min(low).alias("_lo"), F.max(high).alias("_hi"))
    return fit.withColumn(name, F.greatest("_lo", F.least("_hi", name))).drop("_lo", "_hi")


def squared_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Over the last axis, one component after another: no array of all components is built."""
    total = np.zeros(())
    for i in range(a.shape[-1]):
        gap = a[..., i] - b[..., i]
        gap *= gap
        total = total + gap if i else gap
    return total


def local_kriging(
    nbrs: DataFrame, by: Sequence[str], values: dict[str, str], length: Sequence[float], signal: float | str, noise: float | str,
    kernel: str = "matern32", feats: Sequence[str] = ("tx", "ty"), query_feats: Sequence[str] = ("qx", "qy"),
    centers: dict[str, str] | None = None, variance: str | None = None, scale: str | None = None,
) -> DataFrame:
    """Kriging means on each query's own neighbours; several targets share one factorisation.

    ``values`` maps output name -> train value column; ``centers`` names per-query constants (such as the
    split mean) subtracted before and added after, else the neighbour mean is used.  ``signal`` and ``noise``
    are those of the standardised target, or name per-query constants that hold them.  ``variance`` names an output for the latent variance of the first
    target in its own unit: it is multiplied by the square of ``scale``, a per-query constant with the target's
    population deviation in the split (else that of the neighbours).  At most 128 rows per query, stacked by width in Arrow batches.
    """
    f, q, names = list(feats), list(query_feats), list(values)
    centers = centers or {}
    ell = np.asarray(length, float)
    keep = list(dict.fromkeys([*q, *centers.values(), *[c for c in (scale, signal, noise) if isinstance(c, str)]]))
    packed = nbrs.groupBy(*by).agg(
        F.sort_array(F.collect_list(F.struct("rank", *[F.col(values[n]).alias(f"v_{n}") for n in names], *f))).alias("_n"),
        *[F.first(c).alias(c) for c in keep])
    fields = [packed.schema[c] for c in by] + [T.StructField(n, T.DoubleType()) for n in names]
    if variance:
        fields.append(T.StructField(variance, T.DoubleType()))
    flat = packed.select(
        *by, *keep, *[F.expr(f"transform(_n, n -> n.v_{n})").alias(f"_v_{n}") for n in names],
        *[F.expr(f"transform(_n, n -> n.{c})").alias(f"_f_{c}") for c in f])

    def cov(r2):
        if kernel == "rbf":
            return np.exp(-0.5 * r2)
        z = np.sqrt(3.0) * np.sqrt(np.maximum(r2, 1e-24))
        return (1.0 + z) * np.exp(-z)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n, out = len(frame), frame[list(by)].copy()
            mean, var = np.empty((n, len(names))), np.empty(n)
            sizes = np.array([len(v) for v in frame[f"_f_{f[0]}"]], int)
            for m in np.unique(sizes):
                for at in np.array_split(np.flatnonzero(sizes == m), max(1, n // 512)):
                    part = frame.iloc[at]
                    y = np.stack([np.stack([np.asarray(v, float) for v in part[f"_v_{k}"]]) for k in names], axis=2) if len(at) else None
                    if y is None:
                        continue
                    x = np.stack([np.stack([np.asarray(v, float) for v in part[f"_f_{c}"]]) for c in f], axis=2) / ell
                    p = part[q].to_numpy(float) / ell
                    mu = np.stack([part[centers[k]].to_numpy(float) if k in centers else y[:, :, i].mean(axis=1)
                                   for i, k in enumerate(names)], axis=1)
                    sig, own = (part[c].to_numpy(float) if isinstance(c, str) else np.full(len(at), float(c)) for c in (signal, noise))
                    gram = sig[:, None, None] * cov(squared_distance(x[:, :, None, :], x[:, None, :, :]))
                    gram[:, range(m), range(m)] += (own + 1e-8)[:, None]
                    cross = sig[:, None] * cov(squared_distance(x, p[:, None, :]))
                    sol = np.linalg.solve(gram, np.concatenate([y - mu[:, None, :], cross[:, :, None]], axis=2))
                    mean[at] = mu + np.einsum("bk,bkv->bv", cross, sol[:, :, :-1])
                    deviation = part[scale].to_numpy(float) if scale else y[:, :, 0].std(axis=1)
                    var[at] = np.maximum(sig - (cross * sol[:, :, -1]).sum(1), 0.0) * deviation**2
            for i, k in enumerate(names):
                out[k] = mean[:, i]
            if variance:
                out[variance] = var
            yield out

    return flat.mapInPandas(solve, T.StructType(fields))


def tree_regressor(
    fit: DataFrame, query: DataFrame, features: Sequence[str], target: str, kind: str = "forest", seed: int = 0,
    trees: int = 50, depth: int = 8, name: str = "pred",
) -> DataFrame:
    """Forest or gradient-boosted trees for one split, trained by Spark's own distributed learners."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
    pack = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error")
    if kind == "forest":
        model = RandomForestRegressor(featuresCol="_features", labelCol=target, predictionCol=name, numTrees=trees, maxDepth=depth, seed=seed)
    elif kind in ("boosted_squared", "boosted_absolute"):
        model = GBTRegressor(featuresCol="_features", labelCol=target, predictionCol=name, maxIter=trees, maxDepth=min(depth, 5), seed=seed,
                             lossType=kind.split("_")[1])
    else:
        raise ValueError(f"unknown tree kind {kind!r}")
    fitted = model.fit(pack.transform(fit))
    return fitted.transform(pack.transform(query)).drop("_features")
