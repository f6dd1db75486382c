"""Linear combinations fitted on out-of-fold rows: simplex stacking and the error-size model.

Both reduce the rows to a Gram matrix per split; what is solved afterwards has at most ten unknowns.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.functions.quantiles import attach, exact_quantiles
from gridwright.operators.score import _with
from gridwright.session import settle

MAX_METHODS = 10


def wide(preds: DataFrame, by: Sequence[str], methods: Sequence[str], obs: str = "observed_dbm") -> DataFrame:
    """One row per point with a column m0… per method; rows missing any method or the label drop out."""
    t = preds.groupBy(*by, "point_id").agg(
        F.max(obs).alias("y"), *[F.max(F.when(F.col("method") == m, F.col("pred"))).alias(f"m{i}") for i, m in enumerate(methods)])
    return t.dropna(subset=["y", *[f"m{i}" for i in range(len(methods))]])


def _gram(rows: DataFrame, by: Sequence[str], cols: Sequence[Column], y: Column) -> DataFrame:
    n = len(cols)
    sums = [F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]
    sums += [F.sum(c * y).alias(f"c{i}") for i, c in enumerate(cols)] + [F.sum(c).alias(f"s{i}") for i, c in enumerate(cols)]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), *sums)


def _matrix(f: pd.DataFrame, n: int) -> np.ndarray:
    g = np.empty((len(f), n, n))
    for i in range(n):
        for j in range(i, n):
            g[:, i, j] = g[:, j, i] = f[f"g{i}_{j}"].to_numpy(float)
    return g


def simplex_least_squares(g: np.ndarray, c: np.ndarray) -> np.ndarray:
    """argmin w'Gw - 2c'w over the simplex, by trying every support; exact for the few methods there are."""
    n, best, found = len(c), np.inf, np.full(len(c), 1.0 / len(c))
    for size in range(1, n + 1):
        for keep in map(list, combinations(range(n), size)):
            k = np.zeros((size + 1, size + 1))
            k[:size, :size], k[:size, size], k[size, :size] = g[np.ix_(keep, keep)], 1.0, 1.0
            w = np.linalg.lstsq(k, np.append(c[keep], 1.0), rcond=None)[0][:size]
            if (w < -1e-10).any() or abs(w.sum() - 1.0) > 1e-6:
                continue
            value = w @ g[np.ix_(keep, keep)] @ w - 2 * c[keep] @ w
            if value < best - 1e-12 * max(1.0, abs(best) if np.isfinite(best) else 1.0):
                best, found = value, np.zeros(n)
                found[keep] = np.maximum(w, 0.0)
    return found / found.sum()


def stack_weights(preds: DataFrame, by: Sequence[str], methods: Sequence[str], rounds: int = 3, min_rows: int = 20) -> DataFrame:
    """(by…, w0…, bias, rmse): simplex weights and median bias; fewer than ``min_rows`` rows give equal weights.

    Weights for a fixed bias come from the Gram matrix, the bias for fixed weights is one exact median;
    the best of a fixed number of rounds is kept.
    """
    if len(methods) > MAX_METHODS:
        raise ValueError(f"at most {MAX_METHODS} methods")
    m = len(methods)
    rows = settle(wide(preds, by, methods))
    gram = settle(_gram(rows, by, [F.col(f"m{i}") for i in range(m)], F.col("y")))
    fields = [gram.schema[c] for c in by] + [T.StructField(f"w{i}", T.DoubleType()) for i in range(m)]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = f[list(by)].copy()
            g = _matrix(f, m)
            w = np.full((len(f), m), 1.0 / m)
            for r in range(len(f)):
                row = f.iloc[r]
                if row["n"] < min_rows:
                    continue
                c, total = (np.array([row[f"{k}{i}"] for i in range(m)], float) for k in "cs")
                if row["bias"] is None or row["bias"] != row["bias"]:  # first round: the bias is the mean residual
                    w[r] = simplex_least_squares(g[r] - np.outer(total, total) / row["n"], c - total * row["sy"] / row["n"])
                else:
                    w[r] = simplex_least_squares(g[r], c - row["bias"] * total)
            for i in range(m):
                out[f"w{i}"] = w[:, i]
            yield out

    state = gram.withColumn("bias", F.lit(None).cast("double"))
    best = None
    for _ in range(rounds):
        w = settle(state.mapInPandas(solve, T.StructType(fields)))
        blend = sum((F.col(f"w{i}") * F.col(f"m{i}") for i in range(m)), F.lit(0.0))
        res = attach(rows, w, by).withColumn("_r", F.col("y") - blend)
        bias = exact_quantiles(res, by, "_r", [0.5], ["bias"])
        t = attach(res, bias, by).groupBy(*by).agg(
            F.sqrt(F.avg((F.col("_r") - F.col("bias")) * (F.col("_r") - F.col("bias")))).alias("rmse"), F.count(F.lit(1)).alias("n"), F.max("bias").alias("bias"))
        now = settle(_with(w, t, by))
        best = now if best is None else best.unionByName(now)
        state = _with(gram, now.select(*by, "bias"), by)
    keep = [f"w{i}" for i in range(m)]
    top = best.groupBy(*by).agg(F.min(F.struct("rmse", "n", "bias", *keep)).alias("_b")).select(*by, "_b.*")
    small = F.col("n") < min_rows
    return top.withColumn("bias", F.when(small, 0.0).otherwise(F.col("bias"))).withColumn("rmse", F.when(~small, F.col("rmse")))


def apply_stack(preds: DataFrame, weights: DataFrame, by: Sequence[str], methods: Sequence[str], name: str = "pred") -> DataFrame:
    t = preds.groupBy(*by, "point_id").agg(*[F.max(F.when(F.col("method") == m, F.col("pred"))).alias(f"m{i}") for i, m in enumerate(methods)])
    blend = sum((F.col(f"w{i}") * F.col(f"m{i}") for i in range(len(methods))), F.lit(0.0))
    return attach(t, weights, by).select(*by, "point_id", (blend + F.col("bias")).alias(name))


def confidence_model(rows: DataFrame, by: Sequence[str], features: Sequence[str], target: str, ridge: float = 1.0) -> DataFrame:
    """(by…, intercept, k0…, s0…): |error| as a non-negative combination of features over their medians.

    Every sign pattern of the few coefficients is tried, so the bounded optimum is exact.
    """
    m = len(features)
    complete = rows.dropna(subset=[*features, target])
    scales = None
    for i, f in enumerate(features):
        q = exact_quantiles(complete, by, f, [0.5], [f"s{i}"])
        scales = q if scales is None else _with(scales, q, by)
    scales = scales.select(*by, *[F.greatest(f"s{i}", F.lit(1e-3)).alias(f"s{i}") for i in range(m)])
    t = attach(complete, scales, by)
    cols = [F.lit(1.0)] + [F.col(f) / F.col(f"s{i}") for i, f in enumerate(features)]
    gram = _with(_gram(t, by, cols, F.col(target)).drop(*[f"s{i}" for i in range(m + 1)]), scales, by)
    fields = [gram.schema[c] for c in by] + [T.StructField(c, T.DoubleType()) for c in ["intercept", *[f"k{i}" for i in range(m)], *[f"s{i}" for i in range(m)]]]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = f[list(by)].copy()
            g = _matrix(f, m + 1)
            g[:, range(1, m + 1), range(1, m + 1)] += ridge
            c = np.stack([f[f"c{i}"].to_numpy(float) for i in range(m + 1)], axis=1)
            coef = np.zeros((len(f), m + 1))
            for r in range(len(f)):
                best = np.inf
                for size in range(m + 1):
                    for keep in combinations(range(1, m + 1), size):
                        at = [0, *keep]
                        w = np.linalg.solve(g[r][np.ix_(at, at)], c[r][at])
                        if (w[1:] < 0).any():
                            continue
                        value = w @ g[r][np.ix_(at, at)] @ w - 2 * c[r][at] @ w
                        if value < best:
                            best = value
                            coef[r] = 0.0
                            coef[r][at] = w
            out["intercept"] = coef[:, 0]
            for i in range(m):
                out[f"k{i}"] = coef[:, i + 1]
            for i in range(m):
                out[f"s{i}"] = f[f"s{i}"].to_numpy(float)
            yield out

    return gram.mapInPandas(solve, T.StructType(fields))


def confidence_score(rows: DataFrame, model: DataFrame, by: Sequence[str], features: Sequence[str], name: str = "score") -> DataFrame:
    t = attach(rows, model, by)
    value = F.col("intercept") + sum((F.col(f"k{i}") * F.col(f) / F.col(f"s{i}") for i, f in enumerate(features)), F.lit(0.0))
    return t.withColumn(name, F.greatest(value, F.lit(0.0))).drop("intercept", *[f"{p}{i}" for p in "ks" for i in range(len(features))])
