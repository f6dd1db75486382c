"""Kriging hyper-parameters chosen per split by composite likelihood.

The likelihood of a whole split needs one dense system over all its rows.  Here every block of neighbours (the ``k``
nearest of one query, at most 128) gives the log-likelihood of its own small system, and a split's score is their sum: linear in
the blocks, no row outside a block is needed, and the sums combine map-side.  The search has two rounds, both over all
blocks: a log-spaced grid that all splits share, then a finer one around each split's own winner.

Defined results: targets are standardised by the split's ``center`` and ``scale`` columns (a scale below 1e-6 counts as 1e-6);
rows without a value or a feature belong to no block; blocks of one row count; of equal scores the first grid point
wins, in the order lengths, signals, noises; a split without blocks has no row; an empty table gives an empty result.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence
from functools import cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.functions.quantiles import attach
from gridwright.operators import interp
from gridwright.session import settle

JITTER = 1e-8
#: Bounds of the search and its first grid: lengths in metres, variances of the standardised target.
BOUNDS = {"length": (1.0, 2000.0), "signal": (0.01, 100.0), "noise": (0.0001, 10.0)}
LENGTHS = (5.0, 15.0, 50.0, 150.0, 500.0)
SIGNALS = (0.1, 0.3, 1.0, 3.0)
NOISES = (0.001, 0.01, 0.05, 0.2, 0.6, 1.5)
#: Factors of the second grid around the first one's winner.
NEAR = (0.6, 1.0, 1.6)
#: Blocks whose systems are held at once, and blocks of one task where there are many.
STEP_BLOCKS = 128
TASK_BLOCKS = 4096


def shared_grid(lengths: Sequence[float] = LENGTHS, signals: Sequence[float] = SIGNALS, noises: Sequence[float] = NOISES,
                axes: int = 2) -> dict[str, Column]:
    """The columns of a grid that is the same for every split: each axis takes every length."""
    listed = lambda values: F.array(*[F.lit(float(v)) for v in values])
    return {"lengths": F.array(*[listed(p) for p in product(lengths, repeat=axes)]), "signals": listed(signals), "noises": listed(noises)}


def grid_around(best: DataFrame, by: Sequence[str], factors: Sequence[float] = NEAR, axes: int = 2) -> DataFrame:
    """(by…, lengths, signals, noises) near each split's parameters and inside the bounds."""
    def near(value, name):
        low, high = BOUNDS[name]
        return F.array(*[F.least(F.greatest(value * F.lit(float(f)), F.lit(low)), F.lit(high)) for f in factors])

    per_axis = [near(F.col("length")[i], "length") for i in range(axes)]
    pairs = F.array(*[F.array(*[per_axis[i][j] for i, j in enumerate(p)]) for p in product(range(len(factors)), repeat=axes)])
    return best.select(*by, pairs.alias("lengths"), near(F.col("signal"), "signal").alias("signals"), near(F.col("noise"), "noise").alias("noises"))


def correlation(r2: np.ndarray, kernel: str) -> np.ndarray:
    if kernel == "rbf":
        return np.exp(-0.5 * r2)
    if kernel != "matern32":
        raise ValueError(f"unknown kernel {kernel!r}")
    z = np.sqrt(3.0) * np.sqrt(np.maximum(r2, 1e-24))
    return (1.0 + z) * np.exp(-z)


@cache
def _sytrd():
    """LAPACK's ``dsytrd`` out of the library that NumPy's own linear algebra runs on, or None where it has another name."""
    try:
        library = ctypes.CDLL(np.linalg._umath_linalg.__file__)
    except (AttributeError, OSError):
        return None
    found = next((f for name in ("scipy_dsytrd_64_", "dsytrd_64_", "scipy_dsytrd_", "dsytrd_") if (f := getattr(library, name, None))), None)
    if found is None:
        return None
    found.restype = None
    # an integer of 8 bytes behind a pointer serves a library of either width
    sample = np.triu(np.add.outer(np.arange(5.0), np.arange(5.0) ** 2))
    diagonal, off = _tridiagonal(sample[None].copy(), found)
    full = np.diag(diagonal[0]) + np.diag(off[0], 1) + np.diag(off[0], -1)
    return found if np.allclose(np.linalg.eigvalsh(full), np.linalg.eigvalsh(sample, "U")) else None


def _tridiagonal(m: np.ndarray, sytrd) -> tuple[np.ndarray, np.ndarray]:
    """(diagonals, off-diagonals) of the symmetric matrices whose upper triangles ``m`` holds; the first axis is kept, ``m`` is overwritten."""
    count, n = m.shape[:2]
    diagonal, off = np.empty((count, n)), np.empty((count, n - 1))
    scratch, work = np.empty(n), np.empty(n * 64)
    size, length, info = ctypes.c_int64(n), ctypes.c_int64(len(work)), ctypes.c_int64(0)
    by_ref, at = ctypes.byref, ctypes.c_void_p
    for b in range(count):
        sytrd(b"L", by_ref(size), at(m.ctypes.data + b * m.strides[0]), by_ref(size), at(diagonal.ctypes.data + b * diagonal.strides[0]),
              at(off.ctypes.data + b * off.strides[0]), at(scratch.ctypes.data), at(work.ctypes.data), by_ref(length), by_ref(info), ctypes.c_size_t(1))
    return diagonal, off


def _log_and_square(corr: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], y: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log|K + rI| and y'(K + rI)^-1 y, each (block, ratio), of the matrices K with the correlations ``corr`` at ``pairs``.

    K bordered by y is turned into tridiagonal form T with y along the first axis, a quarter of the work of an eigendecomposition
    with its vectors.  Elimination from the far end then gives all pivots of T + rI, for every ratio at once, and the
    last one alone is what the square needs.  No pivot of a positive matrix plus rI is below r.
    """
    count, n = y.shape
    sytrd = _sytrd()
    if sytrd is None:
        full = np.zeros((count, n, n))
        full[:, pairs[1], pairs[0]] = corr
        full[:, range(n), range(n)] = 1.0
        size, turn = np.linalg.eigh(full)
        along = np.einsum("bij,bi->bj", turn, y) ** 2
        spread = np.maximum(size, 0.0)[:, None, :] + ratios[:, None]
        return np.log(spread).sum(axis=2), (along[:, None, :] / spread).sum(axis=2)
    m = np.zeros((count, n + 1, n + 1))
    m[:, 0, 1:] = y
    m[:, pairs[0] + 1, pairs[1] + 1] = corr
    m[:, range(1, n + 1), range(1, n + 1)] = 1.0
    diagonal, off = _tridiagonal(m, sytrd)
    off *= off
    pivot = np.maximum(diagonal[:, n, None] + ratios, ratios)
    log, product = np.zeros(pivot.shape), pivot.copy()
    for i in range(n - 1, 0, -1):
        pivot = np.maximum(diagonal[:, i, None] + ratios - off[:, i, None] / pivot, ratios)
        product *= pivot
        if i % 8 == 0:  # few logarithms, and no product leaves the range of a double
            log += np.log(product)
            product[:] = 1.0
    return log + np.log(product), off[:, 0, None] / pivot


def block_likelihoods(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, signals: np.ndarray, noises: np.ndarray,
                      kernel: str) -> np.ndarray:
    """Log-likelihood summed over equally large blocks: ``x`` (block, row, axis), ``y`` (block, row) -> (length, signal, noise).

    One decomposition of a block's correlations serves every signal and noise, since only their ratio enters it.
    """
    out = np.zeros((len(lengths), len(signals), len(noises)))
    rows = y.shape[1]
    pairs = np.triu_indices(rows, 1)
    ratios = np.ravel((noises + JITTER) / signals[:, None])
    for s in range(0, len(y), STEP_BLOCKS):
        part, values = x[s:s + STEP_BLOCKS], y[s:s + STEP_BLOCKS]
        gaps = [(part[:, pairs[0], k] - part[:, pairs[1], k]) ** 2 for k in range(part.shape[2])]
        for i, length in enumerate(lengths):
            log, square = _log_and_square(correlation(sum(g / (v * v) for g, v in zip(gaps, length)), kernel), pairs, values, ratios)
            total = [t.sum(axis=0).reshape(out.shape[1:]) for t in (log, square)]
            out[i] -= 0.5 * (total[0] + len(values) * rows * np.log(signals)[:, None] + total[1] / signals[:, None])
    return out - 0.5 * len(y) * rows * np.log(2.0 * np.pi)


def block_table(nbrs: DataFrame, split: Sequence[str], block: str, value: str, feats: Sequence[str], center: str, scale: str) -> DataFrame:
    """(split…, block, _y, _x0, _x1, …): the standardised rows of every block, in the order of their rank."""
    kept = nbrs.filter(" and ".join(f"`{c}` is not null" for c in (value, *feats)))
    standard = (F.col(value) - F.col(center)) / F.greatest(F.col(scale), F.lit(1e-6))
    rows = F.sort_array(F.collect_list(F.struct("rank", "train_id", standard.alias("y"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(feats)])))
    packed = kept.groupBy(*split, block).agg(rows.alias("_n"))
    parts = ["y", *[f"x{i}" for i in range(len(feats))]]
    return packed.select(*split, block, *[F.col(f"_n.{p}").alias(f"_{p}") for p in parts])


def likelihoods(blocks: DataFrame, split: Sequence[str], axes: int = 2, kernel: str = "matern32") -> DataFrame:
    """(split…, at, loglik, blocks, rows), one row for each grid point ``at`` of a split.

    ``blocks`` is a :func:`block_table` with the columns of a grid beside it.  A task adds up its own blocks first.
    """
    split = list(split)
    schema = T.StructType([blocks.schema[c] for c in split] + [
        T.StructField(n, t) for n, t in (("_terms", T.ArrayType(T.DoubleType())), ("blocks", T.LongType()), ("rows", T.LongType()))])

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            # every block of a split carries the split's grid
            for _, part in frame.groupby(split, dropna=False, sort=False) if split else [((), frame)]:
                first = part.iloc[0]
                lengths = np.array([np.asarray(v, float) for v in first["lengths"]])
                signals, noises = np.asarray(first["signals"], float), np.asarray(first["noises"], float)
                total, sizes = 0.0, part["_y"].map(len).to_numpy()
                for m in np.unique(sizes):
                    some = part[sizes == m]
                    y = np.stack([np.asarray(v, float) for v in some["_y"]])
                    x = np.stack([np.stack([np.asarray(v, float) for v in some[f"_x{i}"]]) for i in range(axes)], axis=2)
                    total = total + block_likelihoods(x, y, lengths, signals, noises, kernel)
                made.append([*[first[c] for c in split], np.ravel(total), len(part), int(sizes.sum())])
            if made:
                yield pd.DataFrame(made, columns=schema.names)

    terms = blocks.mapInPandas(score, schema)
    return terms.select(*split, F.posexplode("_terms").alias("at", "_t"), "blocks", "rows").groupBy(*split, "at").agg(
        F.sum("_t").alias("loglik"), F.sum("blocks").alias("blocks"), F.sum("rows").alias("rows"))


def _point(grid: DataFrame) -> DataFrame:
    """The parameters of grid point ``at``: lengths vary slowest, noises fastest."""
    signals, noises = F.size("signals"), F.size("noises")
    place = lambda values, index: F.element_at(values, (index + 1).cast("int"))
    return grid.withColumn("length", place(F.col("lengths"), F.floor(F.col("at") / (signals * noises)))).withColumn(
        "signal", place(F.col("signals"), F.floor(F.col("at") / noises) % signals)).withColumn(
        "noise", place(F.col("noises"), F.col("at") % noises)).drop("lengths", "signals", "noises")


def search(nbrs: DataFrame, split: Sequence[str], block: str, value: str, feats: Sequence[str] = ("tx", "ty"), center: str = "center",
           scale: str = "scale", kernel: str = "matern32", grid: dict[str, Column] | None = None, refine: bool = True) -> DataFrame:
    """(split…, length, signal, noise, loglik, blocks, rows): the parameters of the largest composite likelihood per split."""
    split, axes = list(split), len(feats)
    blocks = settle(block_table(nbrs, split, block, value, feats, center, scale))
    # a block is few bytes and much work: tasks are cut by their number, not by the size of the files
    blocks = blocks.repartition(max(blocks.sparkSession.sparkContext.defaultParallelism, -(-blocks.count() // TASK_BLOCKS)))
    grid = grid or shared_grid(axes=axes)

    def best(table: DataFrame, with_grid) -> DataFrame:
        scores = likelihoods(table, split, axes, kernel)
        top = scores.groupBy(*split).agg(F.min(F.struct((-F.col("loglik")).alias("loss"), "at", "blocks", "rows")).alias("_b"))
        top = top.select(*split, F.col("_b.at").alias("at"), (-F.col("_b.loss")).alias("loglik"), "_b.blocks", "_b.rows")
        return _point(with_grid(top)).select(*split, "length", "signal", "noise", "loglik", "blocks", "rows")

    first = settle(best(blocks.withColumns(grid), lambda t: t.withColumns(grid)))
    if not refine:
        return first
    finer = settle(grid_around(first, split, axes=axes))
    return settle(best(attach(blocks, finer, split), lambda t: attach(t, finer, split)))


def fitted_kriging(nbrs: DataFrame, split: Sequence[str], block: str, value: str, best: DataFrame, feats: Sequence[str] = ("tx", "ty"),
                   query_feats: Sequence[str] = ("qx", "qy"), center: str = "center", scale: str = "scale", kernel: str = "matern32") -> DataFrame:
    """(split…, block, pred, latent_var) by :func:`interp.local_kriging` with each split's own parameters."""
    split = list(split)
    near = attach(nbrs, best.select(*split, F.col("length").alias("_l"), F.col("signal").alias("_signal"), F.col("noise").alias("_noise")), split)
    scaled = {f"_f{i}": F.col(c) / F.col("_l")[i] for i, c in enumerate(feats)} | {f"_q{i}": F.col(c) / F.col("_l")[i] for i, c in enumerate(query_feats)}
    n = len(feats)
    return interp.local_kriging(
        near.withColumns(scaled), [*split, block], {"pred": value}, (1.0,) * n, "_signal", "_noise", kernel, [f"_f{i}" for i in range(n)],
        [f"_q{i}" for i in range(n)], centers={"pred": center}, variance="latent_var", scale=scale)
