"""Straight transmitter-receiver segments over a fixed grid, and the attenuation field fitted on them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CELLS = 2048  # up to here the normal matrix of one field (32 MB) is solved in one task, beyond by Spark rounds


@dataclass(frozen=True)
class GridSpec:
    x_min: float
    y_min: float
    size: float
    nx: int
    ny: int

    @property
    def cells(self) -> int:
        return self.nx * self.ny


def segment_cells(points: DataFrame, by: Sequence[str], grid: GridSpec, x: str = "x", y: str = "y",
                  tx_x: str = "tx_x", tx_y: str = "tx_y") -> DataFrame:
    """(by…, point_id, cell_id, frac): exact length of each segment inside each cell over the cell size.

    Cuts are found per row between the end cells only, so a row makes at most nx + ny pieces.  Points are dealt by their id
    before they are cut, so that neither the sum of a cell's pieces nor a join by point has to exchange the pieces.
    """
    points = points.repartition(*by, "point_id")
    def cuts(a, b, low, n):
        first = F.greatest(F.lit(1), (F.floor((F.least(a, b) - low) / grid.size)).cast("int"))
        last = F.least(F.lit(n - 1), (F.ceil((F.greatest(a, b) - low) / grid.size)).cast("int"))
        lines = F.when((F.abs(b - a) > 1e-12) & (first <= last), F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(lines, lambda i: (F.lit(low) + i * grid.size - a) / (b - a)), lambda t: (t >= 0.0) & (t <= 1.0))

    ax, ay, bx, by_ = F.col(tx_x), F.col(tx_y), F.col(x), F.col(y)
    t = F.array_sort(F.array_distinct(F.concat(
        F.array(F.lit(0.0), F.lit(1.0)), cuts(ax, bx, grid.x_min, grid.nx), cuts(ay, by_, grid.y_min, grid.ny))))
    rows = points.select(*by, "point_id", ax.alias("_ax"), ay.alias("_ay"), (bx - ax).alias("_dx"), (by_ - ay).alias("_dy"), t.alias("_t"))
    rows = rows.withColumn("_len", F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))).filter("_len > 1e-12")
    piece = F.explode(F.arrays_zip(
        F.slice("_t", 1, F.size("_t") - 1).alias("l"), F.slice("_t", 2, F.size("_t") - 1).alias("r"))).alias("_s")
    rows = rows.select(*by, "point_id", "_ax", "_ay", "_dx", "_dy", "_len", piece)
    l, r = F.col("_s.l"), F.col("_s.r")
    clamp = lambda v, n: F.least(F.greatest(F.floor(v / grid.size), F.lit(0)), F.lit(n - 1))
    cx = clamp(F.col("_ax") + 0.5 * (l + r) * F.col("_dx") - grid.x_min, grid.nx)
    cy = clamp(F.col("_ay") + 0.5 * (l + r) * F.col("_dy") - grid.y_min, grid.ny)
    return rows.filter(r - l > 1e-12).select(
        *by, "point_id", (cy * grid.nx + cx).cast("bigint").alias("cell_id"), (F.col("_len") * (r - l) / grid.size).alias("_f")
    ).groupBy(*by, "point_id", "cell_id").agg(F.sum("_f").alias("frac"))


def conservation(segments: DataFrame, points: DataFrame, by: Sequence[str], size: float) -> DataFrame:
    """Largest |sum of pieces - distance / size| over the points."""
    total = segments.groupBy(*by, "point_id").agg(F.sum("frac").alias("_s"))
    return points.join(total, [*by, "point_id"]).agg(F.max(F.abs(F.col("_s") - F.col("distance") / size)).alias("worst_gap"))


def influence_field(segments: DataFrame, residuals: DataFrame, by: Sequence[str], residual: str, grid: GridSpec,
                    ridge: float = 5.0, low: float = -20.0, sweeps: int = 2000, tolerance: float = 0.01) -> DataFrame:
    """Bias plus per-cell attenuation in [low, 0]: (by…, cell_id, attenuation_db, intercept_db).

    The optimum is unique for a positive ridge.  On a grid of at most ``MAX_CELLS`` cells the data pass accumulates the
    normal equations, whose size is the grid's and not the table's, and the bounded solve is coordinate descent
    with the free intercept eliminated; on a larger one :func:`field_by_rounds` finds the same optimum to ``tolerance`` dB.
    """
    if grid.cells > MAX_CELLS:
        return field_by_rounds(segments, residuals, by, residual, ridge, low, tolerance)
    by = list(by)
    rows = segments.join(residuals.select(*by, "point_id", F.col(residual).alias("_y")), [*by, "point_id"])
    # a row holds at most nx + ny cells, so its pair products are bounded by the grid as well
    packed = rows.groupBy(*by, "point_id", "_y").agg(F.collect_list(F.struct("cell_id", "frac")).alias("_c"))
    one = F.array(F.struct(F.lit(-1).cast("bigint").alias("cell_id"), F.lit(1.0).alias("frac")))
    packed = packed.withColumn("_c", F.concat(one, "_c"))
    left = packed.select(*by, "_y", "_c", F.explode("_c").alias("_a"))
    pairs = left.select(*by, F.col("_a.cell_id").alias("i"), F.col("_a.frac").alias("_fi"), F.explode("_c").alias("_b"))
    gram = pairs.groupBy(*by, "i", F.col("_b.cell_id").alias("j")).agg(F.sum(F.col("_fi") * F.col("_b.frac")).alias("v"))
    right = left.groupBy(*by, F.col("_a.cell_id").alias("i")).agg(F.sum(F.col("_a.frac") * F.col("_y")).alias("v")).withColumn(
        "j", F.lit(-2).cast("bigint"))
    system = gram.unionByName(right)
    fields = [system.schema[c] for c in by] + [
        T.StructField("cell_id", T.LongType()), T.StructField("attenuation_db", T.DoubleType()), T.StructField("intercept_db", T.DoubleType())]
    names = [f.name for f in fields]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = np.sort(pdf.loc[pdf.j == -2, "i"].to_numpy())  # -1, the intercept, comes first
        at = {c: n for n, c in enumerate(cells)}
        a, b = np.zeros((len(cells), len(cells))), np.zeros(len(cells))
        for i, j, v in zip(pdf.i, pdf.j, pdf.v):
            if j == -2:
                b[at[i]] = v
            else:
                a[at[i], at[j]] = v
        n = a[0, 0]
        h = a[1:, 1:] - np.outer(a[1:, 0], a[0, 1:]) / n
        h[np.diag_indices_from(h)] += ridge
        g = b[1:] - a[1:, 0] * b[0] / n
        w = np.zeros(len(g))
        for _ in range(sweeps):
            moved = 0.0
            for c in range(len(w)):
                new = min(0.0, max(low, w[c] + (g[c] - h[c] @ w) / h[c, c]))
                moved = max(moved, abs(new - w[c]))
                w[c] = new
            if moved < 1e-10:
                break
        out = {k: [pdf[k].iloc[0]] * len(w) for k in by}
        out.update(cell_id=cells[1:], attenuation_db=w, intercept_db=[(b[0] - a[0, 1:] @ w) / n] * len(w))
        return pd.DataFrame(out, columns=names)

    return system.groupBy(*(by or [F.lit(0)])).applyInPandas(solve, T.StructType(fields))


BLOCK_PIECES = 262_144  # pieces of one block of points
BATCH_BYTES = "16m"  # of blocks that a worker receives at once
SENT_VALUES = 2_000_000  # cells of all splits whose step is broadcast, more meet the blocks by a merge


def _point_blocks(pieces: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by…, cells, f, ys, first, y): the pieces (by…, point_id, cell_id, f, _y) of many points as flat arrays.

    ``first`` is where each point's pieces begin and ``y`` its residual; a block has about ``BLOCK_PIECES`` pieces of one split.
    """
    by = list(by)
    listed = lambda c: F.col(f"_c.{c}").alias(c)
    # a point has at most nx + ny pieces
    packed = pieces.groupBy(*by, "point_id").agg(F.collect_list(F.struct("cell_id", "f", F.col("_y").alias("ys"))).alias("_c"), F.max("_y").alias("y"))
    packed = packed.select(*by, listed("cell_id"), listed("f"), listed("ys"), "y")
    many, real = T.ArrayType(T.LongType()), T.ArrayType(T.DoubleType())
    schema = T.StructType([packed.schema[c] for c in by] + [T.StructField(n, t) for n, t in (("cells", many), ("f", real), ("ys", real), ("first", many), ("y", real))])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, split in frame.groupby(by, dropna=False, sort=False) if by else [((), frame)]:
                sizes = split["f"].map(len).to_numpy()
                place = (np.cumsum(sizes) - sizes) // BLOCK_PIECES
                for part in (split[place == p] for p in np.unique(place)):
                    n = part["f"].map(len).to_numpy()
                    flat = [np.concatenate(part[c].to_list()) for c in ("cell_id", "f", "ys")]
                    yield pd.DataFrame([[*[part[c].iloc[0] for c in by], *flat, np.cumsum(n) - n, part["y"].to_numpy(float)]], columns=schema.names)

    return packed.mapInPandas(cut, schema)


def field_by_rounds(segments: DataFrame, residuals: DataFrame, by: Sequence[str], residual: str, ridge: float = 5.0, low: float = -20.0,
                    tolerance: float = 0.01, rounds: int = 2000) -> DataFrame:
    """The field of :func:`influence_field` for grids of any size, by conjugate gradients projected to the bounds.

    A round is one product with the normal matrix, which is never formed: points lie in blocks of flat arrays, where the step of the cells
    is summed along each point's pieces and these sums are summed back per cell.  A task adds up its blocks, so only one
    vector of cells a task and split moves, no cell is a hot key, and all splits advance in the same rounds.  The vectors of a split (one number
    a cell, as small as the grid) are one row, and one task updates it.  The direction is scaled by the diagonal and kept conjugate on the
    cells that are free to move; it is cut at the bounds and the step along the cut direction is exact, so every round
    lowers the objective.  Rounds end when no cell would move by more than ``tolerance`` dB under a diagonal step (the
    optimality conditions); an error is raised if ``rounds`` do not suffice.  Only that one number reaches the driver; older rows are deleted.

    Defined results: points without pieces or with a null residual take no part; a cell without pieces has no row.
    """
    from gridwright.session import release, settle
    keys = list(by) or ["_all"]
    if not by:
        segments, residuals = segments.withColumn("_all", F.lit(0)), residuals.withColumn("_all", F.lit(0))
    spark = segments.sparkSession
    batch = spark.conf.get(BATCH_KEY)
    spark.conf.set(BATCH_KEY, BATCH_BYTES)
    try:
        return _rounds(segments, residuals, keys, residual, ridge, low, tolerance, rounds, settle, release).drop("_all")
    finally:
        spark.conf.set(BATCH_KEY, batch)


BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def _rounds(segments, residuals, by, residual, ridge, low, tolerance, rounds, settle, release) -> DataFrame:
    cell, point = [*by, "cell_id"], [*by, "point_id"]
    pieces = segments.join(residuals.select(*point, F.col(residual).cast("double").alias("_y")), point).filter(F.col("_y").isNotNull())
    blocks = settle(_point_blocks(pieces.select(*point, "cell_id", F.col("frac").alias("f"), "_y"), by))
    size = blocks.select(*by, F.explode("y").alias("y")).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"))
    each = blocks.select(*by, F.explode(F.arrays_zip("cells", "f", "ys")).alias("_p")).select(*by, F.col("_p.cells").alias("cell_id"), "_p.f", "_p.ys")
    each = each.groupBy(*cell).agg(F.sum("f").alias("total"), F.sum(F.col("f") * F.col("f")).alias("ff"), F.sum(F.col("f") * F.col("ys")).alias("fy"))
    # one row a split with one number a cell
    vectors = each.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("cell_id", "total", "ff", "fy"))).alias("_c")).join(size, by)
    vectors = vectors.select(*by, "n", "mean", *[F.col(f"_c.{c}").alias(c) for c in ("cell_id", "total", "ff", "fy")])
    lists = ("total", "diag", "w", "g", "p", "z", "d")
    schema = T.StructType([vectors.schema[c] for c in by] + [T.StructField("n", T.LongType()), T.StructField("mean", T.DoubleType()), T.StructField("lam", T.DoubleType()),
                          T.StructField("worst", T.DoubleType()), T.StructField("cell_id", T.ArrayType(T.LongType()))] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in lists])
    cut = lambda v: np.clip(v, low, 0.0)

    def turned(row: dict, old_g: np.ndarray, old_z: np.ndarray) -> pd.DataFrame:
        """The row with its next direction and how far a cell is from its optimum."""
        w, g, p, diag = (row[c] for c in ("w", "g", "p", "diag"))
        held = ((w >= 0) & (g < 0)) | ((w <= low) & (g > 0))
        z, p = np.where(held, 0.0, g / diag), np.where(held, 0.0, p)
        was = old_z @ old_g
        beta = max(0.0, z @ (g - old_g) / was) if was > 0 else 0.0
        p = (beta if beta * (p @ g) < z @ g else 0.0) * p - z
        row = row | {"p": p, "z": z, "d": cut(w + row["lam"] * p) - w, "worst": float(np.abs(w - cut(w - g / diag)).max())}
        return pd.DataFrame([[row[c] for c in schema.names]], columns=schema.names)

    def begin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.to_dict("records"):
                total, ff, fy = (np.asarray(r[c], float) for c in ("total", "ff", "fy"))
                nothing = np.zeros(len(total))
                yield turned(r | {"total": total, "diag": ff - total * total / r["n"] + ridge, "w": nothing, "g": r["mean"] * total - fy, "p": nothing, "lam": 0.05}, nothing, nothing)

    part = T.StructType([blocks.schema[c] for c in by] + [T.StructField("h", T.ArrayType(T.DoubleType())), T.StructField("sum", T.DoubleType()), T.StructField("square", T.DoubleType())])

    def product(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, list] = {}

        def sent() -> Iterator[pd.DataFrame]:
            for at, (_, place, h, total, square) in sums.items():
                yield pd.DataFrame([[*at, h[place], total, square]], columns=part.names)
            sums.clear()

        for frame in frames:
            for *at, cells, f, first, ids, d in frame[[*by, "cells", "f", "first", "cell_id", "d"]].itertuples(index=False, name=None):
                if tuple(at) not in sums:
                    if sum(len(v[0]) for v in sums.values()) > SENT_VALUES:
                        yield from sent()
                    dense = np.zeros(int(ids[-1] - ids[0]) + 1)
                    dense[ids - ids[0]] = d
                    sums[tuple(at)] = [dense, ids - ids[0], np.zeros(len(dense)), 0.0, 0.0]
                held = sums[tuple(at)]
                place = cells - ids[0]
                along = np.add.reduceat(f * held[0][place], first)
                held[2] += np.bincount(place, f * np.repeat(along, np.diff(first, append=len(f))), len(held[0]))
                held[3] += along.sum()
                held[4] += along @ along
        yield from sent()

    def step(row: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        r = row.iloc[0].to_dict() | {c: np.asarray(row[c].iloc[0], float) for c in lists}
        h = sum(np.asarray(v, float) for v in parts["h"])
        total, square, n = parts["sum"].sum(), parts["square"].sum(), r["n"]
        w, g, d = r["w"], r["g"], r["d"]
        curve = square - total * total / n + ridge * (d @ d)
        exact = -(g @ d) / curve if curve > 0 else 0.0
        moves = d != 0
        room = np.where(d > 0, -w, low - w)[moves] / d[moves]
        take = min(exact, max(1.0, room.min() if len(room) else 1.0))
        change = h - total / n * r["total"] + ridge * d
        return turned(r | {"w": cut(w + take * d), "g": g + take * change, "lam": min(50.0, max(1e-4, 2.0 * r["lam"] * exact))}, g, r["z"])

    state = settle(vectors.mapInPandas(begin, schema))
    hint = "broadcast" if (state.agg(F.sum(F.size("cell_id"))).first()[0] or 0) <= SENT_VALUES else "merge"
    flat = blocks.select(*by, "cells", "f", "first")
    for _ in range(rounds):
        worst = state.agg(F.max("worst")).first()[0]
        if worst is None or worst <= tolerance:
            break
        parts = settle(flat.join(state.select(*by, "cell_id", "d").hint(hint), by).mapInPandas(product, part))
        after = settle(state.groupBy(*by).cogroup(parts.groupBy(*by)).applyInPandas(step, schema))
        release(parts, state)
        state = after
    else:
        raise RuntimeError(f"attenuation field not within {tolerance} dB of its optimum after {rounds} rounds")
    release(blocks)
    dot = F.aggregate(F.zip_with("total", "w", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    bias = (F.col("mean") - dot / F.col("n")).alias("intercept_db")
    out = state.select(*by, bias, F.explode(F.arrays_zip("cell_id", "w")).alias("_c"))
    return out.select(*by, F.col("_c.cell_id").alias("cell_id"), F.col("_c.w").alias("attenuation_db"), "intercept_db")


def field_correction(segments: DataFrame, field: DataFrame, by: Sequence[str]) -> DataFrame:
    """Intercept plus the weighted attenuation of the traversed cells; unsupported cells add nothing."""
    from gridwright.functions.quantiles import attach
    bias = field.groupBy(*by).agg(F.max("intercept_db").alias("_b"))
    along = segments.join(field.select(*by, "cell_id", "attenuation_db"), [*by, "cell_id"], "left").groupBy(*by, "point_id").agg(
        F.sum(F.col("frac") * F.coalesce("attenuation_db", F.lit(0.0))).alias("_w"))
    return attach(along, bias, by).select(*by, "point_id", (F.col("_b") + F.col("_w")).alias("correction_db"))
