"""Height rasters as sparse cell tables: (row, col, …), row 0 in the north, absent row = no data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from gridwright.functions.columns import clip, plan_to_grid, reasons
from gridwright.functions.quantiles import attach, exact_quantiles
from gridwright.operators.score import _with, argmin


def mesh_stats(vertices: DataFrame, faces: DataFrame | None = None, tokens: str = "tokens") -> DataFrame:
    """Vertex count and bounds; triangles = sum of max(0, tokens - 3) over face lines."""
    out = vertices.agg(F.count(F.lit(1)).alias("vertex_count"), *[
        f(c).alias(f"{n}_{c}") for c in ("x", "y", "z") for n, f in (("min", F.min), ("max", F.max))])
    if faces is None:
        return out
    tri = faces.agg(F.coalesce(F.sum(F.greatest(F.lit(0), F.col(tokens) - 3)), F.lit(0)).alias("triangle_count"))
    return out.crossJoin(F.broadcast(tri))  # one row each


def with_grid_cell(vertices: DataFrame, res: float) -> DataFrame:
    """Add row, col and the grid shape; indices are clamped to the grid."""
    b = vertices.agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1"))
    v = vertices.crossJoin(F.broadcast(b))  # one row
    cols = F.greatest(F.lit(1), F.ceil((F.col("_x1") - F.col("_x0")) / res))
    rows = F.greatest(F.lit(1), F.ceil((F.col("_y1") - F.col("_y0")) / res))
    return v.withColumns({
        "col": F.least(cols - 1, F.floor((F.col("x") - F.col("_x0")) / res)).cast("bigint"),
        "row": F.least(rows - 1, F.floor((F.col("_y1") - F.col("y")) / res)).cast("bigint"),
    }).drop("_x0", "_x1", "_y0", "_y1")


def grid_shape(vertices: DataFrame, res: float) -> tuple[int, int]:
    b = vertices.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    import math
    return max(1, math.ceil((b[3] - b[2]) / res)), max(1, math.ceil((b[1] - b[0]) / res))


def rasterize_height(vertices: DataFrame, res: float, z_bin: float) -> DataFrame:
    """(row, col, dtm, rep, dsm): lowest, lower-median binned, and highest z per cell.

    Vertices are counted per (cell, height bin) first, so a cell's median sees its occupied bins only.
    """
    if res <= 0 or z_bin <= 0:
        raise ValueError("raster resolution and height bin must be positive")
    binned = with_grid_cell(vertices, res).withColumn("_b", F.floor(F.col("z") / z_bin) * z_bin)
    counted = binned.groupBy("row", "col", "_b").agg(
        F.count(F.lit(1)).alias("_n"), F.min("z").alias("_lo"), F.max("z").alias("_hi"))
    cells = counted.groupBy("row", "col").agg(
        F.min("_lo").alias("dtm"), F.max("_hi").alias("dsm"), F.sum("_n").alias("_total"),
        F.sort_array(F.collect_list(F.struct("_b", "_n"))).alias("_bins"))  # occupied height bins: the z range / bin
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("double").alias("at"))
    pick = F.aggregate("_bins", start, lambda acc, b: F.struct(
        (acc["seen"] + b["_n"]).alias("seen"),
        F.when(acc["at"].isNotNull(), acc["at"]).when(acc["seen"] + b["_n"] > F.floor((F.col("_total") - 1) / 2), b["_b"]).cast("double").alias("at")))
    return cells.select("row", "col", "dtm", pick["at"].alias("rep"), "dsm")


def raster_lookup(points: DataFrame, raster: DataFrame, rows: int, cols: int, grid_col: Column, grid_row: Column) -> DataFrame:
    """Round half-even to a cell, flag whether it lies inside the grid, and left-join the raster."""
    p = points.withColumn("col", F.rint(grid_col).cast("bigint")).withColumn("row", F.rint(grid_row).cast("bigint"))
    inside = (F.col("col") >= 0) & (F.col("col") < cols) & (F.col("row") >= 0) & (F.col("row") < rows)
    return p.withColumn("inside", inside).join(raster, ["row", "col"], "left")


def zone_heights(cells: DataFrame, zone: str = "zone", low: float = 3.0, high: float = 80.0, min_ground: int = 50,
                 min_coverage: float = 0.30, spread_limit: float = 8.0) -> DataFrame:
    """Per zone: ring ground (p20), fitted roof height (p65), spread p90-p10, coverage, reasons.

    ``cells(zone, row, col, dsm, interior)``; interior cells without dsm count towards the coverage only.
    """
    ring = cells.filter(~F.col("interior"))
    ground = exact_quantiles(ring, [zone], "dsm", [0.2], ["ground_z"])
    sizes = cells.groupBy(zone).agg(
        F.count_if(F.col("interior")).alias("interior_cells"), F.count(F.when(~F.col("interior"), F.col("dsm"))).alias("ground_cells"))
    rel = attach(cells.filter("interior"), ground, [zone]).withColumn("height", F.col("dsm") - F.col("ground_z"))
    good = rel.filter((F.col("height") >= low) & (F.col("height") <= high))
    q = exact_quantiles(good, [zone], "height", [0.1, 0.65, 0.9], ["_p10", "fitted_height", "_p90"])
    n = good.groupBy(zone).agg(F.count(F.lit(1)).alias("roof_cells"))
    peaks = roof_levels(rel, zone, low=low, high=high)
    t = _with(_with(_with(_with(sizes, ground, [zone]), q, [zone]), n, [zone]), peaks, [zone])
    t = t.withColumn("roof_cells", F.coalesce("roof_cells", F.lit(0))).withColumn(
        "coverage", F.when(F.col("interior_cells") > 0, F.col("roof_cells") / F.col("interior_cells")).otherwise(0.0)).withColumn(
        "spread", F.col("_p90") - F.col("_p10")).withColumn("levels", F.coalesce("levels", F.array().cast("array<double>")))
    return t.withColumn("reasons", reasons(
        (F.col("ground_cells") < min_ground, "LOCAL_GROUND_COVERAGE_LOW"), (F.col("coverage") < min_coverage, "ROOF_COVERAGE_LOW"),
        (F.col("fitted_height").isNull(), "NO_PLAUSIBLE_ROOF_HEIGHT"),
        (F.col("spread").isNotNull() & ((F.col("spread") > spread_limit) | (F.size("levels") > 1)), "MULTI_LEVEL_ROOF"))).drop("_p10", "_p90")


def roof_levels(cells: DataFrame, zone: str = "zone", height: str = "height", low: float = 3.0, high: float = 80.0,
                min_fraction: float = 0.025, separation: float = 3.0, max_levels: int = 5, min_cells: int = 20) -> DataFrame:
    """(zone, levels): peaks of the smoothed 1 m height histogram, thinned greedily by support.

    The 78 bins start at 2.5 m whatever the limits are.
    """
    h = F.col(height)
    bins = cells.filter((h >= low) & (h <= high)).select(zone, F.floor(h - 2.5).cast("int").alias("_b")).groupBy(zone, "_b").agg(
        F.count(F.lit(1)).alias("_n"))
    hist = bins.groupBy(zone).agg(  # at most 78 bins a zone
        F.sum("_n").alias("_total"), F.map_from_entries(F.collect_list(F.struct("_b", "_n"))).alias("_h")).filter(F.col("_total") >= min_cells)
    at = lambda i: F.coalesce(F.element_at("_h", i), F.lit(0)).cast("double")
    smooth = F.transform(F.sequence(F.lit(0), F.lit(77)), lambda i: 0.25 * at(i - 1) + 0.5 * at(i) + 0.25 * at(i + 1))
    hist = hist.withColumn("_s", smooth).withColumn("_need", F.greatest(F.lit(20.0), F.col("_total") * min_fraction))
    s = lambda i: F.element_at("_s", i + 1)
    peak = F.filter(F.sequence(F.lit(1), F.lit(76)), lambda i: (s(i) >= F.col("_need")) & (s(i) >= s(i - 1)) & (s(i) >= s(i + 1)))
    ranked = F.reverse(F.array_sort(F.transform(peak, lambda i: F.struct(s(i).alias("support"), (i + 3.0).alias("at")))))
    chosen = F.aggregate(ranked, F.array().cast("array<double>"), lambda acc, c: F.when(
        F.exists(acc, lambda a: F.abs(a - c["at"]) < separation), acc).otherwise(F.concat(acc, F.array(c["at"]))))
    return hist.select(zone, F.slice(F.array_sort(chosen), 1, max_levels).alias("levels"))


def height_fallback(zones: DataFrame, area: str = "area_m2", fitted: str = "fitted_height", default: float = 16.0) -> DataFrame:
    """Zones without a fit take the mean of an area-class guess and the median fitted height."""
    median = exact_quantiles(zones, [], fitted, [0.5], ["campus_median"])
    t = zones.crossJoin(F.broadcast(median)) if not median.isEmpty() else zones.withColumn("campus_median", F.lit(None).cast("double"))
    m = F.coalesce("campus_median", F.lit(default))
    # Area classes in square metres and their height guesses.
    guess = F.when(F.col(area) >= 8000, 24.0).when(F.col(area) >= 3000, 20.0).when(F.col(area) >= 1000, 16.0).otherwise(10.0)
    return t.withColumn("height_m", F.coalesce(fitted, (guess + m) / 2.0)).withColumn(
        "height_source", F.when(F.col(fitted).isNull(), "automatic_area_class_fallback").otherwise("lidar_local_ground_and_roof_modes"))


def stretch(cells: DataFrame, value: str = "rep") -> DataFrame:
    """Add ``preview``: 1..255 between the 1st and 99th percentile of the occupied cells."""
    q = exact_quantiles(cells, [], value, [0.01, 0.99], ["_lo", "_hi"])
    t = cells.crossJoin(F.broadcast(q))  # one row
    high = F.greatest(F.col("_hi"), F.col("_lo") + 1.0)
    return t.withColumn("preview", F.rint(clip((F.col(value) - F.col("_lo")) / (high - F.col("_lo")), 0.0, 1.0) * 254.0 + 1.0)).drop("_lo", "_hi")


def gradient(cells: DataFrame, rows: int, cols: int, value: str = "preview") -> DataFrame:
    """(row, col, magnitude): central differences, one-sided on the border, absent cells count as 0.

    Every occupied cell adds its weighted value to the cells whose difference it enters; no neighbour join.
    """
    def weights(axis: str, n: int):
        t = lambda d: F.col(axis) + d
        edge = lambda p: (p == 0) | (p == n - 1)
        inside = lambda p: (p >= 0) & (p < n)
        own = F.when(F.col(axis) == 0, -1.0).when(F.col(axis) == n - 1, 1.0).otherwise(0.0)
        # the target one step back sees this cell in front of it, the target one step ahead behind it
        back = F.when(inside(t(-1)), F.when(t(-1) == 0, 1.0).when(t(-1) == n - 1, 0.0).otherwise(0.5)).otherwise(0.0)
        ahead = F.when(inside(t(1)), F.when(t(1) == n - 1, -1.0).when(t(1) == 0, 0.0).otherwise(-0.5)).otherwise(0.0)
        return own, back, ahead

    parts = []
    for axis, n, name in (("col", cols, "gx"), ("row", rows, "gy")):
        own, back, ahead = (w if n > 1 else F.lit(0.0) for w in weights(axis, n))
        for step, w in ((0, own), (-1, back), (1, ahead)):
            r = F.col("row") + (step if axis == "row" else 0)
            c = F.col("col") + (step if axis == "col" else 0)
            v = w * F.col(value)
            parts.append(F.struct(r.alias("row"), c.alias("col"), (v if name == "gx" else F.lit(0.0)).alias("gx"),
                                  (v if name == "gy" else F.lit(0.0)).alias("gy")))
    spread = cells.select(F.explode(F.array(*parts)).alias("_p")).select("_p.*").filter("gx <> 0 or gy <> 0")
    g = spread.groupBy("row", "col").agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy"))
    return g.select("row", "col", F.hypot("gx", "gy").alias("magnitude"))


def height_edges(cells: DataFrame, rows: int, cols: int, value: str = "rep") -> DataFrame:
    """Cells whose gradient magnitude reaches the 75th percentile of the positive magnitudes."""
    from gridwright.session import settle
    g = settle(gradient(stretch(cells, value), rows, cols).filter("magnitude > 0"))
    q = exact_quantiles(g, [], "magnitude", [0.75], ["_t"])
    return g.crossJoin(F.broadcast(q)).filter(F.col("magnitude") >= F.col("_t")).select("row", "col", "magnitude")  # one row


# --- plan registration ----------------------------------------------------------------------------

def candidate_grid(spark, rotations: Sequence[float], scales: Sequence[float], shifts: Sequence[float],
                   centre: dict | None = None) -> DataFrame:
    """Similarity candidates in search order; ``centre`` makes the axes offsets around a found transform."""
    nr, ns, nt = len(rotations), len(scales), len(shifts)
    base = centre or {"rotation": 0.0, "scale": 0.0, "dcol": 0.0, "drow": 0.0}
    pick = lambda values, index: F.element_at(F.array(*[F.lit(float(v)) for v in values]), index.cast("int") + 1)
    i = F.col("id")
    return spark.range(nr * ns * nt * nt).select(
        i.alias("candidate"),
        (F.lit(base["rotation"]) + pick(rotations, F.floor(i / (ns * nt * nt)))).alias("rotation"),
        (F.lit(base["scale"]) + pick(scales, F.floor(i / (nt * nt)) % ns)).alias("scale"),
        (F.lit(base["dcol"]) + pick(shifts, F.floor(i / nt) % nt)).alias("dcol"),
        (F.lit(base["drow"]) + pick(shifts, i % nt)).alias("drow"))


def alignment_scores(candidates: DataFrame, boundary: DataFrame, distance: DataFrame, rows: int, cols: int) -> DataFrame:
    """(candidate, score, coverage, p80) of mapping the boundary samples onto a distance raster.

    The product candidates x samples is the search itself; it is reduced to (candidate, distance) counts
    on its way.  The candidate list has a fixed size, so it is the broadcast side.
    """
    pairs = boundary.select("x", "y").crossJoin(F.broadcast(candidates))
    gc, gr = plan_to_grid(F.col("x"), F.col("y"), F.col("rotation"), F.col("scale"), F.col("dcol"), F.col("drow"), rows, cols)
    hits = pairs.select("candidate", F.rint(gc).cast("bigint").alias("col"), F.rint(gr).cast("bigint").alias("row"))
    inside = (F.col("col") >= 0) & (F.col("col") < cols) & (F.col("row") >= 0) & (F.col("row") < rows)
    from gridwright.session import settle
    hits = settle(hits.withColumn("inside", inside).join(distance.select("row", "col", F.col("distance").alias("_d")), ["row", "col"], "left"))
    cov = hits.groupBy("candidate").agg(F.avg(F.col("inside").cast("double")).alias("coverage"))
    q = exact_quantiles(hits.filter("inside"), ["candidate"], "_d", [0.5, 0.8], ["median", "p80"])
    t = _with(cov, q, ["candidate"])
    poor = F.col("coverage") < 0.85
    return t.select("candidate", F.when(poor, 1e6).otherwise(F.col("median") + 0.35 * F.col("p80") + 20.0 * (1.0 - F.col("coverage"))).alias("score"),
                    "coverage", F.when(poor, 1e6).otherwise(F.col("p80")).alias("p80"))


def best_candidate(scores: DataFrame) -> DataFrame:
    return argmin(scores, [], ["score", "candidate"], ["score", "candidate", "coverage", "p80"])


def register_plan(boundary: DataFrame, distance: DataFrame, rows: int, cols: int, nominal_scale: float,
                  coarse: tuple[Sequence[float], Sequence[float], Sequence[float]],
                  fine: tuple[Sequence[float], Sequence[float], Sequence[float]]) -> dict:
    """Two-stage search; the second stage is centred on the first one's winner.  One row reaches the driver."""
    spark = boundary.sparkSession
    first = candidate_grid(spark, coarse[0], [nominal_scale * s for s in coarse[1]], coarse[2])
    won = alignment_scores(first, boundary, distance, rows, cols)
    top = best_candidate(won).join(first, "candidate").first().asDict()
    second = candidate_grid(spark, *fine, centre={k: top[k] for k in ("rotation", "scale", "dcol", "drow")})
    again = best_candidate(alignment_scores(second, boundary, distance, rows, cols)).join(second, "candidate").first().asDict()
    return again if again["score"] < top["score"] else top


# --- two-stage registration by branch and bound ------------------------------------------------------

SHIFT_BLOCK = 4  # shifts of a block, per axis
PROBES = 8  # blocks scored first, to have a score that others must beat
MIN_COVERAGE = 0.85

# The two grids of the search, as (rotations in degrees, scales, shifts in cells).  The first stage's
# scales are factors of the nominal one; the second stage's values are added to the first stage's winner.
COARSE = ([-8.0, -6.0, -4.0, -2.0, 0.0, 2.0, 4.0, 6.0, 8.0], [0.9, 0.925, 0.95, 0.975, 1.0, 1.025, 1.05, 1.075, 1.1],
          [-80, -70, -60, -50, -40, -30, -20, -10, 0, 10, 20, 30, 40, 50, 60, 70, 80])
FINE = ([-1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5], [-0.02, -0.015, -0.01, -0.005, 0.0, 0.005, 0.01, 0.015, 0.02], [-8, -6, -4, -2, 0, 2, 4, 6, 8])


def _axis(values: Sequence[float], name: str, inner: Column) -> Column:
    """One struct (ordinal, value) a row of an axis that starts at ``inner``."""
    return F.explode(F.array(*[F.struct(F.lit(i).alias("at"), (inner + F.lit(float(v))).alias("v")) for i, v in enumerate(values)])).alias(name)


def _placed_cells(samples: DataFrame, poses: DataFrame, by: list[str], rows: int, cols: int) -> DataFrame:
    """(by…, pose, row, col, n): samples that fall on a cell under a rotation and scale, before any shift.

    Shifts are even numbers of cells, so they keep half-even rounding, and all of them share these cells: a raster's
    worth of rows at most, however many samples there are.
    """
    gc, gr = plan_to_grid(F.col("x"), F.col("y"), F.col("rotation"), F.col("scale"), F.lit(0.0), F.lit(0.0), rows, cols)
    at = samples.select(*by, "x", "y").join(poses, by) if by else samples.select("x", "y").crossJoin(poses)  # at most 81 poses
    return at.groupBy(*by, "pose", F.rint(gr).cast("bigint").alias("row"), F.rint(gc).cast("bigint").alias("col")).agg(F.count(F.lit(1)).alias("n"))


def _ranked(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Running count of ``n`` by ``value`` inside the keys; ``values`` has one row a distinct value."""
    order = W.partitionBy(*keys).orderBy(value)  # distinct distances of a raster
    return values.withColumn("_upto", F.sum("n").over(order))


def _scores(cells: DataFrame, moves: DataFrame, distance: DataFrame, by: list[str], rows: int, cols: int) -> DataFrame:
    """Exact (score, coverage, p80) of each candidate in ``moves`` (by…, pose, candidate, dcol, drow)."""
    key = [*by, "candidate"]
    hits = cells.join(moves, [*by, "pose"]).select(*key, "n", (F.col("row") + F.col("drow")).alias("row"), (F.col("col") + F.col("dcol")).alias("col"))
    inside = F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)
    # the raster has every cell, so a hit without a distance lies outside
    counts = hits.join(distance.select("row", "col", F.col("distance").alias("_d")), ["row", "col"], "left").groupBy(*key, F.when(inside, F.col("_d")).alias("_d")).agg(
        F.sum("n").alias("n"))
    total = counts.groupBy(*key).agg(F.sum("n").alias("_all"), F.coalesce(F.sum(F.when(F.col("_d").isNotNull(), F.col("n"))), F.lit(0)).alias("_in"))
    line = _ranked(counts.filter(F.col("_d").isNotNull()), key, "_d").join(total, key)
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_d")))
    picks, made = [], {}
    for q, name in ((0.5, "median"), (0.8, "p80")):
        rank = F.lit(q) * (F.col("_in") - 1)
        picks += [at(F.floor(rank)).alias(f"{name}_a"), at(F.ceil(rank)).alias(f"{name}_b"), F.max(rank - F.floor(rank)).alias(f"{name}_f")]
        made[name] = F.col(f"{name}_a") + (F.col(f"{name}_b") - F.col(f"{name}_a")) * F.col(f"{name}_f")
    cover = (F.col("_in") / F.col("_all")).alias("coverage")
    t = total.select(*key, cover).join(line.groupBy(*key).agg(*picks).withColumns(made), key, "left")
    poor = F.col("coverage") < MIN_COVERAGE
    return t.select(*key, F.when(poor, 1e6).otherwise(F.col("median") + 0.35 * F.col("p80") + 20.0 * (1.0 - F.col("coverage"))).alias("score"),
                    "coverage", F.when(poor, 1e6).otherwise(F.col("p80")).alias("p80"))


def _bounds_of_blocks(cells: DataFrame, blocks: DataFrame, distance: DataFrame, by: list[str], rows: int, cols: int) -> DataFrame:
    """(by…, block, bound): no candidate of a block of shifts scores less.

    A distance changes by no more than the way moved, so a sample's distance at the block's centre, less its radius, bounds its
    distance under every shift of the block; samples that cannot reach the raster cost coverage.  A candidate with
    enough coverage has at least ``MIN_COVERAGE`` of the samples inside, so its quantiles are no less than those of
    that many smallest bounds.
    """
    key = [*by, "block"]
    hits = cells.join(blocks, [*by, "pose"]).select(
        *key, "n", "radius", "reach", (F.col("row") + F.col("mid_row")).alias("row"), (F.col("col") + F.col("mid_col")).alias("col"))
    near = F.col("row").between(-F.col("reach"), rows - 1 + F.col("reach")) & F.col("col").between(-F.col("reach"), cols - 1 + F.col("reach"))
    hits = hits.join(distance.select("row", "col", F.col("distance").alias("_d")), ["row", "col"], "left")
    least = F.when(near, F.greatest(F.lit(0.0), F.coalesce(F.col("_d"), F.lit(0.0)) - F.col("radius")))
    counts = hits.groupBy(*key, least.alias("_l")).agg(F.sum("n").alias("n"))
    total = counts.groupBy(*key).agg(F.sum("n").alias("_all"), F.coalesce(F.sum(F.when(F.col("_l").isNotNull(), F.col("n"))), F.lit(0)).alias("_may"))
    line = _ranked(counts.filter(F.col("_l").isNotNull()), key, "_l").join(total, key)
    fewest = F.ceil(F.lit(MIN_COVERAGE) * F.col("_all") - 1e-6) - 1
    at = lambda q: F.min(F.when(F.col("_upto") > F.floor(F.lit(q) * fewest), F.col("_l")))
    low = line.groupBy(*key).agg(at(0.5).alias("_m"), at(0.8).alias("_p"))
    share = F.col("_may") / F.col("_all")
    return total.join(low, key, "left").select(*key, F.when(share < MIN_COVERAGE, 1e6).otherwise(
        F.coalesce(F.col("_m") + 0.35 * F.col("_p"), F.lit(0.0)) + 20.0 * (1.0 - share) - 1e-9).alias("bound"))


def search_stage(samples: DataFrame, distance: DataFrame, rows: int, cols: int, centre: DataFrame, axes: tuple, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The first best candidate of a stage for every key, and how many candidates were scored.

    ``centre`` (by…, rotation, scale, dcol, drow) is one row a key to which the axes' values are added; ``samples``
    (by…, x, y) are boundary points and ``distance`` a whole raster.  Returns (by…, candidate, score, coverage, p80, rotation,
    scale, dcol, drow) and (by…, candidates, scored).  Blocks of neighbouring shifts are bounded first; the ``PROBES`` lowest
    are scored, and of the rest only those whose bound does not exceed the best score, so the result is the first minimum
    over all candidates.  Candidates are numbered rotation by rotation, then scale, column and row shift.
    """
    from gridwright.session import settle
    by = list(by)
    rotations, scales, shifts = axes
    if any(float(v) % 2 for v in shifts):
        raise ValueError("shifts must be even numbers of cells")
    nt, blocks_a_side = len(shifts), -(-len(shifts) // SHIFT_BLOCK)
    turned = centre.select(*by, "scale", "dcol", "drow", _axis(rotations, "_r", F.col("rotation")))
    poses = settle(turned.select(*by, "dcol", "drow", "_r", _axis(scales, "_s", F.col("scale"))).select(
        *by, (F.col("_r.at") * len(scales) + F.col("_s.at")).cast("long").alias("pose"), F.col("_r.v").alias("rotation"), F.col("_s.v").alias("scale"), "dcol", "drow"))
    cells = settle(_placed_cells(samples, poses.select(*by, "pose", "rotation", "scale"), by, rows, cols))
    one = poses.select(*by, "pose", "rotation", "scale", "drow", _axis(shifts, "_c", F.col("dcol")))
    every = one.select(*by, "pose", "rotation", "scale", "_c", _axis(shifts, "_w", F.col("drow")))
    block = (F.col("pose") * blocks_a_side + F.floor(F.col("_c.at") / SHIFT_BLOCK)) * blocks_a_side + F.floor(F.col("_w.at") / SHIFT_BLOCK)
    every = settle(every.select(*by, "pose", block.cast("long").alias("block"), ((F.col("pose") * nt + F.col("_c.at")) * nt + F.col("_w.at")).alias("candidate"),
                                "rotation", "scale", F.col("_c.v").alias("dcol"), F.col("_w.v").alias("drow")))
    middle = lambda c: F.rint((F.min(c) + F.max(c)) / 2)
    blocks = every.groupBy(*by, "pose", "block").agg(
        middle("dcol").alias("mid_col"), middle("drow").alias("mid_row"), F.min("dcol").alias("_c0"), F.max("dcol").alias("_c1"), F.min("drow").alias("_r0"), F.max("drow").alias("_r1"))
    wide = F.greatest(F.col("_c1") - F.col("mid_col"), F.col("mid_col") - F.col("_c0"))
    high = F.greatest(F.col("_r1") - F.col("mid_row"), F.col("mid_row") - F.col("_r0"))
    blocks = blocks.withColumns({"radius": F.hypot(wide, high), "reach": F.greatest(wide, high)})
    bounds = settle(_bounds_of_blocks(cells, blocks, distance, by, rows, cols))
    order = W.partitionBy(*by).orderBy("bound", "block")  # blocks of one stage: a few thousand
    ranked = bounds.withColumn("_rn", F.row_number().over(order))
    moves = [*by, "pose", "candidate", "dcol", "drow"]
    tried = settle(_scores(cells, every.join(ranked.filter(F.col("_rn") <= PROBES), [*by, "block"]).select(*moves), distance, by, rows, cols))
    best = tried.groupBy(*by).agg(F.min("score").alias("_best"))
    rest = ranked.filter(F.col("_rn") > PROBES)
    rest = (rest.join(best, by) if by else rest.crossJoin(best)).filter(F.col("bound") <= F.col("_best"))  # one row a key
    scored = settle(tried.unionByName(_scores(cells, every.join(rest, [*by, "block"]).select(*moves), distance, by, rows, cols)))
    won = argmin(scored, by, ["score", "candidate"], ["score", "candidate", "coverage", "p80"])
    names = [*by, "candidate", "score", "coverage", "p80", "rotation", "scale", "dcol", "drow"]
    count = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("scored")).withColumn("candidates", F.lit(len(rotations) * len(scales) * nt * nt).cast("long"))
    return settle(won.join(every, [*by, "candidate"]).select(*names)), count


def register_plans(samples: DataFrame, distance: DataFrame, rows: int, cols: int, nominal_scale: float, by: Sequence[str] = (),
                   coarse: tuple = COARSE, fine: tuple = FINE) -> DataFrame:
    """Both stages for every key: (by…, stage, candidate, score, coverage, p80, rotation, scale, dcol, drow), the last stage that
    improved on the score; a key without samples has no row."""
    by = list(by)
    zero = samples.select(*by).distinct() if by else samples.limit(1).select()
    start = zero.select(*by, F.lit(0.0).alias("rotation"), F.lit(0.0).alias("scale"), F.lit(0.0).alias("dcol"), F.lit(0.0).alias("drow"))
    first, _ = search_stage(samples, distance, rows, cols, start, (coarse[0], [nominal_scale * s for s in coarse[1]], coarse[2]), by)
    second, _ = search_stage(samples, distance, rows, cols, first.select(*by, "rotation", "scale", "dcol", "drow"), fine, by)
    both = first.withColumn("stage", F.lit(1)).unionByName(second.withColumn("stage", F.lit(2)))
    return argmin(both, by, ["score", "stage"], ["stage", "candidate", "score", "coverage", "p80", "rotation", "scale", "dcol", "drow"])
