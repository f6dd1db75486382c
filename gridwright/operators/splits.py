"""Leakage-safe spatial splits and nested samples.

A split is rows ``(split_id, point_id, role)``; hundreds of them run as one job.  Randomness is a hash
of ids and a seed, so a split is the same on every run and engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from gridwright.functions.columns import cell_index, hash_u32
from gridwright.functions.quantiles import BROADCAST_ROWS, attach
from gridwright.functions.ranking import global_position
from gridwright.operators.knn import nearest_distance
from gridwright.operators.score import _with, argmin, distance_summary, wasserstein

Points = DataFrame


def with_cell(df: DataFrame, size: float, prefix: str = "c") -> DataFrame:
    return df.withColumn(f"{prefix}x", cell_index(F.col("x"), size)).withColumn(f"{prefix}y", cell_index(F.col("y"), size))


def md5_u32(*parts: Column) -> Column:
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_group_folds(groups: DataFrame, by: Sequence[str], group: str, k: int) -> DataFrame:
    """Distinct groups in SHA-256 order, dealt round-robin to ``k`` folds."""
    distinct = groups.select(*by, group).distinct().withColumn("_h", F.sha2(F.col(group).cast("string"), 256))
    placed = global_position(distinct, by, [F.col("_h"), F.col(group)], "_pos")
    return placed.select(*by, group, ((F.col("_pos") - 1) % k).cast("int").alias("fold"))


def stratified_round_robin(points: DataFrame, count: int, seed: int, block_m: float) -> DataFrame:
    """First ``count`` points in the order (rank inside block, block hash, point hash, id)."""
    rows = points.withColumn("spatial_block", F.concat_ws(
        ":", cell_index(F.col("x"), block_m).cast("string"), cell_index(F.col("y"), block_m).cast("string")))
    rows = rows.withColumn("_p", hash_u32(F.concat(F.lit(f"sample/{seed}/"), F.col("point_id").cast("string")))).withColumn(
        "_b", hash_u32(F.concat(F.lit(f"block/{seed}/"), F.col("spatial_block"))))
    rows = global_position(rows, ["spatial_block"], [F.col("_p"), F.col("point_id")], "within_block")
    placed = global_position(rows, [], [F.col(c) for c in ("within_block", "_b", "_p", "point_id")], "_at")
    return placed.filter(F.col("_at") <= count).drop("_p", "_b", "_at")


def places(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by…, x, y, _n, _place): every coordinate once with its number of rows and an id.

    What depends on the coordinate alone (cell, fold, nearest distance) is found once a place, however many rows share it.
    """
    from gridwright.session import settle
    # settled, because the ids are those of one layout
    return settle(points.groupBy(*by, "x", "y").agg(F.count(F.lit(1)).alias("_n")).withColumn("_place", F.monotonically_increasing_id()))


def balanced_cell_folds(points: DataFrame, by: Sequence[str], n_folds: int, cell: float, seed: Column | int, weight: str | None = None) -> DataFrame:
    """Whole cells to folds: cells by (-count, hash), dealt in serpentine order so that loads stay even.

    ``weight`` names a column with the number of points that a row stands for."""
    count = F.sum(weight) if weight else F.count(F.lit(1))
    cells = with_cell(points, cell).groupBy(*by, "cx", "cy").agg(count.alias("cell_n"))
    s = seed if isinstance(seed, Column) else F.lit(seed)
    cells = cells.withColumn("_h", md5_u32(s, F.col("cx"), F.col("cy")))
    placed = global_position(cells, by, [F.desc("cell_n"), F.col("_h"), F.col("cx"), F.col("cy")], "_pos")
    turn = (F.col("_pos") - 1) % (2 * n_folds)
    fold = F.when(turn < n_folds, turn).otherwise(2 * n_folds - 1 - turn).cast("int")
    return placed.select(*by, "cx", "cy", "cell_n", fold.alias("fold"))


def fold_points(points: DataFrame, folds: DataFrame, by: Sequence[str], cell: float) -> DataFrame:
    """The points with the fold of their cell; cells are counted, since Spark would take few bytes of many points for the small side."""
    from gridwright.session import settle
    cells = settle(folds.drop("cell_n"))
    few = cells.count() <= BROADCAST_ROWS
    return with_cell(points, cell).join(cells.hint("broadcast" if few else "merge"), [*by, "cx", "cy"]).drop("cx", "cy")


def inner_folds(train: DataFrame, by: Sequence[str], k: int, cell: float, seed: int) -> DataFrame:
    """Distinct train cells in hash order, modulo ``k``."""
    cells = with_cell(train, cell).select(*by, "cx", "cy").distinct().withColumn("_h", md5_u32(F.lit(seed), F.col("cx"), F.col("cy")))
    placed = global_position(cells, by, [F.col("_h"), F.col("cx"), F.col("cy")], "_pos")
    folds = placed.select(*by, "cx", "cy", ((F.col("_pos") - 1) % k).cast("int").alias("fold"))
    return with_cell(train, cell).join(folds, [*by, "cx", "cy"]).drop("cx", "cy")


def usable_folds(folded: DataFrame, by: Sequence[str], k: int, min_fit: int, min_valid: int) -> DataFrame:
    counts = folded.groupBy(*by, "fold").agg(F.count(F.lit(1)).alias("valid_n"))
    # k folds a group
    total = F.sum("valid_n").over(W.partitionBy(*by))
    return counts.withColumn("fit_n", total - F.col("valid_n")).filter(
        (F.col("fit_n") >= min_fit) & (F.col("valid_n") >= min_valid))


def mode_geometry(mode: str) -> tuple[float, float]:
    """(cell side, buffer) in metres of a spatial mode."""
    if mode == "infill":
        return 1.0, 0.0
    if mode in ("spatial30", "spatial60"):
        return 50.0, float(mode[len("spatial"):])
    raise ValueError(f"unknown spatial mode {mode!r}")


def outer_splits(points: DataFrame, by: Sequence[str], mode: str, outer_fold: int, n_folds: int, seed: int) -> DataFrame:
    """(by…, point_id, role, nearest_m): role test, pool or buffer; pool keeps its distance to the test set."""
    cell, buffer = mode_geometry(mode)
    folded = fold_points(points, balanced_cell_folds(points, by, n_folds, cell, seed), by, cell)
    test, rest = folded.filter(F.col("fold") == outer_fold), folded.filter(F.col("fold") != outer_fold)
    rest = rest.select(*by, "point_id", "x", "y")
    near = nearest_distance(rest, test, by).withColumnRenamed("query_id", "point_id")
    role = F.when(F.col("nearest_m").isNull() | (F.col("nearest_m") >= buffer), "pool").otherwise("buffer")
    kept = rest.join(near, [*by, "point_id"], "left").select(*by, "point_id", role.alias("role"), "nearest_m")
    return test.select(*by, "point_id", F.lit("test").alias("role"), F.lit(None).cast("double").alias("nearest_m")).unionByName(kept)


def split_lattice(points: DataFrame, by: Sequence[str], modes: Sequence[str], n_folds: int, seed: int) -> DataFrame:
    """(by…, mode, outer_fold, point_id, role, nearest_m): :func:`outer_splits` of every mode and fold.

    Modes of one cell size share their folds, and all folds of all sizes share one neighbour job, which asks once for
    each coordinate; the points meet their coordinate before they are repeated per mode and fold.
    """
    from gridwright.session import settle
    by = list(by)
    geometry = {m: mode_geometry(m) for m in modes}
    at = places(points, by)
    rows = None
    for cell in sorted({c for c, _ in geometry.values()}):
        folded = fold_points(at, balanced_cell_folds(at, by, n_folds, cell, seed, "_n"), by, cell)
        part = folded.select(*by, "_place", "x", "y", F.col("fold").alias("_own"), F.lit(float(cell)).alias("_cell"))
        rows = part if rows is None else rows.unionByName(part)
    many = settle(rows).withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    keys = [*by, "_cell", "outer_fold"]
    is_test = F.col("_own") == F.col("outer_fold")
    near = nearest_distance(many.filter(~is_test), many.filter(is_test), keys, query_id="_place", train_id="_place").withColumnRenamed("query_id", "_place")
    # a place has one entry for each cell size and fold
    entry = F.struct("_cell", "outer_fold", is_test.alias("test"), "nearest_m")
    listed = many.join(near, [*keys, "_place"], "left").groupBy(*by, "_place", "x", "y").agg(F.collect_list(entry).alias("_e")).drop("_place")
    placed = points.select(*by, "point_id", "x", "y").join(listed, [*by, "x", "y"]).select(*by, "point_id", F.explode("_e").alias("_e"))
    sizes = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(float(c)).alias("cell"), F.lit(float(b)).alias("buffer")) for m, (c, b) in geometry.items()])
    placed = placed.withColumn("_m", F.explode(F.filter(sizes, lambda m: m["cell"] == F.col("_e._cell"))))
    nearest = F.col("_e.nearest_m")
    role = F.when(F.col("_e.test"), "test").when(nearest.isNull() | (nearest >= F.col("_m.buffer")), "pool").otherwise("buffer")
    return placed.select(*by, "_m.mode", "_e.outer_fold", "point_id", role.alias("role"), "_e.nearest_m")


def buffered_folds(folded: DataFrame, by: Sequence[str], buffer: float, folds: int, carry: Sequence[str] = ()) -> DataFrame:
    """Each fold in turn is valid; the others are fit when ``buffer`` metres away from it.

    (by…, fold, point_id, carry…, role); one neighbour job over all folds.
    """
    rows = folded.withColumn("_own", F.col("fold")).drop("fold").withColumn(
        "fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    valid = rows.filter(F.col("_own") == F.col("fold"))
    other = rows.filter(F.col("_own") != F.col("fold")).select(*by, "fold", "point_id", *dict.fromkeys(["x", "y", *carry]))
    if buffer > 0:
        near = nearest_distance(other, valid, [*by, "fold"]).withColumnRenamed("query_id", "point_id")
        other = other.join(near.filter(F.col("nearest_m") >= buffer).select(*by, "fold", "point_id"), [*by, "fold", "point_id"], "left_semi")
    return valid.select(*by, "fold", "point_id", *carry, F.lit("valid").alias("role")).unionByName(
        other.select(*by, "fold", "point_id", *carry, F.lit("fit").alias("role")))


def matched_designs(train: DataFrame, query: DataFrame, by: Sequence[str], mode: str, seed: int, candidates: int = 8, folds: int = 3) -> tuple[DataFrame, DataFrame]:
    """Candidate partitions scored by how well their fit-to-valid distances resemble train-to-query ones.

    Returns (audit: by…, candidate, feasible, mismatch, wasserstein_m), (members: by…, candidate, fold,
    point_id, role).  The matched candidate minimises (mismatch, candidate); the fixed one is number 0.
    """
    from gridwright.session import settle
    cell, buffer = mode_geometry(mode)
    by = list(by)
    keys = [*by, "candidate"]
    at = places(train, by)
    many = at.withColumnRenamed("_place", "point_id").withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))))
    many = many.withColumn("_seed", hash_u32(F.concat_ws("|", F.lit(str(seed)), F.lit("inner"), F.col("candidate").cast("string"))))
    cells = balanced_cell_folds(many, [*keys, "_seed"], folds, cell, F.col("_seed"), "_n")
    folded = fold_points(many, cells, [*keys, "_seed"], cell).drop("_seed")
    located = settle(buffered_folds(folded, keys, buffer, folds, ["x", "y", "_n"]))
    weight = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.col("_n"))), F.lit(0))
    sizes = located.groupBy(*keys, "fold").agg(weight("fit").alias("f"), weight("valid").alias("v"))
    feasible = sizes.groupBy(*keys).agg((F.count_if((F.col("f") >= 8) & (F.col("v") >= 3)) == folds).alias("feasible"))
    inner = nearest_distance(located.filter("role = 'valid'"), located.filter("role = 'fit'"), [*keys, "fold"])
    # one row a point again: quantiles and the distance of the distributions count points
    weights = at.select(*by, F.col("_place").alias("query_id"), "_n")
    inner = inner.join(weights if at.count() <= BROADCAST_ROWS else weights.hint("merge"), [*by, "query_id"])
    inner = settle(inner.select(*keys, "nearest_m", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("col"))
    members = train.select(*by, "point_id", "x", "y").join(at.drop("_n"), [*by, "x", "y"]).select(*by, "point_id", "_place").join(
        located.select(*keys, "fold", F.col("point_id").alias("_place"), "role"), [*by, "_place"]).select(*keys, "fold", "point_id", "role")
    target = settle(nearest_distance(query, train, by))
    si, st = distance_summary(inner, keys), distance_summary(target, by)
    names = ["q10", "q25", "q50", "q75", "q90"]
    st = st.select(*by, *[F.col(c).alias(f"t_{c}") for c in names])
    both = attach(si, st, by) if by else si.crossJoin(F.broadcast(st))  # one row a side
    gap = sum((F.abs(F.col(c) - F.col(f"t_{c}")) for c in names), F.lit(0.0)) / len(names)
    mism = both.select(*keys, gap.alias("mismatch"))
    sides = inner.withColumn("side", F.lit("inner")).unionByName(
        target.withColumn("candidate", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1)))).select(*keys, "nearest_m").withColumn("side", F.lit("target")))
    emd = wasserstein(sides, keys, "side", "inner", "target", "nearest_m")
    audit = _with(_with(feasible, mism, keys), emd, keys)
    return audit, members


def pick_design(audit: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by…, scheme, candidate, feasible) for FIXED and MATCHED."""
    fixed = audit.filter("candidate = 0").select(*by, F.lit("FIXED").alias("scheme"), "candidate", "feasible")
    best = argmin(audit.filter("feasible"), by, ["mismatch", "candidate"], ["candidate"])
    return fixed.unionByName(best.select(*by, F.lit("MATCHED").alias("scheme"), "candidate", F.lit(True).alias("feasible")))


def spatial_order(points: DataFrame, by: Sequence[str], seed: int, cell: float = 10.0, levels: int = 8) -> DataFrame:
    """Label-blind coarse-to-fine order, nested by construction: (by…, point_id, position).

    The smallest-hash cell of every block of side cell·2^level gets that level; cells are visited by
    (level descending, hash), one point each, then round-robin through the points of each cell.
    """
    rows = with_cell(points, cell).select(*by, "point_id", "cx", "cy")
    cells = rows.select(*by, "cx", "cy").distinct().withColumn("_h", md5_u32(F.lit(seed), F.col("cx"), F.col("cy")))
    key = F.struct("_h", "cx", "cy")
    ranked = cells.withColumn("_level", F.lit(0))
    # winners of level l are winners at every finer level, so each level only looks at the last winners
    winners = cells
    for level in range(1, levels + 1):
        bx, by_ = F.shiftright("cx", level), F.shiftright("cy", level)
        winners = winners.groupBy(*by, bx.alias("_bx"), by_.alias("_by")).agg(F.min(key).alias("_w")).select(*by, "_w._h", "_w.cx", "_w.cy")
        mark = winners.select(*by, "cx", "cy", F.lit(level).alias("_new"))
        ranked = ranked.join(mark, [*by, "cx", "cy"], "left").withColumn("_level", F.coalesce("_new", "_level")).drop("_new")
    rows = rows.join(ranked, [*by, "cx", "cy"])
    rows = rows.withColumn("_p", md5_u32(F.lit(seed), F.lit("point"), F.col("point_id")))
    turn = global_position(rows, [*by, "cx", "cy"], [F.col("_p"), F.col("point_id")], "_turn")
    order = [F.col("_turn"), F.desc("_level"), F.col("_h"), F.col("cx"), F.col("cy")]
    return global_position(turn, by, order, "position").select(*by, "point_id", "position")


def nested_prefixes(order: DataFrame, by: Sequence[str], budgets: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """(members: by…, budget, point_id), (status: by…, budget, pool_n, status); a budget is never shrunk."""
    grid = F.explode(F.array(*[F.lit(int(b)) for b in budgets]))
    status = order.groupBy(*by).agg(F.count(F.lit(1)).alias("pool_n")).withColumn("budget", grid).withColumn(
        "status", F.when(F.col("pool_n") >= F.col("budget"), "COMPLETE").otherwise("INSUFFICIENT"))
    feasible = status.filter("status = 'COMPLETE'").select(*by, "budget")
    wide = order.filter(F.col("position") <= max(budgets)).withColumn("budget", grid).filter(F.col("position") <= F.col("budget"))
    return wide.join(feasible, [*by, "budget"], "left_semi").select(*by, "budget", "point_id", "position"), status


def allocate_budget(counts: DataFrame, by: Sequence[str], total: int, band: str = "band", n: str = "n", minimum: int = 4) -> DataFrame:
    """Largest-remainder shares of ``total`` over bands (ties by name); from total 8 on each of the two
    bands gets at least ``minimum``, taken from the other."""
    per = W.partitionBy(*by)
    share = F.lit(float(total)) * F.col(n) / F.sum(n).over(per)
    t = counts.withColumn("_raw", share).withColumn("_base", F.floor("_raw").cast("bigint"))
    t = t.withColumn("_left", F.lit(total) - F.sum("_base").over(per)).withColumn(
        "_rn", F.row_number().over(per.orderBy(F.desc(F.col("_raw") - F.col("_base")), band)))  # a handful of bands
    t = t.withColumn("allocated", F.col("_base") + (F.col("_rn") <= F.col("_left")).cast("bigint"))
    if total >= 2 * minimum:
        lowest = F.min("allocated").over(per)
        need = F.greatest(F.lit(minimum) - lowest, F.lit(0))
        t = t.withColumn("_need", need).withColumn("allocated", F.when(
            F.col("allocated") < minimum, F.lit(minimum).cast("bigint")).otherwise(F.col("allocated") - F.col("_need")))
    return t.select(*by, band, n, "allocated")


CANDIDATE_RUN = 1000


def band_balanced_folds(points: DataFrame, n_folds: int, candidates: int, seed: int) -> DataFrame:
    """Search hash-drawn group-to-fold assignments for even loads in both bands.

    Score of a candidate, smaller first: shortfall below max(2 % of the band, 100) squared, squared
    imbalance, largest load, candidate id.  Returns (trajectory_group, fold, candidate, shortfall).
    """
    counts = points.groupBy("trajectory_group").agg(
        F.count_if(F.col("band") == "n41").alias("a"), F.count_if(F.col("band") == "n79").alias("b"))
    total = counts.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.count(F.lit(1)).alias("groups"))
    def fold(candidate):
        return (md5_u32(F.lit(seed), candidate, F.col("trajectory_group")) % n_folds).cast("int")

    # a task draws a run of candidates for all groups and adds up their loads, so only candidates x folds sums move
    run = F.explode(F.sequence(F.lit(0), F.lit((candidates - 1) // CANDIDATE_RUN)))
    first = F.col("_run") * CANDIDATE_RUN
    drawn = counts.withColumn("_run", run).repartition("_run").select(
        "trajectory_group", "a", "b", F.explode(F.sequence(first, F.least(first + CANDIDATE_RUN - 1, F.lit(candidates - 1)))).alias("candidate"))
    loads = drawn.withColumn("fold", fold(F.col("candidate"))).groupBy("candidate", "fold").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    loads = loads.crossJoin(F.broadcast(total))  # one row
    def parts(v, t):
        least = F.greatest(F.col(t) * 0.02, F.lit(100.0))
        target = F.greatest(F.col(t) / n_folds, F.lit(1.0))
        short = F.greatest(least - F.col(v), F.lit(0.0)) / least
        return short * short, F.col(v) / target
    sa, na = parts("a", "ta")
    sb, nb = parts("b", "tb")
    score = loads.groupBy("candidate").agg(
        F.count(F.lit(1)).alias("used"), F.sum(sa + sb).alias("shortfall"),
        F.sum((na - 1.0) * (na - 1.0) + (nb - 1.0) * (nb - 1.0)).alias("imbalance"), F.max(F.greatest(na, nb)).alias("peak"))
    best = argmin(score.filter(F.col("used") == n_folds), [], ["shortfall", "imbalance", "peak", "candidate"], ["candidate", "shortfall"])
    chosen = counts.select("trajectory_group").crossJoin(F.broadcast(best))  # one row
    return chosen.select("trajectory_group", fold(F.col("candidate")).alias("fold"), "candidate", "shortfall")


def train_query_spec(train: DataFrame, query: DataFrame, by: Sequence[str], seed: int) -> DataFrame:
    """Per split: row counts, occupied 1 m groups, min / median train-to-query distance, seed."""
    near = nearest_distance(query, train, by)
    groups = with_cell(train, 1.0).select(*by, "cx", "cy").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("position_groups"))
    sizes = train.groupBy(*by).agg(F.count(F.lit(1)).alias("train_n"))
    from gridwright.functions.quantiles import exact_quantiles
    from gridwright.session import settle
    near = settle(near)
    q = near.groupBy(*by).agg(F.count(F.lit(1)).alias("test_n"), F.min("nearest_m").alias("minimum_m"))
    med = exact_quantiles(near, by, "nearest_m", [0.5], ["median_m"])
    out = _with(_with(_with(sizes, groups, by), q, by), med, by)
    return out.withColumn("seed", hash_u32(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in by], F.lit("fit"))))
