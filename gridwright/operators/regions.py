"""Neighbourhood operators on cell sets: morphology, components, distances, level regions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.functions.columns import reasons
from gridwright.functions.quantiles import attach
from gridwright.operators.knn import knn_join
from gridwright.operators.score import _with
from gridwright.session import settle

CROSS = [(-1, 0), (1, 0), (0, -1), (0, 1)]
EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]


def ellipse(radius: int) -> list[tuple[int, int]]:
    """Offsets of the digital disc: in row dy, |dx| up to round(sqrt(r² - dy²))."""
    out = []
    for dy in range(-radius, radius + 1):
        w = round(math.sqrt(radius * radius - dy * dy))
        out += [(dy, dx) for dx in range(-w, w + 1)]
    return out


def _shift(cells: DataFrame, by: Sequence[str], offsets, rows: int | None = None, cols: int | None = None) -> DataFrame:
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets])).alias("_o")
    out = cells.select(*by, "row", "col", steps).select(
        *by, (F.col("row") + F.col("_o.a")).alias("row"), (F.col("col") + F.col("_o.b")).alias("col"))
    if rows is not None:
        out = out.filter((F.col("row") >= 0) & (F.col("row") < rows) & (F.col("col") >= 0) & (F.col("col") < cols))
    return out.distinct()


def packed_cell(row: Column, col: Column, bits: int) -> Column:
    """row * 2^bits + col as one long; raises where the two would not come apart again."""
    fits = row.between(0, 2 ** (48 - bits) - 1) & col.between(0, 2**bits - 1)
    return F.when(fits, row.cast("bigint") * F.lit(2**bits) + col.cast("bigint")).otherwise(
        F.raise_error(F.concat(F.lit("cell outside the packed range: "), F.coalesce(row.cast("string"), F.lit("null")), F.lit(", "),
                               F.coalesce(col.cast("string"), F.lit("null")))).cast("bigint"))


def frontier(cells: DataFrame, by: Sequence[str], rows: int | None = None, cols: int | None = None) -> DataFrame:
    """Cells outside the set that touch it by an edge."""
    key = [*by, "row", "col"]
    return _shift(cells.select(*key), by, CROSS, rows, cols).join(cells.select(*key), key, "left_anti")


def inner_boundary(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cells of the set with at least one edge neighbour outside it."""
    key = [*by, "row", "col"]
    return _shift(frontier(cells, by), by, CROSS).join(cells.select(*key), key, "left_semi")


def dilate(cells: DataFrame, by: Sequence[str], radius: int, rows: int | None = None, cols: int | None = None) -> DataFrame:
    """Union of discs; only boundary cells are expanded, the interior is already in."""
    key = [*by, "row", "col"]
    grown = _shift(inner_boundary(cells, by), by, ellipse(radius), rows, cols)
    return grown.unionByName(cells.select(*key)).distinct()


def erode(cells: DataFrame, by: Sequence[str], radius: int, rows: int | None = None, cols: int | None = None,
          keep_when_empty: bool = False) -> DataFrame:
    """Cells whose whole disc lies in the set (outside the raster does not count against them).

    Equivalent and cheaper: remove what the discs of the outer frontier reach.
    """
    key = [*by, "row", "col"]
    gone = _shift(frontier(cells, by, rows, cols), by, ellipse(radius))
    out = cells.select(*key).join(gone, key, "left_anti")
    if keep_when_empty and by:
        lost = cells.select(*by).distinct().join(out.select(*by).distinct(), list(by), "left_anti")
        out = out.unionByName(cells.select(*key).join(lost, list(by), "left_semi"))
    return out


def zone_boundary(cells: DataFrame, by: Sequence[str], radius: int = 1) -> DataFrame:
    key = [*by, "row", "col"]
    return cells.select(*key).join(erode(cells, by, radius), key, "left_anti")


def components(cells: DataFrame, by: Sequence[str], tile: int = 256) -> DataFrame:
    """(by…, row, col, component): 8-connected components, named by their smallest row·2^31+col.

    A tile of the raster is labelled locally; the labels that touch across tile borders form a graph that
    is far smaller than the raster and is solved by min-label propagation with pointer jumping.
    """
    names, by = list(by), [f"_key{i}" for i in range(len(by))]
    # the keys get names of their own, so that no name of a caller's key can meet one of the steps below
    cells = cells.select(*[F.col(c).alias(k) for c, k in zip(names, by)], "row", "col")
    return _labelled(cells, by, tile).withColumnsRenamed(dict(zip(by, names)))


def _labelled(cells: DataFrame, by: list[str], tile: int) -> DataFrame:
    span = 2**31
    # row * span + col names a cell uniquely only while columns stay within half of the span
    within = lambda c, most: F.when(F.abs(c) < most, c).otherwise(F.raise_error(F.concat(F.lit("cell out of range: "), c.cast("string"))).cast("bigint"))
    rows = cells.select(*by, within(F.col("row").cast("bigint"), 2**31).alias("row"), within(F.col("col").cast("bigint"), 2**30).alias("col")).distinct()
    rows = rows.withColumn("_tr", F.floor(F.col("row") / tile)).withColumn("_tc", F.floor(F.col("col") / tile))
    schema = T.StructType([rows.schema[c] for c in (*by, "row", "col", "_tr", "_tc")] + [T.StructField("local", T.LongType())])

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        key = (pdf["row"].to_numpy() * span + pdf["col"].to_numpy()).astype("int64")
        order = np.argsort(key)
        keys = key[order]
        ends = []
        for a, b in ((0, 1), (1, -1), (1, 0), (1, 1)):
            at = np.searchsorted(keys, keys + a * span + b)
            ok = (at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == keys + a * span + b)
            ends.append((np.flatnonzero(ok), at[ok]))
        u, v = (np.concatenate(e) for e in zip(*ends))
        parent = np.arange(len(keys))
        while True:
            before = parent.copy()
            low = np.minimum(parent[u], parent[v])
            for side in (u, v):
                np.minimum.at(parent, before[side], low)
                np.minimum.at(parent, side, low)
            parent = parent[parent]
            if (parent == before).all():
                break
        out = pdf[[*by, "row", "col", "_tr", "_tc"]].iloc[order].copy()
        out["local"] = keys[parent]
        return out

    local = settle(rows.groupBy(*by, "_tr", "_tc").applyInPandas(label, schema))
    edge = local.filter((F.col("row") % tile).isin(0, tile - 1) | (F.col("col") % tile).isin(0, tile - 1))
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in EIGHT])).alias("_o")
    reach = edge.select(*by, "_tr", "_tc", "local", (F.col("row") + F.expr("0")).alias("_r"), F.col("col").alias("_c"), steps).select(
        *by, "_tr", "_tc", F.col("local").alias("a"), (F.col("_r") + F.col("_o.a")).alias("row"), (F.col("_c") + F.col("_o.b")).alias("col"))
    reach = reach.filter((F.floor(F.col("row") / tile) != F.col("_tr")) | (F.floor(F.col("col") / tile) != F.col("_tc"))).drop("_tr", "_tc")
    links = settle(reach.join(edge.select(*by, "row", "col", F.col("local").alias("b")), [*by, "row", "col"]).select(*by, "a", "b").distinct())
    names = links.select(*by, F.col("a").alias("node")).distinct().withColumn("label", F.col("node"))
    if not links.isEmpty():
        names = settle(names)
        while True:
            seen = links.join(names.select(*by, F.col("node").alias("b"), F.col("label").alias("_l")), [*by, "b"]).groupBy(
                *by, F.col("a").alias("node")).agg(F.min("_l").alias("_m"))
            low = names.join(seen, [*by, "node"]).select(*by, "node", "label", F.least("label", "_m").alias("_n"))
            # pointer jump: follow the label of the new label
            jump = names.select(*by, F.col("node").alias("_n"), F.col("label").alias("_j"))
            step = settle(low.join(jump, [*by, "_n"], "left").select(
                *by, "node", F.col("label").alias("_old"), F.least("_n", F.coalesce("_j", "_n")).alias("label")))
            moved = step.filter("label <> _old").isEmpty()
            names = step.drop("_old")
            if moved:
                break
    out = local.join(names.withColumnRenamed("node", "local"), [*by, "local"], "left")
    return out.select(*by, "row", "col", F.coalesce("label", "local").alias("component"))


def drop_small(labelled: DataFrame, by: Sequence[str], min_cells: Column | int) -> DataFrame:
    size = labelled.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("cells"))
    return labelled.join(size.filter(F.col("cells") >= min_cells), [*by, "component"])


def distance_raster(edges: DataFrame, rows: int, cols: int) -> DataFrame:
    """(row, col, distance): exact Euclidean distance of every raster cell to the nearest edge cell."""
    spark = edges.sparkSession
    span = 2**31
    if not (0 < cols < span and 0 < rows < span):
        raise ValueError("rows and cols must lie in 1..2^31 - 1")
    grid = spark.range(rows * cols).select(F.floor(F.col("id") / cols).alias("row"), (F.col("id") % cols).alias("col"))
    place = lambda df: df.select((F.col("row") * span + F.col("col")).cast("bigint").alias("point_id"),
                                 F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    near = knn_join(place(grid), place(edges), 1)
    return near.select(F.floor(F.col("query_id") / span).alias("row"), (F.col("query_id") % span).alias("col"), F.col("d").alias("distance"))


def assign_levels(cells: DataFrame, levels: DataFrame, min_cells: DataFrame, zone: str = "zone") -> DataFrame:
    """(zone, row, col, level): nearest level per cell; specks and unknown cells take the nearest kept
    region's level (ties to the lower level); a zone without any region takes its top level.

    ``cells(zone, row, col, height NULL = unknown)``, ``levels(zone, levels ARRAY)``,
    ``min_cells(zone, min_cells)``.
    """
    key = [zone, "row", "col"]
    t = attach(cells.select(*key, "height"), levels.select(zone, "levels"), [zone])
    options = F.transform("levels", lambda v, i: F.struct(F.abs(F.col("height") - v).alias("gap"), i.alias("i")))
    t = settle(t.withColumn("_l", F.when(F.col("height").isNotNull(), F.array_min(options)["i"])))
    known = components(t.filter("_l is not null").select(*key, "_l"), [zone, "_l"])
    size = known.groupBy(zone, "_l", "component").agg(F.count(F.lit(1)).alias("_n"))
    size = attach(size, min_cells, [zone]).filter(F.col("_n") >= F.col("min_cells"))
    kept = settle(known.join(size.select(zone, "_l", "component"), [zone, "_l", "component"], "left_semi").select(*key, F.col("_l").cast("int").alias("level")))
    rest = t.join(kept.select(*key), key, "left_anti")
    # the id orders equal distances by level first; cells come back from it, so they must fit 24 bits each
    cell = packed_cell(F.col("row"), F.col("col"), 24)
    ident = lambda lv: lv.cast("bigint") * F.lit(2**48) + cell
    q = rest.select(zone, cell.alias("point_id"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    s = kept.select(zone, ident(F.col("level")).alias("point_id"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    near = knn_join(q, s, 1, [zone]).select(
        zone, F.floor(F.col("query_id") / 2**24).alias("row"), (F.col("query_id") % 2**24).alias("col"),
        F.floor(F.col("train_id") / 2**48).cast("int").alias("level"))
    top = rest.join(kept.select(zone).distinct(), [zone], "left_anti").select(*key, (F.size("levels") - 1).alias("level"))
    return kept.unionByName(near).unionByName(top)


def zone_parts(assigned: DataFrame, zones: DataFrame, res: float, zone: str = "zone", min_area: float = 35.0) -> DataFrame:
    """(zone, level, component, …): one part per component of a level region with enough area; a zone
    left without parts becomes one whole-zone part at its top level.

    ``zones(zone, ground_z, levels, source, reasons)``.
    """
    comp = components(assigned.select(zone, "row", "col", "level"), [zone, "level"])
    sized = comp.groupBy(zone, "level", "component").agg(F.count(F.lit(1)).alias("cells")).withColumn("area_m2", F.col("cells") * (res * res))
    parts = sized.filter(F.col("area_m2") >= min_area)
    whole = assigned.groupBy(zone).agg(F.count(F.lit(1)).alias("cells")).join(parts.select(zone).distinct(), [zone], "left_anti")
    info = zones.select(zone, "ground_z", "levels", "source", "reasons")
    a = attach(parts, info, [zone]).select(
        zone, "level", "component", "cells", "area_m2", "ground_z", F.element_at("levels", F.col("level").cast("int") + 1).alias("height_m"), "source", "reasons")
    b = attach(whole, info, [zone]).select(
        zone, (F.size("levels") - 1).alias("level"), F.lit(-1).cast("bigint").alias("component"), "cells", (F.col("cells") * (res * res)).alias("area_m2"),
        "ground_z", F.element_at("levels", -1).alias("height_m"), F.lit("automatic_whole_footprint_fallback").alias("source"),
        F.array_distinct(F.concat("reasons", F.array(F.lit("NO_VALID_LEVEL_REGIONS")))).alias("reasons"))
    return a.unionByName(b).withColumn("roof_z", F.col("ground_z") + F.col("height_m"))


def zone_ids(zones: DataFrame, zone: str = "zone", x: str = "x", y: str = "y") -> DataFrame:
    """Number zones north to south, then west to east; centre removed is the middle of the whole extent."""
    from gridwright.functions.ranking import global_position
    m = zones.groupBy(zone).agg(F.avg(y).alias("_my"), F.avg(x).alias("_mx"))
    box = zones.agg(((F.min(x) + F.max(x)) / 2).alias("centre_x"), ((F.min(y) + F.max(y)) / 2).alias("centre_y"))
    placed = global_position(m, [], [F.desc("_my"), F.col("_mx"), F.col(zone)], "_pos")
    return placed.crossJoin(F.broadcast(box)).select(  # one row
        zone, F.format_string("PLAN_BUILDING_%02d", F.col("_pos")).alias("building_id"),
        (F.col("_mx") - F.col("centre_x")).alias("mean_x"), (F.col("_my") - F.col("centre_y")).alias("mean_y"))
