"""Exact k-nearest-neighbour join of vectors with many components.

Space-filling curves order only a few components, so the layout comes from distances to pivots instead.  Up to
``PIVOTS`` train vectors (a hash sample whose size grows with the square root of the table) split the space into
cells of the nearest pivot; rows are ordered by cell and by distance to the cell's pivot and cut into blocks of at
most ``BLOCK_ROWS`` rows.  A block knows the smallest and largest distance of its rows to its own pivot and to the
first ``GUARDS`` pivots, so the triangle inequality bounds its distance to any query block from below and above:

1. neighbouring blocks form tiles, and each pair of a query tile and a train tile is one task, which bounds all its
   pairs of blocks from their few numbers; a pair of blocks is never a row with bounds of its own;
2. the ``SEEDS`` blocks with the least upper bounds are ranked first, and the k-th distances they give are the
   reach of the query block;
3. blocks within the reach are ranked by blocked matrix products.  The products only choose the rows whose
   distance is then computed from the differences, so order and distances do not depend on rounding in the products.

A vector is shipped once to each tile of the other side that needs its block, not once to each block.

Skew: a hot cell is only more blocks, and more than ``k`` train rows with one and the same vector are reduced to
the ``k`` smallest ids, which is exact because the order is (distance, id).  A tile holds about ``PART_VALUES``
numbers, four times as many at most.  Nothing but the pivots reaches the driver.

Defined results: a query vector that is null, of another length, or holds a null or non-finite component raises
an error; such a train row is nobody's neighbour; train vectors of several lengths are an error; a split with fewer
than ``k`` train rows returns all of them; an empty side gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.functions.ranking import global_position
from gridwright.operators.knn import MAX_K, _by_runs
from gridwright.session import settle

PIVOTS = 1024
GUARDS = 32
BLOCK_ROWS = 128
SEEDS = 8
PART_VALUES = 4 << 20  # numbers of a tile's vectors; a task holds two tiles
SLACK = 1e-9  # relative allowance for rounding in bounds and matrix products


def _finite(vector: Column) -> Column:
    return F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def choose_pivots(train: DataFrame, rows: int) -> np.ndarray:
    """A hash sample of train vectors; at most ``PIVOTS`` rows reach the driver."""
    size = int(min(PIVOTS, max(1, round(rows ** 0.5))))
    sample = train.select("_v", F.xxhash64("_v", "_id").alias("_h")).orderBy("_h", "_v").limit(size).collect()
    return np.unique(np.array([r["_v"] for r in sample], float), axis=0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows by one matrix product, right to about 1e-7 of the norms."""
    sq = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(sq, 0.0))


def to_pivots(m: np.ndarray, pivots: np.ndarray, step: int = 256) -> np.ndarray:
    """Distances to the pivots from differences: bounds must hold even for rows that equal a pivot."""
    out = np.empty((len(m), len(pivots)))
    for a in range(0, len(m), step):
        for j, p in enumerate(pivots):
            diff = m[a:a + step] - p
            out[a:a + step, j] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


def _blocks(df: DataFrame, by: list[str], pivots: np.ndarray, copies: int | None) -> DataFrame:
    """Blocks of rows of one split and cell; ``copies`` limits the rows of one vector (None: query rows, which carry
    their distances to every pivot)."""
    guards = min(GUARDS, len(pivots))
    numbers, keys = T.ArrayType(T.DoubleType()), [df.schema[c] for c in by]
    placed_schema = T.StructType([*keys, df.schema["_id"], T.StructField("_v", numbers), T.StructField("cell", T.IntegerType()), T.StructField("_r", T.DoubleType())])

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                far = to_pivots(np.stack(f["_v"].to_numpy()), pivots)
                cell = far.argmin(1)
                yield f.assign(cell=cell.astype("int32"), _r=far[np.arange(len(f)), cell])[placed_schema.names]

    order = [*by, "cell", "_r", F.xxhash64("_v"), "_id"]
    placed = df.select(*by, "_id", "_v").mapInPandas(place, placed_schema).repartitionByRange(*order).sortWithinPartitions(*order)
    box = [T.StructField(c, numbers) for c in ("lo", "hi")]
    schema = T.StructType([*keys, T.StructField("cell", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("n", T.IntegerType()),
                           T.StructField("r_lo", T.DoubleType()), T.StructField("r_hi", T.DoubleType()), *box,
                           T.StructField("ids", T.ArrayType(df.schema["_id"].dataType)), T.StructField("vs", numbers)])

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        for f in frames:
            out = []
            for part in _by_runs(f, [*by, "cell"]):
                m = np.stack(part["_v"].to_numpy())
                ids = part["_id"].to_numpy()
                if copies is not None:  # equal vectors are neighbours in the order, least id first
                    fresh = np.concatenate([[True], (m[1:] != m[:-1]).any(1)])
                    starts = np.flatnonzero(fresh)
                    keep = np.arange(len(m)) - starts[np.cumsum(fresh) - 1] < copies
                    m, ids = m[keep], ids[keep]
                far = to_pivots(m, pivots)
                cell = int(part["cell"].iloc[0])
                for a in range(0, len(m), BLOCK_ROWS):
                    d = far[a:a + BLOCK_ROWS]
                    shown = d if copies is None else d[:, :guards]
                    row = {c: part[c].iloc[0] for c in by}
                    row.update(cell=cell, block=block, n=len(d), r_lo=d[:, cell].min(), r_hi=d[:, cell].max(), lo=shown.min(0), hi=shown.max(0),
                               ids=ids[a:a + BLOCK_ROWS].tolist(), vs=m[a:a + BLOCK_ROWS].ravel())
                    block += 1
                    out.append(row)
            if out:
                yield pd.DataFrame(out, columns=schema.names)

    return settle(placed.mapInPandas(cut, schema))


def _tiled(blocks: DataFrame, by: list[str], block: str, tile: str, width: int) -> DataFrame:
    """``blocks`` with ``tile``, the first block of its tile: consecutive blocks of one split, so many that a tile has
    about ``PART_VALUES`` numbers, or fewer while there are not enough tasks otherwise."""
    size = blocks.groupBy(*by).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("b")).agg(
        F.count(F.lit(1)).alias("splits"), F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    if not size["b"]:
        return blocks.withColumn(tile, F.lit(0).cast("long"))
    side = np.ceil(np.sqrt(4 * blocks.sparkSession.sparkContext.defaultParallelism / size["splits"]))
    rows = min(PART_VALUES // width, max(4 * BLOCK_ROWS, size["n"] / size["splits"] / side))
    most = max(1, 4 * PART_VALUES // width // BLOCK_ROWS)
    per = int(min(most, max(1, rows // (size["n"] / size["b"]))))
    placed = global_position(blocks.select(*by, block), by, [F.col(block)], "_at").withColumn("_at", F.floor((F.col("_at") - 1) / per))
    first = placed.select(F.col(block).alias("_b"), F.min(block).over(W.partitionBy(*by, "_at")).alias(tile))  # the blocks of a tile
    return settle(blocks.join(first, F.col(block) == F.col("_b")).drop("_b"))


def _bounds(q: pd.DataFrame, t: pd.DataFrame, guards: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible distances of the rows of each query block (row) and train block (column)."""
    q_lo, q_hi, lo, hi = (np.stack(c.to_numpy()) for c in (q["q_lo"], q["q_hi"], t["lo"], t["hi"]))
    cell, r_lo, r_hi = (t[c].to_numpy() for c in ("cell", "r_lo", "r_hi"))
    own_lo, own_hi = q_lo[:, cell], q_hi[:, cell]
    near = np.maximum(np.maximum(own_lo - r_hi, r_lo - own_hi), 0.0)
    far = own_hi + r_hi
    for g in range(guards):
        a, b = q_lo[:, g, None], q_hi[:, g, None]
        near = np.maximum(near, np.maximum(lo[:, g] - b, a - hi[:, g]))
        far = np.minimum(far, hi[:, g] + b)
    return near, far


def _boxes(q: DataFrame, tb: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The numbers of the query and the train blocks of every pair of tiles of one split."""
    on = by or ["_all"]
    sides = [(df if by else df.withColumn("_all", F.lit(0))).select(*on, c).distinct() for df, c in ((q, "q_tile"), (tb, "t_tile"))]
    pairs = sides[0].join(sides[1], on).select("q_tile", "t_tile")  # a few tiles a split
    left = q.select("q_tile", *[c for c in ("q_block", "q_lo", "q_hi", "reach") if c in q.columns]).join(pairs, "q_tile")
    right = tb.select("t_tile", "t_block", "n", "cell", "r_lo", "r_hi", "lo", "hi").join(
        pairs.select(F.col("q_tile").alias("_for"), F.col("t_tile").alias("_of")), F.col("t_tile") == F.col("_of")).drop("t_tile")
    return left, right


def _rank(links: DataFrame, qb: DataFrame, tb: DataFrame, want: int, width: int, id_type: T.DataType, train_type: T.DataType) -> DataFrame:
    """(q_block, q_row, query_id, train_id, d): per train tile the ``want`` first train rows of each query row in the linked blocks."""
    pair = ["q_tile", "t_tile"]
    left = links.select(*pair, F.explode("for").alias("q_block")).distinct().join(
        qb.select("q_block", F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs")), "q_block")
    right = links.select(F.col("q_tile").alias("_for"), F.col("t_tile").alias("_of"), "t_block", "for").join(tb.select("t_block", "ids", "vs"), "t_block")
    schema = T.StructType([T.StructField("q_block", T.LongType()), T.StructField("q_row", T.IntegerType()), T.StructField("query_id", id_type),
                           T.StructField("train_id", train_type), T.StructField("d", T.DoubleType())])

    def nearest(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(t):
            return pd.DataFrame(columns=schema.names)
        every = np.concatenate([np.asarray(v, float) for v in t["vs"]]).reshape(-1, width)
        ids = np.concatenate([np.asarray(v) for v in t["ids"]])
        stops = np.cumsum([len(v) for v in t["ids"]])
        place = {b: n for n, b in enumerate(q["q_block"])}
        linked = np.zeros((len(q), len(t)), bool)
        for n, blocks in enumerate(t["for"]):
            linked[[place[b] for b in blocks], n] = True
        out = []
        for n, (block, q_ids, q_vs) in enumerate(zip(q["q_block"], q["q_ids"], q["q_vs"])):
            qm, qid = np.asarray(q_vs, float).reshape(-1, width), np.asarray(q_ids)
            tm, tid = every, ids
            if not linked[n].all():
                rows = np.repeat(linked[n], np.diff(stops, prepend=0))
                tm, tid = every[rows], ids[rows]
            scale = np.sqrt((qm * qm).sum(1).max()) + np.sqrt((tm * tm).sum(1).max())
            for a in range(0, len(qm), 16):
                close = distances(qm[a:a + 16], tm)
                top = min(want, len(tm)) - 1
                limit = np.partition(close, top, axis=1)[:, top]
                # the product may be off by about sqrt(machine precision) of the norms near zero
                r, c = np.nonzero(close <= (limit + 1e-6 * scale)[:, None])
                sq = np.zeros(len(r))
                for i in range(width):
                    diff = qm[a + r, i] - tm[c, i]
                    sq += diff * diff
                d = np.sqrt(sq)
                o = np.lexsort((tid[c], d, r))
                r, c, d = r[o], c[o], d[o]
                first = np.arange(len(r)) - np.searchsorted(r, r, side="left") < want
                r, c, d = r[first] + a, c[first], d[first]
                out.append(pd.DataFrame({"q_block": block, "q_row": r.astype("int32"), "query_id": qid[r], "train_id": tid[c], "d": d}))
        return pd.concat(out)[schema.names]

    return left.groupBy(*pair).cogroup(right.groupBy("_for", "_of")).applyInPandas(nearest, schema)


def _search(query: DataFrame, train: DataFrame, k: int, by: list[str], vector: str, query_id: str, train_id: str, want: int):
    """(linked blocks to rank, query blocks, train blocks, number of components), or None without train rows."""
    t = train.select(*by, F.col(train_id).alias("_id"), F.col(vector).cast("array<double>").alias("_v")).filter(F.col("_v").isNotNull() & _finite(F.col("_v")))
    size = t.agg(F.count(F.lit(1)).alias("rows"), F.min(F.size("_v")).alias("low"), F.max(F.size("_v")).alias("high")).first()
    if not size["rows"]:
        return None
    if size["low"] != size["high"] or not size["high"]:
        raise ValueError(f"train vectors have {size['low']} to {size['high']} components")
    width = size["high"]
    v = F.col(vector).cast("array<double>")
    fine = F.coalesce((F.size(v) == width) & _finite(v), F.lit(False))
    q = query.select(*by, F.col(query_id).alias("_id"), F.when(fine, v).otherwise(
        F.raise_error(F.lit(f"query row without {width} finite components")).cast("array<double>")).alias("_v"))
    pivots = choose_pivots(t, size["rows"])
    guards = min(GUARDS, len(pivots))
    tb = _tiled(_blocks(t, by, pivots, want).withColumnRenamed("block", "t_block"), by, "t_block", "t_tile", width)
    qb = _tiled(_blocks(q, by, pivots, None).withColumnsRenamed({"block": "q_block", "lo": "q_lo", "hi": "q_hi"}), by, "q_block", "q_tile", width)
    pair = ["q_tile", "t_tile"]

    def seed(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = [*pair, "q_block", "t_block", "far", "reach"]
        if not len(a) or not len(b):
            return pd.DataFrame(columns=names)
        _, far = _bounds(a, b, guards)
        order = np.argsort(far, axis=1, kind="stable")
        upto = np.cumsum(b["n"].to_numpy()[order], axis=1)
        # the nearest blocks that hold ``want`` rows together bound the distance of the last of them
        enough = np.minimum((upto < want).sum(1), len(b) - 1)
        sure = far[np.arange(len(a)), order[np.arange(len(a)), enough]]
        reach = np.where(upto[:, -1] >= want, sure, np.inf)
        top = order[:, :SEEDS]
        line = np.repeat(np.arange(len(a)), top.shape[1])
        return pd.DataFrame({"q_tile": a["q_tile"].iloc[0], "t_tile": a["t_tile"].iloc[0], "q_block": a["q_block"].to_numpy()[line],
                             "t_block": b["t_block"].to_numpy()[top.ravel()], "far": far[line, top.ravel()], "reach": reach[line]}, columns=names)

    def link(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = [*pair, "t_block", "n", "for"]
        if not len(a) or not len(b):
            return pd.DataFrame(columns=names)
        near, _ = _bounds(a, b, guards)
        within = near <= a["reach"].to_numpy()[:, None] * (1 + SLACK) + SLACK
        blocks = a["q_block"].to_numpy()
        some = np.flatnonzero(within.any(0))
        if not len(some):
            return pd.DataFrame(columns=names)
        return pd.DataFrame({"q_tile": a["q_tile"].iloc[0], "t_tile": a["t_tile"].iloc[0], "t_block": b["t_block"].to_numpy()[some],
                             "n": b["n"].to_numpy()[some], "for": [blocks[within[:, i]] for i in some]}, columns=names)

    left, right = _boxes(qb, tb, by)
    seeds = settle(left.groupBy(*pair).cogroup(right.groupBy("_for", "_of")).applyInPandas(
        seed, "q_tile long, t_tile long, q_block long, t_block long, far double, reach double"))
    best = W.partitionBy("q_block").orderBy("far", "t_block")  # SEEDS rows a train tile
    first = seeds.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= SEEDS).groupBy(*pair, "t_block").agg(F.collect_list("q_block").alias("for"))
    types = (query.schema[query_id].dataType, train.schema[train_id].dataType)
    seen = _rank(settle(first), qb, tb, want, width, *types).groupBy("q_block", "q_row").agg(
        F.count(F.lit(1)).alias("_n"), F.sort_array(F.collect_list("d")).alias("_d"))  # at most k rows of each of SEEDS tiles
    kth = F.when(F.col("_n") >= want, F.element_at("_d", want)).otherwise(F.lit(float("inf")))
    tight = seen.groupBy("q_block").agg(F.max(kth).alias("_reach")).join(seeds.groupBy("q_block").agg(F.min("reach").alias("_sure")), "q_block")
    reach = settle(tight.select(F.col("q_block").alias("_b"), F.least("_reach", "_sure").alias("reach")))
    left, right = _boxes(qb.drop("ids", "vs").join(reach, F.col("q_block") == F.col("_b")).drop("_b"), tb, by)
    links = settle(left.groupBy(*pair).cogroup(right.groupBy("_for", "_of")).applyInPandas(
        link, "q_tile long, t_tile long, t_block long, n int, for array<long>"))
    return links, qb, tb, width


def vector_knn(query: DataFrame, train: DataFrame, k: int, vector: str = "embedding", by: Sequence[str] = (), query_id: str = "point_id",
               train_id: str = "point_id", exclude_same_id: bool = False) -> DataFrame:
    """``by…, query_id, train_id, rank, d``: the ``k`` nearest train vectors of each query row inside equal ``by`` keys,
    by (Euclidean distance, train id)."""
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must lie in 1..{MAX_K}")
    by, want = list(by), k + 1 if exclude_same_id else k
    found = _search(query, train, k, by, vector, query_id, train_id, want)
    names = [*by, "query_id", "train_id", "rank", "d"]
    if found is None:
        fields = [query.schema[c] for c in by] + [T.StructField("query_id", query.schema[query_id].dataType), T.StructField(
            "train_id", train.schema[train_id].dataType), T.StructField("rank", T.IntegerType()), T.StructField("d", T.DoubleType())]
        return query.sparkSession.createDataFrame([], T.StructType(fields))
    links, qb, tb, width = found
    ranked = _rank(links, qb, tb, want, width, query.schema[query_id].dataType, train.schema[train_id].dataType)
    if exclude_same_id:
        ranked = ranked.filter("query_id <> train_id")
    first = W.partitionBy("q_block", "q_row").orderBy("d", "train_id")  # at most k rows of each train tile
    ranked = ranked.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    return (ranked.join(qb.select("q_block", *by), "q_block") if by else ranked).select(*names)


def search_cost(query: DataFrame, train: DataFrame, k: int, **kw) -> DataFrame:
    """One row: pairs of query and train rows that are ranked at last, and all pairs of the table."""
    by = list(kw.get("by", ()))
    found = _search(query, train, k, by, kw.get("vector", "embedding"), kw.get("query_id", "point_id"), kw.get("train_id", "point_id"), k)
    if found is None:
        return query.sparkSession.createDataFrame([(0, 0)], "ranked_pairs long, all_pairs long")
    links, qb, tb, _ = found
    pairs = links.select("n", F.explode("for").alias("q_block"))
    ranked = pairs.join(qb.select("q_block", F.col("n").alias("_q")), "q_block").agg(F.coalesce(F.sum(F.col("n") * F.col("_q")), F.lit(0)).alias("ranked_pairs"))
    sizes = [b.groupBy(*by).agg(F.sum("n").alias(c)) for b, c in ((qb, "_a"), (tb, "_b"))]
    every = (sizes[0].join(sizes[1], by) if by else sizes[0].crossJoin(sizes[1])).agg(F.coalesce(F.sum(F.col("_a") * F.col("_b")), F.lit(0)).alias("all_pairs"))
    return ranked.crossJoin(every)  # one row each
