"""Exact k-nearest-neighbour join for data of any density.

Both sides are range-partitioned along a Hilbert curve over all features (split keys first) and cut into blocks of
consecutive rows with tight bounding boxes; a query block is cut further until its box is of the size that
a few train blocks have on average, down to single rows.  Block pairs are pruned with box-to-box distance
bounds down a directory of up to four levels: a node is dropped when the nearest nodes that together hold ``k``
rows all lie closer.  The descent starts at the finest level that has at most ``FAN`` nodes in any split, so a
small table is matched in one step and a large one in as many as its blocks need.  Surviving train blocks are
shipped once to each run of ``RUN`` neighbouring query blocks, where NumPy ranks their rows by (distance, train
id); a run with more than ``CANDIDATE_ROWS`` candidates is ranked in several parts of its train blocks, and the
parts' first ``k`` are merged.

Skew: a hot cell, split or coordinate is just more blocks.  More than ``k`` train rows at one
coordinate are reduced to the ``k`` smallest ids, which is exact because the order is (distance, id).

A query row with a NULL or NaN feature raises an error: it has no distance, and dropping it silently would
hide it from its caller.  A train row with one is nobody's neighbour.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.functions.quantiles import BROADCAST_ROWS
from gridwright.session import settle

BLOCK_ROWS = 64
MAX_K = 256  # part of the contract: a neighbourhood is a small window
CANDIDATE_ROWS = 65_536  # train rows that one ranking step holds
FAN = 1024  # nodes of a split that a query block may be paired with in the first step
RUN = 8  # neighbouring query blocks that share their candidates
QUERY_BOX = 2.0  # side of a query box, in average sides of a train block

CURVE_BITS = 20


def curve_position(x: Column, y: Column, low: tuple[float, float], step: float) -> Column:
    """Position along a Hilbert curve over 2^20 x 2^20 cells; consecutive positions are neighbours."""
    @F.pandas_udf(T.LongType())
    def position(xs: pd.Series, ys: pd.Series) -> pd.Series:
        side = 1 << CURVE_BITS
        cx = np.clip(np.floor((xs.to_numpy(float) - low[0]) / step), 0, side - 1).astype("int64")
        cy = np.clip(np.floor((ys.to_numpy(float) - low[1]) / step), 0, side - 1).astype("int64")
        d = np.zeros(len(cx), "int64")
        s = side >> 1
        while s:
            rx, ry = (cx & s) > 0, (cy & s) > 0
            d += s * s * ((3 * rx) ^ ry)
            flip = ~ry & rx
            cx, cy = np.where(flip, side - 1 - cx, cx), np.where(flip, side - 1 - cy, cy)
            cx, cy = np.where(ry, cx, cy), np.where(ry, cy, cx)
            s >>= 1
        return pd.Series(d)
    return position(x, y)


def cube_position(feats: Sequence[Column], low: Sequence[float], step: float) -> Column:
    """Position along a Hilbert curve over cubes of three or more axes (Skilling's transposed form): blocks of
    consecutive positions are tight along every axis, so that a feature of few values bounds distances as well."""
    axes = len(feats)
    bits = min(CURVE_BITS, 62 // axes)
    width = step * 2.0 ** (CURVE_BITS - bits)

    @F.pandas_udf(T.LongType())
    def position(*columns: pd.Series) -> pd.Series:
        side = 1 << bits
        x = [np.clip(np.floor((c.to_numpy(float) - a) / width), 0, side - 1).astype("int64") for c, a in zip(columns, low)]
        q = side >> 1
        while q > 1:
            for i in range(axes):
                flip = (x[i] & q) > 0
                swap = np.where(flip, 0, (x[0] ^ x[i]) & (q - 1))
                x[0] = np.where(flip, x[0] ^ (q - 1), x[0]) ^ swap
                x[i] = x[i] ^ swap
            q >>= 1
        for i in range(1, axes):
            x[i] = x[i] ^ x[i - 1]
        turn = np.zeros(len(x[0]), "int64")
        q = side >> 1
        while q > 1:
            turn = np.where((x[-1] & q) > 0, turn ^ (q - 1), turn)
            q >>= 1
        x = [v ^ turn for v in x]
        d = np.zeros(len(turn), "int64")
        for bit in range(bits - 1, -1, -1):
            for v in x:
                d = (d << 1) | ((v >> bit) & 1)
        return pd.Series(d)
    return position(*feats)


def _block_schema(df: DataFrame, by: Sequence[str], feats: Sequence[str], id_col: str, carry: Sequence[str]) -> T.StructType:
    d = len(feats)
    fields = [T.StructField(c, df.schema[c].dataType) for c in by]
    fields += [
        T.StructField("block", T.LongType()), T.StructField("run", T.LongType()), T.StructField("rows", T.IntegerType()),
        T.StructField("box_lo", T.ArrayType(T.DoubleType())), T.StructField("box_hi", T.ArrayType(T.DoubleType())),
        T.StructField("ids", T.ArrayType(df.schema[id_col].dataType)),
        T.StructField("xs", T.ArrayType(T.DoubleType())),
    ]
    fields += [T.StructField(f"c_{c}", T.ArrayType(T.DoubleType())) for c in carry]
    return T.StructType(fields) if d else T.StructType([])


def _cut(m: np.ndarray, limit: float | None) -> list[tuple[int, int]]:
    """Row ranges of the blocks of consecutive curve rows ``m``; halved until the box is within ``limit``."""
    todo = [(a, min(a + BLOCK_ROWS, len(m))) for a in range(0, len(m), BLOCK_ROWS)][::-1]
    out = []
    while todo:
        a, b = todo.pop()
        if limit is not None and b - a > 1 and np.ptp(m[a:b], axis=0).max() > limit:
            middle = (a + b) // 2
            todo += [(middle, b), (a, middle)]
        else:
            out.append((a, b))
    return out


def _pack(df: DataFrame, by, feats, id_col, carry, low, step, per_coordinate: int | None, limit: float | None = None) -> DataFrame:
    """Blocks of consecutive curve rows: of train rows with at most ``per_coordinate`` rows of one coordinate
    a piece, of query rows (None) with boxes within ``limit``."""
    by, feats, carry = list(by), list(feats), list(carry)
    slim = df.select(*by, F.col(id_col).alias(id_col), *[F.col(c).cast("double").alias(c) for c in {*feats, *carry}])
    for f in feats:
        if per_coordinate is None:
            missing = F.raise_error(F.lit(f"query row without {f}")).cast("double")
            slim = slim.withColumn(f, F.when(F.col(f).isNull() | F.isnan(f), missing).otherwise(F.col(f)))
        else:
            slim = slim.filter(F.col(f).isNotNull() & ~F.isnan(f))
    axes = [F.col(f) for f in feats]
    slim = slim.withColumn("_z", curve_position(*axes, low, step) if len(feats) == 2 else cube_position(axes, low, step))
    order = [F.col(c) for c in [*by, "_z", *feats, id_col]]
    placed = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = _block_schema(slim, by, feats, id_col, carry)

    def chunk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        base = TaskContext.get().partitionId() << 32
        seq = 0
        held: pd.DataFrame | None = None

        def emit(part: pd.DataFrame):
            nonlocal seq
            out, first = [], base + seq
            for start, stop in _cut(part[feats].to_numpy(float), limit):
                p = part.iloc[start:stop]
                m = p[feats].to_numpy(float)
                row = {c: p[c].iloc[0] for c in by}
                row.update(block=base + seq, run=first + len(out) // RUN * RUN, rows=len(p), box_lo=m.min(0).tolist(), box_hi=m.max(0).tolist(),
                           ids=p[id_col].tolist(), xs=m.ravel().tolist())
                for c in carry:
                    row[f"c_{c}"] = [None if v != v else v for v in p[c].tolist()]
                seq += 1
                out.append(row)
            return pd.DataFrame(out, columns=[f.name for f in schema.fields])

        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            if per_coordinate is not None and len(frame):
                frame = frame[frame.groupby([*by, *feats], dropna=False).cumcount() < per_coordinate]
            cut = _last_run_start(frame, by, BLOCK_ROWS, per_coordinate, feats)
            ready, held = frame.iloc[:cut], frame.iloc[cut:].reset_index(drop=True)
            for part in _by_runs(ready, by):
                yield emit(part)
        if held is not None and len(held):
            for part in _by_runs(held, by):
                yield emit(part)

    return placed.mapInPandas(chunk, schema)


def _by_runs(frame: pd.DataFrame, by: list[str]) -> Iterator[pd.DataFrame]:
    if not len(frame):
        return
    if not by:
        yield frame
        return
    keys = frame[by]
    change = (keys != keys.shift()).any(axis=1).to_numpy()
    change[0] = True
    starts = np.flatnonzero(change)
    for a, b in zip(starts, [*starts[1:], len(frame)]):
        yield frame.iloc[a:b]


def _last_run_start(frame, by, size, per_coordinate, feats) -> int:
    """How many leading rows can be cut into whole blocks now; the tail waits for the next batch."""
    n = len(frame)
    if n == 0:
        return 0
    start = 0
    if by:
        keys = frame[by]
        change = (keys != keys.shift()).any(axis=1).to_numpy()
        change[0] = True
        start = int(np.flatnonzero(change)[-1])
    whole = start + (n - start) // size * size
    if per_coordinate is not None and whole > start:
        # keep the last coordinate's rows together so that its duplicate count stays exact
        last = frame[feats].iloc[n - 1]
        same = (frame[feats] == last).all(axis=1).to_numpy()
        first_same = n - int(np.argmin(same[::-1])) if not same.all() else 0
        whole = min(whole, start + max(0, first_same - start) // size * size)
    return whole


def _gap(d: int, kind: str) -> Column:
    """Smallest or largest distance between the query box (q_lo,q_hi) and the node box (lo,hi)."""
    total = None
    for i in range(d):
        ql, qh, lo, hi = (F.col(c)[i] for c in ("q_lo", "q_hi", "lo", "hi"))
        if kind == "min":
            g = F.greatest(lo - qh, ql - hi, F.lit(0.0))
        else:
            g = F.greatest(hi - ql, qh - lo)
        total = g * g if total is None else total + g * g
    return F.sqrt(total)


def _bounds(nodes: DataFrame, keys: Sequence[str], d: int) -> DataFrame:
    """Roll node boxes up to coarser keys."""
    rolled = nodes.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[F.min(F.col("lo")[i]).alias(f"_l{i}") for i in range(d)],
        *[F.max(F.col("hi")[i]).alias(f"_h{i}") for i in range(d)],
    )
    return rolled.select(
        *keys, "n", F.array(*[F.col(f"_l{i}") for i in range(d)]).alias("lo"),
        F.array(*[F.col(f"_h{i}") for i in range(d)]).alias("hi"),
    )


def _prune(state: DataFrame, d: int, k: int, radius: float | None) -> DataFrame:
    """Drop nodes that cannot hold a neighbour of any row of the query block."""
    state = state.withColumn("_near", _gap(d, "min")).withColumn("_far", _gap(d, "max"))
    # the nearest nodes that hold k rows together bound the k-th distance of every row of the block
    upto = F.sum("n").over(W.partitionBy("q_block").orderBy("_far").rowsBetween(W.unboundedPreceding, 0))
    state = state.withColumn("_upto", upto)
    best = F.min(F.when(F.col("_upto") >= k, F.col("_far"))).over(W.partitionBy("q_block"))
    state = state.withColumn("reach", F.least(F.col("reach"), best))
    keep = F.col("_near") <= F.col("reach") * (1 + 1e-12)
    if radius is not None:
        keep = keep & (F.col("_near") <= radius)
    return state.filter(keep).drop("_near", "_far", "_upto")


def knn_join(
    query: DataFrame,
    train: DataFrame,
    k: int,
    by: Sequence[str] = (),
    feats: Sequence[str] = ("x", "y"),
    query_id: str = "point_id",
    train_id: str = "point_id",
    carry: Sequence[str] = (),
    radius: float | None = None,
    exclude_same_id: bool = False,
    reduce: tuple[Callable[[np.ndarray, dict[str, np.ndarray]], list[np.ndarray]], Sequence[str]] | None = None,
) -> DataFrame:
    """The ``k`` nearest train rows of each query row inside equal ``by`` keys.

    Returns ``by…, query_id, train_id, rank, d, carry…`` with rank 1 the nearest; ties by train id.
    ``k`` larger than the split's train rows returns all of them.  ``radius`` drops neighbours farther
    than it.  ``feats`` are two or more columns, and all of them drive the block layout.

    ``reduce`` is (function, names): the neighbours of a query become numbers where they are ranked, and the result is
    ``by…, query_id, names…`` with one row for each query that has neighbours.  The function maps distances (query, rank) and the
    matrices of ``carry``, NaN where a neighbour or its value is absent, to one array a name; no neighbour row is made.
    """
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must lie in 1..{MAX_K}")
    by, feats, carry = list(by), list(feats), list(carry)
    d = len(feats)
    want = k + 1 if exclude_same_id else k
    spark = train.sparkSession

    extent = train.agg(
        *[F.min(f).alias(f"_low{i}") for i, f in enumerate(feats)], *[(F.max(f) - F.min(f)).alias(f"_wide{i}") for i, f in enumerate(feats)],
        (F.count(F.lit(1)) / F.greatest(F.lit(1), F.approx_count_distinct(F.struct(*by)) if by else F.lit(1))).alias("rows"),
    ).first()
    low = tuple(float(extent[f"_low{i}"] or 0.0) for i in range(d))
    span = max(float(extent[f"_wide{i}"] or 0.0) for i in range(d))
    step = max(span, 1e-9) / (2**CURVE_BITS - 1)
    tb = settle(_pack(train, by, feats, train_id, carry, low, step, want)).withColumnRenamed("block", "t_block").drop("run")
    # query rows outside the train extent are clamped to its edge; only the block layout depends on it
    if d == 2:
        limit = QUERY_BOX * span * (max(BLOCK_ROWS, want) / max(1.0, extent["rows"])) ** 0.5
    else:  # rows seldom fill a cube of many axes, so the side of a train block is measured
        side = tb.agg(F.avg(F.array_max(F.zip_with("box_hi", "box_lo", lambda a, b: a - b)))).first()[0]
        limit = QUERY_BOX * float(side or 0.0) * (max(BLOCK_ROWS, want) / BLOCK_ROWS) ** 0.5
    qb = settle(_pack(query, by, feats, query_id, [], low, step, None, limit)).withColumnRenamed("block", "q_block")

    leaves = tb.select(*by, "t_block", F.col("rows").alias("n"), F.col("box_lo").alias("lo"), F.col("box_hi").alias("hi"))
    state = qb.select(*by, "q_block", "run", F.col("box_lo").alias("q_lo"), F.col("box_hi").alias("q_hi"),
                      F.lit(float("inf")).alias("reach"))
    if not by:
        leaves, state = leaves.withColumn("_all", F.lit(0)), state.withColumn("_all", F.lit(0))
    on = by or ["_all"]

    # from coarse to fine: groups of 64 range pieces, range pieces, groups of 64 blocks, blocks
    leaves = leaves.withColumn("_p", F.shiftright("t_block", 32)).withColumn("_pp", F.shiftright("_p", 6)).withColumn(
        "_s", F.shiftright(F.col("t_block").bitwiseAND(F.lit(0xFFFFFFFF)), 6))
    keys = [[*on, "_pp"], [*on, "_pp", "_p"], [*on, "_pp", "_p", "_s"]]
    nodes = leaves.groupBy(*on).agg(*[F.approx_count_distinct(F.struct(*k[len(on):])).alias(f"_{i}") for i, k in enumerate(keys)], F.count(F.lit(1)).alias("_3"))
    widest = nodes.agg(*[F.max(f"_{i}").alias(f"_{i}") for i in range(4)]).first()
    level = max((i for i in range(4) if (widest[i] or 0) <= FAN), default=0)
    pairs, at = state, on
    while level < 3:
        pairs = _prune(pairs.join(_bounds(leaves, keys[level], d), at), d, want, radius).drop("n", "lo", "hi")
        level, at = level + 1, keys[level]
    pairs = _prune(pairs.join(leaves, at), d, want, radius)
    links = settle(pairs.select("q_block", "run", "t_block", "n"))
    # counted: their file is small whatever their number, and Spark would send millions of links through the driver
    many = links.count() > BROADCAST_ROWS
    links = links.select("run", "t_block", "n").distinct()
    load = links.groupBy("run").agg(F.ceil(F.sum("n") / CANDIDATE_ROWS).alias("_parts"))
    parts = load.agg(F.max("_parts")).first()[0] or 1

    packed = tb.select("t_block", F.col("ids").alias("t_ids"), F.col("xs").alias("t_xs"), *[f"c_{c}" for c in carry])
    left = qb.select(*by, "q_block", "run", "ids", "xs")
    if parts > 1:
        links = links.join(load, "run").withColumn("part", F.pmod(F.xxhash64("t_block"), F.col("_parts")).cast("int"))
        left = left.join(load, "run").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts").cast("int") - 1)))
    else:
        links, left = links.withColumn("part", F.lit(0)), left.withColumn("part", F.lit(0))
    if many:
        links, packed = links.hint("merge"), packed.hint("merge")
    candidates = links.select(F.col("run").alias("for_run"), F.col("part").alias("for_part"), "t_block").join(packed, "t_block")

    fields = [T.StructField(c, query.schema[c].dataType) for c in by]
    fields += [
        T.StructField("query_id", query.schema[query_id].dataType),
        T.StructField("train_id", train.schema[train_id].dataType),
        T.StructField("rank", T.IntegerType()), T.StructField("d", T.DoubleType()),
        T.StructField("q_block", T.LongType()), T.StructField("q_row", T.IntegerType()),
    ]
    fields += [T.StructField(c, T.DoubleType()) for c in carry]
    names = [f.name for f in fields]

    def matrices(row: np.ndarray, place: np.ndarray, rows: int, dist: np.ndarray, extra: dict[str, np.ndarray]):
        def matrix(values):
            m = np.full((rows, k), np.nan)
            m[row, place] = values
            return m
        return matrix(dist), {name: matrix(v) for name, v in extra.items()}

    reduced = [*[f.name for f in fields[:len(by) + 1]], *(reduce[1] if reduce else ())]

    def rank_run(qrows: pd.DataFrame, cand: pd.DataFrame, reducing: bool = False) -> pd.DataFrame:
        if not len(qrows) or not len(cand):
            return pd.DataFrame(columns=reduced if reducing else names)
        tx = np.concatenate([np.asarray(v, float) for v in cand["t_xs"]]).reshape(-1, d)
        tid = np.concatenate([np.asarray(v) for v in cand["t_ids"]])
        extra = {c: np.concatenate([np.array(v, dtype=float) for v in cand[f"c_{c}"]]) for c in carry}
        offsets = np.concatenate([[0], np.cumsum([len(v) for v in cand["t_ids"]])])
        lows, highs = (cut.reduceat(tx, offsets[:-1], axis=0) for cut in (np.minimum, np.maximum))
        out = {name: [] for name in ("rows", "row", "train", "rank", "d")}
        qids = []
        for n, (ids, xs) in enumerate(zip(qrows["ids"], qrows["xs"])):
            qx, qid = np.asarray(xs, float).reshape(-1, d), np.asarray(ids)
            r, c, dv = nearest(qx, tx, tid, offsets, lows, highs)
            if exclude_same_id:
                other = tid[c] != qid[r]
                r, c, dv = r[other], c[other], dv[other]
            pos = np.arange(len(r)) - np.searchsorted(r, r, side="left")
            keep = pos < k
            if radius is not None:
                keep &= dv <= radius
            r = r[keep]
            qids.append(qid[r])
            for name, v in (("rows", np.full(len(r), n)), ("row", r), ("train", c[keep]), ("rank", pos[keep] + 1), ("d", dv[keep])):
                out[name].append(v)
        found = {name: np.concatenate(v) for name, v in out.items()}
        if reducing:
            first = found["rank"] == 1
            at = np.cumsum(first) - 1
            made = reduce[0](*matrices(at, found["rank"] - 1, int(first.sum()), found["d"], {name: v[found["train"]] for name, v in extra.items()}))
            frame = {b: [qrows[b].iloc[0]] * int(first.sum()) for b in by}
            return pd.DataFrame(frame | {"query_id": np.concatenate(qids)[first]} | dict(zip(reduce[1], made)), columns=reduced)
        frame = {b: [qrows[b].iloc[0]] * len(found["row"]) for b in by}
        frame.update(query_id=np.concatenate(qids), train_id=tid[found["train"]], rank=found["rank"].astype("int32"), d=found["d"],
                     q_block=qrows["q_block"].to_numpy()[found["rows"]], q_row=found["row"].astype("int32"))
        frame.update({name: v[found["train"]] for name, v in extra.items()})
        return pd.DataFrame(frame, columns=names)

    def nearest(qx, tx, tid, offsets, lows, highs):
        """(row, candidate, distance) of the ``want`` nearest and all that tie with them, in order; nearest blocks
        first, and none beyond every row's k-th distance."""
        gap = np.maximum(np.maximum(lows - qx.max(0), qx.min(0) - highs), 0.0)
        near = np.sqrt((gap * gap).sum(axis=1))
        visit = np.argsort(near, kind="stable")
        best = np.full((len(qx), want), np.inf)
        kth = best.max(axis=1)
        kept, at = [], 0
        while at < len(visit) and near[visit[at]] <= kth.max() * (1 + 1e-12):
            index = [np.arange(offsets[visit[at]], offsets[visit[at] + 1])]
            at += 1
            while at < len(visit) and sum(map(len, index)) < 1024:
                index.append(np.arange(offsets[visit[at]], offsets[visit[at] + 1]))
                at += 1
            index = np.concatenate(index)
            sq = np.zeros((len(qx), len(index)))
            for i in range(d):
                diff = qx[:, i, None] - tx[index, i]
                sq = sq + diff * diff
            dist = np.sqrt(sq)
            best = np.partition(np.concatenate([best, dist], axis=1), want - 1, axis=1)[:, :want]
            kth = best.max(axis=1)
            r, c = np.nonzero(dist <= kth[:, None])
            kept.append((r, index[c], dist[r, c]))
        r, c, dv = (np.concatenate(v) for v in zip(*kept))
        inside = dv <= kth[r]
        r, c, dv = r[inside], c[inside], dv[inside]
        o = np.lexsort((tid[c], dv, r))
        return r[o], c[o], dv[o]

    direct = None
    if reduce:
        numbers = T.StructType([*fields[:len(by) + 1], *[T.StructField(c, T.DoubleType()) for c in reduce[1]]])
        one, whole = left, candidates
        if parts > 1:  # a run in several parts goes by its rows
            few = settle(load.filter("_parts = 1").select("run"))
            one, left = left.join(few, "run", "left_semi"), left.join(few, "run", "left_anti")
            few = few.withColumnRenamed("run", "for_run")
            whole, candidates = candidates.join(few, "for_run", "left_semi"), candidates.join(few, "for_run", "left_anti")
        direct = one.groupBy("run").cogroup(whole.groupBy("for_run")).applyInPandas(lambda q, c: rank_run(q, c, True), numbers)
        if parts == 1:
            return _null_for_nan(direct, reduce[1])
    result = left.groupBy("run", "part").cogroup(candidates.groupBy("for_run", "for_part")).applyInPandas(
        lambda q, c: rank_run(q, c), T.StructType(fields))  # two parameters: Spark gives a third the key
    if parts > 1:  # at most k rows from each part
        first = W.partitionBy("q_block", "q_row").orderBy("d", "train_id")
        result = result.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)
    if reduce:
        listed = result.groupBy(*by, "query_id", "q_block", "q_row").agg(F.sort_array(F.collect_list(F.struct("rank", "d", *carry))).alias("_n"))

        def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                n = frame["d"].map(len).to_numpy() if len(frame) else np.zeros(0, int)
                if not len(n):
                    continue
                flat = {c: np.concatenate([np.asarray(v, float) for v in frame[c]]) for c in ("d", *carry)}
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                made = reduce[0](*matrices(np.repeat(np.arange(len(n)), n), place, len(n), flat["d"], {c: flat[c] for c in carry}))
                yield frame[reduced[:len(by) + 1]].assign(**dict(zip(reduce[1], made)))

        rest = listed.select(*by, "query_id", *[F.col(f"_n.{c}").alias(c) for c in ("d", *carry)]).mapInPandas(numbered, numbers)
        return _null_for_nan(direct.unionByName(rest), reduce[1])
    result = result.drop("q_block", "q_row")
    return _null_for_nan(result, carry)


def _null_for_nan(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        table = table.withColumn(c, F.when(F.isnan(c), None).otherwise(F.col(c)))
    return table


def nearest_distance(query: DataFrame, train: DataFrame, by: Sequence[str] = (), feats=("x", "y"), **kw) -> DataFrame:
    """``by…, query_id, nearest_m`` — NULL-free; queries of a split without train rows are absent."""
    return knn_join(query, train, 1, by, feats, **kw).select(*by, "query_id", F.col("d").alias("nearest_m"))


def buffer_exclude(pool: DataFrame, test: DataFrame, metres: float, by: Sequence[str] = (), id_col: str = "point_id") -> DataFrame:
    """Pool rows with ``nearest_m`` to the test set and ``kept`` (at least ``metres`` away)."""
    near = nearest_distance(pool, test, by, query_id=id_col, train_id=id_col).withColumnRenamed("query_id", id_col)
    joined = pool.join(near, [*by, id_col], "left")
    return joined.withColumn("kept", F.col("nearest_m").isNull() | (F.col("nearest_m") >= metres))
