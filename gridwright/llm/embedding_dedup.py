"""Embedding near-duplicates through a pivot-permutation index.

Every vector is described by its ``NEAREST`` nearest reference points (pivots), in order of nearness.  An
inverted list per (label, pivot) holds the vectors that name the pivot; two vectors of one list are a candidate
pair when they share at least ``SHARED`` pivots, and a candidate is verified by its cosine in double precision.  A
pair that shares several pivots is judged in the list of the least of them, so nothing counts twice.

Pivots are a bounded sample: the 2 * sqrt(n) distinct vectors with the smallest hash, at most ``MAX_PIVOTS``, thinned
so that no two lie within twice the link angle.  Otherwise a dense group draws so many pivots that the nearest of its
members hardly overlap.  Every vector is indexed.  Lists are cut into blocks of about ``BLOCK`` vectors and each pair of blocks is a task of its
own, so a hot list is more tasks, never a larger one.  Pairs are counted and joined to stars inside the block task
and never leave it.  Equal vectors of one label are collapsed into a class first.

Defined results: labels must be equal and not null; vectors that are null, empty, zero, or hold null or non-finite
components link with nothing, and vectors of different dimension never link; repeated rows count as other
vectors; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.components import components
from gridwright.llm.store import settle

THRESHOLD = 0.93
NEAREST, SHARED = 8, 2
MAX_PIVOTS = 4096
BLOCK = 512
LISTED = "cid string, label {label}, dim int, n long, vector array<double>, near array<int>, pivot int"


def classes(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, DataFrame]:
    """All rows (id, and cid of the class or null), and one row per class of equal valid vectors."""
    values = F.col(vector).cast("array<double>")
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    valid = F.col(label).isNotNull() & (F.size(F.coalesce(values, F.array().cast("array<double>"))) > 0) & finite & F.exists(values, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.when(valid, values).alias("vector"))
    held = rows.filter("vector IS NOT NULL").groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    # the least id alone may name two classes when an id repeats with another vector
    cid = F.concat_ws(":", F.coalesce(F.col("rep").cast("string"), F.lit("")), F.hex(F.xxhash64("label", "vector")))
    return rows, settle(held.select(cid.alias("cid"), "rep", "label", "vector", F.size("vector").alias("dim"), "n"), "classes")


def choose_pivots(held: DataFrame, count: int, threshold: float = THRESHOLD) -> dict[int, np.ndarray]:
    """Unit pivots by dimension: at most ``min(MAX_PIVOTS, 2 * sqrt(count))`` vectors of each, thinned."""
    size = max(1, min(MAX_PIVOTS, math.ceil(2 * math.sqrt(count))))
    out = {}
    for dim in [r.dim for r in held.select("dim").distinct().collect()]:
        # the first rows of every partition only, never a sort of all vectors in one task
        rows = held.filter(F.col("dim") == dim).orderBy(F.xxhash64("vector"), "cid").limit(size).select("vector").collect()
        out[dim] = thinned(_unit(np.array([r.vector for r in rows])), threshold)
    return out


def thinned(pivots: np.ndarray, threshold: float) -> np.ndarray:
    """The pivots, in order, that are not within twice the link angle of an earlier one kept."""
    limit = 2 * threshold * threshold - 1 if threshold > 0 else -1.0
    kept, n = np.empty_like(pivots), 0
    for v in pivots:
        if not n or (kept[:n] @ v).max() < limit:
            kept[n] = v
            n += 1
    return kept[:n].copy()


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(1, keepdims=True)  # keeps very large and very small components in range
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def nearest(m: np.ndarray, pivots: np.ndarray, count: int = NEAREST) -> np.ndarray:
    """The nearest pivots of each row, nearest first (ties by number)."""
    return np.argsort(-(_unit(m) @ pivots.T), axis=1, kind="stable")[:, :count]


def _describe(batches, pivots: dict[int, np.ndarray]):
    for pdf in batches:
        for dim, part in pdf.groupby("dim"):
            near = nearest(np.array(part["vector"].tolist()), pivots[dim])
            part = part.assign(near=list(near.astype(np.int32)))
            yield part.assign(pivot=part["near"]).explode("pivot").astype({"pivot": "int32"})


def postings(held: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """One row per class and pivot it names."""
    rows = held.select("cid", "label", "dim", "n", "vector")
    return rows.mapInPandas(partial(_describe, pivots=pivots), LISTED.format(label=rows.schema["label"].dataType.simpleString()))


def _verify(pdf: pd.DataFrame, threshold: float, shared: int, pivots: int) -> pd.DataFrame:
    """Links of one pair of blocks: per class the number of vectors linked, and the least class reachable here."""
    pivot, low, high = int(pdf["pivot"].iloc[0]), int(pdf["low"].iloc[0]), int(pdf["high"].iloc[0])
    pdf = pdf.sort_values("cid", kind="stable").reset_index(drop=True)
    named = np.zeros((len(pdf), pivots), np.float32)
    near = np.array(pdf["near"].tolist())
    np.put_along_axis(named, near, 1, axis=1)
    block = pdf["block"].to_numpy()
    unit = _unit(np.array(pdf["vector"].tolist()))
    linked = (named @ named.T >= min(shared, near.shape[1])) & (named[:, :pivot] @ named[:, :pivot].T == 0) & (unit @ unit.T >= threshold)
    np.fill_diagonal(linked, False)
    if low != high:  # pairs inside a block are judged where the block meets itself
        linked &= block[:, None] != block[None, :]
    hit = linked.any(1)
    count = linked @ pdf["n"].to_numpy(np.int64)
    root = np.arange(len(pdf))
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], len(pdf)).min(1))
        if (least == root).all():
            break
        root = least[least]
    return pd.DataFrame({"cid": pdf["cid"][hit], "links": count[hit], "root": pdf["cid"].to_numpy()[root[hit]]})


def verified(listed: DataFrame, pivots: int, threshold: float = THRESHOLD, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """(cid, links, root) from every pair of blocks of every list."""
    keys = ["label", "dim", "pivot"]
    sizes = listed.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = listed.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    met = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "*", F.least("block", "_other").alias("low"), F.greatest("block", "_other").alias("high")).drop("_other", "blocks")
    return met.groupBy(*keys, "low", "high").applyInPandas(
        partial(_verify, threshold=threshold, shared=shared, pivots=pivots), "cid string, links long, root string")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """id, n_links, component_id and kept of every row."""
    rows, held = classes(vectors, id_col, vector, label)
    pivots = choose_pivots(held, held.count(), threshold)
    listed = settle(postings(held, pivots), "postings")
    found = settle(verified(listed, max([len(p) for p in pivots.values()], default=1), threshold), "links")
    linked = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = components(found.select("cid", "root"), "cid", "root")
    named = (held.join(linked, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
             .select("cid", "label", "vector", "rep", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("root")))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    done = settle(named.join(least, "root").select("label", "vector", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"), "done")
    out = rows.join(done, ["label", "vector"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      component.eqNullSafe(F.col("id")).alias("kept"))
