"""How a set of filters interacts: every order of application, audited in one pass over the documents.

Each document becomes a mask of the filters it fails.  A mask, with the document's labels, stands for one big
integer: a field for each of the 120 orders x 5 steps and each of six counts (kept, removed, redundant,
unique_fails, good_lost, toxic_lost), holding this document's contribution, 0 or 1.  Tasks add the integers of
their rows per part, Spark adds the sums, and the fields of a part's total are its counts.  A field is as wide as the number of
all rows needs, so no sum can overflow into its neighbour; the width is measured, not assumed.

A to D are column expressions.  E (the text of a smaller id) needs the table: rows are first counted by digest, id,
part, mask and labels, then the least id of each digest decides.  Both steps combine before the exchange, so a group
of copies of any size arrives as a few rows.  Partial sums travel as one row per task and part (about 3,600 fields of some bytes) and
are added in two levels, so that no task reads more than a small share of them.

Defined results: a null text is empty (fails A only, and E if an earlier one exists); a null part is the empty string;
a null id has no smaller id and is none; rows repeated with an id do not make each other fail E; of several labels of one id any
1 counts; very long texts are read whole; an empty table gives no row; further columns are not read.
"""

from __future__ import annotations

from functools import lru_cache, partial
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.llm.store import release, settle

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(ORDERS) * len(FILTERS)
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
GOOD, TOXIC = 1 << len(FILTERS), 2 << len(FILTERS)
SPACE = "[\\x20\\x09-\\x0D]+"
#: Parts a task holds before it hands its sums on.
HELD_PARTS = 256
SALTS = 64
REPORT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def text_mask(body: Column) -> Column:
    """Bits of the filters A to D that a text (not null) fails."""
    words = F.filter(F.split(body, SPACE), lambda w: w != "")
    shape = F.struct(F.size(words).cast("long").alias("n"), F.size(F.array_distinct(words)).cast("long").alias("u"))
    counted = F.transform(F.array(shape), lambda s: (s["n"] < 100).cast("int") + (100 * s["u"] < 80 * s["n"]).cast("int") * 2)[0]
    capitals = F.regexp_count(body, F.lit("[A-Z]")).cast("long")
    return (counted + (100 * capitals > 10 * F.length(body)).cast("int") * 4 + body.rlike("[#$%&*|]").cast("int") * 8).cast("int")


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, rows): how many rows fail just the filters in ``mask``; GOOD and TOXIC are bits of it as well."""
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_mask(body).alias("mask"),
                         F.when(F.col(id_col).isNotNull(), F.unhex(F.sha2(body, 256))).alias("digest"))
    flags = (labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_labelled"))
             .agg(F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0)).alias("_good"),
                  F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0)).alias("_toxic")))
    marked = narrow.join(flags, F.col("id") == F.col("_labelled"), "left").select(
        "id", "part", "digest", (F.col("mask") + F.coalesce("_good", F.lit(0)) + F.coalesce("_toxic", F.lit(0))).alias("mask"))
    repeats = marked.groupBy("digest", "id", "part", "mask").agg(F.count(F.lit(1)).alias("rows"))
    groups = repeats.groupBy("digest", "part", "mask").agg(F.sum("rows").alias("rows"), F.min(F.struct("id", "rows")).alias("first"))
    # a digest has a row per part and labels here, not one per copy
    least = F.expr("min(first.id) OVER (PARTITION BY digest)")
    holds = F.when(F.col("digest").isNull(), F.col("rows")).when(F.col("first.id") == F.col("least"), F.col("first.rows")).otherwise(0)
    split = groups.withColumn("least", least).withColumn("unique", holds)
    cases = F.array(F.struct("mask", F.col("unique").alias("rows")),
                    F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), (F.col("rows") - F.col("unique")).alias("rows")))
    return split.select("part", F.explode(cases).alias("c")).filter("c.rows > 0").select("part", "c.mask", "c.rows")


def contribution(mask: int) -> np.ndarray:
    """What one row of this mask adds to each count at each step of each order: an array of 0 and 1."""
    out = np.zeros((len(COUNTS), len(ORDERS), len(FILTERS)), np.uint8)
    for o, order in enumerate(ORDERS):
        gone = False
        for s, name in enumerate(order):
            bit = 1 << FILTERS.index(name)
            fails = bool(mask & bit)
            removed = fails and not gone
            out[:, o, s] = (not gone and not fails, removed, fails and gone, mask & (GOOD - 1) == bit, removed and bool(mask & GOOD), removed and bool(mask & TOXIC))
            gone |= fails
    return out


@lru_cache(maxsize=4)
def _packer(width: int):
    """mask -> big integer with fields of ``width`` bytes."""
    @lru_cache(maxsize=None)
    def integer(mask: int) -> int:
        fields = np.zeros((len(COUNTS) * STEPS, width), np.uint8)
        fields[:, 0] = contribution(mask).reshape(-1)
        return int.from_bytes(fields.tobytes(), "little")
    return integer


def field_width(rows: int) -> int:
    """Bytes that hold any count up to ``rows``."""
    return max(1, (rows.bit_length() + 7) // 8)


def unpack(total: int, width: int) -> np.ndarray:
    """The fields of a sum, by count, order and step."""
    cells = np.frombuffer(total.to_bytes(len(COUNTS) * STEPS * width, "little"), np.uint8).reshape(-1, width).astype(np.int64)
    return (cells << (8 * np.arange(width))).sum(axis=1).reshape(len(COUNTS), len(ORDERS), len(FILTERS))


def _batch(parts: dict[str, int], width: int) -> pa.RecordBatch:
    size = len(COUNTS) * STEPS * width
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.string()), pa.array([t.to_bytes(size, "little") for t in parts.values()], pa.binary())],
                                      names=["part", "packed"])


def _sum_masks(batches, width):
    integer = _packer(width)
    held: dict[str, int] = {}
    for batch in batches:
        counted = pa.table(batch.columns, names=batch.schema.names).group_by(["part", "mask"]).aggregate([("rows", "sum")]).to_pydict()
        for part, mask, rows in zip(counted["part"], counted["mask"], counted["rows_sum"]):
            held[part] = held.get(part, 0) + rows * integer(mask)
            if len(held) >= HELD_PARTS:
                yield _batch(held, width)
                held = {}
    if held:
        yield _batch(held, width)


def _add(rows: pa.Table, width: int) -> pa.Table:
    total = sum(int.from_bytes(cell.as_buffer(), "little") for cell in rows.column("packed"))
    return pa.Table.from_batches([_batch({rows.column("part")[0].as_py(): total}, width)])


def _report(batches, width):
    orders = np.repeat(ORDERS, len(FILTERS)).tolist()
    places = np.array([[FILTERS.index(name) for name in order] for order in ORDERS])
    for batch in batches:
        for part, cell in zip(batch.column("part").to_pylist(), batch.column("packed")):
            counts = unpack(int.from_bytes(cell.as_buffer(), "little"), width)
            over_orders = np.array([counts[COUNTS.index("removed")][places == k].sum() for k in range(len(FILTERS))])
            yield pa.RecordBatch.from_arrays([
                pa.array([part] * STEPS, pa.string()), pa.array(orders, pa.string()),
                pa.array(np.tile(np.arange(1, len(FILTERS) + 1), len(ORDERS)), pa.int32()),
                *[pa.array(c.reshape(-1), pa.int64()) for c in counts],
                pa.array(over_orders[places].reshape(-1), pa.int64()),
            ], names=["part", "filter_order", "step", *COUNTS, "shapley"])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step."""
    masks = settle(failures(docs, labels, id_col, text, part), "masks")
    width = field_width(masks.agg(F.sum("rows")).first()[0] or 0)
    kind = "part string, packed binary"
    sums = masks.mapInArrow(partial(_sum_masks, width=width), kind)

    def add(rows: pa.Table) -> pa.Table:
        return _add(rows, width)

    salted = sums.withColumn("salt", F.spark_partition_id() % SALTS).groupBy("part", "salt").applyInArrow(add, kind)
    totals = settle(salted.groupBy("part").applyInArrow(add, kind), "packed")  # SALTS rows a part at most
    release(masks)
    return totals.mapInArrow(partial(_report, width=width), REPORT)
