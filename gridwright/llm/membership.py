"""A Bloom filter of ids, so that only rows that may be among them take part in a join.

A join of whole documents with a list of ids moves every text once the list is larger than Spark broadcasts.  Here
the list becomes a blocked Bloom filter: an id picks one block of 32,768 bits and sets ``HASHES`` bits in it.  The
filter has ``BITS_PER_ID`` bits an id, is built by one aggregate, and is broadcast only while it is within
``BROADCAST_BYTES`` (44 million ids); rows that fail it pass untouched, the others are joined exactly.  No listed id
ever fails, and about one other row in a hundred is joined for nothing.

Defined results: a null key may be listed like any other (the exact join decides); an empty list lets every row pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.llm.store import packed, settle

BLOCK_BITS = 32_768  # of bitmap_construct_agg
BITS_PER_ID = 12
HASHES = 5
BROADCAST_BYTES = 64 << 20


def _position(keys: Sequence[Column], k: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(k), *keys), F.lit(BLOCK_BITS)).cast("int")


def split(rows: DataFrame, keys: Sequence[str], ids: DataFrame, id_keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that may be listed, rows that are not) by the columns ``keys``; ``ids`` should be settled and distinct."""
    own, listed = [F.col(k) for k in keys], [F.col(k) for k in id_keys]
    blocks = max(1, -(-ids.count() * BITS_PER_ID // BLOCK_BITS))
    block = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(blocks))
    bits = settle(ids.select(block(listed).alias("_block"), F.explode(F.array(*[_position(listed, k) for k in range(HASHES)])).alias("_bit"))
                  .groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_bits")), "membership")
    if blocks * BLOCK_BITS // 8 <= BROADCAST_BYTES:
        bits = F.broadcast(bits)

    def is_set(k: int) -> Column:
        at = _position(own, k)
        byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, at.bitwiseAND(F.lit(7))) == 1

    held = rows.join(bits.withColumnRenamed("_block", "_own"), block(own) == F.col("_own"), "left")
    maybe = F.col("_bits").isNotNull() & reduce(lambda a, b: a & b, [is_set(k) for k in range(HASHES)])
    maybe = F.coalesce(maybe, F.lit(False))
    return held.filter(maybe).select(*rows.columns), held.filter(~maybe).select(*rows.columns)


def without_ids(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is not in ``ids`` (one column, settled, distinct); rows without an id stay."""
    listed = ids.toDF("_gone")
    maybe, rest = split(packed(docs, _id=F.col(id_col)), ["_id"], listed, ["_gone"])
    kept = maybe.join(listed, F.col("_id") == F.col("_gone"), "left_anti")
    return rest.unionByName(kept).select("_row.*")
