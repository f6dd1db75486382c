"""Sharding through fixed virtual slots (DataFrame functions only).

Every record is hashed by its id into one of ``slots`` virtual slots; the number of slots never changes.  A
versioned table maps slots to shards: version 1 deals slots in turn, and a rebalancing writes the next version,
in which only some slots have moved.  Bytes are aggregated per slot, so the plan of a rebalancing sees one row
per slot (``slots`` rows, whatever the table size) and records are never compared with each other.

Defined results: a null text has no bytes (size 1); null ids share a slot; repeated ids share a slot and get
places of their own; an empty table gives an empty result and map version 1 only; extra columns are ignored.
A record id should be nearly unique: all rows of one id live in one slot, hence in one shard.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from gridwright.llm.store import settle

SLOTS = 4096


def measured(docs: DataFrame, id_col: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """One narrow row per record: id, size, text_crc32 and virtual_slot."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(slots)).cast("int").alias("virtual_slot"))


def first_map(slots: int, shards: int) -> list[int]:
    return [s % shards for s in range(slots)]


def _exchange(heavy: list[tuple[int, int]], light: list[tuple[int, int]], gap: int):
    """The slot to move, and the one to take in return (slot -1: none), that bring the two closest; None if nothing helps."""
    best = None
    partners = [(0, -1), *light]
    for w, slot in heavy:
        at = bisect_left(partners, (w - gap / 2, -1))
        for other in partners[max(0, at - 1):at + 1]:
            moved = w - other[0]
            if 0 < moved < gap and (best is None or (abs(gap - 2 * moved), slot, other[1]) < best[0]):
                best = ((abs(gap - 2 * moved), slot, other[1]), (w, slot), other)
    return best and best[1:]


def rebalanced(current: list[int], weights: dict[int, int], shards: int) -> list[int]:
    """The next map: slots move, or change places, from the heaviest to the lightest shard that this helps, until none does.

    The slot (or pair of slots) that comes closest to half of the difference is taken, ties by slot number.
    """
    out = list(current)
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(out):
        held[shard].append((weights.get(slot, 0), slot))
    for slots in held:
        slots.sort()
    totals = [sum(w for w, _ in slots) for slots in held]
    for _ in range(4 * len(out)):
        heavy = max(range(shards), key=lambda s: (totals[s], -s))
        for light in sorted(range(shards), key=lambda s: (totals[s], s)):
            if best := _exchange(held[heavy], held[light], totals[heavy] - totals[light]):
                break
        else:
            break
        for entry, source, target in ((best[0], heavy, light), (best[1], light, heavy)):
            if entry[1] >= 0:
                held[source].remove(entry)
                held[target].insert(bisect_left(held[target], entry), entry)
                out[entry[1]] = target
                totals[source] -= entry[0]
                totals[target] += entry[0]
    return out


def map_table(spark: SparkSession, versions: list[list[int]]) -> DataFrame:
    """(version, virtual_slot, shard), version 1 first; later versions list only the slots they move."""
    entries, known = [], {}
    for number, version in enumerate(versions, 1):
        moved = {slot: shard for slot, shard in enumerate(version) if known.get(slot) != shard}
        entries += [f"{number}:{slot}:{shard}" for slot, shard in moved.items()]
        known.update(moved)
    part = F.split("e", ":")
    return (spark.range(1).select(F.explode(F.split(F.lit(",".join(entries)), ",")).alias("e"))
            .select(*[part[i].cast("int").alias(c) for i, c in enumerate(("version", "virtual_slot", "shard"))]))


def active_map(table: DataFrame, version: int | None = None) -> DataFrame:
    """(virtual_slot, shard) as of ``version`` (default: the last)."""
    seen = table if version is None else table.filter(F.col("version") <= version)
    return seen.groupBy("virtual_slot").agg(F.max_by("shard", "version").alias("shard"))


def shard_by_bytes(docs: DataFrame, shards: int = 8, slots: int = SLOTS, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, map_version, and place: gapless from 0 within the shard."""
    spark = docs.sparkSession
    rows = settle(measured(docs, id_col, text, slots), "measured")
    per_slot = settle(rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "slots")
    # one row per virtual slot: never more than `slots` rows, at any input size
    weights = {r["virtual_slot"]: r["bytes"] for r in per_slot.select("virtual_slot", "bytes").collect()}
    base = first_map(slots, shards)
    versions = [base]
    if (edited := rebalanced(base, weights, shards)) != base:
        versions.append(edited)
    stored = settle(map_table(spark, versions), "slot-map")
    earlier = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    placed = (active_map(stored).join(per_slot, "virtual_slot")
              .select("virtual_slot", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before")))
    within = W.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    return (rows.join(F.broadcast(placed), "virtual_slot")  # at most `slots` rows of three numbers
            .select("doc_id", "size", "text_crc32", "virtual_slot", "shard", F.lit(len(versions)).alias("map_version"),
                    (F.col("_before") + F.row_number().over(within) - 1).alias("place")))
