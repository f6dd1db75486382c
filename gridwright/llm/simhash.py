"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints link at RADIUS = 3 or fewer differing bits.  Two fingerprints at distance 2 or less have a variant
in common when each emits its ball of radius 1; distance 3 needs radius 2 on one side.  Emitting radius 2 for
every fingerprint would cost 2,081 rows each, so the work is done in two steps over distinct fingerprints:

1. Crowding: for each of four 16-bit blocks, the block is left out and the variants within radius 1 of the other
   48 bits are emitted (4 x 49 rows).  Of up to three differing bits one lies in some block, so every linked
   pair meets in a variant.  Fingerprints that meet no other are done; no false meeting decides anything.
2. Links: the crowded fingerprints emit their balls on all 64 bits: radius 1 from each, and the sphere of radius 2
   from those of even parity.  On a variant everyone within radius 1 links to the least such fingerprint (at most
   2 bits), and so does everyone on the sphere (at most 3 bits).  A pair at distance 3 has one even member, so the
   two meet.  Every link emitted is real, and a variant with n members gives n links, never all pairs.

A variant of step 2 has at most 2,081 distinct members and one of step 1 at most 49 x 65,536, whatever the
number of documents, because equal fingerprints are collapsed first.

Defined results: a text that is null, empty or without words has fingerprint zero and links like any other;
fewer than three words are one shingle; repeated rows share a fingerprint; the component id is the least
document id reachable; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.components import components
from gridwright.llm.store import release, settle
from gridwright.llm.text_batches import steps

SHINGLE_WORDS, SEED, RADIUS = 3, 42, 3
BLOCKS, BLOCK_BITS = 4, 16
CHUNK = 1 << 16  # shingles counted at a time


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """64-bit fingerprint of a UTF-8 text: a bit is 1 if set in over half of the shingle hashes."""
    spelled = text.lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not spelled:
        return 0
    size = min(words, len(spelled))
    joined = b" ".join(spelled)
    ends = np.cumsum([len(w) + 1 for w in spelled]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(spelled) - size + 1].tolist()
    ends = ends[size - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(ends)
    for at in range(0, n, CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + CHUNK], ends[at:at + CHUNK])], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _fingerprints(batches, words: int):
    for part in steps(batches, "_text"):
        values = np.array([fingerprint(t or b"", words) for t in part.column("_text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("binary").alias("_text"))
    return rows.mapInArrow(partial(_fingerprints, words=words), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _spread(df: DataFrame) -> DataFrame:
    """One partition per shuffle partition: a small table that is about to grow."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")


def crowded(fps: DataFrame) -> DataFrame:
    """The fingerprints (column fp, distinct) that share a block-free variant with another one."""
    keep, flip = [], []
    for block in range(BLOCKS):
        hidden = ((1 << BLOCK_BITS) - 1) << block * BLOCK_BITS
        for bit in [None, *(i for i in range(64) if not hidden >> i & 1)]:
            keep.append(_signed(~hidden))
            # the block's own bits hold a mark that keeps the blocks' variants apart
            flip.append(_signed((1 << block * BLOCK_BITS) | (0 if bit is None else 1 << bit)))
    pairs = F.arrays_zip(F.lit(keep).alias("k"), F.lit(flip).alias("x"))
    emitted = _spread(fps.select("fp")).select("fp", F.explode(pairs).alias("v")).select(
        "fp", F.col("fp").bitwiseAND(F.col("v.k")).bitwiseXOR(F.col("v.x")).alias("variant"))
    # group size: at most 49 x 65,536 distinct fingerprints
    return (emitted.selectExpr("fp", "variant", "min(fp) OVER (PARTITION BY variant) AS a", "max(fp) OVER (PARTITION BY variant) AS b")
            .filter("a < b").select("fp").distinct())


def links(fps: DataFrame) -> DataFrame:
    """Links (fp, hub) that connect the same fingerprints as all pairs within RADIUS do."""
    spread = _spread(fps.select("fp"))
    ones = [0, *(1 << i for i in range(64))]
    twos = [1 << i | 1 << j for i in range(64) for j in range(i)]
    near = spread.select("fp", F.explode(F.lit([_signed(x) for x in ones])).alias("x")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("x")).alias("variant"), F.col("fp").alias("_hub"))
    far = spread.filter(F.bit_count("fp") % 2 == 0).select("fp", F.explode(F.lit([_signed(x) for x in twos])).alias("x")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("x")).alias("variant"), F.lit(None).cast("long").alias("_hub"))
    # group size: at most 1 + 64 + 2,016 distinct fingerprints
    return (near.unionByName(far).selectExpr("fp", "min(_hub) OVER (PARTITION BY variant) AS hub")
            .filter("fp <> hub").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (signed long) and component_id of every document."""
    rows = settle(fingerprints(docs, id_col, text, words), "fingerprints")
    distinct = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct")
    close = settle(crowded(distinct), "crowded")
    roots = components(links(close), "fp", "hub")
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_doc", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = settle(rooted.join(least, "root").select("fp", "component_id"), "components")
    release(close, distinct)
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def fp_hex(fp):
    """A fingerprint column as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
