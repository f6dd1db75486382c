"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

Pieces are dealt into strata by a hash (about STRATUM_PIECES each, so their number grows with the input) and
every stratum is packed by rounds over sorted runs: a run of documents is the pieces of one length, in the order
of a range sort by (length, id, piece); a run of gaps is sequences with equal room left.  One round sweeps both
sorted sides:

* the successor sweep counts, for each run, the gaps with room enough;
* conflicts are resolved by rank: the longest pieces are accepted as far as gaps suffice (a running minimum),
  then every accepted piece takes the smallest gap that leaves enough larger ones for the pieces above it;
* gaps are updated, split into runs again, and the next round begins.

Bands of lengths run from long to short.  Within a band a gap offers as many slots as surely fit; pieces left
without a gap open as many new sequences as their tokens need at least.  A stratum holds at most one run per
length, so a sweep works on a number of rows that the sequence length bounds; every stratum is a task of its own
and nothing passes through the driver.  The placed runs are spread to one row per piece and joined back by rank.

Defined results: a null or empty text is one piece that holds the closing token alone; a document longer than
the sequence is cut into full pieces and a rest; repeated rows are packed one by one; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from gridwright.llm import bpe
from gridwright.llm.store import settle
from gridwright.llm.text_batches import steps

SEQUENCE = 4096
CLOSING_ID = 1
STRATUM_PIECES = 65_536


# ---------------------------------------------------------------- pieces

def _cut(batches, tokenizer: str, sequence: int, closing: int, with_ids: bool):
    model = bpe.load(tokenizer)
    for part in steps(batches, "_text"):
        ids, ends = model.encode(part.column("_text").to_pylist())
        ids = np.insert(ids, ends[1:], closing).astype("<u4")
        ends = ends + np.arange(len(ends))
        size = np.diff(ends)
        pieces = -(-size // sequence)
        doc = np.repeat(np.arange(len(size)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * sequence
        length = np.minimum(size[doc] - start, sequence)
        first = ends[:-1][doc] + start
        body = memoryview(ids.tobytes())
        crc = [zlib.crc32(body[4 * a:4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist())]
        out = {"doc_id": part.column("doc_id").take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
               "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
        if with_ids:
            out["ids"] = bpe.list_array(ids.astype(np.int32), np.append(first, ends[-1]), pa.int32())
        yield pa.RecordBatch.from_pydict(out)


def cut(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", *, sequence: int = SEQUENCE,
        closing: int = CLOSING_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids on demand) of every piece of every document."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("_text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    return rows.mapInArrow(partial(_cut, tokenizer=tokenizer, sequence=sequence, closing=closing, with_ids=with_ids), schema)


# ---------------------------------------------------------------- rounds over runs

class Runs:
    """Gaps of one stratum as runs: room left, first sequence, number of sequences."""

    def __init__(self, sequence: int):
        self.sequence = sequence
        self.room = self.first = self.n = np.zeros(0, np.int64)
        self.opened = 0
        self.placed: list[np.ndarray] = []  # length, first rank, number, first sequence, offset

    def open(self, count: int) -> None:
        self.room = np.append(self.room, self.sequence)
        self.first = np.append(self.first, self.opened)
        self.n = np.append(self.n, count)
        self.opened += count

    def round(self, length: np.ndarray, rank: np.ndarray, count: np.ndarray, slots_of: int) -> np.ndarray:
        """Place pieces (runs by falling length); returns how many of each run were placed.

        One slot a gap, or ``room // slots_of`` slots for pieces of at most ``slots_of``.
        """
        per_gap = np.maximum(1, self.room // slots_of)
        use = np.flatnonzero(self.room >= length[-1])
        if not len(use):
            return np.zeros(len(length), np.int64)
        use = use[np.argsort(-self.room[use], kind="stable")]
        room, first, n, per_gap = self.room[use], self.first[use], self.n[use], per_gap[use]
        slot_room = np.where(per_gap > 1, slots_of, room)
        order = np.argsort(-slot_room, kind="stable")
        room, first, n, per_gap, slot_room = (x[order] for x in (room, first, n, per_gap, slot_room))
        slots = n * per_gap
        slot_end = np.cumsum(slots)
        # successor sweep: slots with room for each run
        fits = np.searchsorted(-slot_room, -length, side="right")
        able = np.where(fits > 0, slot_end[np.maximum(fits, 1) - 1], 0)
        # the longest first, as far as slots suffice
        wanted_end = np.cumsum(count)
        taken_end = wanted_end + np.minimum(0, np.minimum.accumulate(able - wanted_end))
        taken_end = np.maximum(taken_end, 0)
        taken = np.diff(taken_end, prepend=0)
        if not taken_end[-1]:
            return taken
        # best fit by rank: the smallest slot that keeps enough for the pieces above
        shift = np.minimum.accumulate((able - taken_end)[::-1])[::-1]
        live = taken > 0
        at = (taken_end - taken + shift)[live]  # first slot of each run
        size, its_rank, its_n = length[live], rank[live], taken[live]
        # cut both sides where either begins
        slot_start = slot_end - slots
        edges = np.unique(np.concatenate([at, at + its_n, slot_start, slot_end]))
        run_of = np.searchsorted(at, edges[:-1], side="right") - 1
        inside = (run_of >= 0) & (edges[:-1] < (at + its_n)[run_of])
        low, high, run_of = edges[:-1][inside], edges[1:][inside], run_of[inside]
        gap_of = np.searchsorted(slot_start, low, side="right") - 1
        self._take(low, high, size[run_of], its_rank[run_of] + low - at[run_of], gap_of, slot_start, room, first, n, per_gap, use[order])
        return taken

    def _take(self, low, high, size, rank, gap_of, slot_start, room, first, n, per_gap, source) -> None:
        """Slot j of a gap run belongs to its sequence j mod n: layer by layer over the run."""
        keep = np.ones(len(self.room), bool)
        new_room, new_first, new_n = [], [], []
        bounds = np.flatnonzero(np.diff(gap_of, prepend=-1))
        for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), len(gap_of)]):
            g = int(gap_of[a])
            width, base = int(n[g]), int(slot_start[g])
            cuts, parts = {0, width}, []
            for lo, hi, s, r in zip(low[a:b].tolist(), high[a:b].tolist(), size[a:b].tolist(), rank[a:b].tolist()):
                lo, hi = lo - base, hi - base
                while lo < hi:  # one layer at a time
                    end = min(hi, (lo // width + 1) * width)
                    parts.append((lo % width, lo % width + end - lo, s, r))
                    cuts |= {lo % width, lo % width + end - lo}
                    r += end - lo
                    lo = end
            edge = np.array(sorted(cuts))
            used = np.zeros(len(edge) - 1, np.int64)
            for x, y, s, r in parts:
                i, j = np.searchsorted(edge, [x, y])
                for k in range(i, j):
                    self.placed.append((s, r + edge[k] - x, edge[k + 1] - edge[k], first[g] + edge[k], self.sequence - room[g] + used[k]))
                used[i:j] += s
            keep[source[g]] = False
            new_room.append(room[g] - used)
            new_first.append(first[g] + edge[:-1])
            new_n.append(np.diff(edge))
        self.room = np.concatenate([self.room[keep], *new_room])
        self.first = np.concatenate([self.first[keep], *new_first])
        self.n = np.concatenate([self.n[keep], *new_n])
        alive = self.room > 0
        self.room, self.first, self.n = self.room[alive], self.first[alive], self.n[alive]


def pack_runs(length: np.ndarray, count: np.ndarray, sequence: int = SEQUENCE) -> tuple[list[tuple], int]:
    """Placements (length, first rank, number, first sequence, offset) of ``count`` pieces per length; sequences used."""
    order = np.argsort(-length)
    length, left = length[order].astype(np.int64), count[order].astype(np.int64)
    rank = np.zeros(len(length), np.int64)
    gaps = Runs(sequence)
    top = sequence
    while top >= 1:
        band = np.flatnonzero((length <= top) & (length > top // 2))
        while len(band := band[left[band] > 0]):
            took = gaps.round(length[band], rank[band], left[band], int(length[band[0]]))
            rank[band] += took
            left[band] -= took
            if not took.sum():
                # no gap holds the longest; those it leaves behind are tried again with the new sequences
                tokens, share = int((length[band] * left[band]).sum()), sequence // int(length[band[-1]])
                gaps.open(max(-(-tokens // sequence), -(-int(left[band].sum()) // share)))
        top //= 2
    return gaps.placed, gaps.opened


def _pack_stratum(pdf: pd.DataFrame) -> pd.DataFrame:
    placed, _ = pack_runs(pdf["length"].to_numpy(), pdf["n"].to_numpy(), int(pdf["_sequence"].iloc[0]))
    out = pd.DataFrame(placed, columns=["length", "rank", "n", "sequence", "offset"]).astype("int64")
    out.insert(0, "stratum", pdf["stratum"].iloc[0])
    return out


def pack(pieces: DataFrame, sequence: int = SEQUENCE, stratum_pieces: int = STRATUM_PIECES) -> DataFrame:
    """``pieces`` (doc_id, piece, length and any more columns) with ``sequence_id`` and ``offset``."""
    strata = max(1, -(-pieces.count() // stratum_pieces))
    dealt = pieces.withColumn("stratum", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(strata)).cast("int"))
    # a rank window holds the pieces of one length of one stratum: at most about stratum_pieces
    order = W.partitionBy("stratum", "length").orderBy("doc_id", "piece")
    ranked = settle(dealt.withColumn("_rank", F.row_number().over(order).cast("long") - 1), "ranked")
    histogram = ranked.groupBy("stratum", "length").agg(F.count(F.lit(1)).alias("n")).withColumn("_sequence", F.lit(sequence))
    runs = histogram.groupBy("stratum").applyInPandas(_pack_stratum, "stratum int, length long, rank long, n long, sequence long, offset long")
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    places = (runs.select("stratum", "length", "rank", "sequence", "offset", step.alias("_i"))
              .select("stratum", "length", (F.col("rank") + F.col("_i")).alias("_rank"),
                      ((F.col("sequence") + F.col("_i")) * strata + F.col("stratum")).alias("sequence_id"), "offset"))
    return ranked.join(places, ["stratum", "length", "_rank"]).drop("stratum", "_rank")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", sequence: int = SEQUENCE) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = settle(cut(docs, tokenizer, id_col, text, sequence=sequence), "pieces")
    return pack(pieces, sequence).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
