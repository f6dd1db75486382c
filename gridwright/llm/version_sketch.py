"""Document fingerprints as invertible Bloom lookup sketches, and what differs between two versions.

A text is cut into paragraphs at its line ends, and a paragraph into passages at content-defined points (a hash of
the last four bytes, one byte in ``PASSAGE_BYTES`` on average; after ``LONGEST`` bytes at the latest), so that an edit changes the passages it touches and no
other.  Every passage is a 64-bit digest, numbered when it repeats.  A sketch throws each digest into three of its cells;
a cell keeps a count, the exclusive or of its digests and of their checks.  Two sketches subtract cell by cell: what both
texts hold cancels, and peeling (a cell with one digest left gives it away, which empties two more) recovers the
digests of either side.  Where peeling gets stuck the sketch was too small: the second size is guessed from the counts of
the first difference, and every further one is ``GROWTH`` times larger, under new hashes, until all are recovered; only
the guess of a size is an estimate.  The likeness is the Jaccard similarity
that follows: with d digests recovered of a + b, (a + b - d) / (a + b + d).

``compare_versions`` compares two text columns of a row.  ``edited_chain`` gives every document the one after it in the order of
ids: distinct ids are numbered exactly, every n-th key becomes a bound (as many as shuffle partitions; the driver holds
nothing else), rows are dealt by these bounds in one exchange, and the first row of a range travels to the range before
as well.  Ranges are read in descending order, so a task keeps one successor and no more.

Defined results: a null text is an empty one, without passages; two texts without passages have likeness 1; equal texts have equal
fingerprints; null ids come first; rows that share an id are ordered by hash and text, and a row repeated with id and text is one
document, whose result is repeated; the only document of a table follows itself; very long texts are read whole (a task holds
two of them and their edited text); an empty table gives an empty result; the input row is carried as ``_row``, so no further column can
clash.  Repeated rows of one id and text share a task, which streams them.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.functions.ranking import global_position
from gridwright.llm.store import packed
from gridwright.llm.text_batches import STEP_BYTES, steps

PASSAGE_BYTES = 16
LONGEST = 64
#: Cells of the smallest sketch, which is the fingerprint; a multiple of HASHES.
CELLS = 12
HASHES = 3
GROWTH = 4
#: Cells of the second sketch for each digest that is expected to differ.
SPARE = 1.5
#: Cells worked on at once.
STEP_CELLS = 1 << 20
STEP_WINDOW = 1 << 20
#: A cell as it stands in a fingerprint.
CELL = np.dtype([("count", "<i4"), ("check", "<u4"), ("key", "<u8")])
#: Odd multipliers of the SplitMix64 finaliser and of Fibonacci hashing: fixed values.
MIX_1, MIX_2, GOLDEN_64, GOLDEN_32 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0x9E3779B1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def _salted(x: np.ndarray, salt: int) -> np.ndarray:
    return _mix(x + np.uint64(salt * GOLDEN_64 & 0xFFFFFFFFFFFFFFFF))


# ---------------------------------------------------------------- passages

#: One word for every byte at every place of a passage.
TABLE = _mix(np.arange(1, LONGEST * 256 + 1, dtype=np.uint64) * np.uint64(GOLDEN_64))


@dataclass
class Passages:
    """Distinct digests of several texts, those of text i at ``offsets[i]`` to ``offsets[i + 1]``."""
    keys: np.ndarray
    offsets: np.ndarray

    def pick(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All digests of the chosen texts and, beside each, the place of its text in ``texts``."""
        sizes = self.offsets[texts + 1] - self.offsets[texts]
        owner = np.repeat(np.arange(len(texts)), sizes)
        inside = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner]
        return self.keys[self.offsets[texts][owner] + inside], owner

    def sizes(self) -> np.ndarray:
        return np.diff(self.offsets)


def _cuts(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Where passages end: after line ends, at content-defined points, and with their text."""
    cut = np.zeros(len(data), bool)
    for a in range(0, len(data), STEP_WINDOW):
        base = max(a - 3, 0)
        piece = data[base:a + STEP_WINDOW].astype(np.uint32)
        window = piece.copy()
        for k in (1, 2, 3):
            window[k:] |= piece[:-k] << np.uint32(8 * k)
        hit = (window * np.uint32(GOLDEN_32) >> np.uint32(16)) % np.uint32(PASSAGE_BYTES) == 0
        cut[a:a + STEP_WINDOW] = hit[a - base:]
    for k in range(3):  # a window does not reach into the text before
        at = starts + k
        cut[at[at < stops]] = False
    cut |= data == 10
    cut[stops[stops > starts] - 1] = True
    ends = np.flatnonzero(cut) + 1
    # a stretch without such points (a repeated word) is cut at fixed steps from its start
    begins = np.concatenate([[0], ends])[:-1]
    pieces = -(-(ends - begins) // LONGEST)
    last = np.cumsum(pieces)
    step = np.arange(1, pieces.sum() + 1) - np.repeat(last - pieces, pieces)
    return np.minimum(np.repeat(begins, pieces) + step * LONGEST, np.repeat(ends, pieces))


def _digests(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tabulation hashes: the exclusive or of one word for every byte at its place in the passage."""
    keys = np.zeros(len(ends), np.uint64)
    for a in range(0, len(ends), STEP_WINDOW // LONGEST):
        first, last = begins[a:a + STEP_WINDOW // LONGEST], ends[a:a + STEP_WINDOW // LONGEST]
        place = np.arange(first[0], last[-1]) - np.repeat(first, last - first)
        words = TABLE[place << 8 | data[first[0]:last[-1]]]
        keys[a:a + len(first)] = np.bitwise_xor.reduceat(words, first - first[0])
    return keys


def passages(texts: pa.Array) -> Passages:
    """The passages of every text; ``texts`` has no nulls."""
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0]:bounds[-1]] if raw is not None else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    starts, stops = bounds[:-1], bounds[1:]
    ends = _cuts(data, starts, stops)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    owner = np.searchsorted(stops, ends, "left")
    keys = _digests(data, begins, ends)
    # number the repeats of a digest within its text
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    ordinal = np.arange(len(keys)) - np.repeat(at, np.diff(at, append=len(keys)))
    keys = _mix(keys + ordinal.astype(np.uint64) * np.uint64(GOLDEN_64))
    # two numbered digests that collide would cancel: keep one
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    fresh[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    keys, owner = keys[fresh], owner[fresh]
    return Passages(keys, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int64))


# ---------------------------------------------------------------- sketches

class Cells(NamedTuple):
    """The cells of several sketches, one array for each of their parts."""
    count: np.ndarray
    check: np.ndarray
    key: np.ndarray


def _places(keys: np.ndarray, owner: np.ndarray, cells: int) -> np.ndarray:
    """The HASHES cells of every digest; a sketch of another size hashes anew."""
    third = cells // HASHES
    return np.stack([owner * cells + k * third + (_salted(keys, cells + k) % np.uint64(third)).astype(np.int64) for k in range(HASHES)])


def _check(keys: np.ndarray) -> np.ndarray:
    return (_salted(keys, -1) >> np.uint64(32)).astype(np.uint32)


def _throw(table: Cells, keys: np.ndarray, owner: np.ndarray, cells: int, sign: np.ndarray | int) -> np.ndarray:
    check = _check(keys)
    places = _places(keys, owner, cells)
    signs = np.full(len(keys), sign, np.int32)
    for row in places:
        np.add.at(table.count, row, signs)
        np.bitwise_xor.at(table.key, row, keys)
        np.bitwise_xor.at(table.check, row, check)
    return places


def sketches(found: Passages, texts: np.ndarray, cells: int) -> Cells:
    """The sketches of the chosen texts, ``cells`` each."""
    table = Cells(*(np.zeros(len(texts) * cells, CELL[part]) for part in Cells._fields))
    keys, owner = found.pick(texts)
    _throw(table, keys, owner, cells, 1)
    return table


def subtract(a: Cells, b: Cells) -> Cells:
    return Cells(a.count - b.count, a.check ^ b.check, a.key ^ b.key)


def peel(table: Cells, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, side) of all that can be recovered from differences, and which of them are now empty; works in place."""
    gone = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    look = np.arange(len(table.count))
    while len(look):
        pure = look[np.abs(table.count[look]) == 1]
        pure = pure[_check(table.key[pure]) == table.check[pure]]
        pair, keys, side = pure // cells, table.key[pure], table.count[pure]
        order = np.lexsort((keys, pair))
        pair, keys, side, pure = pair[order], keys[order], side[order], pure[order]
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (pair[1:] != pair[:-1])
        pair, keys, side, pure = pair[first], keys[first], side[first], pure[first]
        own = (_places(keys, pair, cells) == pure).any(axis=0)  # a mixture that passes the check by chance lies elsewhere
        pair, keys, side = pair[own], keys[own], side[own]
        look = _throw(table, keys, pair, cells, -side).ravel()
        for kept, new in zip(gone, (pair, keys, side)):
            kept.append(new)
    empty = ~((table.count != 0) | (table.key != 0)).reshape(-1, cells).any(axis=1)
    return *(np.concatenate(kept) for kept in gone), empty


def smallest(found: Passages) -> Cells:
    """The sketches of all texts at the size of a fingerprint."""
    return sketches(found, np.arange(len(found.offsets) - 1), CELLS)


def _rows(table: Cells, texts: np.ndarray) -> Cells:
    return Cells(*(part.reshape(-1, CELLS)[texts].ravel() for part in table))


def _expected(table: Cells, apart: np.ndarray) -> np.ndarray:
    """About how many digests differ: the squares of the counts of a difference, less what the surplus of one side adds to each."""
    third = CELLS // HASHES
    squares = (table.count.astype(np.float64) ** 2).reshape(-1, CELLS).sum(axis=1) / HASHES
    return (squares - apart.astype(np.float64) ** 2 / third) / (1 - 1 / third)


def differences(a: Passages, at: np.ndarray, b: Passages, bt: np.ndarray,
                small: tuple[Cells, Cells] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, side) of every digest that one text of a pair holds and the other does not; side 1 is ``a``, -1 ``b``.

    The smallest sketches (``small``, of all texts on either side) are tried first; their counts say how large the next ones
    should be.  A wrong guess costs another round and nothing else.
    """
    out = [], [], []
    small = small or (smallest(a), smallest(b))
    apart = np.abs(a.sizes()[at] - b.sizes()[bt])
    table = subtract(_rows(small[0], at), _rows(small[1], bt))
    likely = np.maximum(np.minimum(_expected(table, apart), a.sizes()[at] + b.sizes()[bt]), apart)
    doublings = np.maximum(np.ceil(np.log2(np.maximum(SPARE * likely / CELLS, 1))), 1).astype(np.int64)
    need = CELLS << doublings

    def keep(some, pair, keys, side, empty):
        done = empty[pair]
        for kept, new in zip(out, (some[pair[done]], keys[done], side[done])):
            kept.append(new)
        return some[~empty]

    waiting = keep(np.arange(len(at)), *peel(table, CELLS))
    while len(waiting):
        cells = int(need[waiting].min())
        late, ready = [waiting[need[waiting] > cells]], waiting[need[waiting] == cells]
        for s in range(0, len(ready), max(1, STEP_CELLS // cells)):
            some = ready[s:s + max(1, STEP_CELLS // cells)]
            failed = keep(some, *peel(subtract(sketches(a, at[some], cells), sketches(b, bt[some], cells)), cells))
            need[failed] = cells * GROWTH
            late.append(failed)
        waiting = np.concatenate(late)
    kinds = (np.int64, np.uint64, np.int32)
    return tuple(np.concatenate(kept) if kept else np.zeros(0, kind) for kept, kind in zip(out, kinds))


def likeness(a: Passages, at: np.ndarray, b: Passages, bt: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Jaccard similarity of every pair, from the recovered differences."""
    both = (a.sizes()[at] + b.sizes()[bt]).astype(np.float64)
    apart = np.bincount(pair, minlength=len(at))
    return np.where(both + apart > 0, (both - apart) / np.maximum(both + apart, 1), 1.0)


def fingerprints(small: Cells) -> list[str]:
    """Smallest sketches in hex."""
    table = np.empty(len(small.count), CELL)
    for part in Cells._fields:
        table[part] = getattr(small, part)
    rows = table.tobytes()
    size = CELLS * CELL.itemsize
    return [rows[i:i + size].hex() for i in range(0, len(rows), size)]


# ---------------------------------------------------------------- two versions in a row

DIFF = "struct<old_fingerprint: string, new_fingerprint: string, only_old: array<long>, only_new: array<long>, likeness: double>"


def _lists(pair: np.ndarray, keys: np.ndarray, rows: int) -> pa.Array:
    order = np.lexsort((keys, pair))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(pair, minlength=rows))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[order].view(np.int64)))


def _compare(batches):
    for part in steps((_with_both(b) for b in batches), "_both", STEP_BYTES):
        old, new = (pc.fill_null(part.column(c), "") for c in ("_old", "_new"))
        a, b, every = passages(old), passages(new), np.arange(part.num_rows)
        small = smallest(a), smallest(b)
        pair, keys, side = differences(a, every, b, every, small)
        diff = pa.StructArray.from_arrays([
            pa.array(fingerprints(small[0]), pa.string()), pa.array(fingerprints(small[1]), pa.string()),
            _lists(pair[side > 0], keys[side > 0], len(every)), _lists(pair[side < 0], keys[side < 0], len(every)),
            pa.array(likeness(a, every, b, every, pair))],
            names=["old_fingerprint", "new_fingerprint", "only_old", "only_new", "likeness"])
        yield pa.RecordBatch.from_arrays([part.column("_row"), diff], names=["_row", "_diff"])


def _with_both(batch: pa.RecordBatch) -> pa.RecordBatch:
    both = pc.binary_join_element_wise(pc.fill_null(batch.column("_old"), ""), pc.fill_null(batch.column("_new"), ""), "")
    return batch.append_column("_both", both)


def compare_versions(rows: DataFrame, old: str, new: str) -> DataFrame:
    """``_row`` and ``_diff``: fingerprints of both texts, the passage digests only one of them holds, and their likeness."""
    kind = f"_row {rows.schema.simpleString()}, _diff {DIFF}"
    return packed(rows, _old=F.col(old), _new=F.col(new)).mapInArrow(_compare, kind)


# ---------------------------------------------------------------- every document, its edited text and its successor

CHAIN = ("struct<n_chars: bigint, edited: string, fingerprint: string, edited_fingerprint: string, near_edited: double, near_next: double>")


def _order(key) -> tuple:
    return tuple((v is not None, 0 if v is None else v) for v in key)


def _route(batches, id_col, bounds):
    for batch in batches:
        ids = pc.struct_field(batch.column("_row"), id_col).to_pylist()
        keys = [_order(k) for k in zip(ids, batch.column("_h").to_pylist())]
        bucket = np.array([bisect.bisect_right(bounds, k) - 1 for k in keys], np.int32)
        first = np.array([bounds[b] == k for b, k in zip(bucket.tolist(), keys)], bool)
        twice = np.concatenate([np.arange(len(keys)), np.flatnonzero(first)])
        ahead = np.arange(len(twice)) >= len(keys)
        placed = np.where(ahead, (bucket[twice] - 1) % len(bounds), bucket[twice]).astype(np.int32)
        rows = batch.take(pa.array(twice))
        yield pa.RecordBatch.from_arrays([rows.column("_row"), rows.column("_h"), pa.array(placed), pa.array(ahead)],
                                         names=["_row", "_h", "_bucket", "_ahead"])


def _chain(batches, id_col, text):
    current, after = None, None  # (bucket, id, text) of the last row read, and the text of the document that follows it
    for part in steps((_flat(b, id_col, text) for b in batches), "_body", STEP_BYTES):
        bodies = part.column("_body").to_pylist()
        texts, place, edited = [after, current and current[2]], [], []  # the texts read so far that a row may be followed by
        nearest = 0
        for key in zip(part.column("_bucket").to_pylist(), part.column("_id").to_pylist(), bodies):
            if key != current:
                # the first row of a bucket is the one ahead, which has no successor here
                nearest = len(texts) - 1 if current is not None and current[0] == key[0] else len(texts)
                after = texts[nearest] if nearest < len(texts) else key[2]
                current = key
            texts.append(key[2])
            place.append(nearest)
            cut = len(key[2]) // 4
            edited.append(key[2][:len(key[2]) - cut] + after[:cut])
        own, new = passages(pa.array([t or "" for t in texts], pa.string())), passages(pa.array(edited, pa.string()))
        keep = np.flatnonzero(~part.column("_ahead").to_numpy(zero_copy_only=False))
        place, at = np.array(place)[keep], keep + 2
        small, small_new = smallest(own), smallest(new)
        to_edited = likeness(own, at, new, keep, differences(own, at, new, keep, (small, small_new))[0])
        to_next = likeness(own, at, own, place, differences(own, at, own, place, (small, small))[0])
        made = pa.StructArray.from_arrays([
            pa.array([len(bodies[i]) for i in keep.tolist()], pa.int64()), pa.array([edited[i] for i in keep.tolist()], pa.string()),
            pa.array(fingerprints(_rows(small, at)), pa.string()), pa.array(fingerprints(_rows(small_new, keep)), pa.string()),
            pa.array(to_edited), pa.array(to_next)],
            names=["n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        yield pa.RecordBatch.from_arrays([part.column("_row").take(pa.array(keep)), made], names=["_row", "_print"])


def _flat(batch: pa.RecordBatch, id_col: str, text: str) -> pa.RecordBatch:
    row = batch.column("_row")
    return pa.RecordBatch.from_arrays(
        [row, batch.column("_bucket"), batch.column("_ahead"), pc.struct_field(row, id_col), pc.fill_null(pc.struct_field(row, text), "")],
        names=["_row", "_bucket", "_ahead", "_id", "_body"])


def edited_chain(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``_row`` and ``_print``: the text with its last quarter replaced by the start of the next document, both
    fingerprints, and the likeness to the edited text and to the next document."""
    spark = docs.sparkSession
    rows = packed(docs, _h=F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    keys = rows.select(F.col(f"_row.{id_col}").alias("id"), "_h").distinct()
    numbered = global_position(keys, [], [F.asc_nulls_first("id"), F.asc("_h")])
    pieces = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = max(1, -(-(numbered.agg(F.max("position")).first()[0] or 0) // pieces))
    bounds = sorted(_order(r) for r in numbered.filter((F.col("position") - 1) % every == 0).select("id", "_h").collect())
    routed = rows.mapInArrow(partial(_route, id_col=id_col, bounds=bounds), f"_row {docs.schema.simpleString()}, _h bigint, _bucket int, _ahead boolean")
    ordered = routed.repartitionById(max(1, len(bounds)), F.col("_bucket")).sortWithinPartitions(
        "_bucket", F.desc("_ahead"), F.desc_nulls_last(f"_row.{id_col}"), F.desc("_h"), F.desc_nulls_last(f"_row.{text}"))
    return ordered.select("_row", "_bucket", "_ahead").mapInArrow(
        partial(_chain, id_col=id_col, text=text), f"_row {docs.schema.simpleString()}, _print {CHAIN}")
