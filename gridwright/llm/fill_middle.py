"""Fill-in-the-middle documents, made batch by batch with ``pyarrow.compute``.

A text is split into line units (a line with its newline; the last may lack it).  The lists are flattened beside
their parent indices, every unit gets its ordinal within its document, two cut points give it a role (prefix,
middle or suffix), units are filtered by role, lists are rebuilt from the counts of each role, and ``binary_join``
makes one piece of each.  No Python loop runs over rows or units, nothing is shuffled, and a step holds about 2 MB
of text or one longer text.

Cut points and form come from a hash of the document id, so a rerun or a lost task gives the same output.
``restore`` rebuilds the text from an output and its form alone: a transformed text holds none of the three marks,
so the first occurrence of each in an output is its own.

Defined results: a null text is an empty one and stays plain, as does a text that holds a mark; a null id hashes
like an empty one; very long texts are read whole; rows repeated with their id give the same output each time; an
empty table gives an empty result; the input row is carried as ``_row``, so no further column can clash.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.llm.store import packed
from gridwright.llm.text_batches import STEP_BYTES, steps

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
SEED = 7
#: Per cent of the documents to transform, and of those in the order suffix, prefix, middle.
FIM_PERCENT, SPM_PERCENT = 100, 50
FIM_TYPE = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(id_col: Column, seed: int = SEED) -> Column:
    """Four unsigned 32-bit numbers from the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return F.struct(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)])


def line_units(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All units of ``texts`` (no nulls) in order, the index of each one's text, and the number of units per text."""
    lists = pc.split_pattern(texts, "\n")
    flat = pc.list_flatten(lists)
    parent = pc.list_parent_indices(lists).to_numpy()
    stop = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    last = np.zeros(len(flat), bool)
    last[stop - 1] = True  # a split has one entry at least
    ended = pc.if_else(pa.array(last), flat, pc.binary_join_element_wise(flat, "\n", ""))
    real = ~last | (pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0)
    return ended.filter(pa.array(real)), parent[real], np.bincount(parent[real], minlength=len(texts))


def _joined(units: pa.Array, chosen: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One string per text: the chosen units, ``counts`` of them for each text in turn."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), units.filter(pa.array(chosen))), "")


def _marked(texts: pa.Array) -> np.ndarray:
    found = np.zeros(len(texts), bool)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        found |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    return found


def fill_middle(texts: pa.Array, h: list[np.ndarray], fim_percent: int, spm_percent: int) -> pa.StructArray:
    units, parent, n = line_units(texts)
    ordinal = np.arange(len(parent)) - (np.cumsum(n) - n)[parent]
    cuts = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
    role = (ordinal >= cuts[0][parent]).astype(np.int8) + (ordinal >= cuts[1][parent])
    prefix, middle, suffix = (_joined(units, role == k, c) for k, c in enumerate((cuts[0], cuts[1] - cuts[0], n - cuts[1])))
    plain = (n == 0) | _marked(texts) | (h[2] % 100 >= fim_percent)
    spm = h[3] % 100 < spm_percent
    psm_text = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    spm_text = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    is_plain, is_spm, none = pa.array(plain), pa.array(spm), pa.scalar(None, pa.int64())
    return pa.StructArray.from_arrays([
        pa.array(n, pa.int64()),
        pc.if_else(is_plain, PLAIN, pc.if_else(is_spm, SPM, PSM)),
        pc.if_else(is_plain, none, pc.utf8_length(prefix).cast(pa.int64())),
        pc.if_else(is_plain, none, pc.utf8_length(middle).cast(pa.int64())),
        pc.if_else(is_plain, texts, pc.if_else(is_spm, spm_text, psm_text)),
    ], names=["n", "form", "prefix_chars", "middle_chars", "output"])


def _cut(texts: pa.Array, mark: str) -> tuple[pa.Array, pa.Array]:
    """What stands before and after the first ``mark``, which every text holds."""
    parts = pc.split_pattern(texts, mark, max_splits=1)
    return pc.list_element(parts, 0), pc.list_element(parts, 1)


def _between(outputs: pa.Array, here: pa.Array, first: str, second: str) -> tuple[pa.Array, pa.Array, pa.Array]:
    framed = pc.if_else(here, outputs, first + second + MIDDLE)  # other rows: a stand-in with all marks
    one, rest = _cut(pc.utf8_slice_codeunits(framed, len(first)), second)
    return one, *_cut(rest, MIDDLE)


def rebuilt(outputs: pa.Array, forms: pa.Array) -> pa.Array:
    """The texts behind ``outputs``."""
    is_psm, is_spm = pc.equal(forms, PSM), pc.equal(forms, SPM)
    p1, s1, m1 = _between(outputs, is_psm, PREFIX, SUFFIX)
    s2, p2, m2 = _between(outputs, is_spm, SUFFIX, PREFIX)
    return pc.if_else(is_psm, pc.binary_join_element_wise(p1, m1, s1, ""),
                      pc.if_else(is_spm, pc.binary_join_element_wise(p2, m2, s2, ""), outputs))


def _step_rows(rows: pa.RecordBatch, text: str) -> pa.RecordBatch:
    body = pc.fill_null(pc.struct_field(rows.column("_row"), text), "")
    return pa.RecordBatch.from_arrays([rows.column("_row"), rows.column("_h"), body], names=["_row", "_h", "_body"])


def _transform(batches, text, fim_percent, spm_percent):
    for part in steps((_step_rows(b, text) for b in batches), "_body", STEP_BYTES):
        h = [pc.struct_field(part.column("_h"), f"h{k}").to_numpy() for k in (1, 2, 3, 4)]
        made = fill_middle(part.column("_body"), h, fim_percent, spm_percent)
        yield pa.RecordBatch.from_arrays([part.column("_row"), made], names=["_row", "_fim"])


def transform(docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, seed: int = SEED,
              fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``_row`` (the input row) and ``_fim``: n units, form, prefix_chars, middle_chars, output."""
    rows = packed(docs, _h=draws(F.col(id_col), seed))
    out = f"_row {docs.schema.simpleString()}, _fim struct<{', '.join(': '.join(c.split()) for c in FIM_TYPE.split(', '))}>"
    return rows.mapInArrow(partial(_transform, text=text, fim_percent=fim_percent, spm_percent=spm_percent), out)


def _restore(batches):
    for part in steps(batches, "_output", STEP_BYTES):
        texts = rebuilt(pc.fill_null(part.column("_output"), ""), pc.fill_null(part.column("_form"), PLAIN))
        yield pa.RecordBatch.from_arrays([part.column("_row"), texts], names=["_row", "restored"])


def restore(made: DataFrame, output: Column | str, form: Column | str) -> DataFrame:
    """``_row`` (the input row) and ``restored``, the text behind ``output``; null outputs are empty ones."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = packed(made, _output=column(output), _form=column(form))
    return rows.mapInArrow(_restore, f"_row {made.schema.simpleString()}, restored string")
