"""Language identification by rank-order profiles.

A document and a language are each described by their most frequent n-grams (one to three characters over
lower-cased letters, words joined by one boundary mark).  The out-of-place distance adds, for every n-gram of the
document, how far its rank is from the rank in the language's profile; an n-gram the profile lacks counts
``PROFILE`` places.  The nearest language wins, ties by name.

Profiles come from all training rows: each task adds up its own n-gram counts, Spark sums them per language and
keeps the first ``PROFILE`` of each.  Only those (languages x PROFILE rows) reach the driver and the tasks.

Defined results: a null text, or one without letters, or any text when nothing was learned, is ``und`` with score
0; rows with a null text or language teach nothing; repeated rows count each time and are predicted each time; an
empty table gives an empty result; further columns are carried through and never read.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.llm.bpe import LETTER, char_classes, code_points
from gridwright.llm.text_batches import steps

PROFILE = 300
UNKNOWN = "und"
BOUNDARY = 1  # no letter has this code point
STEP_CHARS = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    table = np.arange(0x110000, dtype=np.int64)
    table[char_classes() != LETTER] = BOUNDARY
    return table


def count_grams(texts: list[str | None]):
    """Per text the distinct n-gram codes (ascending) and their counts, empty without letters.

    A code holds up to three code points of 21 bits each.
    """
    lowered = [(t or "").lower() for t in texts]
    code = _letters()[code_points("\n".join(["", *lowered, ""]))]
    ends = np.cumsum([len(t) + 1 for t in lowered])
    # one boundary between words, and one on either side of a text
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != BOUNDARY) | (code[:-1] != BOUNDARY)
    upto = np.cumsum(keep)
    code = code[keep]
    two = code[:-1] << 21 | code[1:]
    three = two[:-1] << 21 | code[2:]
    starts = upto[np.concatenate([[0], ends[:-1]])] - 1
    stops = upto[ends]
    for a, b in zip(starts.tolist(), stops.tolist()):
        if b - a < 3:  # boundaries alone
            yield np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        one = code[a:b]
        grams = np.concatenate([one[one != BOUNDARY], two[a:b - 1], three[a:b - 2]])
        grams.sort()
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        yield grams[first], np.diff(first, append=len(grams))


def _add_up(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, place = np.unique(np.concatenate(codes), return_inverse=True)
    return distinct, np.bincount(place, np.concatenate(counts)).astype(np.int64)


def _gram_counts(batches):
    totals: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for part in steps(batches, "_text", STEP_CHARS):
        held: dict[str, list] = {}
        for lang, found in zip(part.column("_lang").to_pylist(), count_grams(part.column("_text").to_pylist())):
            held.setdefault(lang, []).append(found)
        for lang, found in held.items():
            if lang in totals:
                found.append(totals[lang])
            totals[lang] = _add_up([c for c, _ in found], [n for _, n in found])
    for lang, (codes, counts) in totals.items():
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(codes), pa.string()), "gram": pa.array(codes, pa.int64()), "n": pa.array(counts, pa.int64())})


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """(lang, gram, place): the profiles, place 0 being the most frequent n-gram."""
    rows = docs.select(F.col(text).alias("_text"), F.col(lang).cast("string").alias("_lang")).filter("_text IS NOT NULL AND _lang IS NOT NULL")
    counts = rows.mapInArrow(_gram_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # distinct n-grams of a language; only the first `size` leave each task
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("place", F.row_number().over(order) - 1).filter(F.col("place") < size).select("lang", "gram", "place")


class Profiles:
    """The learned profiles as one table of ranks: row = n-gram, column = language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64))
        self.rank = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        column = {lang: i for i, lang in enumerate(self.langs)}
        for lang, gram, place in rows:
            self.rank[np.searchsorted(self.grams, gram), column[lang]] = place

    def closest(self, codes: np.ndarray, counts: np.ndarray) -> tuple[str, float]:
        """Language and score: 1 less the mean out-of-place distance as a share of the profile size."""
        if not len(codes) or not self.langs:
            return UNKNOWN, 0.0
        order = np.argsort(-counts, kind="stable")[: self.size]
        codes = codes[order]
        at = np.searchsorted(self.grams, codes)
        at[at == len(self.grams)] = 0
        rank = np.where((self.grams[at] == codes)[:, None], self.rank[at], -1)
        apart = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(codes))[:, None])).sum(0)
        best = int(apart.argmin())
        return self.langs[best], 1.0 - float(apart[best]) / (self.size * len(codes))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        return [self.closest(*found) for found in count_grams(texts)]


def collect_profiles(learned: DataFrame, size: int = PROFILE) -> Profiles:
    """``size`` rows for each language and no more."""
    return Profiles([(r.lang, r.gram, r.place) for r in learned.collect()], size)


def _identify(batches, text: str, profiles: Profiles):
    for part in steps(batches, text, STEP_CHARS):
        found = profiles.predict(part.column(text).to_pylist())
        yield pa.RecordBatch.from_arrays(
            [*part.columns, pa.array([lang for lang, _ in found], pa.string()), pa.array([score for _, score in found], pa.float64())],
            [*part.schema.names, "lang_pred", "score"])


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """Rows packed as ``_row`` with ``_found`` (lang_pred, score)."""
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # by place: no name can clash
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    found = rows.mapInArrow(partial(_identify, text=f"c{docs.columns.index(text)}", profiles=profiles), schema)
    return found.select(F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]).alias("_row"), F.struct("lang_pred", "score").alias("_found"))


def held_out(id_column: Column) -> Column:
    """A third of the documents, by their id alone, that no profile learns from."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", *, hold_out: bool = True) -> DataFrame:
    """Rows packed as ``_row`` with held_out and ``_found`` (lang_pred, score).

    Learns from the labelled rows that are not held out, or from all of them without ``hold_out``.
    """
    profiles = collect_profiles(learn(docs.filter(~held_out(F.col(id_col))) if hold_out else docs, text, lang))
    return identify(docs, profiles, text).withColumn("held_out", held_out(F.col(f"_row.`{id_col}`")))
