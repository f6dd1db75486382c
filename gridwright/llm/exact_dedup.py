"""Exact duplicates by progressive refinement: length, then a prefix hash, then the full hash.

Texts are equal when identical after lower-casing A-Z.  Rows are first grouped by byte length, the groups of
several rows by a hash of their first characters, and only rows of groups that survive both are read in
full.  The narrow levels carry three numbers a row; text moves once, beside the survivor flag of its group.

Defined results: a null text counts as empty; empty texts form one group; of equal texts the row with the
largest id stays, and a row repeated with its id counts in the group size and stays with it (the id is the
identity); a null id is smaller than any other; an empty table gives an empty result; extra columns are
carried in a struct, so their names cannot clash.  Groups of any size are safe: levels are aggregates with
map-side partial counts, and flags come back by joins that adaptive execution splits when a key is hot.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwright.llm.membership import without_ids
from gridwright.llm.store import LOWER, UPPER, packed, release, settle

PREFIX_CHARS = 256


def _full_hash(content: pd.Series) -> pd.Series:
    # bytes.lower() touches A-Z only
    return content.map(lambda b: None if b is None else hashlib.sha256(bytes(b).lower()).hexdigest())


def surviving_groups(docs: DataFrame, text: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """(``_n`` byte length, ``_p`` prefix hash) of the groups whose rows must be read in full."""
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = settle(docs.select(
        F.octet_length(body).alias("_n"), F.xxhash64(F.translate(F.left(body, F.lit(prefix_chars)), UPPER, LOWER)).alias("_p")), "lengths")
    lengths = narrow.groupBy("_n").count().filter("count > 1").select("_n")
    prefixes = narrow.join(lengths, "_n", "left_semi").groupBy("_n", "_p").count().filter("count > 1")
    out = settle(prefixes.select("_n", "_p", F.lit(True).alias("_survives")), "prefixes")
    release(narrow)
    return out


def mark_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", *, prefix_chars: int = PREFIX_CHARS, digest_all: bool = False
) -> DataFrame:
    """Rows packed as ``_row`` with ``keep_id``, ``group_size``, ``kept`` and ``digest``.

    ``digest`` is the SHA-256 of the normalised text: null for rows that no full reading was needed for,
    unless ``digest_all`` asks for it.
    """
    survivors = surviving_groups(docs, text, prefix_chars)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = packed(docs, _id=F.col(id_col), _body=body, _n=F.octet_length(body),
                  _p=F.xxhash64(F.translate(F.left(body, F.lit(prefix_chars)), UPPER, LOWER)))
    full_hash = F.pandas_udf(_full_hash, T.StringType())
    flagged = rows.join(survivors, ["_n", "_p"], "left")
    read = F.col("_body") if digest_all else F.when(F.col("_survives"), F.col("_body"))
    hashed = settle(flagged.select("_row", "_id", "_survives", full_hash(read.cast("binary")).alias("digest")), "hashed")
    groups = hashed.filter("_survives").groupBy("digest").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    several = groups.filter("group_size > 1")
    out = hashed.join(several, "digest", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    return out.select("_row", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                      keep.eqNullSafe(F.col("_id")).alias("kept"), "digest")


def dropped_ids(docs: DataFrame, id_col: str = "doc_id", text: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """(id) of the rows that go: those of which an equal text with a larger id exists.  Only ids and digests are kept of a text."""
    survivors = surviving_groups(docs, text, prefix_chars)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), body.alias("_body"), F.octet_length(body).alias("_n"),
                       F.xxhash64(F.translate(F.left(body, F.lit(prefix_chars)), UPPER, LOWER)).alias("_p"))
    full_hash = F.pandas_udf(_full_hash, T.StringType())
    hashed = settle(rows.join(survivors, ["_n", "_p"], "left_semi").select("id", full_hash(F.col("_body").cast("binary")).alias("digest")), "hashed")
    groups = hashed.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    out = settle(hashed.join(groups, "digest").filter("id < keep_id").select("id").distinct(), "dropped")
    release(hashed, survivors)
    return out


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns; rows without an id are not dropped.

    Only rows that a Bloom filter of the dropped ids lets through are joined with them; the others do not move.
    """
    return without_ids(docs, id_col, dropped_ids(docs, id_col, text))
