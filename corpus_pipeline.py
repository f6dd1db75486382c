"""A training-data pipeline of five stages, each one call of an operator in ``gridwright.llm``.

Documents whose language cannot be told go; of equal texts the row with the largest id stays; of SimHash groups
(three-word shingles, at most three bits apart) the document with the least id stays; secrets are masked; what is
left is packed into sequences.  Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept.

Defined results: rows with null or empty texts go in the first stage; null ids are kept and never match another
row; rows repeated with their id stay together; an empty table gives an empty result; further columns of ``docs``
are kept up to the last stage, whose columns are those of the packing.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm import exact_dedup, langid, packing, secret_scan, simhash
from gridwright.llm.membership import without_ids
from gridwright.llm.queries import tokenizer_path
from gridwright.llm.store import release, settle
from gridwright.llm.text_batches import bound_batches

#: A document farther than this from every profile (0: nothing in common) is in none of the languages.
MIN_LANGUAGE_SCORE = 0.2


def bounded(stage):
    """The stage on small Arrow batches: all stages run in the same executors, whose memory adds up."""
    @wraps(stage)
    def run_bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)
    return run_bounded


@bounded
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify_documents(docs, hold_out=False)
    told = (F.col("_found.lang_pred") != langid.UNKNOWN) & (F.col("_found.score") >= MIN_LANGUAGE_SCORE)
    return found.filter(told).select("_row.*")


@bounded
def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


@bounded
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = settle(simhash.near_duplicates(docs).filter("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return without_ids(docs, "doc_id", gone)


@bounded
def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


@bounded
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scan", mask_secrets),
    ("best_fit_packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        before = docs
        docs = settle(stage(spark, docs, sf_dir), name)
        if at:
            release(before)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
