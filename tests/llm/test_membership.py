"""The Bloom filter of ids and the joins that use it."""

import random

import pytest

import corpus_pipeline
from gridwright.llm import exact_dedup, membership, secret_scan
from gridwright.llm.store import settle


@pytest.mark.parametrize("n", [0, 1, 300, 20_000])
def test_no_listed_id_is_missed(spark, n):
    ids = settle(spark.range(n).selectExpr("id * 7 AS k", "CASE WHEN id % 3 = 0 THEN NULL ELSE concat('t', id) END AS s"))
    rows = spark.range(60_000).selectExpr("id AS k", "CASE WHEN id % 7 = 0 AND id div 7 % 3 = 0 THEN NULL ELSE concat('t', id div 7) END AS s", "id AS _row")
    maybe, rest = membership.split(rows, ["k", "s"], ids, ["k", "s"])
    there = {r.k for r in maybe.collect()}
    listed = {k for k in range(0, 7 * n, 7) if k < 60_000}
    assert listed <= there and maybe.count() + rest.count() == 60_000 and maybe.columns == rows.columns
    assert len(there) - len(listed) <= 0.03 * 60_000


def test_rows_that_stay(frame):
    docs = frame([(i, f"text {i}", i) for i in range(50)] + [(None, "x", 1), (3, "text 3", 7)], "doc_id long, _gone string, _row long")
    gone = settle(docs.filter("doc_id % 5 = 3").select("doc_id").distinct())
    out = membership.without_ids(docs, "doc_id", gone)
    assert out.dtypes == docs.dtypes
    assert sorted((str(r.doc_id) for r in out.collect())) == sorted([str(i) for i in range(50) if i % 5 != 3] + ["None"])


def test_clashing_names_in_the_stages(spark, frame):
    rng = random.Random(1)
    body = " ".join(rng.choices("red green blue yellow house tree river".split(), k=60))
    token = f"{rng.getrandbits(160):040x}"
    rows = [(1, body, "a", "g", 1, 2), (2, body.upper(), "a", "g", 1, 2), (3, f'{body} token = "{token}"', "a", "g", 1, 2), (4, "other words here", None, "g", 1, 2)]
    docs = frame(rows, "doc_id long, text string, source string, _gone string, _spans int, _bits int")
    assert {r.doc_id for r in exact_dedup.drop_duplicates(docs).collect()} == {2, 3, 4}
    near = corpus_pipeline.near_duplicates(spark, docs, "")
    assert {r.doc_id for r in near.collect()} >= {1, 4} and near.columns == docs.columns
    out = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert out[3].text == f'{body} token = "[secret]"' and out[1].text == body and out[3]._gone == "g" and len(out) == 4
