"""The pipeline, stage by stage, against plain Python on the rows each stage was given."""

import random
import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from gridwright.llm import langid
from test_simhash import LOWER, plain_components, plain_fingerprint

SF = "/root/testdata/sf0.01"


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = [by_id(docs)]
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = corpus_pipeline.settle(stage(spark, docs, SF))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        docs = out
        given.append(by_id(docs))
    start, told, exact, near, clean = given
    assert set(told) == {i for i, r in start.items() if re.search(r"[^\W\d_]", r.text or "")}
    largest = {}
    for i, r in told.items():
        key = r.text.translate(LOWER)
        largest[key] = max(i, largest.get(key, i))
    assert set(exact) == set(largest.values())
    roots = plain_components({i: plain_fingerprint(r.text) for i, r in exact.items()})
    assert set(near) == set(roots.values()) and len(near) <= len(exact)
    assert set(clean) == set(near)
    for i, r in clean.items():
        assert r.text == re.sub(r'(?i)(token = ")[0-9a-f]{40}(")', r"\1[secret]\2", near[i].text) and r.n_chars == len(r.text)
    rows = corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {i: 1 + len(library.encode(r.text, add_special_tokens=False).ids) for i, r in clean.items()}
    assert {i: sum(r.length for r in rows if r.doc_id == i) for i in sizes} == sizes
    assert len({r.sequence_id for r in rows}) <= -(-sum(sizes.values()) // 4096) + 1


def test_one_document_of_a_near_group_stays(spark, frame):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(4000)]
    texts = {0: " ".join(words), 99: " ".join(reversed(words))}
    for i in range(1, 9):
        texts[i] = " ".join([*words[:i * 300], "changed", *words[i * 300 + 1:]])
    roots = plain_components({i: plain_fingerprint(t) for i, t in texts.items()})
    assert len(set(roots.values())) < 6 and roots[99] == 99
    out = corpus_pipeline.near_duplicates(spark, frame(list(texts.items()), "doc_id long, text string"), SF)
    assert {r.doc_id for r in out.collect()} == set(roots.values())


def test_odd_rows_pass_every_stage(spark, frame):
    rows = [(1, None, "en", "s", 0, 1), (2, "", "en", "s", 0, 1), (3, "the cat sat on the mat " * 9, "en", "s", 1, 1), (3, "the cat sat on the mat " * 9, "en", "s", 1, 1),
            (None, "a dog ran in the old park " * 9, None, None, None, 1), (5, "12345 !!", "en", "s", 8, 1), (6, "word " * 30000, "en", "s", 9, 1)]
    docs = frame(rows, "doc_id long, text string, lang string, source string, n_chars long, score int")
    for table in (docs, docs.filter("false")):
        out = table
        for _, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.settle(stage(spark, out, SF))
        assert sorted((r.doc_id for r in out.filter("piece = 0").collect()), key=str) == (sorted([3, 3, None, 6], key=str) if table is docs else [])
    assert langid.UNKNOWN == "und"


def test_stages_read_small_batches(spark):
    docs = spark.range(9_000).selectExpr("id as doc_id", "'a b c' as text", "'en' as lang").coalesce(1)
    corpus_pipeline.language_id(spark, docs, "")

    def sizes(batches):
        import pyarrow as pa
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64())})
    assert max(r.n for r in docs.mapInArrow(sizes, "n long").collect()) <= 2_000
