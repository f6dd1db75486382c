"""Tokens and packing against the tokenizers library and against the definition."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridwright.llm import bpe, packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "  ", "don't 's 'll we've i'm 'D''s !'s x's's 'st 're'llama ''", "a1b2 ½ ²Ⅷ 12\x1c3\x85x​z", "<|endoftext|>Hi<|startoftext|>",
       "ΑΣ ΣΑΣ İstanbul ǅ ß", "é 가 한국어 日本 👍🏽  　x", "a" * 5000 + " " + "l" * 4000, "x" * 70000, "<|ENDOFTEXT|> <|endoftext"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoding_and_decoding_match_the_library(library):
    ids, ends = bpe.load(PATH).encode(ODD)
    want = [ids_of(library, t) for t in ODD]
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want
    assert bpe.load(PATH).decode(ids, ends).to_pylist() == [library.decode(w, skip_special_tokens=False) for w in want]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("abtshe'lmrvd!.1 \n\tÉéñΣ'’𝟙²<|>_日") | st.characters(max_codepoint=0x24F), max_size=40), max_size=4))
def test_any_text_matches_the_library(library, texts):
    ids, ends = bpe.load(PATH).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [ids_of(library, t) for t in texts]


def test_long_texts_are_cut_at_white_space_only(library, monkeypatch):
    text = "the quick brown fox " * 500 + "x" * 400
    monkeypatch.setattr(bpe, "SEGMENT_CHARS", 64)
    ids, _ = bpe.load(PATH).encode([text])
    assert ids.tolist() == ids_of(library, text)


def test_a_full_word_cache_starts_again(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_WORDS", 2)
    model = bpe.WordBpe(PATH)
    for text in ("one two three four", "five six seven", "one two"):
        assert model.encode([text])[0].tolist() == ids_of(library, text)


def test_query_of_op5(spark, library):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op5_bpe"](spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        ids = ids_of(library, texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_carries_columns_and_nulls(frame):
    docs = frame([(1, None, "a"), (1, None, "a"), (2, "hello", None)], "doc_id long, text string, ids string")
    out = bpe.encode(docs, PATH)
    assert sorted((r.doc_id, len(r.ids)) for r in out.collect()) == [(1, 0), (1, 0), (2, 1)]
    assert bpe.decode(bpe.encode(docs.filter("false"), PATH), PATH).count() == 0
    for again in (bpe.decode(out, PATH), bpe.decode(bpe.encode(docs, PATH, packed=True), PATH), bpe.round_trip(docs, PATH)):
        assert sorted(r.text for r in again.collect()) == ["", "", "hello</w>"]


def packed_ok(rows, sequence):
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= sequence
    return len(places)


def test_query_of_op7(spark, library):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op7_best_fit_packing"](spark, sf).collect()
    used = packed_ok(rows, 4096)
    total, want = 0, {}
    for doc, text in texts.items():
        ids = [*ids_of(library, text), 1]
        total += len(ids)
        for k in range(0, len(ids), 4096):
            want[doc, k // 4096] = (k, len(ids[k:k + 4096]), zlib.crc32(np.array(ids[k:k + 4096], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert used <= -(-total // 4096) + 2


def test_packing_of_odd_rows(frame):
    rows = [(1, None, 5), (1, None, 5), (2, "", 1), (3, "word " * 9000, 2), (None, "x", 3)]
    out = packing.pack_documents(frame(rows, "doc_id long, text string, length int"), PATH, sequence=64).collect()
    packed_ok(out, 64)
    assert sum(r.length for r in out) == 1 + 1 + 1 + 9001 + 2
    assert packing.pack_documents(frame([], "doc_id long, text string"), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), min_size=1, max_size=300))
def test_rounds_place_every_piece_once(lengths):
    values, counts = np.unique(lengths, return_counts=True)
    placed, opened = packing.pack_runs(values, counts, 32)
    seen, sequences = set(), {}
    for length, rank, n, first, offset in placed:
        for i in range(int(n)):
            assert (length, rank + i) not in seen
            seen.add((length, rank + i))
            sequences.setdefault(first + i, []).append((offset, length))
    assert seen == {(v, i) for v, c in zip(values, counts) for i in range(c)}
    for held in sequences.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 32
    assert len(sequences) <= opened <= 1 + 2 * -(-sum(lengths) // 32)
