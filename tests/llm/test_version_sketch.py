"""Version sketches against plain sets, and the chain of edited documents against plain Python."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from gridwright.llm import queries, version_sketch as vs

SF = "/root/testdata/sf0.01"


def plain_pieces(text):
    """The passages of a text, byte by byte."""
    data, out, begin = text.encode(), [], 0
    for i in range(len(data)):
        window = int.from_bytes(data[i - 3:i + 1], "big") if i >= 3 else None
        hit = window is not None and ((window * vs.GOLDEN_32 & 0xFFFFFFFF) >> 16) % vs.PASSAGE_BYTES == 0
        if hit or data[i] == 10 or i == len(data) - 1:
            for a in range(begin, i + 1, vs.LONGEST):
                out.append(data[a:min(a + vs.LONGEST, i + 1)])
            begin = i + 1
    return out


def plain_set(text):
    seen, keys = Counter(), []
    for piece in plain_pieces(text):
        keys.append((xxhash.xxh64_intdigest(piece), seen[piece]))
        seen[piece] += 1
    return set(keys)


def plain_likeness(a, b):
    a, b = plain_set(a), plain_set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def some_texts(rng):
    words = ["alpha", "bêta", "γ", "delta\n", "eps ilon", "", "日本語", "a", "\n\n"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 400))) for _ in range(60)]
    return [*texts, "", "", "x", "no " * 500, "ab" * 3000, "\n" * 50, *texts[:5]]


def test_passages_are_those_of_plain_python():
    texts = some_texts(random.Random(1))
    found = vs.passages(pa.array(["?", *texts], pa.string()).slice(1))
    assert found.sizes().tolist() == [len(plain_pieces(t)) for t in texts]
    assert len(vs.passages(pa.array([""], pa.string())).keys) == 0


@pytest.mark.parametrize("cells", [vs.CELLS, 48, 3072])
def test_peeling_gives_real_digests_only(cells):
    texts = some_texts(random.Random(2))
    found, at = vs.passages(pa.array(texts, pa.string())), np.arange(len(texts))
    bt = np.roll(at, 1)
    pair, keys, side, empty = vs.peel(vs.subtract(vs.sketches(found, at, cells), vs.sketches(found, bt, cells)), cells)
    for i in at.tolist():
        a, b = (set(found.keys[found.offsets[j]:found.offsets[j + 1]].tolist()) for j in (i, bt[i]))
        left, right = (set(keys[(pair == i) & (side == s)].tolist()) for s in (1, -1))
        assert left <= a - b and right <= b - a
        assert not empty[i] or (left == a - b and right == b - a)
    assert empty.all() or cells < 3072


def test_all_differences_are_recovered():
    texts = some_texts(random.Random(3))
    found, at = vs.passages(pa.array(texts, pa.string())), np.arange(len(texts))
    bt = np.roll(at, 7)
    pair, keys, side = vs.differences(found, at, found, bt)
    like = vs.likeness(found, at, found, bt, pair)
    for i in at.tolist():
        assert like[i] == pytest.approx(plain_likeness(texts[i], texts[bt[i]]))
        a, b = (set(found.keys[found.offsets[j]:found.offsets[j + 1]].tolist()) for j in (i, bt[i]))
        assert Counter(keys[pair == i].tolist()) == Counter(a ^ b)
        assert set(keys[(pair == i) & (side > 0)].tolist()) == a - b


def test_two_versions_of_a_row(frame):
    texts = some_texts(random.Random(4))
    rows = [(i, t, texts[-1 - i], "_old", i) for i, t in enumerate(texts)] + [(None, None, "", "x", 1), (1, None, None, "x", 1), (2, None, "gone", "x", 1)]
    got = vs.compare_versions(frame(rows, "doc_id long, text string, later string, _row string, _diff int"), "text", "later").collect()
    assert len(got) == len(rows)
    for r in got:
        a, b, d = r._row.text or "", r._row.later or "", r._diff
        assert d.likeness == pytest.approx(plain_likeness(a, b)) and (d.old_fingerprint == d.new_fingerprint or a != b)
        assert (len(d.only_old), len(d.only_new)) == (len(plain_set(a) - plain_set(b)), len(plain_set(b) - plain_set(a)))


def plain_chain(docs, key):
    """(id, text) -> text of the next document."""
    order = sorted(set(docs), key=key)
    return {d: order[(k + 1) % len(order)][1] for k, d in enumerate(order)}


def check_chain(rows, after):
    prints = {}
    for doc_id, text, p in rows:
        cut = len(text) // 4
        nxt = after[(doc_id, text)]
        assert p.n_chars == len(text) and p.edited == text[:len(text) - cut] + nxt[:cut]
        assert p.near_edited == pytest.approx(plain_likeness(text, p.edited)) and p.near_next == pytest.approx(plain_likeness(text, nxt))
        for t, f in ((text, p.fingerprint), (p.edited, p.edited_fingerprint)):
            assert prints.setdefault(t, f) == f
    assert len(set(prints.values())) >= 0.99 * len(prints)


@pytest.mark.parametrize("pieces", ["1", "4", "50"])
def test_chain(spark, frame, pieces):
    texts = some_texts(random.Random(5))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", pieces)
    try:
        rows = [(i * 3 % 71, t) for i, t in enumerate(texts)] * 2 + [(500, None), (None, "without id"), (500, None)] + [(600, "often")] * 300
        table = frame([(*r, "x", 1) for r in rows], "doc_id long, text string, _bucket string, _ahead int")
        got = [(r._row.doc_id, r._row.text or "", r._print) for r in vs.edited_chain(table).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    docs = [(i, t or "") for i, t in rows]
    assert Counter((i, t) for i, t, _ in got) == Counter(docs)
    check_chain(got, plain_chain(docs, lambda d: (d[0] is not None, d[0])))


def test_chain_of_none_and_one(frame):
    kind = "doc_id string, text string"
    assert vs.edited_chain(frame([("a", "x")], kind).filter("false")).count() == 0
    only = vs.edited_chain(frame([("a", "one text\nof two lines")], kind)).first()._print
    assert only.edited == "one text\nof two " + "one t" and only.near_next == 1.0


def test_ties_of_one_id(frame):
    got = vs.edited_chain(frame([(1, "aaaa"), (1, "bbbb"), (1, "cccc"), (1, "aaaa")], "doc_id long, text string")).collect()
    nexts = {(r._row.text, r._print.edited[3:]) for r in got}
    assert len(nexts) == 3 and {b for _, b in nexts} == {"a", "b", "c"} and all(a[0] != b for a, b in nexts)


def test_very_long_text(frame):
    rng = random.Random(6)
    long = " ".join(rng.choice(["lorem", "ipsum", "dolor", "sit", "ämet"]) + str(rng.randrange(999)) for _ in range(620_000))
    got = {r._row.doc_id: r._print for r in vs.edited_chain(frame([(1, long), (2, "short text"), (3, "z" * 5_000_000)], "doc_id long, text string")).collect()}
    assert got[1].n_chars == len(long) > 5_000_000 and got[1].edited == long[:len(long) - len(long) // 4] + "short text"
    assert 0.6 < got[1].near_edited < 0.9 and got[1].near_next == 0 and got[3].edited[3_750_000:] == long[:1_250_000]


def test_query_of_op11(spark):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    after, texts = plain_chain(docs, lambda d: d[0]), dict(docs)
    rows = queries.QUERIES["op11_version_sketch"](spark, SF).collect()
    assert len(rows) == len(docs) and rows[0].__fields__[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for r in rows:
        text, nxt = texts[r.doc_id], after[(r.doc_id, texts[r.doc_id])]
        edited = text[:len(text) - len(text) // 4] + nxt[:len(text) // 4]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(plain_likeness(text, edited)) and r.near_next == pytest.approx(plain_likeness(text, nxt))
