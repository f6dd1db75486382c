"""Fill-in-the-middle documents against plain Python."""

import hashlib
import random
import re
from collections import Counter

import pytest

from gridwright.llm import fill_middle


def plain_fim(doc_id, text, fim=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    rng = random.Random(1)
    parts = ["a", "é\n", "\n", "日本", " ", "\r\n", " ", "<P", "S>", "<", "M>\n", "\x00"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    return [*texts, None, "", "\n", "x", "x\n", "\n\n", "a<P>b", "<M>", "line\n<S>\n", "<\n<\n<\n", "<P\n<S\n<M\n", "q" * 3_000_000 + "\n" + "r\n" * 1_000_000]


@pytest.mark.parametrize("fim,spm", [(100, 50), (40, 0), (0, 50), (100, 100)])
def test_against_plain_python(frame, fim, spm):
    rows = [(i, t, "x", 1) for i, t in enumerate(odd_texts())] + [(None, "no\nid\n", "x", 1), (3, "again\n", "x", 1), (3, "again\n", "x", 1)]
    table = frame(rows, "doc_id long, text string, _row string, output int")
    made = fill_middle.transform(table, fim_percent=fim, spm_percent=spm)
    back = fill_middle.restore(made, "_fim.output", "_fim.form").collect()
    assert Counter((r._row._row.doc_id, r._row._row.text) for r in back) == Counter((i, t) for i, t, *_ in rows)
    for r in back:
        doc, got = r._row._row, r._row._fim
        assert (got.n, got.form, got.prefix_chars, got.middle_chars, got.output) == plain_fim(doc.doc_id, doc.text, fim, spm)
        assert r.restored == (doc.text or "") and doc.output == 1


def test_empty_table(frame):
    none = frame([(1, "x")], "doc_id long, text string").filter("false")
    assert fill_middle.restore(fill_middle.transform(none), "_fim.output", "_fim.form").count() == 0
