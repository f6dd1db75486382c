"""The filter interaction audit against plain Python."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from gridwright.llm import filter_audit


def plain_audit(docs, labels):
    """(part, order, step) -> the seven counts, one document after another."""
    fails, first = [], {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    for i, text, lang in docs:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0D]+", text)
        capitals = len(re.findall("[A-Z]", text))
        fails.append((lang or "", i, {x for x, bad in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * capitals > 10 * len(text), re.search("[#$%&*|]", text) is not None,
            i is not None and i > first[text])) if bad}))
    out = {(part, "".join(o), k + 1): [0] * 7 for part in {f[0] for f in fails} for o in permutations("ABCDE") for k in range(5)}
    for part, i, bad in fails:
        for order in permutations("ABCDE"):
            gone = False
            for k, x in enumerate(order):
                c = out[part, "".join(order), k + 1]
                lost = x in bad and not gone
                for j, v in enumerate((not gone and x not in bad, lost, x in bad and gone, bad == {x}, lost and i in good, lost and i in toxic)):
                    c[j] += v
                gone |= x in bad
    shapley = Counter()
    for (part, order, k), c in out.items():
        shapley[part, order[k - 1]] += c[1]
    for (part, order, k), c in out.items():
        c[6] = shapley[part, order[k - 1]]
    return out


def audit_case():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["one", "Two", "three", "FOUR", "five$", "six\tseven", "é", str(rng.randrange(300))]) for _ in range(rng.choice([3, 90, 150, 400])))
             for _ in range(40)]
    texts += ["", None, " \t\n", "A", "w " * 100, " ".join(map(str, range(100))), "x" * 2_000_000, " ".join(str(k) for k in range(200_000))]
    docs = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(300)]
    docs += [(7, docs[7][1], "en")] * 5 + [(None, "w " * 100, "en"), (None, texts[0], None), (1000, "w " * 100, "rare")] + [(2000 + i, "copy " * 120, "hot") for i in range(200)]
    labels = [(i, rng.randrange(2), rng.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1), (99999, 1, 1)]
    return docs, labels


def test_audit_against_plain_python(frame):
    docs, labels = audit_case()
    got = filter_audit.audit(frame([(*d, 1, "x") for d in docs], "doc_id long, text string, lang string, mask int, part string"),
                             frame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, mask int")).collect()
    want = plain_audit(docs, labels)
    assert len(got) == len(want) == 600 * 5
    assert {(r.part, r.filter_order, r.step): [*r[3:]] for r in got} == want


def test_many_parts_and_small_holds(frame, monkeypatch):
    monkeypatch.setattr(filter_audit, "HELD_PARTS", 3)
    docs = [(i, "w " * (i % 5 * 40), f"p{i % 40}") for i in range(400)]
    rows = filter_audit.audit(frame(docs, "doc_id long, text string, lang string"), frame([(1, 1, 0)], "doc_id long, quality int, toxic int"))
    got = {(r.part, r.filter_order, r.step): [*r[3:]] for r in rows.filter(F.col("filter_order").isin("ABCDE", "EDCBA")).collect()}
    want = plain_audit(docs, [(1, 1, 0)])
    assert len(got) == 400 and all(want[k] == v for k, v in got.items())


def test_audit_of_nothing(frame):
    docs = frame([(1, "x", "en")], "doc_id long, text string, lang string")
    labels = frame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs.filter("false"), labels).count() == 0
    assert filter_audit.audit(docs, labels.filter("false")).count() == 600


@pytest.mark.parametrize("rows", [1, 255, 256, 65_535, 65_536, 10**12])
def test_fields_never_overflow(rows):
    width = filter_audit.field_width(rows)
    whole = rows * filter_audit._packer(width)(31 + filter_audit.GOOD)
    counts = filter_audit.unpack(whole, width)
    assert (counts == rows * filter_audit.contribution(31 + filter_audit.GOOD).astype(object)).all()
