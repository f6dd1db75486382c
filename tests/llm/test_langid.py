"""Language identification: held-out accuracy, and the distance against its definition."""

import re
import zlib
from collections import Counter

from gridwright.llm import langid, queries


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    joined = f" {' '.join(words)} "
    found = Counter(joined[i:i + n] for n in (1, 2, 3) for i in range(len(joined) - n + 1)) if words else Counter()
    found.pop(" ", None)
    return found


def code(gram):
    out = 0
    for c in gram:
        out = out << 21 | (langid.BOUNDARY if c == " " else ord(c))
    return out


TEXTS = ["Hello, world! Hello.", "", None, "…!? 12", "a", "ÉÈ çà\n\nb", "日本 mixed 日", "x" * 5000, "  lead and trail  "]


def test_gram_counts_match_the_definition():
    for text, (codes, counts) in zip(TEXTS, langid.count_grams(TEXTS)):
        assert dict(zip(codes.tolist(), counts.tolist())) == {code(g): n for g, n in plain_grams(text or "").items()}


def test_distance_matches_the_definition():
    places = {"a": ["th", "e", " t"], "b": ["é", "e"]}
    rows = [(lang, code(g), i) for lang, grams in places.items() for i, g in enumerate(grams)]
    profiles = langid.Profiles(rows, 5)
    text = "the tee é"
    ranked = [g for g, _ in sorted(((g, n) for g, n in plain_grams(text).items()), key=lambda x: (-x[1], code(x[0])))][:5]
    apart = {lang: sum(abs(i - grams.index(g)) if g in grams else 5 for i, g in enumerate(ranked)) for lang, grams in places.items()}
    best = min(sorted(apart), key=apart.get)
    assert profiles.predict([text]) == [(best, 1 - apart[best] / 25)]


def test_query_of_op1(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op1_language_id"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", docs[r.doc_id].text or ""))
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)


def test_odd_rows(frame):
    rows = [(1, "the the the", "en", 1), (2, None, "en", 1), (3, "la la la", None, 2), (4, "", "fr", 2), (5, "la la", "fr", 3), (5, "la la", "fr", 3)]
    docs = frame(rows, "doc_id long, text string, lang string, score int")
    profiles = langid.collect_profiles(langid.learn(docs))
    assert profiles.langs == ["en", "fr"]
    got = [(r._row.doc_id, r._found.lang_pred) for r in langid.identify(docs, profiles).collect()]
    assert sorted(got) == [(1, "en"), (2, "und"), (3, "fr"), (4, "und"), (5, "fr"), (5, "fr")]
    none = langid.identify_documents(frame([], "doc_id long, text string, lang string"))
    assert none.count() == 0
    unlabelled = langid.identify_documents(frame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()
    assert unlabelled[0]._found.lang_pred == "und"
