"""Secret scanning: counts and candidates against plain Python, the forest on held-out findings, redaction."""

import re
from collections import Counter

import pytest

from gridwright.llm import queries, secret_scan

SF = "/root/testdata/sf0.1"


def plain_candidates(text):
    return [(m.start(), m.group()) for m in re.finditer(r"[A-Za-z0-9+/_=-]{16,}", text or "") if re.search("[0-9]", m.group())]


TEXTS = ["", None, "x" * 40, "key = abcdefgh12345678 end", "1234567890123456", "é1234567890123456é", "日" + "a1" * 9, "a1" * 7 + " b2" * 9, "ab-12/cd_34=ef+56" * 3]


def test_candidates_match_a_plain_search():
    assert list(secret_scan.find_candidates(TEXTS)) == [(i, a, v) for i, t in enumerate(TEXTS) for a, v in plain_candidates(t)]


def test_word_counts(frame):
    texts = ["The cat, the CAT x1cat cat2 éclat cat", None, "", "abc-abc abc", "a" * 30]
    got = {r.word: r.n for r in secret_scan.word_counts(frame([(t,) for t in texts], "text string")).collect()}
    want = Counter(w for t in texts if t for w in re.findall(r"(?<![A-Za-z0-9+/_=\-À-ÿ])[a-z]{3,24}(?![A-Za-z0-9+/_=\-À-ÿ])", t.lower()))
    assert {w: n for w, n in got.items() if len(w) > 2} == dict(want)
    letters = Counter(p for t in texts if t for p in (t.lower()[i:i + 2] for i in range(len(t) - 1)) if p.isascii() and p.isalpha())
    assert {w: n for w, n in got.items() if len(w) == 2 and n} == dict(letters)


@pytest.fixture(scope="module")
def found(spark):
    return queries.QUERIES["op4_secret_scan"](spark, SF).collect()


def test_query_of_op4(spark, found):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert {(r.doc_id, r.start, texts[r.doc_id][r.start:r.start + r.length]) for r in found} == {(d, a, v) for d, t in texts.items() for a, v in plain_candidates(t)}
    assert len(found) == len({(r.doc_id, r.start) for r in found})
    assert all(0 <= r.score <= 1 and 0 <= r.covered <= 1 and r.secret == (r.score >= 0.5) for r in found)
    for r in found:  # assigned tokens are secrets, bare numbers are not
        if re.fullmatch("[0-9a-fA-F]{40}", texts[r.doc_id][r.start:r.start + r.length]):
            assert r.secret
        if texts[r.doc_id][r.start:r.start + r.length].isdigit():
            assert not r.secret


def test_forest_on_held_out_findings(spark, frame):
    import random
    rng = random.Random(3)
    rows = []
    for i in range(600):
        value = "".join(rng.choice("0123456789abcdefABCDEFGHxyzXYZ") for _ in range(rng.randint(20, 44))) + "7"
        slug = "-".join(rng.choice(["alpha", "build", "report", "2024", "notes", "final"]) for _ in range(4)) + "-12"
        number = "".join(rng.choice("0123456789") for _ in range(rng.randint(16, 20)))
        rows.append((i, rng.choice([f'some text secret = "{value}" more', f"see page {slug} for all", f"call {number} today"]), f"a/b/{i % 7}"))
    docs = frame(rows, "doc_id long, text string, source string")
    counts = secret_scan.settle(secret_scan.word_counts(docs))
    table = secret_scan.settle(secret_scan.coverage(secret_scan.candidates(docs, secret_scan.pair_scores(counts)), counts))
    hidden = table.selectExpr("*", "label AS truth").drop("label").selectExpr("*", "CASE WHEN doc_id % 3 <> 1 THEN truth END AS label")
    scored = [r for r in secret_scan.score(hidden).select("doc_id", "truth", "score").collect() if r.doc_id % 3 == 1 and r.truth is not None]
    assert len(scored) > 150 and sum((r.score >= 0.5) == (r.truth == 1) for r in scored) >= 0.97 * len(scored)


def test_odd_rows_and_redaction(frame):
    token = "0123456789abcdef0123456789abcdef"
    rows = [(1, f'a token = "{token}" b token="{token}"', None, 1), (2, None, "p", 2), (3, "", "p", 3), (4, "id 12345678901234567890", "p/q", 4),
            (5, f'TOKEN = "{token.upper()}"', "p", 5), (5, f'TOKEN = "{token.upper()}"', "p", 5), (None, f"password: {token}", "p", 6)]
    docs = frame(rows, "doc_id long, text string, source string, score int")
    assert docs.count() == secret_scan.redact(docs).count()
    got = sorted(((r.score, r.text) for r in secret_scan.redact(docs).collect()), key=str)
    assert got == sorted([(1, 'a token = "[secret]" b token="[secret]"'), (2, None), (3, ""), (4, rows[3][1]), (5, 'TOKEN = "[secret]"'),
                          (5, 'TOKEN = "[secret]"'), (6, "password: [secret]")], key=str)
    assert secret_scan.redact(docs.filter("false")).count() == 0
    one_class = secret_scan.scan(docs.filter("score = 4")).collect()
    assert [r.score for r in one_class] == [0.0]


def test_assigned_values_of_any_shape(spark, frame):
    base = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    planted = {'password = "correcthorsebattery"': "correcthorsebattery", "token: ab12 end": "ab12", "api_key=abc.def-ghi.jkl, x": "abc.def-ghi.jkl",
               "Authorization: Bearer ey12.ab.c end": "ey12.ab.c", "secret = 'a b c!'": "a b c!", "x token=0123456789abcdef01 y": "0123456789abcdef01"}
    texts = {10_000_000 + k: f"the page {t} and more" for k, t in enumerate(planted)}
    docs = frame([*base, *[(i, t, "p/q") for i, t in texts.items()]], "doc_id long, text string, source string")
    found = {(r.doc_id, texts[r.doc_id][r.start:r.start + r.length]) for r in secret_scan.scan(docs).filter("secret").collect() if r.doc_id in texts}
    assert found == set(zip(texts, planted.values()))


def test_runs_without_a_digit(frame):
    import random
    rng = random.Random(6)
    rows = [(i, f'see token = "{rng.getrandbits(160):040x}" and internationalisation of {rng.getrandbits(64) + (1 << 63)} words', "p") for i in range(200)]
    rows += [(1000, "the key kXqZbVtRwPmKsLdFgHjKqWzX is here", "p"), (1001, "of Internationalisation ==================== words", "p")]
    docs = frame(rows, "doc_id long, text string, source string")
    texts = {i: t for i, t, _ in rows}
    runs = {v for _, _, v, _ in secret_scan.all_candidates(list(texts.values()))}
    assert {"kXqZbVtRwPmKsLdFgHjKqWzX", "internationalisation", "Internationalisation"} <= runs and "=" * 20 not in runs
    assert not any("nternational" in texts[r.doc_id][r.start:r.start + r.length] for r in secret_scan.scan(docs).collect())
    only_words = docs.filter("doc_id = 1001")
    assert secret_scan.redact(only_words).first().text == texts[1001]


def test_rare_secrets_are_not_lost_in_the_sample(frame):
    import random
    rng = random.Random(9)
    rows = [(i, f"call {rng.randrange(10 ** 17, 10 ** 18)} today", "p") for i in range(400)]
    rows += [(1000 + i, f'a token = "{rng.getrandbits(160):040x}" b', "p") for i in range(3)] + [(2000, "page alpha-build-report-12 only", "p")]
    docs = frame(rows, "doc_id long, text string, source string")
    counts = secret_scan.settle(secret_scan.word_counts(docs))
    table = secret_scan.settle(secret_scan.coverage(secret_scan.candidates(docs, secret_scan.pair_scores(counts)), counts))
    table = table.withColumn("label", secret_scan.F.when(table.doc_id != 2000, table.label))
    # 20 of 403 labelled: a sample without classes holds numbers only, and gives the slug score 1
    scored = {r.doc_id: r.score for r in secret_scan.score(table, max_training=20).collect()}
    assert all(scored[1000 + i] == 1.0 for i in range(3)) and scored[2000] < 1 and all(scored[i] < 0.5 for i in range(400))


ORDINARY = ["max_tokens = 4096", "Authentication: OAuth2 is required", "token_count: 1,024", "tokenizer=gpt2", "authorship = shared", "secretary: J.Smith",
            "if token == END_TOKEN:", "password = os.environ['X']", "auth_url = https://login.example.com/oauth2/v1/authorize", "secret = value_of_it",
            "password = get_password()", "api_key: ${API_KEY}", "token = 12345", "the secret: nothing to hide", "credentials: https://example.org/a/b"]
ASSIGNMENTS = {'DB_PASSWORD="hunter two"': "hunter two", "apiToken = 'x9-y'": "x9-y", "client_secret=ab12.cd34": "ab12.cd34", "AUTH_TOKEN: z8Q!p": "z8Q!p",
               "aws.access-key = AKIA77XQ": "AKIA77XQ", "token := t0k3n": "t0k3n"}


def test_ordinary_text_is_no_certain_finding():
    certain = {t: [v for _, _, v, sure in secret_scan.all_candidates([t]) if sure] for t in [*ORDINARY, *ASSIGNMENTS]}
    assert certain == {**{t: [] for t in ORDINARY}, **{t: [v] for t, v in ASSIGNMENTS.items()}}


def test_planted_findings_precision_and_recall(spark, frame):
    """Truth is what was planted, not what a rule says."""
    import random
    rng = random.Random(11)
    base = [(r.doc_id, r.text, r.source) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    planted, plain = [], []
    for i in range(120):
        value = "".join(rng.choices(alphabet, k=rng.randint(10, 40))) + str(rng.randint(0, 9))
        planted.append((5_000_000 + i, f"the page {rng.choice(['token', 'db_password', 'API_KEY', 'clientSecret'])} = \"{value}\" and more words", "p/q", value))
        plain.append((6_000_000 + i, f"the page {rng.choice(ORDINARY)} and more words", "p/q"))
    docs = frame([*base, *[p[:3] for p in planted], *plain], "doc_id long, text string, source string")
    texts = {i: t for i, t, *_ in [*planted, *plain]}
    found = {(r.doc_id, texts[r.doc_id][r.start:r.start + r.length]) for r in secret_scan.scan(docs).filter("secret").collect() if r.doc_id in texts}
    right = {(i, v) for i, _, _, v in planted}
    assert len(found & right) >= 0.95 * len(right) and len(found & right) >= 0.95 * len(found)
