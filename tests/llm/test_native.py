"""URL rules, sharding and exact dedup against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from gridwright.llm import exact_dedup, queries, sharding, url_rules

SF = "/root/testdata/sf0.01"


def plain_verdict(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = []
    for rule, action in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), action, rule))
    best = max(fits, default=None)
    return host, path, best and best[2], best[1] if best else "allow"


def test_url_rules(spark, frame):
    rules = [*queries.RULES, ("example.com/a", "allow"), ("b.example.com/", "block"), ("net/x/", "block"), ("net/x/", "block")]
    urls = [None, "", "no scheme", "http://", "http://net", "http://net/", "http://NET/x", "http://a.net/x/y", "http://internet/", "x://é.Example.COM/de/?q", "a://b://net/",
            "http://example.com/de", "http://example.com/de/1", "http://m.example.net/en/1#x", "http://example.net?/en/", "http://b.example.com/abc", "http://b.example.com/a",
            "http://x.org/fr/", "http://org/fr/" + "p" * 5000, "http://.net/", "http://net./", "http://a..net/", "http://h.net/\nx"]
    table = frame([(i, u, "x", "y") for i, u in enumerate([*urls, *urls])] + [(None, "http://net/", "x", "y")], "page_id long, url string, host string, rule string")
    got = sorted([(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(table, url_rules.rule_table(spark, rules)).collect()], key=str)
    assert got == sorted([(i, *plain_verdict(u, rules)) for i, u in enumerate([*urls, *urls])] + [(None, "net", "/", "net/", "block")], key=str)
    assert url_rules.judge_urls(table.filter("false"), url_rules.rule_table(spark, rules)).count() == 0
    none = url_rules.judge_urls(table, url_rules.rule_table(spark, rules).filter("false")).select("verdict").distinct().collect()
    assert [r.verdict for r in none] == ["allow"]


def test_hosts_of_many_labels(spark, frame):
    rules = [*queries.RULES, ("a.b.c.example.com/", "block")]
    hosts = ["x." * 20_000 + "example.net", "x." * 20_000 + "a.b.c.example.com", "." * 5_000, "c.example.com", "b.c.example.com", "y" * 100_000 + ".org"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("/", "/en/1", "/fr/")]
    rows = url_rules.judge_urls(frame(list(enumerate(urls)), "page_id long, url string"), url_rules.rule_table(spark, rules)).collect()
    assert {r.page_id: (r.rule, r.verdict) for r in rows} == {i: plain_verdict(u, rules)[2:] for i, u in enumerate(urls)}


def shards_ok(rows, texts):
    totals, places = defaultdict(int), defaultdict(list)
    for r in rows:
        body = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(body) + 1, zlib.crc32(body))
        totals[r.shard] += r.size
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    return totals


def test_query_of_op8(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op8_virtual_slots"](spark, SF).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    totals = shards_ok(rows, texts)
    assert sorted(totals) == list(range(8)) and max(totals.values()) - min(totals.values()) <= 0.001 * sum(totals.values())


def test_sharding_of_odd_rows(spark, frame):
    rows = [(1, None, 0), (2, "", 0), (2, "", 0), (None, "x", 0), (3, "é" * 100_000, 0), *[(i, "same", 0) for i in range(10, 60)]]
    out = sharding.shard_by_bytes(frame(rows, "doc_id long, text string, size int"), shards=3, slots=16).collect()
    assert len(out) == len(rows) and max(r.size for r in out) == 200_001
    held = defaultdict(list)
    for r in out:
        held[r.shard].append(r.place)
    assert all(sorted(p) == list(range(len(p))) for p in held.values())
    assert sharding.shard_by_bytes(frame([], "doc_id long, text string")).count() == 0


def test_slot_map_versions(spark):
    rng = random.Random(1)
    weights = {s: int(rng.lognormvariate(8, 1)) for s in range(512)}
    one = sharding.first_map(512, 8)
    two = sharding.rebalanced(one, weights, 8)
    nine = sharding.rebalanced(two, weights, 9)
    load = lambda m, k: [sum(w for s, w in weights.items() if m[s] == i) for i in range(k)]
    assert max(load(two, 8)) - min(load(two, 8)) <= 0.001 * sum(weights.values())
    assert max(load(nine, 9)) - min(load(nine, 9)) <= 0.001 * sum(weights.values())
    table = sharding.map_table(spark, [one, two, nine])
    for version, want in enumerate((one, two, nine), 1):
        assert {r.virtual_slot: r.shard for r in sharding.active_map(table, version).collect()} == dict(enumerate(want))


def test_exact_dedup_of_odd_rows(frame):
    long = "Long É " * 20_000
    rows = [(1, None), (2, ""), (3, "ab"), (4, "AB"), (5, "É"), (6, "é"), (7, long), (8, long.replace("L", "l")), (9, long + "x"), (9, long + "x"), (10, long[:-1] + "z"), (None, "aB"), (11, " ab")]
    docs = frame([(*r, "k", 1) for r in rows], "doc_id long, text string, keep_id string, _n int")
    low = lambda t: "".join(c.lower() if c.isascii() else c for c in t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    want = []
    for i, t in rows:
        ids = groups[low(t)]
        keep = max(x for x in ids if x is not None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    marked = exact_dedup.mark_duplicates(docs, digest_all=True)
    assert sorted([(r._row.doc_id, r.keep_id, r.group_size, r.kept, r.digest) for r in marked.collect()], key=str) == sorted(want, key=str)
    assert sorted([r.doc_id for r in exact_dedup.drop_duplicates(docs).collect()], key=str) == sorted([w[0] for w in want if w[3]] + [None], key=str)
    # only rows of surviving groups are read in full
    assert {r._row.doc_id for r in exact_dedup.mark_duplicates(docs).filter("digest IS NOT NULL").collect()} == {1, 2, 3, 4, 7, 8, 9, 10, None}
    assert exact_dedup.mark_duplicates(docs.filter("false")).count() == 0
