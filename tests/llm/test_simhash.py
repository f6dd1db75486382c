"""SimHash fingerprints and links against brute force."""

import random
import re

import xxhash

from gridwright.llm import queries, simhash
from gridwright.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """fps: id -> fingerprint; id -> least id reachable over links of at most 3 bits."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_query_of_op2(spark):
    sf = "/root/testdata/sf0.01"
    want = {r.doc_id: plain_fingerprint(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op2_simhash"](spark, sf).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{f:016x}" for i, f in want.items()} and len(rows) == len(want)
    assert {r.doc_id: r.component_id for r in rows} == plain_components(want)


def test_links_join_what_all_pairs_join(spark):
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(25):  # chains and clouds of neighbours
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(f)
            g = f
            for b in rng.sample(range(64), rng.randint(1, 5)):
                g ^= 1 << b
            fps.add(g)
            f = g if rng.random() < 0.5 else f
    ids = {i: f for i, f in enumerate(sorted(fps))}
    table = spark.createDataFrame([(simhash._signed(f),) for f in ids.values()], "fp long")
    close = simhash.crowded(table)
    found = {}
    for r in components(simhash.links(close), "fp", "hub").collect():
        found.setdefault(r.root, {r.root}).add(r.node)
    groups = {}
    for i, root in plain_components(ids).items():
        groups.setdefault(root, set()).add(simhash._signed(ids[i]))
    assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_odd_rows(frame):
    long = "one two three four " * 40000
    rows = [(5, None, "x"), (7, "", "x"), (9, " \t\r\n", "y"), (3, "A b", "y"), (2, "a B", "z"), (2, "a B", "z"), (8, long, "l"), (6, long.upper(), "l")]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(frame(rows, "doc_id long, text string, fp string")).collect()}
    assert got == {(5, 5), (7, 5), (9, 5), (3, 2), (2, 2), (8, 6), (6, 6)}
    assert simhash.near_duplicates(frame([], "doc_id long, text string")).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 100 + i) for i in range(1, 300)]
    out = {r.node: r.root for r in components(spark.createDataFrame(chain + star + [(7, 7)], "a long, b long"), "a", "b").collect()}
    assert out == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 300)}}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
