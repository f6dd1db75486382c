"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwright.llm import (bpe, embedding_dedup, exact_dedup, fill_middle, filter_audit, langid, packing, secret_scan, sharding, simhash,
                            url_rules, version_sketch, warc_store)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns)


# ---------------------------------------------------------------- 1: language ID

@query("op1_language_id")
def op1_language_id(spark, sf):
    found = langid.identify_documents(table(spark, sf, "documents", "doc_id", "text", "lang"))
    return found.select("_row.doc_id", "held_out", "_found.lang_pred", "_found.score")


# ---------------------------------------------------------------- 2: SimHash near-dedup

@query("op2_simhash")
def op2_simhash(spark, sf):
    found = simhash.near_duplicates(table(spark, sf, "documents", "doc_id", "text"))
    return found.select("doc_id", simhash.fp_hex(F.col("fp")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- 3: URL filters

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query("op3_url_rules", f"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, {SQL_LOWER.format("regexp_extract(coalesce(rest,''), '^([^/?#]*)', 1)")} AS host,
    regexp_extract(coalesce(rest,''), '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(rule, h, p, action) AS (VALUES ('net/','net','/','block'), ('example.net/en/','example.net','/en/','allow'),
  ('example.com/de/','example.com','/de/','block'), ('org/fr/','org','/fr/','allow')),
fits AS (
  SELECT s.page_id, s.host, s.path, r.rule, r.action,
    row_number() OVER (PARTITION BY s.page_id ORDER BY length(r.rule) DESC NULLS LAST, r.action DESC, r.rule DESC) AS k
  FROM split s LEFT JOIN rules r ON (s.host = r.h OR ends_with(s.host, '.' || r.h)) AND starts_with(s.path, r.p))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE k = 1""")
def op3_url_rules(spark, sf):
    return url_rules.judge_urls(table(spark, sf, "pages", "page_id", "url"), url_rules.rule_table(spark, RULES))


# ---------------------------------------------------------------- 4: secret scans

@query("op4_secret_scan")
def op4_secret_scan(spark, sf):
    return secret_scan.scan(table(spark, sf, "documents", "doc_id", "text", "source")).drop("doc_key")


# ---------------------------------------------------------------- 5: BPE encoding and decoding

def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op5_bpe")
def op5_bpe(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text")
    decoded = bpe.round_trip(docs, tokenizer_path())
    return decoded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("text", 256).alias("decoded_sha256"))


# ---------------------------------------------------------------- 6: embedding near-dedup

@query("op6_pivot_permutation", """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93e0),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links,
  least(e.vec_id, coalesce((SELECT min(b) FROM reach WHERE a = e.vec_id), e.vec_id)) AS component_id,
  e.vec_id <= coalesce((SELECT min(b) FROM reach WHERE a = e.vec_id), e.vec_id) AS kept
FROM embeddings e""")
def op6_pivot_permutation(spark, sf):
    return embedding_dedup.near_duplicates(table(spark, sf, "embeddings", "vec_id", "embedding", "label"))


# ---------------------------------------------------------------- 7: best-fit packing

@query("op7_best_fit_packing")
def op7_best_fit_packing(spark, sf):
    return packing.pack_documents(table(spark, sf, "documents", "doc_id", "text"), tokenizer_path())


# ---------------------------------------------------------------- 8: sharding

@query("op8_virtual_slots")
def op8_virtual_slots(spark, sf):
    placed = sharding.shard_by_bytes(table(spark, sf, "documents", "doc_id", "text"), shards=8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").cast("long").alias("slot"),
                         F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


# ---------------------------------------------------------------- 9: WARC

@query("op9_warc_store", """
WITH t AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
h AS (SELECT page_id, CAST(strlen(p) AS BIGINT) AS payload_bytes, sha1(p) AS payload_digest,
  max(page_id) OVER (PARTITION BY sha256(p)) AS holder FROM t)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN holder END AS refers_to FROM h""")
def op9_warc_store(spark, sf):
    read = warc_store.archived(table(spark, sf, "pages", "page_id", "url", "html"))
    return read.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


# ---------------------------------------------------------------- 10: exact dedup

@query("op10_exact_dedup", f"""
WITH t AS (SELECT doc_id, sha256({SQL_LOWER.format("coalesce(text, '')")}) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256 FROM t""")
def op10_exact_dedup(spark, sf):
    marked = exact_dedup.mark_duplicates(table(spark, sf, "documents", "doc_id", "text"), digest_all=True)
    return marked.select("_row.doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


# ---------------------------------------------------------------- 11: document fingerprints

@query("op11_version_sketch")
def op11_version_sketch(spark, sf):
    chained = version_sketch.edited_chain(table(spark, sf, "documents", "doc_id", "text"))
    return chained.select("_row.doc_id", "_print.n_chars", F.sha2("_print.edited", 256).alias("edited_sha256"), "_print.fingerprint",
                          "_print.edited_fingerprint", "_print.near_edited", "_print.near_next")


# ---------------------------------------------------------------- 12: fill-in-middle

@query("op12_fill_middle", """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || CAST(doc_id AS VARCHAR)) AS h,
    string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
u AS (
  SELECT doc_id, t, CAST(len(p) - CASE WHEN p[len(p)] = '' THEN 1 ELSE 0 END AS BIGINT) AS n,
    list_transform(p, lambda x, i: CASE WHEN i < len(p) THEN x || chr(10) ELSE x END) AS units,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM u),
q AS (
  SELECT doc_id, t, n, array_to_string(list_slice(units, 1, a), '') AS pre, array_to_string(list_slice(units, a + 1, b), '') AS mid,
    array_to_string(list_slice(units, b + 1, len(units)), '') AS suf,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM q""")
def op12_fill_middle(spark, sf):
    made = fill_middle.transform(table(spark, sf, "documents", "doc_id", "text")).select("_row.doc_id", "_fim")
    back = fill_middle.restore(made, "_fim.output", "_fim.form")
    return back.select("_row.doc_id", "_row._fim.n", "_row._fim.form", "_row._fim.prefix_chars", "_row._fim.middle_chars",
                       F.sha2("_row._fim.output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


# ---------------------------------------------------------------- 13: filter interaction audit

@query("op13_filter_audit", """
WITH flags AS (SELECT doc_id AS k, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS tox
  FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM t),
m AS (
  SELECT part, len(ws) < 100 AS fa, 100 * len(list_distinct(ws)) < 80 * len(ws) AS fb,
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) AS fc, regexp_matches(t, '[#$%&*|]') AS fd,
    doc_id > min(doc_id) OVER (PARTITION BY sha256(t)) AS fe, coalesce(good, 0) = 1 AS good, coalesce(tox, 0) = 1 AS tox
  FROM w LEFT JOIN flags ON doc_id = k),
g AS (SELECT part, fa, fb, fc, fd, fe, good, tox, count(*) AS rows FROM m GROUP BY ALL),
bits AS (SELECT *, [fa, fb, fc, fd, fe] AS f, CAST(fa AS INT) + CAST(fb AS INT) + CAST(fc AS INT) + CAST(fd AS INT) + CAST(fe AS INT) AS fails FROM g),
l(x) AS (VALUES (1), (2), (3), (4), (5)),
orders AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, x AS step, o[x] AS own, list_slice(o, 1, x - 1) AS before FROM orders, l),
marks AS (
  SELECT b.part, s.o, s.step, s.own, b.rows, b.good, b.tox, b.f[s.own] AS failing, b.fails,
    len(list_filter(s.before, lambda i: b.f[i])) > 0 AS gone FROM bits b, steps s),
r AS (
  SELECT part, o, step, own,
    CAST(coalesce(sum(rows) FILTER (WHERE NOT gone AND NOT failing), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(rows) FILTER (WHERE NOT gone AND failing), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(rows) FILTER (WHERE gone AND failing), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(rows) FILTER (WHERE failing AND fails = 1), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(rows) FILTER (WHERE NOT gone AND failing AND good), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(rows) FILTER (WHERE NOT gone AND failing AND tox), 0) AS BIGINT) AS toxic_lost
  FROM marks GROUP BY part, o, step, own)
SELECT part, array_to_string(list_transform(o, lambda i: substr('ABCDE', i, 1)), '') AS filter_order, step, kept, removed, redundant,
  unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r""")
def op13_filter_audit(spark, sf):
    return filter_audit.audit(table(spark, sf, "documents", "doc_id", "text", "lang"), table(spark, sf, "labels", "doc_id", "quality", "toxic"))
