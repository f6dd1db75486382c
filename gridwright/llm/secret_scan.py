"""Secret scanning: candidate strings, and a random forest that removes false positives.

A candidate is a literal of any length assigned to a credential name (calls, look-ups, addresses and numbers are none,
and the credential word must be a whole word of the name), or else a run of at least ``MIN_LENGTH``
characters of ``[A-Za-z0-9+/_=-]`` with a letter or digit in it.  Runs without a digit are mostly words, so they are
findings only where the forest calls them secrets.  Features:

* length; shares of digits, lower and upper case; class changes between neighbours, longest run of one class,
  distinct characters; the mean log-probability of its letter pairs under the corpus's own pair counts;
* dictionary coverage: the share of the candidate that is made of words of the corpus (counted over all
  documents, with at least ``MIN_COUNT`` occurrences as a word of letters alone);
* path: depth of the path, place in the document, and the smoothed share of true findings at the path in training;
* neighbouring words: three before and two after, hashed, and whether the candidate is quoted or assigned.

The forest is trained from labelled findings: those a rule can judge (``label``: assigned to a credential name,
or plainly a number, a slug or corpus words), at most ``MAX_TRAINING`` of each class, the ones with the smallest
hash, both classes with the same total weight.  Everything else (counts, search, scoring) covers all documents.

Defined results: null and empty texts have no candidates; a null path is the empty path; equal rows have equal
findings, one for each distinct (id, text); with fewer than two classes to learn from the score is the label, or 1
where no rule applies and the run has a digit or is assigned, else 0; an empty table gives an empty result; extra columns are ignored (redaction carries them through).
"""

from __future__ import annotations

import math
import re
import string
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.llm.bpe import code_points
from gridwright.llm.membership import split
from gridwright.llm.store import packed, release, settle
from gridwright.llm.text_batches import steps

MIN_LENGTH = 16
MIN_COUNT = 5
MAX_TRAINING = 20_000
NEIGHBOUR_BUCKETS = 32
MASK = "[secret]"
LETTERS = string.ascii_lowercase
#: A credential word as the last word of a name: whole words before it (``db_password``, ``apiToken``), and few after it.
NAME = (r"(?<![A-Za-z0-9])(?:[A-Za-z0-9]{1,30}[_.\-]){0,6}(?-i:[a-z0-9]{1,30}(?=[A-Z]))?"
        r"(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|auth(?:orization)?|credentials?)(?:[_-]?(?:key|token|value|string|hash))?")
NAMES = re.compile(rf"(?i){NAME}[\"']?\s*[:=]\s*[\"']?$")
CREDENTIAL = ("token", "secret", "password", "passwd", "apikey", "api_key", "api-key", "accesskey", "access_key", "access-key", "auth", "credential")
ASSIGNED = re.compile(rf"""(?i){NAME}["']?\s{{0,8}}(?::=|=>|[:=])(?![=:])\s{{0,8}}"""
                      r"""(?:(?P<quote>["'])(?P<quoted>[^"'\r\n]+)(?P=quote)|["']?(?:(?:bearer|basic)\s{1,8})?(?P<bare>[^\s"']+))""")
#: Values that are code or figures rather than literals: calls, look-ups, placeholders, addresses, numbers.
NOT_LITERAL = re.compile(r"[(){}\[\]<>$]|^[a-z][a-z0-9+.-]*://|^[^A-Za-z0-9]+$", re.I)
NUMBER = re.compile(r"[+-]?[0-9][0-9.,_:/-]*[0-9%]?$")
IDENTIFIER = re.compile(r"[A-Za-z_]+$")
SLUG = re.compile(r"(?:[A-Za-z]+|[0-9]{1,4})(?:[-_/](?:[A-Za-z]+|[0-9]{1,4}))+$")
PIECE = re.compile(r"[a-z]{3,}")


# ---------------------------------------------------------------- corpus counts

@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the code points below 256: letter number (26: none), member of a candidate, digit."""
    letter = np.full(256, 26, np.uint8)
    for i, c in enumerate(LETTERS):
        letter[[ord(c), ord(c.upper())]] = i
    member = np.zeros(256, bool)
    member[[ord(c) for c in string.ascii_letters + string.digits + "+/_=-"]] = True
    digit = np.zeros(256, bool)
    digit[[ord(c) for c in string.digits]] = True
    return letter, member, digit


def _low(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts joined by newlines, 255 standing for all from 255 on, and where each text begins."""
    code = code_points("\n".join(["", *[t or "" for t in texts], ""]))
    if code.itemsize > 1:
        code = np.minimum(code, 255).astype(np.uint8)
    return code, np.cumsum([1, *[len(t or "") + 1 for t in texts]])


def _words(batches):
    """Counts of words of 3 to 24 ASCII letters, and, as two-letter entries, of neighbouring letters."""
    for part in steps(batches, "_text"):
        code, _ = _low(part.column("_text").to_pylist())
        letter, member, _ = _tables()
        number = letter[code]
        inside = number < 26
        pairs = np.bincount(number[:-1].astype(np.int32) * 27 + number[1:], minlength=27 * 27).reshape(27, 27)[:26, :26].ravel()
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        start, stop = edge[::2], edge[1::2]
        # neither a digit nor a letter beyond ASCII next to it
        free = ~(member[code] | (code >= 0xC0))
        whole = free[start - 1] & free[stop] & (stop - start >= 3) & (stop - start <= 24)
        start, size = start[whole], (stop - start)[whole]
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        body = (number + ord("a"))[np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])] if len(start) else np.zeros(0, np.uint8)
        spelled = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body))])
        counts = pc.value_counts(spelled)
        yield pa.RecordBatch.from_pydict({
            "word": pa.concat_arrays([counts.field("values"), pa.array([a + b for a in LETTERS for b in LETTERS], pa.string())]),
            "n": pa.concat_arrays([counts.field("counts"), pa.array(pairs, pa.int64())])})


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all documents; entries of two letters count letter pairs."""
    return docs.select(F.col(text).alias("_text")).mapInArrow(_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pair_scores(counts: DataFrame) -> dict[str, float]:
    """Log-probability of the second letter of a pair given the first, add-one smoothed: 676 entries."""
    n = {r.word: r.n for r in counts.filter(F.length("word") == 2).collect()}
    total = {a: sum(n.get(a + b, 0) for b in LETTERS) for a in LETTERS}
    return {a + b: math.log((n.get(a + b, 0) + 1) / (total[a] + 26)) for a in LETTERS for b in LETTERS}


# ---------------------------------------------------------------- candidates

def label_of(value: str, before: str) -> int | None:
    """1: assigned to a credential name; 0: a number or a slug; None: no rule applies."""
    if NAMES.search(before):
        return 1
    if value.isdigit() or SLUG.match(value):
        return 0
    return None


def shape_features(value: str, pairs: dict[str, float]) -> list[float]:
    n = len(value)
    kind = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "o" for c in value]
    run = longest = 1
    for a, b in zip(kind, kind[1:]):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    low = value.lower()
    seen = [pairs[p] for p in (low[i:i + 2] for i in range(n - 1)) if p in pairs]
    return [math.log(n), *[kind.count(k) / n for k in "dlu"], sum(a != b for a, b in zip(kind, kind[1:])) / max(1, n - 1), longest / n,
            len(set(low)) / n, sum(seen) / len(seen) if seen else 0.0, float(all(c in string.hexdigits for c in value))]


def find_assigned(text: str):
    """(start, value, certain) of every literal assigned to a credential name; a bare word may be prose or a variable."""
    folded = text.casefold()
    if not any(name in folded for name in CREDENTIAL):
        return
    at = 0
    while m := ASSIGNED.search(text, at):
        group = "quoted" if m["quoted"] else "bare"
        value = m[group] if m["quoted"] else m[group].rstrip(",;.)]}")
        at = m.start(group) + max(1, len(value))
        if value and not NOT_LITERAL.search(value) and not NUMBER.match(value):
            yield m.start(group), value, bool(m["quoted"]) or not IDENTIFIER.match(value)


def find_runs(texts: list[str | None]):
    """(text number, start, value) of every run of at least MIN_LENGTH characters with a letter or digit."""
    code, begin = _low(texts)
    letter, member, digit = _tables()
    inside = member[code]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, stop = edge[::2], edge[1::2]
    named = np.concatenate([[0], np.cumsum(digit[code] | (letter[code] < 26))])
    hit = (stop - start >= MIN_LENGTH) & (named[stop] > named[start])
    start, stop = start[hit], stop[hit]
    owner = np.searchsorted(begin, start, side="right") - 1
    for i, a, b in zip(owner.tolist(), (start - begin[owner]).tolist(), (stop - begin[owner]).tolist()):
        yield i, a, texts[i][a:b]


def _outside(at: int, value: str, spans: list[tuple[int, int]]):
    """The parts of a run outside the assigned values, if still long enough."""
    for a, b in [*spans, (at + len(value), 0)]:
        part = value[:max(0, a - at)]
        if len(part) >= MIN_LENGTH and any(c.isalnum() for c in part):
            yield at, part
        if b > at:
            at, value = b, value[b - at:]


def all_candidates(texts: list[str | None]):
    """(text number, start, value, assigned): assigned is None for a run, else whether the value is certain."""
    runs: dict[int, list] = {}
    for i, at, value in find_runs(texts):
        runs.setdefault(i, []).append((at, value))
    for i, text in enumerate(texts):
        given = list(find_assigned(text)) if text else []
        spans = [(a, a + len(v)) for a, v, _ in given]
        k = 0
        for at, value in runs.get(i, []):
            while k < len(spans) and spans[k][1] <= at:
                k += 1
            met = [s for s in spans[k:k + len(value)] if s[0] < at + len(value)]
            for a, v in _outside(at, value, met) if met else [(at, value)]:
                yield i, a, v, None
        for a, v, certain in given:
            yield i, a, v, certain


def find_candidates(texts: list[str | None]):
    """(text number, start, value) of every candidate that is a finding whatever the forest says of it."""
    for i, at, value, assigned in sorted(all_candidates(texts), key=lambda c: c[:2]):
        if assigned is not None or any(c in string.digits for c in value):
            yield i, at, value


def _candidates(batches, pairs: dict[str, float]):
    schema = pa.schema([("doc_key", pa.int64()), ("path", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("label", pa.int32()), ("listed", pa.bool_()),
                        ("pieces", pa.list_(pa.string())), ("words", pa.list_(pa.string())), ("shape", pa.list_(pa.float64()))])
    for part in steps(batches, "_text"):
        texts = part.column("_text").to_pylist()
        paths = part.column("path").to_pylist()
        keys = part.column("doc_key").to_pylist()
        rows, owner = [], []
        for i, at, value, assigned in all_candidates(texts):
            text, end = texts[i], at + len(value)
            before, after = text[max(0, at - 80):at], text[end:end + 80]
            # a bare identifier is a variable or prose
            label = label_of(value, before) if assigned is None else int(assigned)
            near = [f"b:{w}" for w in before.lower().split()[-3:]] + [f"a:{w}" for w in after.lower().split()[:2]]
            shape = [*shape_features(value, pairs), float(before[-1:] in ("'", '"') and after[:1] in ("'", '"')),
                     float(bool(re.search(r"[:=]\s*[\"']?$", before))), float(paths[i].count("/")), at / max(1, len(text))]
            rows.append({"doc_key": keys[i], "path": paths[i], "start": at, "length": len(value), "label": label,
                         "listed": assigned is not None or any(c in string.digits for c in value),
                         "pieces": PIECE.findall(value.lower()), "words": near, "shape": shape})
            owner.append(i)
        found = pa.RecordBatch.from_pylist(rows, schema)
        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner, pa.int64())), *found.columns], ["doc_id", *schema.names])


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def candidates(docs: DataFrame, pairs: dict[str, float], id_col: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text)).alias("doc_key"), F.coalesce(F.col(path).cast("string"), F.lit("")).alias("path"),
                       F.col(text).alias("_text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(partial(_candidates, pairs=pairs), f"doc_id {kind}, doc_key long, path string, start int, length int, label int, listed boolean, "
                           "pieces array<string>, words array<string>, shape array<double>").dropDuplicates(["doc_id", "doc_key", "start"])


def coverage(found: DataFrame, counts: DataFrame) -> DataFrame:
    """``found`` with the share of each candidate that corpus words make up."""
    pieces = found.select("doc_id", "doc_key", "start", "length", F.explode("pieces").alias("word"))
    known = counts.filter((F.length("word") > 2) & (F.col("n") >= MIN_COUNT)).select("word")
    covered = (pieces.join(known, "word").groupBy("doc_id", "doc_key", "start")
               .agg((F.sum(F.length("word")) / F.max("length")).alias("covered"))
               .select(F.col("doc_id").alias("_d"), F.col("doc_key").alias("_k"), F.col("start").alias("_s"), "covered"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("doc_key") == F.col("_k")) & (F.col("start") == F.col("_s"))
    return found.join(covered, same, "left").drop("_d", "_k", "_s").withColumn("covered", F.coalesce("covered", F.lit(0.0)))


def plain_words(found: DataFrame) -> DataFrame:
    """Runs without a digit that corpus words make up for the most part are labelled as words."""
    return found.withColumn("label", F.when(F.col("label").isNull() & ~F.col("listed") & (F.col("covered") >= 0.5), 0).otherwise(F.col("label")))


# ---------------------------------------------------------------- forest

def score(found: DataFrame, *, max_training: int = MAX_TRAINING, trees: int = 20, depth: int = 6) -> DataFrame:
    """``found`` with ``score``: 1 where a rule finds a secret, else the forest's probability of one."""
    order = F.xxhash64("doc_id", "doc_key", "start")
    # a bounded sample of each class, so that a rare class is never lost and never outweighed
    sample = [found.filter(F.col("label") == c).orderBy(order, "doc_key", "start").limit(max_training) for c in (0, 1)]
    labelled = settle(sample[0].unionByName(sample[1]), "labelled")
    # two rows at most
    sizes = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return found.withColumn("score", F.coalesce(F.col("label").cast("double"), F.col("listed").cast("double")))
    rates = labelled.groupBy("path").agg(((F.sum("label") + 1.0) / (F.count(F.lit(1)) + 2.0)).alias("path_rate"))
    bucket = F.transform("words", lambda w: F.pmod(F.xxhash64(w), F.lit(NEIGHBOUR_BUCKETS)))
    hashed = F.transform(F.sequence(F.lit(0), F.lit(NEIGHBOUR_BUCKETS - 1)), lambda i: F.array_contains(F.col("_bucket"), i.cast("long")).cast("double"))

    def featured(df: DataFrame) -> DataFrame:
        return (df.join(rates, "path", "left").withColumn("_bucket", bucket)
                .withColumn("features", array_to_vector(F.concat("shape", F.array("covered", F.coalesce("path_rate", F.lit(0.5))), hashed)))
                .drop("_bucket", "path_rate"))
    weight = F.when(F.col("label") == 1, sum(sizes.values()) / (2 * sizes[1])).otherwise(sum(sizes.values()) / (2 * sizes[0]))
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="_weight", numTrees=trees, maxDepth=depth, seed=7)
    model = forest.fit(featured(labelled).withColumn("_weight", weight))
    # what a rule calls a secret is one, whatever the forest says
    return model.transform(featured(found)).withColumn("score", F.when(F.col("label") == 1, 1.0).otherwise(vector_to_array("probability")[1]))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = "source", threshold: float = 0.5) -> DataFrame:
    """doc_id, doc_key, path, start, length, label, covered, score and ``secret`` of every candidate."""
    counts = settle(word_counts(docs, text), "words")
    listed = settle(candidates(docs, pair_scores(counts), id_col, text, path), "candidates")
    found = settle(plain_words(coverage(listed, counts)), "covered")
    release(listed, counts)
    return score(found).filter(F.col("listed") | (F.col("score") >= threshold)).select("doc_id", "doc_key", "path", "start", "length", "label", "covered", "score", (F.col("score") >= threshold).alias("secret"))


def masked(text: str, starts, lengths) -> str:
    for start, length in sorted(zip(starts, lengths), reverse=True):
        text = text[:start] + MASK + text[start + length:]
    return text


def _mask(starts: pd.Series, lengths: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else masked(t, s, n) for s, n, t in zip(starts, lengths, texts)], dtype=object)


def redact(docs: DataFrame, id_col: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """``docs`` with every confirmed secret replaced by MASK, all rows and columns kept."""
    spans = settle(scan(docs, id_col, text, path).filter("secret").groupBy("doc_id", "doc_key")
                   .agg(F.collect_list(F.struct("start", "length")).alias("_spans"))  # spans of one text do not overlap
                   .select(F.col("doc_id").alias("_d"), F.col("doc_key").alias("_k"), "_spans"), "spans")
    # texts without a secret stay where they are
    maybe, rest = split(packed(docs, _id=F.col(id_col), _key=text_key(F.col(text))), ["_id", "_key"], spans, ["_d", "_k"])
    joined = maybe.join(spans, F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    mask = F.pandas_udf(_mask, "string")
    clean = mask("_spans.start", "_spans.length", F.when(F.col("_spans").isNotNull(), F.col(f"_row.`{text}`")))
    columns = [F.coalesce(clean, F.col(f"_row.`{c}`")).alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    return rest.select("_row.*").unionByName(joined.select(columns))
