"""Word BPE encoding and decoding through a pair occurrence index.

A step cuts its texts into words with array operations, keeps each distinct word once, and lays the distinct
words out as one linked list of byte symbols.  An index maps every mergeable pair to all its positions.  The
active ranks are taken in ascending order; a rank is applied at all its positions at once, and only the pairs
that touch a merged position are looked up again and appended to the lists of their ranks.  The cost follows the
number of symbols and merges, so one word of a million characters is no worse than many short ones.

The tokenizer file (vocabulary, merges, special tokens) is a parameter.  Covered: byte-level BPE with an
end-of-word suffix, NFC and lower-casing, words of letters, single digits, runs of other characters and the
English contractions; without a decoder, decoding joins the tokens with spaces.  Anything else is refused when
the file is loaded.

Defined results: a null or empty text has no tokens and decodes to the empty text; special tokens in a text are
matched literally before normalisation and become their ids; repeated rows give repeated rows; an empty table
gives an empty result; extra columns are carried through, and a column named like an output is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridwright.llm.text_batches import list_array, steps, text_bytes

SPACE, LETTER, NUMBER, OTHER = range(4)
CACHED_WORDS = 120_000
SEGMENT_CHARS = 4 << 20  # longer texts are cut at white space, which no word spans

WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point."""
    kind = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE] = SPACE
    return table


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Vocabulary and merges of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["decoder"] or spec["post_processor"] or not model["end_of_word_suffix"] or model["dropout"]:
            raise ValueError("a byte-level word BPE without decoder and post-processor is expected")
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        end = model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[s] for s in symbols], np.int64)
        self.final = np.array([self.vocab[s + end] for s in symbols], np.int64)
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        self.left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        keys = self.left << 17 | self.right
        # a pair listed twice keeps its last rank
        last = {int(k): r for r, k in enumerate(keys)}
        self._hash_pairs(np.array(list(last), np.int64), np.array(list(last.values()), np.int32))
        tokens = [""] * (max(*self.vocab.values(), *self.special.values()) + 1)
        for token, i in {**self.vocab, **self.special}.items():
            tokens[i] = token
        self.spaced = pa.array([t + " " for t in tokens], pa.large_string())
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.starts = self.counts = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def _hash_pairs(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing: the pair of a slot, its rank, and how many slots a search may take."""
        self.bits = max(4, int(len(keys) * 8).bit_length())
        self.slot_key, self.slot_rank = np.full(1 << self.bits, -2, np.int64), np.full(1 << self.bits, -1, np.int32)
        at, todo, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(todo):
            self.probes += 1
            free = todo[self.slot_key[at[todo]] == -2]
            self.slot_key[at[free]] = keys[free]  # of several, one stays
            won = free[self.slot_key[at[free]] == keys[free]]
            self.slot_rank[at[won]] = ranks[won]
            todo = np.setdiff1d(todo, won)
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        # Fibonacci hashing
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 if none; a negative symbol is in no pair."""
        key = left.astype(np.int64) << 17 | right
        at = self._slot(key)
        held = self.slot_key[at]
        rank = np.where(held == key, self.slot_rank[at], -1)
        todo = np.flatnonzero((held != key) & (held != -2) & (key >= 0))
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            held = self.slot_key[at[todo]]
            hit = held == key[todo]
            rank[todo[hit]] = self.slot_rank[at[todo[hit]]]
            todo = todo[~hit & (held != -2)]
        return rank

    def merge_words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, flat, and tokens per word.  ``data``: their bytes, no word is empty."""
        n = len(data)
        sym = np.empty(n + 1, np.int32)  # entry n stands for "no neighbour"
        sym[:n] = self.inner[data]
        ends = offsets[1:] - 1
        sym[ends] = self.final[data[ends]]
        sym[n] = -1
        nxt = np.minimum(np.arange(1, n + 2, dtype=np.int32), n)
        nxt[ends] = n
        prv = np.arange(-1, n, dtype=np.int32)
        prv[offsets[:-1]] = n
        prv[n] = n
        index: dict[int, list[np.ndarray]] = {}

        def add(positions: np.ndarray) -> None:
            rank = self._rank(sym[positions], sym[nxt[positions]])
            found = np.flatnonzero(rank >= 0)
            if not len(found):
                return
            rank, positions = rank[found], positions[found]
            order = np.argsort(rank, kind="stable")
            rank, positions = rank[order], positions[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(rank)]
            for r, a, b in zip(rank[bounds[:-1]].tolist(), bounds, bounds[1:]):
                if r in index:
                    index[r].append(positions[a:b])
                else:
                    index[r] = [positions[a:b]]
                    heapq.heappush(active, r)

        active: list[int] = []
        add(np.flatnonzero(nxt[:n] < n).astype(np.int32))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            left, right = self.left[r], self.right[r]
            at = at[(sym[at] == left) & (sym[nxt[at]] == right)]
            if not len(at):
                continue
            if left == right:  # in a run of one symbol the pairs overlap: every second one counts
                at = np.unique(at)
                fresh = np.ones(len(at), bool)
                fresh[1:] = nxt[at[:-1]] != at[1:]
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            gone = nxt[at]
            after = nxt[gone]
            sym[at] = self.made[r]
            sym[gone] = -1
            nxt[at] = after
            prv[after] = at
            prv[n] = n
            add(np.concatenate([prv[at], at]))
        alive = sym[:n] >= 0
        return sym[:n][alive], np.add.reduceat(alive, offsets[:-1], dtype=np.int64) if len(offsets) > 1 else np.zeros(0, np.int64)

    def _lookup(self, words: pa.Array, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and count of the ids of each distinct word, and the ids; merges the words not met before.

        Words that occur twice in a step are kept for later steps.
        """
        if len(self.known) > CACHED_WORDS:
            self._forget()
        spelled = words.to_pylist()
        known = self.known
        places = np.fromiter((known.get(w, -1) for w in spelled), np.int64, len(spelled))
        new = np.flatnonzero(places < 0)
        if len(new):
            fresh = [spelled[i] for i in new.tolist()]
            offsets = np.zeros(len(fresh) + 1, np.int64)
            np.cumsum([len(w) for w in fresh], out=offsets[1:])
            ids, counts = self.merge_words(np.frombuffer(b"".join(fresh), np.uint8), offsets)
            begin = np.cumsum(counts) - counts
            starts = np.concatenate([self.starts, len(self.flat) + begin])
            both = np.concatenate([self.counts, counts])
            flat = np.concatenate([self.flat, ids])
            places[new] = len(self.starts) + np.arange(len(new))
            often = np.flatnonzero(times[new] > 1)
            kept = counts[often]
            ends = np.cumsum(kept)
            known.update(zip([fresh[i] for i in often.tolist()], range(len(self.starts), len(self.starts) + len(often))))
            self.starts = np.concatenate([self.starts, len(self.flat) + ends - kept])
            self.counts = np.concatenate([self.counts, kept])
            if len(often):
                self.flat = np.concatenate([self.flat, ids[np.repeat(begin[often] - ends + kept, kept) + np.arange(ends[-1])]])
            return starts[places], both[places], flat
        return self.starts[places], self.counts[places], self.flat

    def _encode_segments(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts, flat, and tokens per text."""
        texts = [normal_form(t) for t in texts]
        joined = "\n".join(texts)
        code = code_points(joined)
        if not len(code):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        kind = char_classes()[: 256 if code.itemsize == 1 else None][code]
        start = np.empty(len(code), bool)
        start[0] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == NUMBER
        start &= kind != SPACE
        quotes = np.flatnonzero(code == 39)
        if len(quotes):
            contractions(code, kind, start, quotes)
        kept = kind != SPACE
        data = np.frombuffer(joined.encode("utf-8"), np.uint8)
        word_at = np.flatnonzero(start)
        if len(data) == len(code):
            offsets = np.cumsum(kept, dtype=np.int32)[word_at] - 1
            data = data[kept]
        else:
            size = np.ones(len(code), np.uint8)
            for least in (0x80, 0x800, 0x10000) if code.itemsize > 1 else (0x80,):
                size += code >= least
            data = data[np.repeat(kept, size)]
            size[~kept] = 0
            offsets = (np.cumsum(size, dtype=np.int32) - size)[word_at]
        chars = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        bounds = np.searchsorted(word_at, np.concatenate([[0], np.cumsum(chars + 1)]))
        offsets = np.append(offsets, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(word_at), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        coded = words.dictionary_encode()
        word = coded.indices.to_numpy()
        starts, counts, flat = self._lookup(coded.dictionary, np.bincount(word, minlength=len(coded.dictionary)))
        counts = counts[word]
        upto = np.concatenate([[0], np.cumsum(counts)])
        shift = (starts[word] - upto[:-1]).astype(np.int32)
        ids = flat[np.repeat(shift, counts) + np.arange(upto[-1], dtype=np.int32)]
        return ids, np.diff(upto[bounds])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and offsets (one more than texts)."""
        segments: list[str] = []
        owner: list[int] = []
        fixed: list[tuple[int, int]] = []  # (segment, special id)
        for i, text in enumerate(texts):
            for piece in self._pieces(text or ""):
                if isinstance(piece, int):
                    fixed.append((len(segments), piece))
                    piece = ""
                segments.append(piece)
                owner.append(i)
        ids, counts = self._encode_segments(segments)
        if fixed:
            upto = np.concatenate([[0], np.cumsum(counts)])
            where = np.array([s for s, _ in fixed])
            ids = np.insert(ids, upto[where], [i for _, i in fixed])
            counts[where] += 1
        per_text = np.bincount(np.array(owner, np.int64), counts, minlength=len(texts)).astype(np.int64) if owner else np.zeros(len(texts), np.int64)
        return ids.astype(np.uint32), np.concatenate([[0], np.cumsum(per_text)])

    def _pieces(self, text: str):
        """Texts between special tokens, and the ids of these; long texts are cut at white space."""
        if self.special_pattern is not None and (found := list(self.special_pattern.finditer(text))):
            at = 0
            for m in found:
                yield from cut_at_space(text[at:m.start()])
                yield self.special[m.group()]
                at = m.end()
            yield from cut_at_space(text[at:])
        else:
            yield from cut_at_space(text)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of id lists: the tokens joined with spaces."""
        spelled = pc.take(self.spaced, pa.array(ids.astype(np.int64)))
        _, ends, data = spelled.buffers()
        byte_at = np.frombuffer(ends, np.int64)[: len(ids) + 1][offsets] if len(ids) else np.zeros(len(offsets), np.int64)
        data = memoryview(data) if data is not None else memoryview(b"")
        return pa.array([bytes(data[a:max(a, b - 1)]).decode() for a, b in zip(byte_at[:-1].tolist(), byte_at[1:].tolist())], pa.string())


def normal_form(text: str) -> str:
    """NFC and lower case, one character at a time (no final sigma)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")
    return text.lower()


def code_points(text: str) -> np.ndarray:
    """Code points as bytes where all are below 256, else as 32-bit numbers."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def cut_at_space(text: str):
    """The text in pieces of about SEGMENT_CHARS; a piece without white space stays whole."""
    at = 0
    while len(text) - at > SEGMENT_CHARS:
        m = re.compile(r"[ \t\n\r]").search(text, at + SEGMENT_CHARS)
        if not m:
            break
        yield text[at:m.end()]
        at = m.end()
    yield text[at:] if at else text


def contractions(code: np.ndarray, kind: np.ndarray, start: np.ndarray, quotes: np.ndarray) -> None:
    """Let an apostrophe that begins a run take s, t, m, d, re, ve or ll after it."""
    first = quotes[(quotes == 0) | (kind[quotes - 1] != OTHER)]
    padded = np.append(code, [0, 0])
    one, two = padded[first + 1], padded[first + 2]
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for hit, size in ((short, 2), (long, 3)):
        at = first[hit]
        start[at + 1] = False
        after = at + size
        after = after[after < len(code)]
        start[after[kind[after] == LETTER]] = True


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    """One instance for each worker process, with the words it has met."""
    return WordBpe(path)


def with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [c for c in batch.schema.names if c != name]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], values], [*names, name])


def _encode(batches, path: str, text: str, ids: str, packed: bool):
    model = load(path)
    for part in steps(batches, text):
        flat, offsets = model.encode(part.column(text).to_pylist())
        if packed:
            column = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(flat.astype("<u4"))])
        else:
            column = list_array(flat.astype(np.int32), offsets, pa.int32())
        yield with_column(part, ids, column)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", *, packed: bool = False) -> DataFrame:
    """``docs`` with the token ids of ``text`` as an array column, or ``packed`` as little-endian 32-bit numbers."""
    kind = T.BinaryType() if packed else T.ArrayType(T.IntegerType())
    schema = T.StructType([f for f in docs.schema.fields if f.name != ids] + [T.StructField(ids, kind)])

    return docs.mapInArrow(partial(_encode, path=path, text=text, ids=ids, packed=packed), schema)


def _round_trip(batches, path: str, text: str):
    for part in _encode(batches, path, text, "ids", True):
        yield with_column(part, text, load(path).decode(*id_lists(part.column("ids"))))


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``decode(encode(docs, packed=True))`` in one pass: ``ids`` beside the decoded ``text``."""
    columns = [f for f in docs.schema.fields if f.name not in ("ids", text)]
    schema = T.StructType([*columns, T.StructField("ids", T.BinaryType()), T.StructField(text, T.StringType())])
    return docs.mapInArrow(partial(_round_trip, path=path, text=text), schema)


def id_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of an array or packed column; nulls as empty lists."""
    if pa.types.is_binary(column.type):
        body = b"".join(v or b"" for v in column.to_pylist())
        return np.frombuffer(body, "<u4"), np.concatenate([[0], np.cumsum(text_bytes(column) // 4)])
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def _decode(batches, path: str, text: str, ids: str):
    model = load(path)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            yield with_column(part, text, model.decode(*id_lists(part.column(ids))))


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``encoded`` with the text of its token ids (array or packed) as a column."""
    schema = T.StructType([f for f in encoded.schema.fields if f.name != text] + [T.StructField(text, T.StringType())])

    return encoded.mapInArrow(partial(_decode, path=path, text=text, ids=ids), schema)
