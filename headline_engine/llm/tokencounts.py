"""Token counts (13): map-side two-tier lookup of pre-token lengths.

A text's token count is the sum of its pre-tokens' counts, so no text need be encoded whole and no pre-token need be
shuffled:

* Tier 1 is a compact open-addressing hash table (128-bit key, length) of frequent pre-tokens. It is broadcast; its size
  is bounded by TABLE_ENTRIES. It is filled from a sample of about SAMPLE_BYTES of text, which decides only how often
  tier 2 is asked, never a result.
* Tier 2 is each worker's cache of the pre-tokens that the table lacks. It keeps two generations of CACHE entries, so
  what stays in use stays in the cache and memory is bounded. What is in neither is encoded by the tokenizer.

Cutting, hashing, lookup and summing are vectorised over the bytes of a chunk of texts. A text longer than a chunk is
taken in several pieces that end at white space.

A pre-token here is a run of ASCII and Latin-1 letters, one digit, or a run of other ASCII characters. A run between
white spaces that holds anything else (an apostrophe, `<`, a control character, another script) is taken as one unit and
given to the tokenizer whole, as are whole texts for vocabularies with other rules.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); a null doc_id and repeated rows give a row each; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headline_engine.llm.common import BASE, BASE2, CHUNK_BYTES, Words, process_latest, signed, text_buffer

#: Entries of the broadcast table at most (its arrays take 18 bytes for each of twice as many slots).
TABLE_ENTRIES = 1 << 16
#: Expected bytes of text in the sample that fills the table, and entries that one of its tasks returns at most.
SAMPLE_BYTES = 8 << 20
TASK_ENTRIES = 1 << 17
#: Pre-tokens in each of the two generations of a worker's cache.
CACHE = 200_000
LIMIT = 2048

OUT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

#: The rules under which texts are cut here, as the vocabulary file states them (fixed values).
RULES = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "split": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}

_BLANK, _LETTER, _DIGIT, _MARK, _ODD, _UNIT = range(6)


def _classes() -> np.ndarray:
    t = np.full(256, _ODD, np.uint8)
    t[0x21:0x7F] = _MARK
    t[[0x20, 0x09, 0x0A, 0x0D]] = _BLANK
    t[0x30:0x3A] = _DIGIT
    t[0x41:0x5B] = t[0x61:0x7B] = _LETTER
    t[[0x27, 0x3C]] = _ODD  # contractions; special strings
    return t


_CLASS = _classes()


def pretokens(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Pre-tokens of the texts data[offsets[i]:offsets[i + 1]], lower-cased where they are letters."""
    n = len(data)
    k = np.zeros(n + 2, np.uint8)
    k[1:-1] = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if n else np.zeros(0, np.int64)
    tail = data[lead + 1]
    lead = lead[(tail >= 0x80) & (tail <= 0xBF) & (tail != 0x97) & (tail != 0xB7)]
    k[lead + 1] = k[lead + 2] = _LETTER
    cut = np.zeros(n + 1, bool)  # a text begins or ends before this byte
    cut[offsets] = True
    filled = k != _BLANK
    first = np.flatnonzero(filled[1:-1] & (~filled[:-2] | cut[:-1]))
    last = np.flatnonzero(filled[1:-1] & (~filled[2:] | cut[1:])) + 1
    odd = np.concatenate([np.zeros(1, np.int64), np.cumsum(k[1:-1] == _ODD)])
    whole = odd[last] > odd[first]
    if whole.any():
        step = np.zeros(n + 1, np.int8)
        step[first[whole]] += 1
        step[last[whole]] -= 1
        k[1:-1][np.cumsum(step[:-1]) > 0] = _UNIT
    own = k[1:-1]
    own_start = (own != _BLANK) & ((own != k[:-2]) | (own == _DIGIT) | cut[:-1])
    own_end = (own != _BLANK) & ((own != k[2:]) | (own == _DIGIT) | cut[1:])
    low = np.where((own == _LETTER) & (data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data)
    upper = lead[(own[lead] == _LETTER) & (data[lead + 1] <= 0x9E)] + 1
    low[upper] += np.uint8(32)
    start = np.flatnonzero(own_start)
    return Words(low, start, np.flatnonzero(own_end) + 1, np.searchsorted(start, offsets))


@dataclass
class LengthTable:
    """Open addressing with linear probing: slot of a key = low bits of its first half."""

    key: np.ndarray
    check: np.ndarray
    length: np.ndarray  # 0: empty slot
    probes: int

    @classmethod
    def of(cls, key: np.ndarray, check: np.ndarray, length: np.ndarray) -> LengthTable:
        slots = 1 << max(4, int(2 * len(key) - 1).bit_length() if len(key) else 4)
        out = cls(np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.uint16), 0)
        left = np.arange(len(key))
        at = (key & np.uint64(slots - 1)).astype(np.int64)
        while len(left):
            free = out.length[at[left]] == 0
            _, one = np.unique(at[left[free]], return_index=True)
            put = left[free][one]
            out.key[at[put]], out.check[at[put]], out.length[at[put]] = key[put], check[put], length[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = (at[left] + 1) & (slots - 1)
            out.probes += 1
        return out

    def __call__(self, key: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Lengths; 0 where the table lacks the key."""
        got = np.zeros(len(key), np.int64)
        left = np.arange(len(key))
        at = (key & np.uint64(len(self.key) - 1)).astype(np.int64)
        for _ in range(self.probes):
            here = self.length[at[left]]
            same = (self.key[at[left]] == key[left]) & (self.check[at[left]] == check[left]) & (here > 0)
            got[left[same]] = here[same]
            left = left[~same & (here > 0)]
            if not len(left):
                break
            at[left] = (at[left] + 1) & (len(self.key) - 1)
        return got


class Lengths:
    """A worker's tokenizer with its two-generation cache of pre-token lengths."""

    def __init__(self, path: str, cache: int = CACHE) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.cache = cache
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}
        self.cuts = False
        if path.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        self.encode = lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = [x["pattern"].get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
        specials = all("<" in x["content"] and not x["single_word"] and not x["normalized"] for x in spec.get("added_tokens", []))
        self.cuts = kinds == RULES["normalizer"] and split == [RULES["split"]] and specials

    def of(self, pieces: list[bytes]) -> list[int]:
        """Token counts of distinct pre-tokens."""
        out, new = [0] * len(pieces), []
        for i, p in enumerate(pieces):
            got = self.young.get(p)
            if got is None:
                got = self.old.get(p)
                if got is None:
                    new.append(i)
                    continue
                self._keep(p, got)
            out[i] = got
        for i, n in zip(new, self.encode([pieces[i].decode() for i in new]) if new else ()):
            out[i] = n
            self._keep(pieces[i], n)
        return out

    def _keep(self, piece: bytes, n: int) -> None:
        if len(piece) > 256:
            return
        if len(self.young) >= self.cache:
            self.old, self.young = self.young, {}
        self.young[piece] = n


def lengths(path: str) -> Lengths:
    """The process's lengths for a vocabulary file (one large object a worker)."""
    return process_latest("large", "lengths_" + path, lambda: Lengths(path))


def _distinct(key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of one row of each key, each row's group); keys are equal in both halves."""
    both = np.empty(len(key), [("a", np.uint64), ("b", np.uint64)])
    both["a"], both["b"] = key, check
    u, first, group = np.unique(key, return_index=True, return_inverse=True)
    if (check != check[first][group]).any():  # two keys share a first half: sort by both
        u, first, group = np.unique(both, return_index=True, return_inverse=True)
    return first, group


def _parts(data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first text, bytes before, offsets of the slice): texts together up to about `limit` bytes; a longer text goes in
    parts that end after white space (whole where it has none)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        if j > i + 1 or offsets[j] - offsets[i] <= limit:
            yield i, int(offsets[i]), offsets[i : j + 1] - offsets[i]
        else:
            s, e = int(offsets[i]), int(offsets[j])
            while s < e:
                t = min(e, s + limit)
                if t < e:
                    for width in (1 << 12, limit):
                        blank = np.flatnonzero(_CLASS[data[max(s, t - width) : t]] == _BLANK)
                        if len(blank):
                            t = max(s, t - width) + int(blank[-1]) + 1
                            break
                    else:
                        blank = next((t + a + int(x[0]) for a in range(0, e - t, limit) if len(x := np.flatnonzero(_CLASS[data[t + a : min(e, t + a + limit)]] == _BLANK))), None)
                        t = e if blank is None else blank + 1
                yield i, s, np.array([0, t - s])
                s = t
        i = j


def _hashed(w: Words) -> tuple[np.ndarray, np.ndarray]:
    return w.hashes(BASE), w.hashes(BASE2)


def count_batch(texts: pa.Array, path: str, table: LengthTable | None, limit: int = CHUNK_BYTES) -> np.ndarray:
    """Token counts of the texts of a column."""
    tier2 = lengths(path)
    out = np.zeros(len(texts), np.int64)
    if not tier2.cuts:
        for i, t in enumerate(texts):
            out[i] = tier2.encode([t.as_py() or ""])[0]
        return out
    data, offsets = text_buffer(texts)
    for i, at, off in _parts(data, offsets, limit):
        part = data[at : at + int(off[-1])]
        if len(off) == 2 and len(part) > 4 * limit:  # a run without white space: no cut is safe to make here
            out[i] += tier2.encode([part.tobytes().decode()])[0]
            continue
        w = pretokens(part, off)
        if not len(w.start):
            continue
        key, check = _hashed(w)
        n = table(key, check) if table is not None else np.zeros(len(key), np.int64)
        miss = np.flatnonzero(n == 0)
        if len(miss):
            first, group = _distinct(key[miss], check[miss])
            raw = w.data.tobytes()
            got = tier2.of([raw[w.start[m] : w.end[m]] for m in miss[first]])
            n[miss] = np.array(got, np.int64)[group]
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        out[i : i + len(off) - 1] += total[w.doc[1:]] - total[w.doc[:-1]]
    return out


def _sampled(path: str, entries: int) -> Callable:
    schema = pa.schema([("key", pa.int64()), ("check", pa.int64()), ("length", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tier2 = lengths(path)
        if not tier2.cuts:
            return
        keys = checks = np.zeros(0, np.uint64)
        size = counts = np.zeros(0, np.int64)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0))
            for _, at, off in _parts(data, offsets, CHUNK_BYTES):
                part = data[at : at + int(off[-1])]
                if len(part) > 4 * CHUNK_BYTES:
                    continue
                w = pretokens(part, off)
                key, check = _hashed(w)
                first, group = _distinct(key, check)
                raw = w.data.tobytes()
                got = np.array(tier2.of([raw[w.start[m] : w.end[m]] for m in first]), np.int64)
                keys, checks = np.concatenate([keys, key[first]]), np.concatenate([checks, check[first]])
                size, counts = np.concatenate([size, got]), np.concatenate([counts, np.bincount(group, minlength=len(first))])
                first, group = _distinct(keys, checks)
                counts = np.bincount(group, counts, len(first)).astype(np.int64)
                keys, checks, size = keys[first], checks[first], size[first]
                if len(keys) > entries:
                    top = np.argsort(-counts, kind="stable")[:entries]
                    keys, checks, size, counts = keys[top], checks[top], size[top], counts[top]
        if len(keys):
            yield pa.RecordBatch.from_arrays([signed(keys), signed(checks), pa.array(size), pa.array(counts)], schema=schema)

    return run


def frequent(docs: DataFrame, path: str, text: str = "text", entries: int = TABLE_ENTRIES, sample_bytes: int = SAMPLE_BYTES) -> LengthTable:
    """Tier 1: the most frequent pre-tokens of a sample of about `sample_bytes` of text (at most `entries`)."""
    col = F.col(text).cast("string")
    total = docs.agg(F.sum(F.octet_length(col))).first()[0] or 0
    if not total:
        return LengthTable.of(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint16))
    some = docs.select(col.alias("text"))
    if total > sample_bytes:
        some = some.sample(sample_bytes / total, seed=13)
    seen = some.mapInArrow(_sampled(path, TASK_ENTRIES), "key long, check long, length long, n long").toArrow()
    key, check = (seen[c].to_numpy().view(np.uint64) for c in ("key", "check"))
    first, group = _distinct(key, check)
    n = np.bincount(group, seen["n"].to_numpy(), len(first)) if len(first) else np.zeros(0)
    size = seen["length"].to_numpy()[first]
    fit = np.flatnonzero((size > 0) & (size < 1 << 16))
    top = fit[np.argsort(-n[fit], kind="stable")[:entries]]
    return LengthTable.of(key[first][top], check[first][top], size[top].astype(np.uint16))


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text", doc_id: str = "doc_id", table: LengthTable | None = None) -> DataFrame:
    """A row per document: doc_id, n_bytes (UTF-8), n_tokens (as the library of the vocabulary file `path` gives them,
    without added tokens) and over_limit (n_tokens > limit)."""
    table = table if table is not None else frequent(docs, path, text)
    share = docs.sparkSession.sparkContext.broadcast((table.key, table.check, table.length, table.probes))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tier1 = LengthTable(*share.value)
        for batch in batches:
            _, offsets = text_buffer(batch.column(1))
            n = count_batch(batch.column(1), path, tier1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], schema=schema)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, OUT)
