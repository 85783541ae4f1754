"""Token ids of whole columns: each distinct pre-token of a chunk of texts is looked up once, and the texts' ids are
gathered with array operations.

A worker's pool maps the pre-tokens' 128-bit hashes to ids in sorted arrays, so a chunk's known pre-tokens are found by one
binary search of arrays and only new ones are touched singly; when it is full, those not used for longest go. Two kinds of vocabulary are cut
here: the kind that tokencounts cuts, and the byte-level kind whose pre-tokens take the space before them (spaced()). Texts
in which that second cut would be unsafe, and texts under vocabularies with other rules, are encoded by tokens.Encoder.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from headline_engine.llm.common import BASE, BASE2, CHUNK_BYTES, Words, mix64, process_latest, text_buffer
from headline_engine.llm.tokencounts import _BLANK, _CLASS, _LETTER, _ODD, _UNIT, Lengths, _distinct, _hashed, _parts, pretokens
from headline_engine.llm.tokens import Encoder, _byte_chars

#: Pre-tokens that a worker's pool keeps when it is cut; it is cut at twice as many.
CACHE = 300_000
_LINE = 9
#: Bytes of the longest pre-token that is hashed by words of eight bytes; masks of a word's first bytes.
LONG = 256
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Pre-tokens of ASCII and Latin-1 letters (lower-case in the first kind): the vocabulary merges them as they are.
_PLAIN = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Bytes of white space other than the space and the line feed, and of control characters that some rules take for it.
_STRANGE = np.zeros(256, bool)
_STRANGE[[0x09, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F]] = True


def spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """(pre-tokens, texts cut safely) under the byte-level rules: a run of letters, of digits or of marks with the space
    before it, or a line feed. Safe are texts whose white space is single spaces and line feeds inside the text; a run
    between them that holds anything but ASCII and Latin-1 letters is one unit. Unsafe texts get no pre-tokens."""
    n, texts = len(data), len(offsets) - 1
    if not n:
        return Words(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(texts + 1, np.int64)), np.ones(texts, bool)
    blank = (data == 0x20) | (data == 0x0A)
    edge = np.zeros(n + 1, bool)  # a text begins or ends before this byte
    edge[offsets] = True
    wrong = _STRANGE[data]
    wrong[1:] |= blank[1:] & blank[:-1] & ~edge[1:-1]
    wrong |= blank & (edge[:-1] | edge[1:])
    at = np.flatnonzero(data >= 0xC2)  # first bytes of longer characters
    lead = at[data[at] == 0xC3]
    at = at[(data[at] <= 0xC2) | (data[at] >= 0xE1) & (data[at] <= 0xE3)]
    b0, b1, b2 = data[at], data[np.minimum(at + 1, n - 1)], data[np.minimum(at + 2, n - 1)]
    space = (b0 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0)) | (b0 == 0xE1) & (b1 == 0x9A) & (b2 == 0x80) | (b0 == 0xE3) & (b1 == 0x80) & (b2 == 0x80)
    space |= (b0 == 0xE2) & ((b1 == 0x80) & ((b2 <= 0x8A) | (b2 >= 0xA8) & (b2 <= 0xAF)) | (b1 == 0x81) & (b2 == 0x9F))
    wrong[at[space]] = True
    bad = np.searchsorted(np.flatnonzero(wrong), offsets)
    safe = bad[1:] == bad[:-1]
    k = np.zeros(n + 2, np.uint8)
    own = k[1:-1]
    own[:] = _CLASS[data]
    own[data == 0x0A] = _LINE
    lead = lead[lead < n - 1]
    tail = data[lead + 1]
    lead = lead[(tail >= 0x80) & (tail <= 0xBF) & (tail != 0x97) & (tail != 0xB7)]
    own[lead] = own[lead + 1] = _LETTER
    odd = np.flatnonzero(own == _ODD)
    if len(odd):  # the runs between white space that hold such bytes
        solid = ~blank
        first = np.flatnonzero(solid & (np.append(True, ~solid[:-1]) | edge[:-1]))
        last = np.flatnonzero(solid & (np.append(~solid[1:], True) | edge[1:])) + 1
        whole = np.unique(np.searchsorted(first, odd, "right") - 1)
        size = last[whole] - first[whole]
        own[np.arange(int(size.sum())) + np.repeat(first[whole] - (np.cumsum(size) - size), size)] = _UNIT
    begins = (own != _BLANK) & ((own != k[:-2]) | (own == _LINE) | edge[:-1])
    ends = (own != _BLANK) & ((own != k[2:]) | (own == _LINE) | edge[1:])
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    keep = np.repeat(safe, np.diff(np.searchsorted(start, offsets)))
    start, end = start[keep], end[keep]
    doc = np.searchsorted(start, offsets)
    takes = (start > 0) & (data[start - 1] == 0x20) & ~edge[start] & (data[start] != 0x0A)
    return Words(data, start - takes, end, doc), safe


def hashed(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every pre-token, over its bytes eight at a time; _hashed() where one is longer than LONG."""
    size = w.end - w.start
    if not len(size) or size.max() > LONG:
        return _hashed(w)
    data = np.concatenate([w.data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(w.data) + 1, "<u8", data, strides=(1,))  # the eight bytes from each place on
    key, check = size.astype(np.uint64) * BASE, size.astype(np.uint64) * BASE2
    left, at, rest = np.arange(len(size)), w.start, size
    while len(left):
        x = words[at] & _MASK[np.minimum(rest, 8)]
        if len(left) == len(size):
            key, check = mix64(key ^ x) * BASE2, mix64((check ^ x) * BASE + BASE2)
        else:
            key[left], check[left] = mix64(key[left] ^ x) * BASE2, mix64((check[left] ^ x) * BASE + BASE2)
        on = np.flatnonzero(rest > 8)
        left, at, rest = left[on], at[on] + 8, rest[on] - 8
    return key, check


class Pool:
    """Ids of pre-tokens by their 128-bit hash: entries sorted by the first half, ids[base : base + size] of each."""

    def __init__(self, room: int) -> None:
        self.room, self.clock = room, 0
        self.key = self.check = np.zeros(0, np.uint64)
        self.base = self.size = self.used = np.zeros(0, np.int32)
        self.ids = np.zeros(0, "<u4")

    def _cut(self) -> None:
        """Keeps the `room` entries that were used last, and their ids."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: self.room])
        self.key, self.check, self.used = self.key[keep], self.check[keep], self.used[keep]
        size = self.size[keep].astype(np.int64)
        self.ids = gather(self.ids, self.base[keep].astype(np.int64), size)
        self.base, self.size = (np.cumsum(size) - size).astype(np.int32), self.size[keep]

    def of(self, key: np.ndarray, check: np.ndarray, make: Callable[[int], bytes], short: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, base, size) of distinct pre-tokens, keys ascending. make(i): the ids of a new one; short: may be kept."""
        if len(self.key) > 2 * self.room or len(self.ids) > 32 * self.room:
            self._cut()
        self.clock += 1
        at = np.searchsorted(self.key, key)
        same = np.zeros(len(key), bool)
        inside = np.flatnonzero(at < len(self.key))
        same[inside] = self.key[at[inside]] == key[inside]
        hit = same.copy()
        hit[same] = self.check[at[same]] == check[same]
        self.used[at[hit]] = self.clock
        new = np.flatnonzero(~hit)
        made = [make(i) for i in new]
        base, size = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        base[hit], size[hit] = self.base[at[hit]], self.size[at[hit]]
        size[new] = [len(x) // 4 for x in made]
        base[new] = len(self.ids) + np.cumsum(size[new]) - size[new]
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(made), "<u4")])
        # Two pre-tokens may share the first half of the hash: the pool has one of them.
        put = new[short[new] & ~same[new] & np.append(True, key[new][1:] != key[new][:-1])[: len(new)]]
        if len(put):
            clock = np.full(len(put), self.clock)
            for name, x in (("key", key[put]), ("check", check[put]), ("base", base[put]), ("size", size[put]), ("used", clock)):
                setattr(self, name, np.insert(getattr(self, name), at[put], x))
        return self.ids, base, size


def gather(ids: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """ids[base : base + size] of all entries, one after the other."""
    before = np.cumsum(size) - size
    return ids[np.arange(int(size.sum())) + np.repeat(base - before, size)]


class PieceIds:
    def __init__(self, path: str, cache: int = CACHE) -> None:
        self.cuts, self.spaced = Lengths(path).cuts, False
        if not self.cuts:
            self.slow = Encoder(path, cache // 16)
            if path.endswith(".json"):
                with open(path, encoding="utf-8") as f:
                    spec = json.load(f)
                pre, specials = spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
                self.spaced = (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                               and all("<" in x["content"] and not (x["single_word"] or x["lstrip"] or x["rstrip"]) for x in specials))
            if not self.spaced:
                return
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.chars = _byte_chars()
        self.pool = Pool(cache)

    def _new(self, piece: bytes) -> bytes:
        if _PLAIN.fullmatch(piece):
            return array("I", [t.id for t in self.tok.model.tokenize(piece.decode("latin1").translate(self.chars))]).tobytes()
        return self.whole(piece)

    def whole(self, raw: bytes) -> bytes:
        return array("I", self.tok.encode(raw.decode(), add_special_tokens=False).ids).tobytes()


def _groups(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """Whole texts together up to about `limit` bytes: (first text, bytes before, offsets)."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, int(offsets[i]), offsets[i : j + 1] - offsets[i]
        i = j


def ids_batch(texts: pa.Array, path: str, limit: int = CHUNK_BYTES, cache: int = CACHE) -> list[bytes]:
    """Ids of every text (little-endian unsigned 32-bit), equal to Tokenizer.encode(text, add_special_tokens=False). `cache`:
    pre-tokens that the worker's pool keeps (about 40 bytes each, up to twice as many)."""
    enc = process_latest("large", f"piece_ids_{cache}_{path}", lambda: PieceIds(path, cache))
    if not enc.cuts and not enc.spaced:
        return [enc.slow.ids(t.as_py() or "") for t in texts]
    data, offsets = text_buffer(texts)
    out: list[list[bytes]] = [[] for _ in range(len(texts))]
    # The second kind takes a text in one piece: its cuts depend on what comes before a space.
    for i, at, off in _parts(data, offsets, limit) if enc.cuts else _groups(offsets, limit):
        part = data[at : at + int(off[-1])]
        if enc.cuts and len(off) == 2 and len(part) > 4 * limit:  # a run without white space
            out[i].append(enc.whole(part.tobytes()))
            continue
        if not enc.cuts and len(off) == 2 and len(part) > 8 * limit:  # hashing takes 40 bytes a byte
            out[i].append(enc.slow.ids(part.tobytes().decode()))
            continue
        if enc.cuts:
            w = pretokens(part, off)
        else:
            w, safe = spaced(part, off)
            for j in np.flatnonzero(~safe):
                out[i + j].append(enc.slow.ids(part[off[j] : off[j + 1]].tobytes().decode()))
        if not len(w.start):
            continue
        key, check = hashed(w)
        first, group = _distinct(key, check)
        raw, start, end = w.data.tobytes(), w.start[first], w.end[first]
        pool, base, size = enc.pool.of(key[first], check[first], lambda m: enc._new(raw[start[m] : end[m]]), end - start <= 256)
        ids = gather(pool, base[group], size[group])
        cut = np.concatenate([np.zeros(1, np.int64), np.cumsum(size[group])])[w.doc]
        for j in np.flatnonzero(np.diff(w.doc)):
            out[i + j].append(ids[cut[j] : cut[j + 1]].tobytes())
    return [x[0] if len(x) == 1 else b"".join(x) for x in out]
