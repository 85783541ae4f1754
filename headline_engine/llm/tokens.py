"""Exact token ids at speed: the public tokenizer on the distinct pieces of a text.

Both tokenizers split a text into pieces before they merge, and always start a new piece at a space that follows a
character other than white space. So a text may be cut there, each piece be encoded once by the tokenizers library, and
the ids be joined; the ids equal those of the whole text. Texts in which a cut would be unsafe (runs of white space,
white space before a space) take finer pieces or go to the tokenizer whole. Each worker caches the ids of pieces, of runs
of letters and of other short runs apart, each in two generations: when the young one is full it becomes the old one, and
what is asked for again moves to the young one. So pieces that stay in use stay cached, whenever they first came, and
memory is bounded.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

from headline_engine.llm.common import process_latest

#: Distinct pieces in each of a cache's two generations.
CACHE = 100_000
END_ID = 1

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD = re.compile(f"([{_LETTERS}]+)([.,]?)(\\n?)([{_LETTERS}]*)([.,]?)")
_RUNS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_ODD_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")


def _byte_chars() -> dict[int, int]:
    """Byte to the code point that byte-level vocabularies write for it: printable bytes stand for themselves, the others
    follow from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}


class _Cache:
    """A mapping of at most twice `room` entries that forgets what has not been asked for longest."""

    def __init__(self, room: int) -> None:
        self.room = room
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def get(self, key: str) -> bytes | None:
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key: str, value: bytes) -> None:
        if len(self.young) >= self.room:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Encoder:
    """ids(text) as little-endian unsigned 32-bit bytes, equal to Tokenizer.encode(text, add_special_tokens=False)."""

    def __init__(self, path: str, cache: int = CACHE) -> None:
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        #: This kind drops white space and lower-cases; the other keeps the space with the word that follows.
        self.drops_space = spec.get("normalizer") is not None
        self.chars = _byte_chars()
        #: Ids of pieces between spaces (with the space before them), of their runs of letters, and of other runs.
        self.cache, self.letters, self.bare = _Cache(cache), _Cache(cache // 2), _Cache(cache // 4)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _merged(self, word: str) -> bytes:
        """Ids of one pre-split piece of letters (with or without its leading space)."""
        mapped = word.encode().decode("latin1").translate(self.chars)
        return array("I", [t.id for t in self.tok.model.tokenize(mapped)]).tobytes()

    def _sub(self, letters: str) -> bytes:
        """Ids of a piece of letters, with the space before it where the tokenizer keeps it."""
        got = self.letters.get(letters)
        if got is None:
            got = self._merged(letters if self.drops_space else " " + letters)
            self.letters.put(letters, got)
        return got

    def _run(self, piece: str) -> bytes:
        got = self.bare.get(piece)
        if got is None:
            got = self._whole(piece)
            if len(piece) <= 256:
                self.bare.put(piece, got)
        return got

    def _piece(self, piece: str) -> bytes | None:
        """Ids of a piece between single spaces, its leading space included; None if the cut after it is unsafe."""
        m = _WORD.fullmatch(piece)
        if m:  # letters, a full stop or comma, perhaps a line end and the same once more
            a, p, nl, b, q = m.groups()
            if self.drops_space and (nl or not b and not q):
                return self._sub(a.lower()) + (self._run(p) if p else b"") + (self._sub(b.lower()) if b else b"") + (self._run(q) if q else b"")
            if not self.drops_space and (b if nl else not (b or q)):
                return self._sub(a) + (self._run(p) if p else b"") + (self._run(nl) + self._merged(b) if nl else b"") + (self._run(q) if q else b"")
        if self.drops_space:
            return self._whole(piece)
        if not piece or piece[-1].isspace() or piece[0].isspace():
            return None
        return self._whole(" " + piece)

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        pieces = text.split(" ")
        first = b""
        if not self.drops_space:
            head = pieces[0]
            if not head or head[-1].isspace():
                return self._careful(text)
            first = self._whole(head)
            pieces = pieces[1:]
        young = self.cache.young
        out = []
        for p in pieces:
            got = young.get(p)
            if got is None:
                got = self.cache.get(p)
                if got is None:
                    got = self._piece(p)
                    if got is None:
                        return self._careful(text)
                    if len(p) <= 256:
                        self.cache.put(p, got)
                young = self.cache.young
            out.append(got)
        return first + b"".join(out)

    def _careful(self, text: str) -> bytes:
        """Cuts only before runs of spaces and line ends that follow another character."""
        if _ODD_SPACE.search(text):
            return self._whole(text)
        return b"".join(map(self._run, _RUNS.findall(text)))


def encoder(path: str) -> Callable[[str], bytes]:
    """The process's encoder for a vocabulary file (loaded once a worker, dropped when another large object is needed)."""
    return process_latest("large", "encoder_" + path, lambda: Encoder(path)).ids


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
