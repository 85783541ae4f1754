"""Ids of whole columns against the tokenizers library."""

import random

import numpy as np
import pyarrow as pa
import pytest
from test_token_counts import odd_texts
from tokenizers import Tokenizer

from headline_engine.llm import tokenids, tokens
from headline_engine.llm.common import Words


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_equal_the_library(name):
    path = tokens.tokenizer_path(name)
    texts = odd_texts(3000) + ["it's <|endoftext|> here", "ÀÉÎ õü ß÷× naïve CAFÉ", "word " * 9000]
    texts += ["One two, three.\nFour 55 six_7\n“Quoted” it's — fine", " lead", "trail ", "a\n\nb", "a \nb", "x\u00a0 y", "tab\there", "\u3000", "a <|endoftext|>b 'sup", "é3à", "1234 a"]
    rnd = random.Random(1)
    some = ["The", "été", "a.b", "12", "3x", "“q”", "it's", "—", "naïve,", "漢字", "<|", "<|endoftext|>", "_", "$5", "ﬁ", "½"]
    texts += ["".join(rnd.choice(some) + rnd.choice([" ", " ", "\n", " "]) for _ in range(rnd.randrange(1, 30))) + "end" for _ in range(3000)]
    rnd.shuffle(texts)
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for limit in (1 << 12, 1 << 20):
        got = tokenids.ids_batch(pa.array(texts), path, limit)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def test_the_pool_asks_once_for_a_pre_token_and_forgets_what_was_not_used(monkeypatch):
    """A pre-token of many chunks is encoded once; a full pool drops the oldest ones; equal first halves stay apart."""
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    asked = []
    new = tokenids.PieceIds._new
    monkeypatch.setattr(tokenids.PieceIds, "_new", lambda self, piece: asked.append(piece) or new(self, piece))
    texts = [f"the word{chr(97 + i % 26)} of {'xyz'[i % 3]}abc" for i in range(2000)]
    want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    for cache, most in ((998, 32), (5, 1 << 30)):
        asked.clear()
        got = tokenids.ids_batch(pa.array(texts), path, 1 << 10, cache)
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == want and len(asked) <= most
    pool = tokenids.Pool(4)
    u = lambda *x: np.array(x, np.uint64)
    make = lambda m: np.arange(m + 1, dtype="<u4").tobytes()
    for _ in range(3):
        ids, base, size = pool.of(u(3, 3, 7), u(1, 2, 1), make, np.ones(3, bool))
        assert tokenids.gather(ids, base, size).tolist() == [0, 0, 1, 0, 1, 2] and pool.key.tolist() == [3, 7]
    for i in range(50):
        pool.of(u(7, 100 + i), u(1, 0), make, np.ones(2, bool))
        assert len(pool.key) <= 10 and 7 in pool.key


def test_hashes_tell_spans_apart_and_do_not_depend_on_the_place():
    rnd = random.Random(3)
    pieces = list({bytes(rnd.choice(b"ab\0") for _ in range(rnd.randrange(1, 40))) for _ in range(4000)})
    pieces += pieces[::-1]
    end = np.cumsum([len(p) for p in pieces])
    w = Words(np.frombuffer(b"".join(pieces), np.uint8), np.append(0, end[:-1]), end, np.array([0, len(pieces)]))
    for h in tokenids.hashed(w):
        n = len(pieces) // 2
        assert len(set(h[:n].tolist())) == n and h[:n].tolist() == h[n:][::-1].tolist()
