"""Token counts (13) against the tokenizers library on whole texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from headline_engine.llm import tokencounts, tokens

PATH = tokens.tokenizer_path("word_bpe_49k.json")
ODD = ["a", "B", "é", "É", "ß", "×", "÷", "Ÿ", "ÿ", "'s", "'", "it's", "5", "42", "!?", "...", "_", "漢字", "かな", "́", "é", " ", "\u0085", "\x0b",
       "\x0c", "\x1c", "\x00", " ", "\n", "\t", "\r", "  ", "<|endoftext|>", "<|startoftext|>", "<|", "<", "ﬁ", "İ", "Σ", "½", "ª", "Àç", "word", "The", "​", "😀"]


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(PATH)
    return lambda texts: [len(x.ids) for x in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def odd_texts(n=4000):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randrange(0, 14))) for _ in range(n)]
    return texts + ["x" * 90_000, " ".join(texts), None, "", " \n"]


def test_counts_of_odd_texts_equal_the_library(library):
    texts = odd_texts()
    for limit in (1 << 12, 1 << 20):  # the small limit cuts the long texts
        assert tokencounts.count_batch(pa.array(texts), PATH, None, limit).tolist() == library(texts)


def test_both_tiers_and_defined_cases(spark, odd, odd_rows, none, library):
    want = sorted((i is None, i or 0, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(odd_rows, library([t for _, t in odd_rows])))
    for table in (None, tokencounts.frequent(odd, PATH, entries=50), tokencounts.frequent(odd, PATH, sample_bytes=1000)):
        got = tokencounts.count_tokens(odd, PATH, table=table).collect()
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    assert tokencounts.count_tokens(none, PATH).count() == 0


def test_table_holds_what_it_was_given():
    rnd = np.random.default_rng(1)
    key = rnd.integers(0, 1 << 63, 5000).astype(np.uint64)
    key[1000:1400] = (key[1000:1400] >> np.uint64(16)) << np.uint64(16)  # one home slot for all
    check, length = rnd.integers(0, 1 << 63, 5000).astype(np.uint64), rnd.integers(1, 99, 5000).astype(np.uint16)
    t = tokencounts.LengthTable.of(key, check, length)
    assert (t(key, check) == length).all() and not t(key, check + np.uint64(1)).any() and not t(check, key).any()


def test_worker_cache_is_bounded():
    lengths = tokencounts.Lengths(PATH, cache=10)
    words = [f"word{i}".encode() for i in range(100)]
    first = [lengths.of([w])[0] for w in words]
    assert lengths.of(words) == first and len(lengths.young) <= 10 and len(lengths.old) <= 10


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_vocabularies_encode_whole_texts(name):
    path = tokens.tokenizer_path(name)
    texts = ["One two, three", None, "", "a  b\n c"]
    if name.endswith(".model"):
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode([t or "" for t in texts])]
    else:
        want = [len(x.ids) for x in Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert tokencounts.count_batch(pa.array(texts), path, None).tolist() == want
