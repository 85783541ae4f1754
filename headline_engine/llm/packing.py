"""Lexical retrieval packing.

Documents are tokenised where they lie (the ids are a written table) and dealt to shards of at most about SHARD_ROWS
documents by their words, so that related documents meet whatever the table's size. Document frequencies of the token ids
over the whole corpus give BM25 weights; a document's key is its strongest term that SHARD_ROWS documents or more hold
(one that can fill a shard), then its two strongest terms of all, then a salt. Shards are contiguous ranges of the key with
exact counts: rare keys share a shard with the keys beside them, a hot key is cut by the terms that follow, and copies of
one document by the salt. In a shard an inverted index over token ids (postings with BM25 weights of the corpus) serves
retrieval: a seed document opens a window, its strongest terms score the unused documents, and the best ones fill the
window greedily. The last neighbour is cut where the window ends, and its rest opens the next window, so only a shard's
last window can be padded. When no unused document shares a term with the seed, the next unused one follows.

A document longer than a window fills whole windows by itself first; only its rest takes part in retrieval.

Defined cases: a null or empty text is the end id alone; repeated rows and ids are separate documents; an empty table
gives no piece; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headline_engine.llm.common import (
    chunks,
    contiguous_shards,
    durable,
    keyed,
    mix64,
    real_id,
    tidy,
)
from headline_engine.llm.tokenids import ids_batch
from headline_engine.llm.tokens import END_ID, tokenizer_path

WINDOW = 2048
SHARD_ROWS = 1500
#: Query terms of a seed; BM25's saturation and length constants.
QUERY_TERMS, K1, LENGTH_B = 12, 1.2, 0.75

_CODED = "_id long, _th long, wide boolean, ids binary, df binary"
_DEALT = "shard long, _id long, _th long, wide boolean, ids binary"
_PIECES = "_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _ids(raw: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(raw, "<u4" if wide else "<u2")


def _by(x: np.ndarray) -> np.ndarray:
    """Stable order of small non-negative integers (16 bits are sorted by digits)."""
    return np.argsort(x.astype(np.uint16) if not len(x) or x.max() < 1 << 16 else x, kind="stable")


def distinct_terms(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of every distinct term of each document, in this order."""
    key = np.sort((np.repeat(np.arange(len(docs), dtype=np.uint64), [len(d) for d in docs]) << np.uint64(32)) | np.concatenate(docs).astype(np.uint64))
    new = np.flatnonzero(np.diff(key, prepend=key[0] - np.uint64(1))) if len(key) else np.zeros(0, int)
    return (key[new] >> np.uint64(32)).astype(np.int64), (key[new] & np.uint64(0xFFFFFFFF)).astype(np.int64), np.diff(np.append(new, len(key)))


class Corpus:
    """Number of documents, their mean length, and document frequencies by token id."""

    def __init__(self, n: int, tokens: int, df: np.ndarray) -> None:
        self.n, self.mean, self.df, self._idf = n, tokens / max(1, n), df, None

    def weights(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        if self._idf is None:
            self._idf = np.log1p((self.n - self.df + 0.5) / (self.df + 0.5))
        return self._idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - LENGTH_B + LENGTH_B * length[doc] / self.mean))


def lexical_keys(docs: list[np.ndarray], salt: np.ndarray, corpus: Corpus, shard_rows: int) -> np.ndarray:
    """The documents' keys: 16 bits for each of the three terms, 15 of salt. No document is empty (the end id)."""
    doc, term, tf = distinct_terms(docs)
    weight = corpus.weights(doc, term, tf, np.array([len(d) for d in docs], np.float64))
    first = np.searchsorted(doc, np.arange(len(docs)))

    def strongest(w: np.ndarray) -> np.ndarray:
        best = np.flatnonzero(w == np.maximum.reduceat(w, first)[doc])
        return best[np.diff(doc[best], prepend=-1) > 0]

    key = np.zeros(len(docs), np.int64)
    shared = np.where(corpus.df[term] > 1, weight, 0.0)
    one = strongest(shared)
    rest = shared.copy()
    rest[one] = 0.0
    for at, w in ((strongest(x := np.where(corpus.df[term] >= shard_rows, weight, 0.0)), x), (one, shared), (strongest(rest), rest)):
        key = (key << 16) | np.where(w[at] > 0, term[at] & 0xFFFF, 0)
    return (key << 15) | (salt >> np.uint64(49)).astype(np.int64)


class Index:
    """BM25 postings of one shard's documents; weights are those of the corpus, or of the shard alone without one."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None) -> None:
        n = self.n = len(docs)
        length = np.array([len(d) for d in docs], np.float64)
        doc, term, tf = distinct_terms(docs)
        by_term = _by(term)
        self.at = np.append(np.flatnonzero(np.diff(term[by_term], prepend=-1)), len(term))
        self.terms, df = term[by_term[self.at[:-1]]], np.diff(self.at)
        self.doc = doc[by_term]
        which = np.empty(len(term), np.int64)
        which[by_term] = np.repeat(np.arange(len(df)), df)
        if corpus is None:
            weight = Corpus(n, int(length.sum()), df).weights(doc, which, tf, length)
        else:
            weight = corpus.weights(doc, term, tf, length)
        self.weight = weight[by_term]
        # Query of a document: its strongest terms that another document has too.
        useful = np.flatnonzero(df[which] > 1)
        order = useful[np.argsort(-weight[useful], kind="stable")]  # equal weights: the smaller term first, as they lie
        order = order[_by(doc[order])]
        first = np.searchsorted(doc[order], np.arange(n + 1))
        self.query = [which[order[first[i] : min(first[i + 1], first[i] + QUERY_TERMS)]] for i in range(n)]

    def neighbours(self, seed: int, free: np.ndarray) -> np.ndarray:
        """Unused documents that share a query term, best first (ties: earlier document)."""
        spans = [slice(self.at[t], self.at[t + 1]) for t in self.query[seed]]
        if not spans:
            return np.zeros(0, np.int64)
        score = np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        hit = np.flatnonzero((score > 0) & free)
        return hit[np.argsort(-score[hit], kind="stable")]


def pack_shard(docs: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; sequences count from 0."""
    pieces, seq = [], 0
    rest = np.zeros(len(docs), np.int64)  # first id that is not placed yet
    for i, d in enumerate(docs):
        while len(d) - rest[i] >= window:
            pieces.append((i, int(rest[i]), window, seq, 0))
            rest[i] += window
            seq += 1
    length = np.array([len(d) for d in docs], np.int64)
    pool = [i for i in range(len(docs)) if length[i] > rest[i]]
    if not pool:
        return pieces
    index = Index([docs[i] for i in pool], corpus)
    free = np.ones(len(pool), bool)
    nxt, carry = 0, None  # carry: the cut document that opens the next window
    while True:
        while nxt < len(pool) and not free[nxt]:
            nxt += 1
        if carry is None:
            if nxt == len(pool):
                return pieces
            seed = nxt
            free[seed] = False
        else:
            seed = carry
        used, carry, queue, at = 0, None, None, 0
        take = seed
        while take is not None:
            i = pool[take]
            n = int(min(length[i] - rest[i], window - used))
            pieces.append((i, int(rest[i]), n, seq, used))
            rest[i] += n
            used += n
            if rest[i] < length[i]:
                carry = take
            if used == window:
                break
            if queue is None:
                queue = index.neighbours(seed, free)
            if at < len(queue):
                take = int(queue[at])
                at += 1
                free[take] = False
                continue
            while nxt < len(pool) and not free[nxt]:
                nxt += 1
            take = nxt if nxt < len(pool) else None
            if take is not None:
                free[take] = False
        seq += 1


def deal(documents: DataFrame, path: str, shard_rows: int) -> tuple[DataFrame, Corpus]:
    """(shard, _id, _th, wide, ids), one row per document, and the corpus. ids: 16 bits each where they fit (not wide)."""

    def encode(batches):
        end = np.array([END_ID], "<u4").tobytes()
        df, n, tokens = np.zeros(1 << 16, np.int64), 0, 0
        for batch in batches:
            for part in chunks(batch, "text"):
                docs = [np.frombuffer(x + end, "<u4") for x in ids_batch(part.column("text"), path)]
                seen = np.bincount(distinct_terms(docs)[1])
                if len(seen) > len(df):
                    df = np.append(df, np.zeros(len(seen) - len(df), np.int64))
                df[: len(seen)] += seen
                n, tokens = n + len(docs), tokens + sum(map(len, docs))
                wide = [bool(d.max() > 0xFFFF) for d in docs]
                raw = [d.tobytes() if w else d.astype("<u2").tobytes() for d, w in zip(docs, wide)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), part.column("_th"), pa.array(wide), pa.array(raw, pa.binary()), pa.nulls(len(docs), pa.binary())],
                    ["_id", "_th", "wide", "ids", "df"])
        # A task's last row: its documents, tokens and document frequencies.
        total = pa.array([np.append([n, tokens], df).astype("<i8").tobytes()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.bool_()), pa.nulls(1, pa.binary()), total],
                                         ["_id", "_th", "wide", "ids", "df"])

    def counts(batches):
        for batch in batches:
            for raw in batch.column("df").to_pylist():
                x = np.frombuffer(raw, "<i8")
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(x[at])], ["at", "n"])

    coded = durable(keyed(documents).mapInArrow(tidy(encode), _CODED))
    rows = coded.where("df is not null").select("df").mapInArrow(counts, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(max([1 << 16, *(r["at"] for r in rows)]) + 2, np.int64)  # the vocabulary's size, not the table's
    for r in rows:
        total[r["at"]] = r["n"]
    corpus = Corpus(int(total[0]), int(total[1]), total[2:])
    coded = coded.where("ids is not null").select("_id", "_th", "wide", "ids")

    def with_keys(batches):
        for batch in batches:
            for part in chunks(batch, "ids"):
                docs = [_ids(x, w) for x, w in zip(part.column("ids").to_pylist(), part.column("wide").to_pylist())]
                # Repeated rows differ by their place.
                th = np.array(part.column("_th"), np.int64).view(np.uint64)
                yield part, lexical_keys(docs, mix64(th + mix64(np.array(part.column("_id"), np.int64).view(np.uint64) + np.arange(len(docs), dtype=np.uint64))), corpus, shard_rows)

    def key_rows(batches):
        for _, key in with_keys(batches):
            yield pa.RecordBatch.from_arrays([pa.array(key)], ["key"])

    bounds = np.zeros(1, np.int64)
    if corpus.n > shard_rows:
        shards = contiguous_shards(durable(coded.mapInArrow(tidy(key_rows), "key long")), "key", shard_rows, 256)
        bounds = np.array([shards.first[i] for i in sorted(shards.first)], np.int64)

    def placed(batches):
        for part, key in with_keys(batches):
            shard = np.maximum(np.searchsorted(bounds, key, "right") - 1, 0)
            yield pa.RecordBatch.from_arrays([pa.array(shard), *part.columns], ["shard", "_id", "_th", "wide", "ids"])

    return coded.mapInArrow(tidy(placed), _DEALT), corpus


def pack(documents: DataFrame, tokenizer: str | None = None, window: int = WINDOW, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset); ids: the piece's ids, unsigned 32-bit
    little-endian. A window is one sequence_id (shard and number in the shard); offsets in it are gapless from 0."""
    dealt, corpus = deal(documents, tokenizer or tokenizer_path("byte_bpe_50k.json"), shard_rows)

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_id", "ascending"), ("_th", "ascending")])
        docs = [_ids(x, w).astype("<u4") for x, w in zip(table.column("ids").to_pylist(), table.column("wide").to_pylist())]
        ids = table.column("_id").to_pylist()
        shard = table.column("shard")[0].as_py()
        rows = pack_shard(docs, window, corpus)
        cols = zip(*[(ids[i], s, n, docs[i][s : s + n].tobytes(), len(docs[i]), (shard << 32) | q, o) for i, s, n, q, o in rows])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], ["_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    out = dealt.groupBy("shard").applyInArrow(place, _PIECES)
    return out.select(real_id().alias("doc_id"), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
