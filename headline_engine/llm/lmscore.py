"""Stupid-backoff language-model scores over n-gram count tables that are partitioned by hash.

Every document is scored by the counts of all other documents (its own n-grams are subtracted, so a text is not its own
evidence). For a word with its longest available context of up to order - 1 words,

    S(w | context) = c(context w) / c(context)            if c(context w) > 0
                   = ALPHA * S(w | shorter context)       otherwise,
    S(w) = c(w) / N  if c(w) > 0, else 1 / (N + 1)        (N: words of the other documents)

and the score is the sum of log10 S over the document's words.

Relational form, in three joins of columnar blocks: documents are dealt to chunks by a hash; a chunk explodes its n-grams
and sends each distinct one once, with its count, to the n-gram's hash bucket (pre-aggregation: a hot n-gram is one entry
a chunk); a bucket sums the counts and answers each chunk; the answers are joined to the chunk's exploded n-grams and
summed per document. Hashes have 64 bits, sorted and delta-coded by byte planes. Chunks and buckets hold about
CHUNK_ROWS documents' worth whatever the table's size.

Words: ASCII letters and digits and all non-ASCII characters, A-Z lower-cased. Defined cases: a null or word-less text has
score 0 and no words; repeated rows and ids are documents of their own; an empty table gives no row. Extra columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headline_engine.llm.common import ALNUM_WORDS, SpanHash, durable, keyed, real_id, text_buffer, words_of

#: Longest n-gram; see the README for what a longer one costs.
ORDER = 2
ALPHA = 0.4
CHUNK_ROWS = 2000

_SENT = "bucket int, chunk int, n int, hashes binary, counts binary"
_ANSWER = "chunk int, n int, bucket int, totals binary"
_PARTS = "_id long, n_words long, logs double, by_total long, unseen long"


def _planes(x: np.ndarray, kind: str) -> bytes:
    """Byte planes of the values: planes of zeros compress away."""
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(len(x), -1).T).tobytes()


def _values(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


class Grams:
    """The exploded n-grams of a chunk. For n: `distinct` hashes (sorted), `counts`, and for each word the index of the
    n-gram that ends there (`at`; -1 where the document has fewer words before it)."""

    def __init__(self, table: pa.Table, order: int) -> None:
        w = words_of(*text_buffer(table.column("text")), ALNUM_WORDS, lower=True)
        self.doc = np.repeat(np.arange(table.num_rows), np.diff(w.doc))
        self.size = np.diff(w.doc)
        place = np.arange(len(self.doc)) - w.doc[:-1][self.doc]  # number of the word in its document
        span = SpanHash(w.hashes()) if len(self.doc) else None
        self.distinct, self.counts, self.at = [], [], []
        for n in range(1, order + 1):
            end = np.flatnonzero(place >= n - 1)
            h = span(end - n + 1, end + 1) if len(end) else np.zeros(0, np.uint64)
            d, inverse, c = np.unique(h, return_inverse=True, return_counts=True)
            at = np.full(len(self.doc), -1, np.int64)
            at[end] = inverse
            self.distinct.append(d)
            self.counts.append(c)
            self.at.append(at)


def _bucket_cuts(distinct: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are equal ranges of the hash; positions where each begins in the sorted hashes, and the end."""
    edges = np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)
    return np.append(np.searchsorted(distinct, edges), len(distinct))


def own_counts(doc: np.ndarray, at: np.ndarray, kinds: int) -> np.ndarray:
    """For each word, how often its own document holds the n-gram that ends there."""
    out = np.zeros(len(at), np.int64)
    has = np.flatnonzero(at >= 0)
    _, inverse, c = np.unique(doc[has] * kinds + at[has], return_inverse=True, return_counts=True)
    out[has] = c[inverse]
    return out


def score_chunk(g: Grams, totals: list[np.ndarray], order: int, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By document: sum of log10 terms without the division by N, number of words divided by N, and of unseen words."""
    n = len(g.doc)
    rest = []  # c of the other documents, by order, at the n-gram that ends at each word
    for k in range(order):
        t = np.zeros(n, np.int64)
        has = g.at[k] >= 0
        if has.any():
            t[has] = totals[k][g.at[k][has]]
        rest.append(t - own_counts(g.doc, g.at[k], max(1, len(g.distinct[k]))))
    logs, open_ = np.zeros(n), np.ones(n, bool)
    for k in range(order - 1, 0, -1):
        tried = open_ & (g.at[k] >= 0)
        hit = np.flatnonzero(tried & (rest[k] > 0))
        logs[hit] += np.log10(rest[k][hit] / rest[k - 1][hit - 1])
        open_[hit] = False
        logs[tried & open_] += np.log10(alpha)
    known = open_ & (rest[0] > 0)
    logs[known] += np.log10(rest[0][known])
    m = len(g.size)
    add = lambda x: np.bincount(g.doc, x, m) if n else np.zeros(m)
    return add(logs), add(known.astype(float)).astype(np.int64), add((open_ & ~known).astype(float)).astype(np.int64)


def score(documents: DataFrame, order: int = ORDER, alpha: float = ALPHA, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(doc_id, n_words, log10_score, log10_per_word), one row per document."""
    docs = keyed(documents)
    chunks = buckets = max(1, -(-documents.count() // chunk_rows))
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("_id", "_th"), F.lit(chunks)).cast("int")).select("chunk", "_id", "text")

    def send(table: pa.Table) -> pa.Table:
        g, chunk, rows = Grams(table, order), table.column("chunk")[0].as_py(), []
        for n in range(order):
            cuts = _bucket_cuts(g.distinct[n], buckets)
            for b in range(buckets):
                d = g.distinct[n][cuts[b] : cuts[b + 1]]
                if len(d):
                    rows.append((b, chunk, n + 1, _planes(np.diff(d, prepend=np.uint64(0)), "<u8"), _planes(g.counts[n][cuts[b] : cuts[b + 1]], "<u4")))
        cols = list(zip(*rows)) if rows else [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], ["bucket", "chunk", "n", "hashes", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        """The count table of one bucket, joined to the n-grams that the chunks asked for."""
        n, bucket = np.asarray(table.column("n")), table.column("bucket")[0].as_py()
        hashes, counts, totals = table.column("hashes"), table.column("counts"), {}
        for k in np.unique(n):
            rows = np.flatnonzero(n == k)
            h = [np.cumsum(_values(hashes[int(r)].as_py(), "<u8"), dtype=np.uint64) for r in rows]
            c = np.concatenate([_values(counts[int(r)].as_py(), "<u4") for r in rows])
            _, inverse = np.unique(np.concatenate(h), return_inverse=True)
            total = np.bincount(inverse, c).astype(np.int64)[inverse]
            for r, part in zip(rows, np.split(total, np.cumsum([len(x) for x in h])[:-1])):
                totals[int(r)] = _planes(part, "<u8")
        return pa.table([table.column("chunk"), table.column("n"), pa.array([bucket] * table.num_rows, pa.int32()),
                         pa.array([totals[r] for r in range(table.num_rows)], pa.binary())], ["chunk", "n", "bucket", "totals"])

    def add_up(texts: pa.Table, answers: pa.Table) -> pa.Table:
        g = Grams(texts, order)
        found: list[list[bytes]] = [[] for _ in range(order)]
        answers = answers.sort_by([("n", "ascending"), ("bucket", "ascending")])
        for n, t in zip(answers.column("n").to_pylist(), answers.column("totals")):
            found[n - 1].append(_values(t.as_py(), "<u8").astype(np.int64))
        totals = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]
        logs, by_total, unseen = score_chunk(g, totals, order, alpha)
        return pa.table([texts.column("_id"), pa.array(g.size), pa.array(logs), pa.array(by_total), pa.array(unseen)],
                        ["_id", "n_words", "logs", "by_total", "unseen"])

    sent = docs.groupBy("chunk").applyInArrow(send, _SENT)
    answers = sent.groupBy("bucket").applyInArrow(answer, _ANSWER)
    parts = durable(docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(add_up, _PARTS))
    total = parts.agg(F.sum("n_words")).first()[0] or 0
    others = F.lit(total) - F.col("n_words")
    logs = F.col("logs") - F.when(F.col("by_total") > 0, F.col("by_total") * F.log10(others)).otherwise(0.0) - F.col("unseen") * F.log10(others + 1)
    out = parts.select(real_id().alias("doc_id"), "n_words", logs.alias("log10_score"))
    return out.withColumn("log10_per_word", F.when(F.col("n_words") > 0, F.col("log10_score") / F.col("n_words")).otherwise(0.0))
