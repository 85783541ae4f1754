"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every 48-bit shingle hash below 2^48 / SCALE. It is a fixed fraction of the shingles whatever the
document's length, so sketches of very unequal documents compare (containment), and the sketch of a union is the union
of the sketches. One rule for short texts: the smallest hash is always kept, so that a text with words has a sketch
(merging keeps this: the union's smallest hash is the smallest of the parts').

A shingle is 5 consecutive words (ASCII letters/digits and all non-ASCII characters, A-Z lower-cased); a text of 1 to 4
words is one shingle. The fingerprint string is the sketch's hashes, ascending, 12 hex digits each, without separator.

Defined cases: a null or empty text has the empty fingerprint; two empty fingerprints have likeness 1, an empty and a
non-empty one 0; repeated rows get equal results; order of equal ids is by text; null ids come first. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headline_engine.llm.common import (
    ALNUM_WORDS,
    CHUNK_BYTES,
    chunks,
    contiguous_shards,
    keyed,
    ngram_spans,
    parallelism,
    real_id,
    SpanHash,
    text_buffer,
    words_of,
)

SHINGLE = 5
#: One shingle in SCALE is kept.
SCALE = 8
_BITS = 48

NEIGHBOUR_SCHEMA = "_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def sketches(data: np.ndarray, offsets: np.ndarray, scale: int = SCALE, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sorted sketch (uint64, 48-bit values) of each text data[offsets[i]:offsets[i + 1]]."""
    out: list[np.ndarray] = []
    n = len(offsets) - 1
    at = 0
    while at < n:  # at most 2^16 texts at once: document and hash share a 64-bit sort key
        to = min(n, at + (1 << 16))
        off = offsets[at : to + 1]
        w = words_of(data[off[0] : off[-1]], off - off[0], ALNUM_WORDS, lower=True)
        s, e, of = ngram_spans(w.doc, shingle)
        h = SpanHash(w.hashes())(s, e) >> np.uint64(64 - _BITS)
        keep = h < np.uint64((1 << _BITS) // scale)
        if len(h):
            first = np.flatnonzero(np.diff(of, prepend=-1))
            least = np.minimum.reduceat(h, first)
            has = np.zeros(to - at, bool)
            has[of[keep]] = True
            lone = ~has[of[first]]
            key = np.concatenate([(of[keep].astype(np.uint64) << np.uint64(_BITS)) | h[keep],
                                  (of[first][lone].astype(np.uint64) << np.uint64(_BITS)) | least[lone]])
            key = np.unique(key)
        else:
            key = np.zeros(0, np.uint64)
        cut = np.searchsorted(key, np.arange(to - at + 1, dtype=np.uint64) << np.uint64(_BITS)) if to - at < (1 << 16) else \
            np.append(np.searchsorted(key, np.arange(to - at, dtype=np.uint64) << np.uint64(_BITS)), len(key))
        key &= np.uint64((1 << _BITS) - 1)
        out += [key[cut[i] : cut[i + 1]] for i in range(to - at)]
        at = to
    return out


def to_hex(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - _BITS // 8 :].tobytes().hex()


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the smaller sketch that the other one holds (0 to 1)."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of the two texts' shingles together."""
    u = np.union1d(a, b)
    return u[: max(1, int(np.searchsorted(u, np.uint64((1 << _BITS) // scale))))]


def fingerprints(documents: DataFrame, scale: int = SCALE) -> DataFrame:
    """The documents' rows with `fingerprint` (and `fp_hashes`, its number of hashes) added."""
    spark_cols = [c for c in documents.columns if c not in ("fingerprint", "fp_hashes")]
    documents = documents.select(*spark_cols)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields) + ", fingerprint string, fp_hashes long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                sk = sketches(*text_buffer(part.column("text")), scale=scale)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([to_hex(x) for x in sk], pa.string()), pa.array([len(x) for x in sk], pa.int64())],
                    [*part.schema.names, "fingerprint", "fp_hashes"])

    return documents.mapInArrow(run, schema)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the following text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q]


def _compare(rows: list[tuple], following: str, scale: int) -> list[tuple]:
    """Results for the consecutive documents rows = [(id, text)], the last one followed by `following`."""
    texts = [r[1] for r in rows]
    edits = [edited(t, u) for t, u in zip(texts, [*texts[1:], following])]
    raw = [t.encode("utf-8", "surrogatepass") for t in (*texts, following, *edits)]
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    sk = sketches(np.frombuffer(b"".join(raw), np.uint8), off, scale)
    n = len(texts)
    return [
        (rows[i][0], len(texts[i]), hashlib.sha256(raw[n + 1 + i]).hexdigest(), to_hex(sk[i]), to_hex(sk[n + 1 + i]),
         containment(sk[i], sk[n + 1 + i]), containment(sk[i], sk[i + 1]))
        for i in range(n)
    ]


def compare_neighbours(documents: DataFrame, scale: int = SCALE, shard_rows: int = 2000) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document in ascending doc_id.

    The texts move once: into contiguous id ranges, sorted inside. The first document of each range is also sent to the
    range before it (the very first one to the last), so that every document meets its successor; a range is a stream
    of which one chunk is in memory.
    """
    docs = keyed(documents)
    n = max(1, docs.select("_id").count() // (shard_rows * 4 * parallelism(documents.sparkSession)))
    shards = contiguous_shards(docs.select("_id"), "_id", shard_rows * n)
    order = sorted(shards.first)
    placed = docs.withColumn("_shard", shards.column)
    if order:
        # The smallest id of a range, exactly: bounded by the number of ranges.
        least = {r["_shard"]: r["m"] for r in placed.groupBy("_shard").agg(F.min("_id").alias("m")).collect()}
        nonempty = sorted(least)
        before = {least[s]: nonempty[i - 1] for i, s in enumerate(nonempty)}  # the first goes to the last range
        ids = sorted(before)
        target = _lookup(F.col("_id"), ids, [before[i] for i in ids])
        home = F.struct(F.col("_shard").alias("shard"), F.lit(0).alias("extra"))
        copy = F.struct(target.alias("shard"), F.lit(1).alias("extra"))
        placed = placed.select("_id", "_th", "text", F.explode(
            F.when(target.isNull(), F.array(home)).otherwise(F.array(home, copy))).alias("_p"))
        placed = placed.select("_p.shard", "_p.extra", "_id", "_th", "text")
    else:
        placed = placed.select(F.col("_shard").alias("shard"), F.lit(0).alias("extra"), "_id", "_th", "text")
    parts = parallelism(documents.sparkSession)
    # `text` in the sort only orders rows of one id.
    placed = placed.repartition(parts, "shard").sortWithinPartitions("shard", "extra", "_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # consecutive documents of one range that wait for their successor
        size, shard, closed = 0, None, False

        def done(rows: list[tuple], following: str) -> pa.RecordBatch:
            res = _compare(rows, following, scale)
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*res), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()))],
                ["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in ("shard", "extra", "_id")]
            for s, extra, i, text in zip(*cols, batch.column("text")):
                t = text.as_py() or ""
                if s != shard:
                    shard, closed = s, False
                if closed:
                    continue  # further copies of the next range's first id
                if extra:
                    yield done(held, t)
                    held, size, closed = [], 0, True
                    continue
                if size > CHUNK_BYTES:
                    yield done(held, t)
                    held, size = [], 0
                held.append((i, t))
                size += len(t)

    return placed.mapInArrow(run, NEIGHBOUR_SCHEMA).select(real_id().alias("doc_id"), "n_chars", "edited_sha256",
                                                           "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _lookup(x, keys: list, values: list):
    """values[keys.index(x)] or null, by nested comparisons (log2 of the number of keys a row)."""
    if len(keys) == 1:
        return F.when(x == F.lit(keys[0]), F.lit(values[0]))
    m = len(keys) // 2
    return F.when(x < F.lit(keys[m]), _lookup(x, keys[:m], values[:m])).otherwise(_lookup(x, keys[m:], values[m:]))
