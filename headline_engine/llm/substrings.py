"""Exact substring dedup by seed and extend on winnowed anchors.

A word is removed when a window of `window` consecutive words that covers it also starts in a document with a smaller
doc_id (windows are judged on the input).

Seed: of every run of `window` words at least one K-gram is an anchor (winnowing: the smallest K-gram hash of each
window - K + 1 consecutive ones), and equal windows have the same anchors at the same places. Anchors of all documents
are grouped by hash; anchors of a single document cannot repeat and end there.

Extend: an anchor's context is all words that some window around it can reach. Occurrences with equal contexts form a
class, and share all windows around the anchor, so every member but the smallest document is a maximal repeat over the
whole context: one row decides, copies are never paired. Only where an anchor has several classes is each class's first
member extended window by window to both sides; a window is taken with its smallest K-gram, grouped by a 128-bit hash of
its words, and compared by the smallest document. Work is linear in the number of anchors; hot groups are combined
map-side and hot joins split by AQE.

Defined cases: words are runs of anything but ASCII white space; a null or short text has no window and keeps all; a
null doc_id is the smallest id; repeated ids are separate documents with equal ids (neither is smaller); repeated rows
each get the result; an empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headline_engine.llm.common import (
    BASE2,
    chunks,
    durable,
    keyed,
    mix64,
    real_id,
    signed,
    SPACE_WORDS,
    SpanHash,
    text_buffer,
    Words,
    words_of,
)

WINDOW = 50
K = 20

_ANCHORS = "h long, ctx long, _id long, _th long, pos int"
_WINDOWS = "h long, ctx long, first long, w1 long, w2 long, off int"
_KEPT = "_id long, n_words long, n_removed long, kept_text string"


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over x[i : i + width] for every i with a whole window, in log2(width) steps."""
    size, out = 1, x
    while size * 2 <= width:
        out = pick(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, SpanHash]:
    """(word position, hash, document) of the anchors, and the hasher of word spans."""
    span = SpanHash(words.hashes())
    n = int(words.doc[-1])
    none = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), span)
    reach = window - k + 1  # consecutive K-grams of a window
    if n < window:
        return none
    at = np.arange(n - k + 1)
    h = span(at, at + k)
    least = _slide(h, reach, np.minimum)  # by first K-gram of the window
    doc = np.repeat(np.arange(len(words.doc) - 1), np.diff(words.doc))
    start = np.arange(len(least))
    least[words.doc[1:][doc[start]] - start < window] = 0  # windows that leave their document
    pad = np.zeros(reach - 1, np.uint64)
    most = _slide(np.concatenate([pad, least, pad]), reach, np.maximum)  # over the windows that hold each K-gram
    chosen = np.flatnonzero((most == h) & (most > 0))
    return chosen, h[chosen], doc[chosen], span


def _context(words: Words, pos: np.ndarray, doc: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    lo = np.maximum(pos - (window - k), words.doc[doc])
    return lo, np.minimum(pos + window, words.doc[doc + 1])


def remove_repeats(documents: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text), one row per document; kept words are joined by one space."""
    docs = keyed(documents)

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                w = words_of(*text_buffer(part.column("text")), SPACE_WORDS, lower=False)
                pos, h, doc, span = anchors(w, window, k)
                if not len(pos):
                    continue
                lo, hi = _context(w, pos, doc, window, k)
                with np.errstate(over="ignore"):
                    ctx = mix64(span(lo, pos) * np.uint64(3) + span(pos, hi))
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [signed(h), signed(ctx), part.column("_id").take(take), part.column("_th").take(take), pa.array((pos - w.doc[doc]).astype(np.int32))],
                    ["h", "ctx", "_id", "_th", "pos"])

    found = docs.mapInArrow(seed, _ANCHORS)
    # Most anchors occur in one document; only the others go on.
    twice = found.groupBy("h").agg(F.min("_id").alias("lo"), F.max("_id").alias("hi")).where("hi > lo").select("h")
    # A written table: the join then has a side of its own for AQE to split where an anchor is hot.
    found = durable(found.join(durable(twice), "h"))
    classes = found.groupBy("h", "ctx").agg(F.min(F.struct("_id", "_th", "pos")).alias("rep"), F.max("_id").alias("last"))
    groups = classes.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("rep._id").alias("lo"))
    classes = durable(classes.join(groups.select("h", (F.col("n") > 1).alias("several"), "lo"), "h").select(
        "h", "ctx", F.col("rep._id").alias("first"), F.col("rep._th").alias("th"), F.col("rep.pos").alias("pos"), "last", "several", "lo"))

    # Several classes: extend the first member of each to all windows around its anchor. A class that holds the anchor's
    # smallest document has nothing smaller to meet, but the others need its windows.
    reps = classes.where("several").groupBy(F.col("first").alias("_id"), F.col("th").alias("_th")).agg(
        F.collect_list(F.struct("h", "ctx", "pos")).alias("at"))

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = window - k
        for batch in batches:
            for part in chunks(batch, "text"):
                w = words_of(*text_buffer(part.column("text")), SPACE_WORDS, lower=False)
                at = part.column("at")
                of = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(at.offsets)))
                flat = at.flatten()
                h, ctx, pos = (np.asarray(flat.field(x)) for x in ("h", "ctx", "pos"))
                pos = pos.astype(np.int64) + w.doc[of]
                one, two = SpanHash(w.hashes()), SpanHash(w.hashes(BASE2), BASE2)
                ids = np.asarray(part.column("_id"))
                off = np.arange(-reach, 1)
                start = pos[:, None] + off
                ok = (start >= w.doc[of][:, None]) & (start + window <= w.doc[of + 1][:, None])
                r, o = np.nonzero(ok)
                # A window belongs to the anchor that is its smallest K-gram: its words alone decide, in every document.
                first = np.arange(max(0, int(w.doc[-1]) - k + 1))
                kgram = one(first, first + k)
                mine = _slide(kgram, window - k + 1, np.minimum)[start[r, o]] == kgram[pos[r]]
                r, o = r[mine], o[mine]
                s = start[r, o]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[r]), pa.array(ctx[r]), pa.array(ids[of[r]]), signed(one(s, s + window)), signed(two(s, s + window)), pa.array(off[o].astype(np.int32))],
                    ["h", "ctx", "first", "w1", "w2", "off"])

    windows = docs.join(reps, ["_id", "_th"]).select("_id", "text", "at").mapInArrow(extend, _WINDOWS)
    windows = durable(windows)
    least = windows.groupBy("w1", "w2").agg(F.min("first").alias("least"), F.max("first").alias("most")).where("least < most")
    older = windows.join(least, ["w1", "w2"]).where("least < first").groupBy("h", "ctx").agg(F.sort_array(F.collect_set("off")).alias("offs"))

    # Word spans to remove, relative to the document: the whole context for all but a class's smallest document, single
    # windows for that one.
    state = classes.where("last > first or (several and first > lo)").select("h", "ctx", "first").join(older, ["h", "ctx"], "left")
    state = state.select("h", "ctx", "first", "offs")
    spans = found.join(state, ["h", "ctx"]).where("_id > first or offs is not null")
    spans = spans.select("_id", "_th", F.struct("pos", F.when(F.col("_id") > F.col("first"), F.lit(None)).otherwise(F.col("offs")).alias("offs")).alias("s"))
    spans = spans.groupBy("_id", "_th").agg(F.collect_list("s").alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, offsets = text_buffer(part.column("text"))
                w = words_of(data, offsets, SPACE_WORDS, lower=False)
                n = int(w.doc[-1])
                edge = np.zeros(n + 1, np.int64)
                col = part.column("spans")
                for i in np.flatnonzero(np.asarray(col.is_valid())):
                    lo, hi = int(w.doc[i]), int(w.doc[i + 1])
                    for x in col[int(i)].as_py():
                        p = x["pos"] + lo
                        if x["offs"] is None:
                            edge[max(lo, p - (window - k))] += 1
                            edge[min(hi, p + window)] -= 1
                        else:
                            for o in x["offs"]:
                                edge[p + o] += 1
                                edge[p + o + window] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                raw = data.tobytes()
                removed = np.add.reduceat(np.append(gone, False).astype(np.int64), np.minimum(w.doc[:-1], n)) if n else np.zeros(part.num_rows, np.int64)
                removed[np.diff(w.doc) == 0] = 0
                texts = []
                for i in range(part.num_rows):
                    a, b = w.doc[i], w.doc[i + 1]
                    if not removed[i]:
                        texts.append(b" ".join(raw[offsets[i] : offsets[i + 1]].split()))
                    else:
                        keep = np.flatnonzero(~gone[a:b]) + a
                        texts.append(b" ".join(raw[s:e] for s, e in zip(w.start[keep].tolist(), w.end[keep].tolist())))
                yield pa.RecordBatch.from_arrays(
                    [part.column("_id"), pa.array(np.diff(w.doc)), pa.array(removed), pa.array(texts, pa.binary()).cast(pa.string())],
                    ["_id", "n_words", "n_removed", "kept_text"])

    out = docs.join(spans, ["_id", "_th"], "left").select("_id", "text", "spans").mapInArrow(cut, _KEPT)
    return out.select(real_id().alias("doc_id"), "n_words", "n_removed", "kept_text")


def digest(removed: DataFrame) -> DataFrame:
    """The digest columns of remove_repeats()."""
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
