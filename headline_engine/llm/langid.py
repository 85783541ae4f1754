"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts of order 0 to 3 is counted on labelled texts. Its escape probabilities
(method C: in a context with n bytes seen and d distinct ones, a seen byte has c / (n + d), the escape d / (n + d)) give
an exact code length for any byte after any context: the longest known context suffix codes it, or escapes to the next
shorter one, and below order 0 all 256 bytes are equally likely. Statistics are frozen after training, so a language's
code length of a text is a sum of table entries; the language with the shortest code wins.

Training takes a bounded sample: at most about TRAIN_DOCS labelled documents per language, chosen by a hash of doc_id,
each whole. Counts of the sample are summed by Spark and the model (contexts x bytes) goes to the tasks; its size
depends on TRAIN_DOCS and the number of languages, not on the table. Scoring reads every document whole, without a
shuffle.

ASCII letters are lower-cased and other ASCII characters than letters count as one space, for model and text alike;
code lengths are kept in 1/1024 bit, so sums are exact in any order.

Defined cases: a null text, or one without a letter, is `und` with score 0 (letters are Unicode letters); with no
labelled document all are `und`; a null doc_id counts as not held out; a null lang is never learned from; ties go to the
first language in order. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headline_engine.llm.common import (
    chunks,
    process_latest,
    text_buffer,
)

#: Labelled documents per language that the model learns from (expected number; a hash decides).
TRAIN_DOCS = 1500
ORDER = 3
UNKNOWN = "und"
_SCALE = 1024
_LETTER = regex.compile(r"\p{L}")

_FOLD = np.full(256, 0x20, np.uint8)
for _b in range(256):
    if 0x61 <= _b <= 0x7A or _b >= 0x80:
        _FOLD[_b] = _b
    elif 0x41 <= _b <= 0x5A:
        _FOLD[_b] = _b + 32


def held_out(doc_id: Column) -> Column:
    """Documents that the model never learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes, three spaces before each text, and the position of each text's first byte, one more at the end."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.full(len(data) + ORDER * n, 0x20, np.uint8)
    start = offsets[:-1] + ORDER * (np.arange(n) + 1)
    where = np.arange(len(data)) + np.repeat(ORDER * (np.arange(n) + 1), size)
    out[where] = _FOLD[data]
    return out, np.append(start, len(out) + ORDER)


def _grams(b: np.ndarray) -> np.ndarray:
    """Big-endian 32-bit code of the 4 bytes that end at each position from ORDER on."""
    x = b.astype(np.uint32)
    return (x[:-3] << np.uint32(24)) | (x[1:-2] << np.uint32(16)) | (x[2:-1] << np.uint32(8)) | x[3:]


def count_grams(train: DataFrame) -> DataFrame:
    """(lang, gram, n): 4-byte grams (3 bytes of context and the byte) of the texts, counted once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict] = {}
        for batch in batches:
            for part in chunks(batch, "text"):
                langs = np.array(part.column("lang").to_pylist(), object)
                data, off = text_buffer(part.column("text"))
                b, start = _folded(data, off)
                codes = _grams(b)
                for lang in dict.fromkeys(langs):
                    idx = np.concatenate([np.arange(off[i], off[i + 1]) + start[i] - off[i] - ORDER for i in np.flatnonzero(langs == lang)])
                    g, n = np.unique(codes[idx], return_counts=True)
                    mine = total.setdefault(lang, {})
                    for k, v in zip(g.tolist(), n.tolist()):
                        mine[k] = mine.get(k, 0) + v
        for lang, mine in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(mine), pa.string()), pa.array(list(mine), pa.int64()), pa.array(list(mine.values()), pa.int64())],
                                             ["lang", "gram", "n"])

    return train.select("lang", "text").mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Frozen context trees of all languages, as code-length tables.

    Every context that any language has seen (of order 0 to 3) is a node with one row: for each language and symbol the
    length of the symbol's code after that context. Symbols are the bytes seen in training and one for all others.
    """

    def __init__(self, langs: list[str], grams: np.ndarray, counts: list[np.ndarray]) -> None:
        """grams: sorted 4-byte grams; counts: for each language their counts."""
        self.langs = langs
        symbols = np.unique(grams & 0xFF)
        a = self.a = len(symbols) + 1
        self.symbol = np.full(256, a - 1, np.int64)
        self.symbol[symbols] = np.arange(a - 1)
        sym = self.symbol[grams & 0xFF]
        self.nodes: list[np.ndarray] = []  # by order: sorted contexts
        self.base: list[int] = []
        tables, below = [], [np.full((1, a), 8.0) for _ in langs]
        for lower in below:
            lower[:, -1] = 8.0
        parent, rows = np.zeros(1, np.int64), 0
        for k in range(ORDER + 1):
            ctx = (grams >> 8) & ((1 << (8 * k)) - 1)
            known = np.unique(ctx)
            at = np.searchsorted(known, ctx)
            if k:
                parent = np.searchsorted(self.nodes[-1], known & ((1 << (8 * (k - 1))) - 1))
            level = []
            for li, c in enumerate(counts):
                n = np.zeros((len(known), a))
                np.add.at(n, (at, sym), c)
                total, kinds = n.sum(1), (n > 0).sum(1)
                seen = total > 0
                escape = np.where(seen, np.log2(np.where(seen, (total + kinds) / np.maximum(kinds, 1), 1)), 0.0)
                lower = below[li][parent] if k else np.repeat(below[li], len(known), 0)
                own = np.log2(np.maximum(total + kinds, 1))[:, None] - np.log2(np.maximum(n, 1))
                level.append(np.where(n > 0, own, lower + escape[:, None]))
            self.nodes.append(known)
            self.base.append(rows)
            rows += len(known)
            tables.append(np.stack(level, 2))
            below = level
        #: [node * a + symbol, language], 1/1024 bit.
        self.cost = np.rint(np.concatenate(tables) * _SCALE).astype(np.int32).reshape(-1, len(langs))

    def node_maps(self) -> list[np.ndarray]:
        """For orders 2 and 3 a direct map context -> row (0: not a node); built once in each worker."""
        maps = []
        for k in (2, 3):
            m = np.zeros(1 << (8 * k), np.int32)
            m[self.nodes[k]] = self.base[k] + np.arange(len(self.nodes[k]), dtype=np.int32)
            maps.append(m)
        one = np.zeros(256, np.int32)  # order 1, else order 0
        one[self.nodes[1]] = self.base[1] + np.arange(len(self.nodes[1]), dtype=np.int32)
        return [one, *maps]

    def code_lengths(self, data: np.ndarray, offsets: np.ndarray, maps: list[np.ndarray]) -> np.ndarray:
        """[text, language]: exact code length of each text in 1/1024 bit."""
        n = len(offsets) - 1
        out = np.zeros((n, len(self.langs)), np.int64)
        if not len(data):
            return out
        b, start = _folded(data, offsets)
        g = _grams(b)
        keep = np.repeat(start[:-1] - ORDER - offsets[:-1], np.diff(offsets)) + np.arange(len(data))
        g = g[keep]
        row = maps[2][g >> np.uint32(8)]
        miss = np.flatnonzero(row == 0)
        if len(miss):
            r = maps[1][(g[miss] >> np.uint32(8)) & np.uint32(0xFFFF)]
            deep = r == 0
            r[deep] = maps[0][(g[miss][deep] >> np.uint32(8)) & np.uint32(0xFF)]
            row[miss] = r
        at = row.astype(np.int64) * self.a + self.symbol[g & np.uint32(0xFF)]
        filled = np.flatnonzero(np.diff(offsets) > 0)
        for li in range(len(self.langs)):
            out[filled, li] = np.add.reduceat(self.cost[at, li].astype(np.int64), offsets[:-1][filled])
        return out


def fit(documents: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | None:
    """Learn from text and lang of a bounded hash sample of the labelled documents that are not held out."""
    labelled = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per language
    if not sizes:
        return None
    share = None
    for lang in sorted(sizes):
        part = min(1.0, train_docs / sizes[lang])
        share = F.when(F.col("lang") == lang, F.lit(part)) if share is None else share.when(F.col("lang") == lang, F.lit(part))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30))
    pdf = count_grams(chosen).toPandas()  # bounded by the sample
    if pdf.empty:
        return None
    langs = sorted(pdf["lang"].unique())
    grams = np.unique(pdf["gram"].to_numpy(np.int64))
    counts = []
    for lang in langs:
        mine = pdf[pdf["lang"] == lang]
        c = np.zeros(len(grams))
        c[np.searchsorted(grams, mine["gram"].to_numpy(np.int64))] = mine["n"].to_numpy(np.float64)
        counts.append(c)
    return Model(langs, grams, counts)


def predict(documents: DataFrame, model: Model | None) -> DataFrame:
    """The documents' columns with lang_pred, score and bits_per_byte (of the best language) added.

    score is the best language's share of 2^(-code length): 1 when the others need many more bits, 0 for `und`.
    """
    spark = documents.sparkSession
    documents = documents.select(*[c for c in documents.columns if c not in ("lang_pred", "score", "bits_per_byte")])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    schema += ", lang_pred string, score double, bits_per_byte double"
    shipped = spark.sparkContext.broadcast(vars(model) if model else None)  # bounded by the training sample
    tag = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = None
        if shipped.value is not None:
            m = Model.__new__(Model)
            m.__dict__.update(shipped.value)
        maps = process_latest("large", tag, m.node_maps) if m else None
        for batch in batches:
            for part in chunks(batch, "text"):
                texts = part.column("text").to_pylist()
                has = [t is not None and _LETTER.search(t) is not None for t in texts]
                if m is None:
                    best, names, score, bits = None, [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
                else:
                    data, off = text_buffer(part.column("text"))
                    cost = m.code_lengths(data, off, maps)
                    best = cost.argmin(1)
                    low = cost.min(1)
                    p = 1.0 / np.exp2(-np.minimum((cost - low[:, None]) / _SCALE, 1000.0)).sum(1)
                    per = low / _SCALE / np.maximum(np.diff(off), 1)
                    names = [m.langs[i] if ok else UNKNOWN for i, ok in zip(best, has)]
                    score = [float(x) if ok else 0.0 for x, ok in zip(p, has)]
                    bits = [float(x) if ok else 0.0 for x, ok in zip(per, has)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())],
                    [*part.schema.names, "lang_pred", "score", "bits_per_byte"])

    return documents.mapInArrow(run, schema)


def identify(documents: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """predict() with a model fitted on the same table's labelled sample."""
    return predict(documents, fit(documents, train_docs))
