"""Token-id files with Simple-8b word-aligned coding.

A 64-bit word holds a 4-bit selector and 60 bits of ids: 60 ids of 1 bit, 30 of 2, ... 1 of 60; two selectors stand for
runs of 240 and 120 zeros. Ids are cut into blocks of BLOCK that are coded alone, so the word offset of every block lets
blocks be decoded by themselves, and a whole file by one vectorised pass per selector. A value of more than 60 bits is an
escape: its place holds 0 and the value stands in the escape list.

File (little-endian): magic, counts, document ids, tokens per document, word offset per block, escape positions, escape
values, words. Files hold contiguous documents in ascending id order: texts move once to contiguous id ranges, a task
streams a range through the tokenizer into files that roll at ROLL_IDS ids, under temporary names until whole. The
manifest is a table that Spark commits after all files and gives every file its first id's position.

Defined cases: a null or empty text is the end id alone; null ids come first; rows of one id are in text order, each its
own document; an empty table gives no file. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headline_engine.llm.common import (
    chunks,
    contiguous_shards,
    keyed,
    open_fs,
    parallelism,
    real_id,
    tidy,
)
from headline_engine.llm.tokenids import ids_batch
from headline_engine.llm.tokens import END_ID, tokenizer_path

BLOCK = 1024
ROLL_IDS = 16 << 20
#: Pre-tokens in each of the two generations of a worker's cache (a vocabulary of real words has some 10^5).
CACHE = 300_000
_MAGIC = b"S8BTOK01"
#: (ids, bits) by selector: fixed values of the coding.
SELECTORS = ((240, 0), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
_COUNT = np.array([c for c, _ in SELECTORS])
_LIMIT = np.uint64(1) << np.uint64(60)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offset of each block and of the end, escape positions, escape values) of unsigned ids."""
    v = ids.astype(np.uint64)
    escape = np.flatnonzero(v >= _LIMIT).astype(np.uint64)
    values = v[escape.astype(np.int64)]
    v[escape.astype(np.int64)] = 0
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64), escape, values
    left = BLOCK - np.arange(n) % BLOCK  # ids from here to the end of the block
    left = np.minimum(left, n - np.arange(n))
    best = np.full(n, 15, np.int64)
    for s in range(14, -1, -1):  # the selector of most ids that fits wins
        count, bits = SELECTORS[s]
        bad = np.flatnonzero(v >> np.uint64(bits))
        if len(bad) == n:
            continue
        nxt = np.full(n + 1, n, np.int64)  # first id at or after each place that does not fit
        nxt[bad] = bad
        run = np.minimum.accumulate(nxt[::-1])[::-1][:n] - np.arange(n)
        best[(run >= count) & (left >= count)] = s
    # Follow the words of all blocks in step.
    pos = np.arange(0, n, BLOCK)
    end = np.minimum(pos + BLOCK, n)
    block = np.arange(len(pos))
    starts, owners = [], []
    while len(pos):
        starts.append(pos)
        owners.append(block)
        pos = pos + _COUNT[best[pos]]
        live = pos < end
        pos, end, block = pos[live], end[live], block[live]
    start = np.sort(np.concatenate(starts))
    per_block = np.bincount(np.concatenate(owners), minlength=-(-n // BLOCK))
    sel = best[start]
    words = sel.astype(np.uint64) << np.uint64(60)
    for s, (count, bits) in enumerate(SELECTORS):
        at = np.flatnonzero(sel == s)
        if len(at) and bits:
            shift = (np.arange(count) * bits).astype(np.uint64)
            words[at] |= np.bitwise_or.reduce(v[start[at][:, None] + np.arange(count)] << shift, axis=1)
    return words, np.append(0, np.cumsum(per_block)).astype(np.uint64), escape, values


def decode(words: np.ndarray, n: int, escape: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The n ids of a run of whole blocks."""
    out = np.zeros(n, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    end = np.cumsum(_COUNT[sel])
    start = end - _COUNT[sel]
    for s, (count, bits) in enumerate(SELECTORS):
        at = np.flatnonzero(sel == s)
        if len(at) and bits:
            shift = (np.arange(count) * bits).astype(np.uint64)
            out[start[at][:, None] + np.arange(count)] = (words[at][:, None] >> shift) & np.uint64((1 << bits) - 1)
    out[escape.astype(np.int64)] = values
    return out


class _File:
    """Collects whole documents and writes one file."""

    def __init__(self) -> None:
        self.docs: list[int] = []
        self.sizes: list[int] = []
        self.held: list[bytes] = []  # ids not coded yet
        self.n_held = self.n = self.n_words = 0
        self.words: list[np.ndarray] = []
        self.index: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        self.values: list[np.ndarray] = []

    def add(self, doc: int, ids: bytes) -> None:
        self.docs.append(doc)
        self.sizes.append(len(ids) // 4)
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= 512 * BLOCK:
            self._code(self.n_held // BLOCK * BLOCK)

    def _code(self, take: int) -> None:
        raw = np.frombuffer(b"".join(self.held), "<u4")
        words, index, esc, val = encode(raw[:take])
        self.held, self.n_held = [raw[take:].tobytes()], len(raw) - take
        self.words.append(words)
        self.index.append(index[:-1] + np.uint64(self.n_words))
        self.escapes.append(esc + np.uint64(self.n))
        self.values.append(val)
        self.n += take
        self.n_words += len(words)

    @property
    def ids(self) -> int:
        return self.n + self.n_held

    def write(self, folder: str, name: str) -> None:
        if self.n_held:
            self._code(self.n_held)
        index = np.append(np.concatenate(self.index), np.uint64(self.n_words))
        esc, val = np.concatenate(self.escapes), np.concatenate(self.values)
        head = np.array([self.n, self.n_words, len(index) - 1, len(esc), len(self.docs)], "<u8")
        fs, home = open_fs(folder)
        fs.create_dir(home, recursive=True)
        temp = f"{home}/.tmp-{uuid.uuid4().hex}"
        with fs.open_output_stream(temp, compression=None) as f:
            for x in (_MAGIC, head.tobytes(), np.array(self.docs, "<i8").tobytes(), np.array(self.sizes, "<u8").tobytes(),
                      index.astype("<u8").tobytes(), esc.astype("<u8").tobytes(), val.astype("<u8").tobytes(), *[w.astype("<u8").tobytes() for w in self.words]):
                f.write(x)
        fs.move(temp, f"{home}/{name}")


class Reader:
    """An open token file. Blocks are read and decoded on demand; memory holds the asked-for blocks."""

    def __init__(self, folder: str, name: str) -> None:
        fs, home = open_fs(folder)
        self.f = fs.open_input_file(f"{home}/{name}")
        if self.f.read(8) != _MAGIC:
            raise ValueError(f"{name} is not a token file")
        self.n, self.n_words, blocks, escapes, docs = (int(x) for x in np.frombuffer(self.f.read(40), "<u8"))
        self.docs = np.frombuffer(self.f.read(8 * docs), "<i8")
        self.sizes = np.frombuffer(self.f.read(8 * docs), "<u8").astype(np.int64)
        self.index = np.frombuffer(self.f.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        self.escape = np.frombuffer(self.f.read(8 * escapes), "<u8")
        self.values = np.frombuffer(self.f.read(8 * escapes), "<u8")
        self.words_at = self.f.tell()

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start..end (exclusive)."""
        if end <= start:
            return np.zeros(0, np.uint64)
        a, b = start // BLOCK, -(-end // BLOCK)
        self.f.seek(self.words_at + 8 * int(self.index[a]))
        words = np.frombuffer(self.f.read(8 * int(self.index[b] - self.index[a])), "<u8")
        lo, hi = a * BLOCK, min(b * BLOCK, self.n)
        x, y = np.searchsorted(self.escape, [lo, hi])
        got = decode(words, hi - lo, self.escape[x:y] - np.uint64(lo), self.values[x:y])
        return got[start - lo : end - lo]


def write(documents: DataFrame, folder: str, tokenizer: str | None = None, shard_rows: int = 1000, roll_ids: int = ROLL_IDS) -> DataFrame:
    """Tokenise all documents and write the files; returns the committed manifest (shard, part, file, docs, ids)."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    spark = documents.sparkSession
    docs = keyed(documents)
    parts = parallelism(spark)
    n = max(1, docs.select("_id").count() // (shard_rows * 4 * parts))
    shards = contiguous_shards(docs.select("_id"), "_id", shard_rows * n)
    rows = docs.select(shards.column.alias("shard"), "_id", "text").repartition(parts, "shard").sortWithinPartitions("shard", "_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([END_ID], "<u4").tobytes()
        shard, part, out = None, 0, _File()
        made: list[tuple] = []

        def close() -> None:
            nonlocal part, out
            if out.docs:
                name = f"ids-{shard:05d}-{part:05d}.s8b"
                made.append((shard, part, name, len(out.docs), out.ids))
                out.write(folder, name)
                part, out = part + 1, _File()

        for piece in (p for batch in batches for p in chunks(batch, "text")):
            for s, i, ids in zip(piece.column("shard").to_pylist(), piece.column("_id").to_pylist(), ids_batch(piece.column("text"), path, cache=CACHE)):
                if s != shard:
                    close()
                    shard, part = s, 0
                out.add(i, ids + end)
                if out.ids >= roll_ids:
                    close()
        close()
        if made:
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], ["shard", "part", "file", "docs", "ids"])

    rows.mapInArrow(tidy(run), "shard int, part int, file string, docs long, ids long").write.parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files that the manifest names."""
    manifest = spark.read.parquet(f"{folder}/_manifest")
    # Ids before each range: one row per range on the driver (their number follows the cluster, not the table).
    before, at = {}, 0
    for r in sorted(manifest.groupBy("shard").agg(F.sum("ids").alias("ids")).collect()):
        before[r["shard"]] = at
        at += r["ids"]
    files = manifest.withColumn("start", F.coalesce(F.sum("ids").over(
        Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    files = files.select("shard", "file", "docs", "ids", "start").repartition(parallelism(spark), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                f = Reader(folder, row["file"])
                if f.n != row["ids"] or len(f.docs) != row["docs"] or int(f.sizes.sum()) != f.n:
                    raise ValueError(f"{row['file']} does not fit its manifest")
                end = np.cumsum(f.sizes)
                crc, at, buf = [], 0, None
                while at < len(f.docs):  # about 4 million ids at a time, one document at least
                    first = int(end[at] - f.sizes[at])
                    to = max(at + 1, int(np.searchsorted(end, first + (4 << 20), "right")))
                    buf = f.ids(first, int(end[to - 1])).astype("<u4")
                    crc += [zlib.crc32(buf[int(end[i] - f.sizes[i]) - first : int(end[i]) - first]) for i in range(at, to)]
                    at = to
                start = end - f.sizes + row["start"] + before[row["shard"]]
                yield pa.RecordBatch.from_arrays([pa.array(f.docs), pa.array(start), pa.array(f.sizes), pa.array(crc, pa.int64())],
                                                 ["_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, "_id long, start long, n_tokens long, ids_crc32 long").select(real_id().alias("doc_id"), "start", "n_tokens", "ids_crc32")
