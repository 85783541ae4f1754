"""Helpers shared by the training-data operators.

* Arrow string columns as byte buffers, and vectorised word spans, word hashes
  and word n-gram hashes over them (no Python object per word).
* Contiguous, deterministic shards of an integer key from exact counts.
* The checkpoint folder and Hadoop-path file access for operators that keep files.
"""

from __future__ import annotations

import os
import sys
import types
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import headline_engine
from headline_engine.session import ensure_checkpoint_dir

# Workers need no installed copy of the package.
cloudpickle.register_pickle_by_value(headline_engine)

#: A chunk of documents handled at once by the vectorised code (bytes of text; one document may exceed it).
CHUNK_BYTES = 1 << 20
#: Stands for a null doc_id in keys: nulls sort first and equal each other.
NULL_ID = -(1 << 63)

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE2 = np.uint64(0xD1342543DE82EF95)


def _inverse(b: np.uint64) -> np.uint64:
    return np.uint64(pow(int(b), -1, 1 << 64))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inv = base, _inverse(base)
        self.p = self.q = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.p) < n:
            m = max(n, 1 << 16)
            one = np.ones(1, np.uint64)
            with np.errstate(over="ignore"):
                self.p = np.concatenate([one, np.cumprod(np.full(m - 1, self.base))])
                self.q = np.concatenate([one, np.cumprod(np.full(m - 1, self.inv))])
        return self.p[:n], self.q[:n]


def process_wide(name: str, make: Callable):
    """One object per Python worker process, kept from task to task (pickled functions bring fresh globals each)."""
    home = sys.modules.setdefault("_headline_engine_process", types.ModuleType("_headline_engine_process"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def process_latest(name: str, tag: str, make: Callable):
    """As process_wide, for one tag at a time: a new tag replaces the object of the one before."""
    slot = process_wide(name, dict)
    if tag not in slot:
        slot.clear()
        slot[tag] = make()
    return slot[tag]


def tidy(run: Callable) -> Callable:
    """A mapInArrow function that gives freed memory back to the system when its task ends, so that an idle worker does not
    hold a task's peak."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import ctypes

            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library: nothing to trim
                pass

    return tidied


def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    return process_wide(f"powers_{int(base)}", lambda: _Powers(base)).upto(n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective): spreads polynomial hashes over all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class SpanHash:
    """Hash of any span [s, e) of a value array in O(1): prefix sums of v[i]·b^i, shifted back by b^-s."""

    def __init__(self, values: np.ndarray, base: np.uint64 = BASE) -> None:
        n = len(values)
        p, q = _powers(base, n + 1)
        self.q = q
        with np.errstate(over="ignore"):
            self.c = np.concatenate([np.zeros(1, np.uint64), np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p[:n])])

    def __call__(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.c[e] - self.c[s]) * self.q[s] + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def _table(separators: str | bytes) -> np.ndarray:
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


#: Words `[^\x20\x09-\x0D]+`: everything but ASCII white space.
SPACE_WORDS = _table(bytes([0x20, *range(0x09, 0x0E)]))
#: ASCII letters and digits and every byte of a non-ASCII character.
ALNUM_WORDS = _table(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    """Words of a chunk of documents. doc[i]:doc[i + 1] are the words of document i."""

    data: np.ndarray  # bytes
    start: np.ndarray  # byte spans of the words
    end: np.ndarray
    doc: np.ndarray  # word offsets by document, one more than documents

    def hashes(self, base: np.uint64 = BASE) -> np.ndarray:
        return SpanHash(self.data, base)(self.start, self.end)


def words_of(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool) -> Words:
    """Word spans of the documents data[offsets[i]:offsets[i + 1]]."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    m = np.zeros(n + 2, bool)
    m[1:-1] = table[data]
    prev, nxt = m[:-2].copy(), m[2:].copy()
    inner = offsets[(offsets > 0) & (offsets < n)]
    prev[inner] = False
    nxt[inner - 1] = False
    m = m[1:-1]
    start, end = np.flatnonzero(m & ~prev), np.flatnonzero(m & ~nxt) + 1
    return Words(data, start, end, np.searchsorted(start, offsets))


def ngram_spans(doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start word, end word, document) of every k-gram; a document with 1 to k-1 words gives one shorter gram."""
    n = np.diff(doc)
    grams = np.where(n >= k, n - k + 1, (n > 0).astype(n.dtype))
    of = np.repeat(np.arange(len(n)), grams)
    first = np.cumsum(grams) - grams
    s = np.arange(int(grams.sum())) - first[of] + doc[:-1][of]
    return s, np.minimum(s + k, doc[1:][of]), of


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return d, o - o[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about `limit` bytes of the column each, one row at least."""
    if not batch.num_rows:
        return
    _, off = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def keyed(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(_id, _th, text): the integer id (nulls first and equal) and the hash of the text tell documents apart, so that
    repeated ids with different texts stay different documents; repeated rows are one document."""
    return df.select(
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NULL_ID)).alias("_id"),
        F.xxhash64(F.col(text)).alias("_th"),
        F.col(text).cast("string").alias("text"),
    )


def real_id() -> Column:
    """The id that keyed() took."""
    return F.when(F.col("_id") != F.lit(NULL_ID), F.col("_id"))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


@dataclass
class Shards:
    """Contiguous ranges of an integer key with about equal row counts. column: the shard of a row; first: the smallest
    key of each shard that has rows."""

    n: int
    column: Column
    first: dict[int, int]


def contiguous_shards(df: DataFrame, key: str, rows: int, cells: int = 2048) -> Shards:
    """Cut the key's range so that a shard has about `rows` rows (a single key is never cut).

    Exact counts of equal-width cells, refined where a cell is too full, give the bounds: the same table gives the
    same shards whatever its partitions. The driver holds `cells` counts for each range that is refined. Null keys
    are not allowed (see keyed()).
    """
    x = F.col(key)
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    if lo is None:
        return Shards(1, F.lit(0), {})
    tree, todo = {}, [(lo, hi)]  # range -> (width, counts)
    while todo:
        step, nxt = todo[:64], todo[64:]
        case = None
        for i, (a, b) in enumerate(step):
            w = -(-(b - a + 1) // cells)
            cond = x.between(a, b)
            val = F.struct(F.lit(i).alias("r"), F.floor((x.cast("decimal(20,0)") - F.lit(a)) / F.lit(w)).cast("int").alias("c"))
            case = F.when(cond, val) if case is None else case.when(cond, val)
        counted = df.select(case.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n")).collect()
        for i, (a, b) in enumerate(step):
            w = -(-(b - a + 1) // cells)
            c = {r["v"]["c"]: r["n"] for r in counted if r["v"]["r"] == i}
            tree[(a, b)] = (w, c)
            nxt += [(a + k * w, min(b, a + k * w + w - 1)) for k, n in c.items() if n > rows and w > 1]
        todo = nxt
    state = {"shard": 0, "filled": 0}
    cuts: list[tuple[int, int]] = []  # (smallest key of the cell, shard)

    def walk(a: int, b: int) -> None:
        w, c = tree[(a, b)]
        for k in sorted(c):
            sub = (a + k * w, min(b, a + k * w + w - 1))
            if sub in tree and sub != (a, b):
                walk(*sub)
                continue
            if state["filled"] and state["filled"] + c[k] > rows:
                state["shard"] += 1
                state["filled"] = 0
            state["filled"] += c[k]
            if not cuts or cuts[-1][1] != state["shard"]:
                cuts.append((sub[0], state["shard"]))

    walk(lo, hi)
    n = state["shard"] + 1
    # Binary search by nested conditions: log2(n) comparisons a row.
    def expr(i: int, j: int) -> Column:
        if j - i == 1:
            return F.lit(cuts[i][1])
        m = (i + j) // 2
        return F.when(x < F.lit(cuts[m][0]), expr(i, m)).otherwise(expr(m, j))

    return Shards(n, expr(0, len(cuts)), {s: k for k, s in cuts})


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def open_fs(uri: str):
    """(pyarrow file system, path) of a URI or a local path; reaches what the cluster's checkpoint folder names."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def durable(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts lineage, survives lost executors, and gives the
    planner true sizes."""
    return saved(df)[0]


def saved(df: DataFrame) -> tuple[DataFrame, str]:
    """As durable, with the folder, for tables that are deleted (delete_dir) once nothing needs them."""
    path = shared_dir(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own in the shared folder, by whatever file system Spark has for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
