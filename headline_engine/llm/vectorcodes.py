"""Vector code compression (12): product codes by Lloyd rounds with adaptive bounds (Drake and Hamerly).

A vector's components become integers, floor(scale * x), and are cut into equal consecutive parts. Each part position has
a codebook of at most ENTRIES entries; a part's code is the index of its nearest entry. All arithmetic that decides a
code is on integers.

Between rounds a written table keeps, for every part, its code, its b closest other entries in the order of their lower
bounds, those bounds, and one outer bound under the distance of every entry not listed. When the codebooks move, a
listed entry's bound falls by that entry's drift and the outer bound by the largest drift. Then

* if the exact distance to the own entry is below all bounds, the code stands;
* if it is only below the outer bound, the listed entries are verified by integer distances;
* otherwise all entries are, and the part gets a new list.

Bounds are floating point, always rounded down (distances and drifts up), and compared strictly; ties can therefore only
occur among integer distances, where the lower index wins. b adapts: each round counts how deep the lists were needed.
While more than SEARCHED of the parts need a full search, the next lists are twice as long; once less than SPARED do, they
shrink to the depth that served SERVED of the parts that lists settled, by half at most.

One pass a round reads the table of the round before and writes the new one, together with the task's sums by entry,
which Spark adds up; only codebooks (entries x components numbers) and the depth counts come to the driver. The table
before the last is deleted.

Defined cases: vectors that are null or hold a null or non-finite component are dropped; so are vectors that the length of
the first kept vector (by vec_id) does not fit: another length, or one that parts do not divide, and vectors whose
integers are so large that a squared distance could pass a long. A null vec_id is coded but gives no codebook
entry; a repeated vec_id gives one entry (its smallest vector) and a row each. With fewer ids than entries the codebook
has that many. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headline_engine.llm.common import delete_dir, shared_dir

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries that a list holds at first, at least and at most.
FIRST_B, LEAST_B, MOST_B = 8, 2, 32
#: Rows worked on at once (a full search holds this many rows of ENTRIES distances).
BLOCK = 4096
#: Share of full searches above which lists grow, share under which they shrink, and share of the parts settled by lists
#: that shorter lists shall serve.
SEARCHED, SPARED, SERVED = 0.1, 0.02, 0.99
_UP, _DOWN = 1 + 1e-12, 1 - 1e-12


def largest(dim: int) -> int:
    """Integers up to this keep any squared distance of `dim` components within a long."""
    return math.isqrt((1 << 62) // max(1, dim)) // 2


def _prepare(scale: int, parts: int) -> Callable:
    """(id, label, vector) -> the kept rows with integer components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(2)
            rows = np.flatnonzero(np.asarray(col.is_valid()))
            col = col.take(pa.array(rows))
            n = np.asarray(col.value_lengths()).astype(np.int64)
            flat = col.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
            off = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
            with np.errstate(invalid="ignore", over="ignore"):
                v = np.floor(x * scale)
                bad = ~(np.abs(v) <= np.repeat([largest(int(k)) for k in n], n))
            bad = np.concatenate([np.zeros(1, np.int64), np.cumsum(bad)])
            keep = np.flatnonzero((bad[off[1:]] == bad[off[:-1]]) & (n > 0) & (n % parts == 0))
            v[~np.isfinite(v) | (np.abs(v) > 2**31 - 1)] = 0
            ints = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(v.astype(np.int32))).take(pa.array(keep))
            at = pa.array(rows[keep])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), ints], names=["vec_id", "label", "x"])

    return run


@dataclass
class Bounds:
    """Of m vectors and P parts: code [m, P], near [m, P, b], low [m, P, b], outer [m, P]."""

    code: np.ndarray
    near: np.ndarray
    low: np.ndarray
    outer: np.ndarray

    @classmethod
    def empty(cls, m: int, parts: int, b: int) -> Bounds:
        return cls(np.zeros((m, parts), np.uint8), np.zeros((m, parts, b), np.uint8), np.zeros((m, parts, b), np.float32), np.zeros((m, parts), np.float32))

    def pack(self) -> np.ndarray:
        m = len(self.code)
        return np.concatenate([a.reshape(m, -1).view(np.uint8).reshape(m, -1) for a in (self.code, self.near, self.low, self.outer)], axis=1)

    @classmethod
    def unpack(cls, raw: np.ndarray, parts: int, b: int) -> Bounds:
        m, sizes = len(raw), [parts, parts * b, 4 * parts * b, 4 * parts]
        cut = np.cumsum([0, *sizes])
        a = [np.ascontiguousarray(raw[:, s:e]) for s, e in zip(cut[:-1], cut[1:])]
        return cls(a[0], a[1].reshape(m, parts, b), a[2].view(np.float32).reshape(m, parts, b), a[3].view(np.float32).reshape(m, parts))


def _floor32(x: np.ndarray) -> np.ndarray:
    """float32 not above x."""
    y = x.astype(np.float32)
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances [m, K] of integer rows: by matrix product where doubles hold every sum exactly."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * top * top * x.shape[1] < 1 << 53:
        xf, cf = x.astype(np.float64), c.astype(np.float64)
        return ((xf * xf).sum(1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(1)[None, :]).astype(np.int64)
    out = np.zeros((len(x), len(c)), np.int64)
    for j in range(x.shape[1]):
        d = x[:, j, None] - c[None, :, j]
        out += d * d
    return out


def _search(x: np.ndarray, c: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All entries verified: (code, squared distance, near, low, outer)."""
    d = squared(x, c)
    code = d.argmin(1)  # the first of equal minima
    rows = np.arange(len(x))
    best = d[rows, code]
    d[rows, code] = np.iinfo(np.int64).max
    k = len(c)
    m = min(b, k - 1)
    near = np.repeat(code[:, None], b, 1)
    low = np.full((len(x), b), np.inf)
    outer = np.full(len(x), np.inf)
    if m:
        some = np.argpartition(d, min(m, k - 2), axis=1)[:, : m + 1] if k - 1 > m else np.argsort(d, axis=1)[:, : m]
        dist = np.take_along_axis(d, some, 1)
        order = np.argsort(dist, axis=1, kind="stable")
        some, dist = np.take_along_axis(some, order, 1), np.sqrt(np.take_along_axis(dist, order, 1).astype(np.float64)) * _DOWN
        near[:, :m], low[:, :m] = some[:, :m], dist[:, :m]
        if k - 1 > m:
            outer = dist[:, m]
    return code, best, near, low, outer


def assign(x: np.ndarray, books: np.ndarray, old: Bounds | None, drift: np.ndarray | None, b: int) -> tuple[Bounds, np.ndarray, np.ndarray]:
    """New bounds with lists of b, exact squared distances [m, P], and how many parts needed which list depth (0: the
    bounds held; the last: a full search)."""
    m, parts = x.shape[0], x.shape[1]
    out, dist = Bounds.empty(m, parts, b), np.zeros((m, parts), np.int64)
    had = old.near.shape[2] if old is not None else 0
    depth = np.zeros(MOST_B + 2, np.int64)
    for q in range(parts):
        c = books[q]
        todo = np.ones(m, bool)
        if old is not None:
            a, near = old.code[:, q].astype(np.int64), old.near[:, q].astype(np.int64)
            gap = x[:, q] - c[a]
            d = (gap * gap).sum(1)
            u = np.sqrt(d.astype(np.float64)) * _UP
            low = old.low[:, q].astype(np.float64) - drift[q][near]
            outer = old.outer[:, q].astype(np.float64) - drift[q].max()
            need = (low <= u[:, None]).sum(1)
            todo = u >= outer
            some = np.flatnonzero(~todo & (need > 0))
            depth[: had + 1] += np.bincount(need[~todo], minlength=had + 1)[: had + 1]
            if len(some):
                ids = np.concatenate([a[some, None], near[some]], 1)
                gap = x[some, q][:, None, :] - c[ids]
                e = (gap * gap).sum(2)
                e[:, 1:][np.isinf(low[some])] = np.iinfo(np.int64).max  # fillers of short lists
                order = np.lexsort((ids, e), axis=1)
                ids, e = np.take_along_axis(ids, order, 1), np.take_along_axis(e, order, 1)
                far = e == np.iinfo(np.int64).max
                a[some], d[some], near[some] = ids[:, 0], e[:, 0], ids[:, 1:]
                low[some] = np.where(far, np.inf, np.sqrt(e.astype(np.float64)) * _DOWN)[:, 1:]
            order = np.argsort(low, axis=1, kind="stable")
            near, low = np.take_along_axis(near, order, 1), np.take_along_axis(low, order, 1)
            if b < had:  # what leaves the list lies beyond its own bound
                outer = np.minimum(outer, low[:, b])
            w = min(b, had)
            out.near[:, q], out.low[:, q] = a[:, None], np.inf
            out.near[:, q, :w], out.low[:, q, :w] = near[:, :w], _floor32(low[:, :w])
            out.code[:, q], out.outer[:, q], dist[:, q] = a, _floor32(outer), d
        rows = np.flatnonzero(todo)
        depth[-1] += len(rows)
        for i in range(0, len(rows), BLOCK):
            r = rows[i : i + BLOCK]
            code, d, near, low, outer = _search(x[r, q], c, b)
            out.code[r, q], dist[r, q], out.near[r, q], out.low[r, q], out.outer[r, q] = code, d, near, _floor32(low), _floor32(outer)
    return out, dist, depth


def _matrix(col: pa.Array, width: int, kind) -> np.ndarray:
    return np.asarray(col.flatten()).astype(kind).reshape(len(col), width)


def _binary(raw: np.ndarray) -> pa.Array:
    m, w = raw.shape
    return pa.Array.from_buffers(pa.binary(), m, [None, pa.py_buffer(np.arange(0, (m + 1) * w, w, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def _round(books: np.ndarray, drift: np.ndarray | None, had: int, b: int, label: T.DataType) -> tuple[Callable, T.StructType]:
    """One pass: kind 0 rows are the new table, kind 1 rows the task's sums by entry, kind 2 rows its depth counts."""
    parts, entries, width = books.shape
    schema = T.StructType([
        T.StructField("kind", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("label", label),
        T.StructField("x", T.ArrayType(T.IntegerType())), T.StructField("state", T.BinaryType()), T.StructField("error", T.LongType()),
        T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType()),
        T.StructField("sums", T.ArrayType(T.LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts, entries, width), np.int64)
        count = np.zeros((parts, entries), np.int64)
        depth = np.zeros(MOST_B + 2, np.int64)
        of_label = None
        for batch in batches:
            of_label = batch.schema.field(1).type
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                m = part.num_rows
                x = _matrix(part.column(2), parts * width, np.int64).reshape(m, parts, width)
                old = None
                if drift is not None:
                    raw = b"".join(part.column(3).to_pylist())
                    old = Bounds.unpack(np.frombuffer(raw, np.uint8).reshape(m, -1), parts, had)
                new, dist, deep = assign(x, books, old, drift, b)
                depth += deep
                for q in range(parts):
                    np.add.at(sums[q], new.code[:, q], x[:, q])
                    count[q] += np.bincount(new.code[:, q], minlength=entries)
                gone = [pa.nulls(m, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), *part.columns[:3], _binary(new.pack()), pa.array(dist.sum(1)), *gone], names=schema.names)
        if of_label is None:
            return
        q, e = np.nonzero(count)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(q) + 1) * width, width, dtype=np.int32)), pa.array(sums[q, e].reshape(-1)))
        deep = np.flatnonzero(depth)
        for kind, p, at, n, values in ((1, q, e, count[q, e], lists), (2, deep * 0 - 1, deep, depth[deep], pa.nulls(len(deep), pa.list_(pa.int64())))):
            m = len(p)
            gone = [pa.nulls(m, t) for t in (pa.int64(), of_label, pa.list_(pa.int32()), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int32)), *gone, pa.array(p.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(n), values], names=schema.names)

    return run, schema


def next_b(b: int, depth: np.ndarray) -> int:
    """List length for the next round from this round's depth counts."""
    total, searched = int(depth.sum()), int(depth[-1])
    if searched > SEARCHED * total:
        return min(MOST_B, 2 * b)
    listed = np.cumsum(depth[1:-1])
    if searched >= SPARED * total or not listed[-1]:
        return b
    return int(min(b, max(LEAST_B, b // 2, 1 + np.searchsorted(listed, SERVED * listed[-1]))))


def _seeds(kept: DataFrame, parts: int, entries: int) -> np.ndarray:
    """[P, K, width]: the parts of the vectors of the smallest ids."""
    ids = kept.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(entries)
    rows = kept.join(F.broadcast(ids), "vec_id").groupBy("vec_id").agg(F.min("x").alias("x")).collect()  # `entries` rows at most
    x = np.array([r["x"] for r in sorted(rows, key=lambda r: r["vec_id"])], np.int64)
    return np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2))


@dataclass
class Codes:
    """frame: vec_id, label, code (bytes), error; books: the final codebooks [part, entry, component]; lists: b by round;
    depths: the depth counts by round."""

    frame: DataFrame
    books: np.ndarray
    lists: list[int]
    depths: list[np.ndarray]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, first_b: int = FIRST_B) -> Codes | None:
    """Codebooks and codes of all kept vectors; None if there are none (or no ids)."""
    if not 1 < entries <= 256:
        raise ValueError("a code is one byte")
    spark = vectors.sparkSession
    src = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(vec).cast("array<double>").alias("v"))
    kind = src.schema["label"].dataType
    ints = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", kind), T.StructField("x", T.ArrayType(T.IntegerType()))])
    at = shared_dir(spark, "vectors")
    src.mapInArrow(_prepare(scale, parts), ints).write.parquet(at)
    kept = spark.read.schema(ints).parquet(at)
    first = kept.where("vec_id is not null").orderBy("vec_id", "x").limit(1).collect()
    if not first:
        delete_dir(spark, at)
        return None
    kept = kept.where(F.size("x") == len(first[0]["x"]))
    books = _seeds(kept, parts, entries)
    drift, had, b = None, 0, first_b
    source, lists, depths = kept, [], []
    for r in range(rounds + 1):
        run, schema = _round(books, drift, had, b, kind)
        new = shared_dir(spark, "codes")
        source.mapInArrow(run, schema).write.partitionBy("kind").parquet(new)
        delete_dir(spark, at)
        at = new
        table = spark.read.schema(schema).parquet(new)
        depth = np.zeros(MOST_B + 2, np.int64)
        for row in table.where("kind = 2").groupBy("entry").agg(F.sum("n").alias("n")).collect():
            depth[row["entry"]] = row["n"]
        lists.append(b)
        depths.append(depth)
        source = table.where("kind = 0").select("vec_id", "label", "x", "state")
        if r < rounds:
            moved = books.copy()
            total = table.where("kind = 1").select("part", "entry", "n", F.posexplode("sums").alias("pos", "v"))
            for row in total.groupBy("part", "entry", "pos").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect():
                moved[row["part"], row["entry"], row["pos"]] = row["v"] // row["n"]
            gap = (moved - books).astype(np.float64)
            drift = np.sqrt((gap * gap).sum(2)) * _UP
            books, had = moved, b
            b = next_b(b, depth) if r else b
    frame = table.where("kind = 0").select("vec_id", "label", F.substring("state", 1, parts).alias("code"), "error")
    return Codes(frame, books, lists, depths)


def report(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """vec_id, code (hex), error, label_error and codebooks_sha256 of every kept vector."""
    got = compress(vectors)
    if got is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    by = got.frame.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    out = got.frame.join(by, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(got.sha256()).alias("codebooks_sha256"))
