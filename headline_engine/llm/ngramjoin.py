"""N-gram Jaccard join with Bayesian candidate pruning.

Documents with the same words are one class, stood for by its smallest document. Classes are joined on the Jaccard
similarity of their word 5-gram sets:

1. Each class gets HASHES MinHash values, cut into BANDS bands. Classes that share a band bucket are candidates; the
   chance that a pair of similarity 0.8 shares none is (1 - 0.8^4)^32, below 5e-8.
2. Bucket rows are small (band, hash, document). Buckets with one member end there; buckets with the same members are
   one bucket. A bucket is dealt in blocks of BLOCK members, so a hot bucket becomes many block pairs and never one task.
3. A block pair compares MinHash values STEP at a time: with m of n equal values the posterior probability (uniform
   prior) that the similarity reaches the threshold is 1 - I_t(m + 1, n - m + 1); pairs below TOLERANCE are dropped.
   A pair is handled in the first band it shares and nowhere else, so nothing is counted twice.
4. What is left is verified on the exact 5-gram sets in the same task. A block pair returns one row per member: the
   number of its verified links and a link into its component in the block. Pairs are never emitted.

Groups are the connected components of the links, by smallest-label propagation with pointer jumping over the (linear
number of) component links, checkpointed each round.

Words: ASCII letters and digits and all non-ASCII characters, A-Z lower-cased; 1 to 4 words are one gram. Defined cases:
null and word-less texts are one class without links; repeated ids with different texts are different documents; a null
doc_id is the smallest; an empty table gives no row. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headline_engine.llm.common import (
    BASE,
    BASE2,
    ALNUM_WORDS,
    chunks,
    durable,
    keyed,
    mix64,
    ngram_spans,
    NULL_ID,
    real_id,
    signed,
    SpanHash,
    text_buffer,
    Words,
    words_of,
)

THRESHOLD = 0.8
SHINGLE = 5
HASHES, BANDS = 128, 32
ROWS = HASHES // BANDS
BLOCK = 512
STEP = 16
TOLERANCE = 1e-7

_CLASSES = "_id long, _th long, cls1 long, cls2 long, keys array<long>"
_MEMBERS = "key long, bi int, bj int, band int, side int, _id long, _th long, sig binary, grams binary"
_FOUND = "_id long, _th long, links long, root_id long, root_th long"


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For n = STEP, 2 STEP, ... HASHES compared values, the least equal values that keep a pair."""
    out = []
    s = (np.arange(200_000) + 0.5) / 200_000
    for n in range(STEP, HASHES + 1, STEP):
        m = np.arange(n + 1)
        logs = m[:, None] * np.log(s[None, ::50]) + (n - m)[:, None] * np.log1p(-s[None, ::50])
        w = np.exp(logs - logs.max(1, keepdims=True))
        tail = w[:, s[::50] >= threshold].sum(1) / w.sum(1)
        out.append(int(np.flatnonzero(tail >= tolerance)[0]))
    return out


def _seeds() -> np.ndarray:
    return mix64(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def gram_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, Words]:
    """(hashes of the word 5-grams in text order, offsets by text, words)."""
    w = words_of(data, offsets, ALNUM_WORDS, lower=True)
    s, e, of = ngram_spans(w.doc, SHINGLE)
    return SpanHash(w.hashes())(s, e), np.searchsorted(of, np.arange(len(offsets))), w


def signatures(h: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """[text, HASHES] 32-bit MinHash values; all ones for a text without grams."""
    sig = np.full((len(cut) - 1, HASHES), 0xFFFFFFFF, np.uint32)
    filled = np.flatnonzero(np.diff(cut))
    if len(filled):
        at = cut[:-1][filled]
        with np.errstate(over="ignore"):
            for j, a in enumerate(_seeds()):
                x = ((h * a) >> np.uint64(32)).astype(np.uint32)
                sig[filled, j] = np.minimum.reduceat(x, at)
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """[text, BANDS] 64-bit hash of each band's values, the band number mixed in."""
    x = sig.astype(np.uint64).reshape(len(sig), BANDS, ROWS)
    with np.errstate(over="ignore"):
        k = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), x.shape[:2]).copy()
        for r in range(ROWS):
            k = mix64((k + np.uint64(0x9E3779B97F4A7C15)) ^ (x[:, :, r] * np.uint64(0xD1342543DE82EF95)))
    return k


def _classes(docs: DataFrame) -> DataFrame:
    """(_id, _th, cls1, cls2, keys): word-sequence class (128 bits) and band keys; no keys without grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                h, cut, w = gram_hashes(*text_buffer(part.column("text")))
                keys = band_keys(signatures(h, cut)).view(np.int64)
                n = np.diff(cut)
                cls = []
                for base in (BASE, BASE2):
                    cls.append(signed(SpanHash(w.hashes(base), base)(w.doc[:-1], w.doc[1:])))
                offs = np.append(0, np.cumsum(np.where(n > 0, BANDS, 0))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offs), pa.array(keys[n > 0].ravel()))
                yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_th"), *cls, lists], ["_id", "_th", "cls1", "cls2", "keys"])

    return docs.mapInArrow(run, _CLASSES)


class _Side:
    def __init__(self, rows: list[tuple]) -> None:
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.node = [(r[0], r[1]) for r in rows]
        self.sig = np.stack([np.frombuffer(r[2], "<u4") for r in rows])
        self.grams = [np.frombuffer(r[3], "<u8") for r in rows]


def pairs_of(a: _Side, b: _Side, band: int, same: bool, threshold: float, least: list[int]) -> Iterator[tuple[int, int]]:
    """Verified pairs (index in a, index in b) whose first shared band is `band`."""
    # Gram sets as small integers of this block.
    sets_b = b.grams
    every = np.unique(np.concatenate([*a.grams, *sets_b]))
    ids_a = [np.searchsorted(every, g) for g in a.grams]
    ids_b = ids_a if same else [np.searchsorted(every, g) for g in sets_b]
    mark = np.zeros(len(every), bool)
    bands_b = b.sig.reshape(len(b.sig), BANDS, ROWS)
    for i in range(len(a.sig)):
        js = np.arange(i + 1 if same else 0, len(b.sig))
        if not len(js):
            continue
        equal = np.zeros(len(js), np.int64)
        for step, need in enumerate(least):
            at = slice(step * STEP, (step + 1) * STEP)
            equal += (a.sig[i, at] == b.sig[js, at]).sum(1)
            ok = equal >= need
            js, equal = js[ok], equal[ok]
        if not len(js):
            continue
        shared = (bands_b[js] == a.sig[i].reshape(BANDS, ROWS)).all(2)
        js = js[shared.argmax(1) == band]
        mark[ids_a[i]] = True
        na = len(ids_a[i])
        for j in js.tolist():
            both = int(mark[ids_b[j]].sum())
            if both >= threshold * (na + len(ids_b[j]) - both) - 1e-9:
                yield i, j
        mark[ids_a[i]] = False


def _components(n: int, pairs: list[tuple[int, int]]) -> list[int]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs:
        x, y = find(i), find(j)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [find(x) for x in range(n)]


def _block_links(threshold: float, least: list[int]):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(set(zip(*(table.column(c).to_pylist() for c in ("_id", "_th", "sig", "grams", "side")))), key=lambda r: r[:2])
        left = _Side([r for r in rows if r[4] == 0])
        same = table.column("bi")[0].as_py() == table.column("bj")[0].as_py()
        rest = [r for r in rows if r[4] == 1]
        right = left if same or not rest else _Side(rest)
        links: dict[tuple, int] = {}
        nodes = left.node if right is left else left.node + right.node
        shift = 0 if right is left else len(left.node)
        found = list(pairs_of(left, right, table.column("band")[0].as_py(), right is left, threshold, least)) if same or rest and left.node else []
        found = [(i, j + shift) for i, j in found]
        for i, j in found:
            links[i] = links.get(i, 0) + 1
            links[j] = links.get(j, 0) + 1
        order = sorted(range(len(nodes)), key=lambda i: nodes[i])
        place = {i: k for k, i in enumerate(order)}
        root = _components(len(nodes), [(place[i], place[j]) for i, j in found])
        out = [(*nodes[i], n, *nodes[order[root[place[i]]]]) for i, n in links.items()]
        cols = list(zip(*out)) if out else [[]] * 5
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["_id", "_th", "links", "root_id", "root_th"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's connected component, for edges (a, b) in any direction.

    Each round takes the smallest label around a node and then its label's label, so that chains shorten by half; rounds
    end when no label moves. Only the number of moved labels reaches the driver.
    """
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = durable(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        step = labels.join(near.select(F.col("a").alias("node"), "m"), "node").select("node", F.col("label").alias("was"), F.least("label", "m").alias("label"))
        step = durable(step)
        up = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = durable(step.join(up, "label", "left").select("node", "was", F.least("label", F.coalesce("up", "label")).alias("label")))
        if new.where("label <> was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def near_duplicates(documents: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(_id, _th, rep, n_same_text, n_links, group), one row per input row.

    rep: smallest (id, text hash) with the same words; n_links: other texts with a similarity of at least the threshold;
    group: smallest (id, text hash) of the texts that are linked, directly or through others.
    """
    docs = keyed(documents)
    parts = durable(_classes(docs))
    classes = durable(parts.groupBy("cls1", "cls2").agg(F.min(F.struct("_id", "_th")).alias("rep"), F.count(F.lit(1)).alias("n_same_text")))

    rows = parts.select(F.posexplode("keys").alias("band", "key"), "cls1", "cls2")
    shared = rows.groupBy("key").agg(F.min("cls1").alias("lo"), F.max("cls1").alias("hi")).where("lo <> hi").select("key")
    rows = durable(rows.join(shared, "key").select("band", "key", "cls1", "cls2").distinct())
    sets = rows.groupBy("key").agg(F.min("band").alias("band"), F.count(F.lit(1)).alias("n"), F.bit_xor("cls1").alias("x"), F.bit_xor(F.xxhash64("cls1", "cls2")).alias("y"))
    one = sets.groupBy("n", "x", "y").agg(F.min(F.struct("band", "key")).alias("first")).select("first.key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    members = rows.join(one, "key").withColumn("sub", F.pmod(F.xxhash64("cls1", "cls2"), F.col("blocks")).cast("int"))
    members = members.select("key", "band", "cls1", "cls2", "sub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    members = members.select("cls1", "cls2", F.struct(
        "key", F.least("sub", "other").alias("bi"), F.greatest("sub", "other").alias("bj"), "band", (F.col("sub") > F.col("other")).cast("int").alias("side")).alias("m"))
    members = members.join(classes, ["cls1", "cls2"]).groupBy(F.col("rep._id").alias("_id"), F.col("rep._th").alias("_th")).agg(F.collect_list("m").alias("m"))

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                h, cut, _ = gram_hashes(*text_buffer(part.column("text")))
                sig = signatures(h, cut)
                at = part.column("m")
                of = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(at.offsets)))
                flat = at.flatten()
                sigs = [x.tobytes() for x in sig]
                grams = [np.unique(h[cut[i] : cut[i + 1]]).tobytes() for i in range(part.num_rows)]
                for a in range(0, len(of), 4096):  # a document's sets are repeated for each of its blocks
                    sub = of[a : a + 4096]
                    take = pa.array(sub)
                    f = flat.slice(a, len(sub))
                    yield pa.RecordBatch.from_arrays(
                        [*(f.field(x) for x in ("key", "bi", "bj", "band", "side")), part.column("_id").take(take), part.column("_th").take(take),
                         pa.array([sigs[i] for i in sub], pa.binary()), pa.array([grams[i] for i in sub], pa.binary())],
                        ["key", "bi", "bj", "band", "side", "_id", "_th", "sig", "grams"])

    blocks = docs.join(members, ["_id", "_th"]).select("_id", "_th", "text", "m").mapInArrow(profile, _MEMBERS)
    found = durable(blocks.groupBy("key", "bi", "bj").applyInArrow(_block_links(threshold, least_matches(threshold, tolerance)), _FOUND))
    links = found.groupBy(F.struct("_id", "_th").alias("rep")).agg(F.sum("links").alias("n_links"))
    node = lambda i, t: F.struct(F.col(i).alias("_id"), F.col(t).alias("_th"))
    labels = components(found.select(node("_id", "_th").alias("a"), node("root_id", "root_th").alias("b")))

    classes = classes.join(links, "rep", "left").join(labels.select(F.col("node").alias("rep"), "label"), "rep", "left")
    classes = classes.select("cls1", "cls2", "rep", "n_same_text", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("label", "rep").alias("group"))
    return parts.select("_id", "_th", "cls1", "cls2").join(classes, ["cls1", "cls2"]).select("_id", "_th", "rep", "n_same_text", "n_links", "group")


def report(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links, same_text_id, n_same_text), one row per document. class_id: the smallest doc_id of its
    group; n_links: different texts it is linked with; same_text_id: the smallest doc_id with the same words."""
    id_of = lambda c: F.when(F.col(c)["_id"] != F.lit(NULL_ID), F.col(c)["_id"])
    return near_duplicates(documents, threshold).select(
        real_id().alias("doc_id"), id_of("group").alias("class_id"), "n_links", id_of("rep").alias("same_text_id"), "n_same_text")


def keep_first(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents' columns for one row of each group: its smallest (doc_id, text hash), once if the row is repeated."""
    found = near_duplicates(documents, threshold)
    first = found.where(F.struct("_id", "_th") == F.col("group")).select("_id", "_th").distinct()
    rows = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("_row"),
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("_id"), F.xxhash64("text").alias("_th"))
    return rows.join(first, ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"]).select("_row.*")
