"""Exact set-similarity joins (J4, J5, J6; SURVEY §4.3).

No pair enumeration within a scope: candidates come from an equi-join on the
tokens of each title's *prefix* (tokens ordered by ascending document frequency,
then text). If J(x, y) >= t the two prefixes of length |x| - ceil(t|x|) + 1 share
a token, so the join misses no pair; size and length bounds prune further in the
join condition, and every candidate is verified with the exact similarity.

For the hybrid near-duplicate similarity with threshold 0.8 and unequal keys,
0.6J + 0.4L > 0.8 with L < 1 forces J > 2/3, so t = (thr - 0.4) / 0.6.

Titles can be long (whole paragraphs), so every distinct (scope, title) becomes
a unit with a deterministic 128-bit hash as id; the units are written once, and
the token join and the pair dedup move only hashes; the titles, keys and token
sets are attached to the surviving candidates only. Where equal keys are not
wanted, the key's hash is part of the join condition, so a key that many titles
share yields no candidate among them.

A token that more than BLOCK_ROWS rows of a scope share is heavy: its rows are
dealt into blocks of about BLOCK_ROWS rows by a hash of the unit, and every pair
of blocks is joined once under a key of its own, so no task holds more than a
pair of blocks of one token. All other tokens join as they are.

Inside scopes of at most SCOPE_ROWS rows (crawls) no pair is shuffled at all: a
scope's titles are shuffled once, large ones dealt into blocks of GROUP_ROWS, and
each pair of blocks counts its shared tokens by a matrix product over the tokens'
incidence, in slices. Only larger scopes go by the prefix join.

History (J4, J6) meets its items in cells of a window-wide bucket of time
(history_cells): a cell counts the shared tokens of its items and sightings and
tests the open window (T - window, T) itself, so no token and no pair is shuffled.
session_buckets() and points_met() are the same point-in-interval test as an
equi-join, by presence sessions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

import headline_engine

from headline_engine.config import EngineConfig
from headline_engine.functions.similarity import (
    blended, edit_budget, edits, jaccard, length_ok, min_jaccard, position_ok, prefix_len, size_ok,
)
from headline_engine.functions.text import title_key, tokens
from headline_engine.operators.novelty import presence_sessions  # noqa: F401
from headline_engine.session import written

# Workers need no copy of this package on their path.
cloudpickle.register_pickle_by_value(headline_engine)

#: Rows of a scope up to which it is joined in groups, titles of a block of them, and tokens of a slice of their matrix.
SCOPE_ROWS, GROUP_ROWS, SLICE = 4096, 512, 4096
#: Most frequent tokens whose frequencies order the prefixes, and the 64-bit words of a title's token parities.
COMMON, SIGN_WORDS = 65_536, 4
SIGN = [f"s{i}" for i in range(SIGN_WORDS)]
#: Rows of one token in one scope beyond which it is dealt into blocks, and rows of a block (expected).
BLOCK_ROWS = 2000
#: Rows of a side of a cell in which items meet their history (expected), pairs of a token below a share of all that are listed,
#: and token rows listed at a time.
CELL_ROWS, RARE_SHARE, LISTED = 2048, 512, 65_536


def units(df: DataFrame, scope: list[str], cfg: EngineConfig, title: str = "title") -> DataFrame:
    """Distinct (scope..., title) with key, key hash `kid`, token set, sizes and a deterministic 128-bit `uid`."""
    u = df.select(*scope, title).distinct()
    k = title_key(title)
    ids = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in (*scope, title)]
    return (
        u.withColumn("title_key", k)
        .withColumn("kid", F.xxhash64("title_key"))
        .withColumn("toks", tokens(title, "title_key", cfg.token_mode))
        .withColumn("n_tok", F.size("toks"))
        .withColumn("key_len", F.length("title_key"))
        .withColumn("uid", F.unhex(F.md5(F.concat_ws("\x01", *ids).cast("binary"))))
    )


def token_order(u: DataFrame) -> DataFrame:
    """Document frequency of every token over the given units (one aggregate, combined map-side)."""
    return u.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("df"))


def _marked(common: np.ndarray, df: np.ndarray, keep: list[str]):
    """For mapInArrow: the prefix rows of units (keep..., th, _p). th: hashes of the distinct tokens; _p: prefix length."""

    def mark(batches):
        for batch in batches:
            th = batch.column("th")
            size, flat = np.asarray(th.value_lengths(), np.int64), np.asarray(th.flatten(), np.int64)
            row = np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
            # Tokens outside the table are rarer than those in it.
            order = np.lexsort((flat, np.where(common[at] == flat, df[at], 0), row))
            pos = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + 1
            here = pos <= np.asarray(batch.column("_p"), np.int64)[row]
            bit = np.uint64(1) << (flat & 63).astype(np.uint64)
            signs = []
            for word in range(SIGN_WORDS):
                sign = np.zeros(len(size), np.uint64)
                mine = ((flat >> 6) & (SIGN_WORDS - 1)) == word
                np.bitwise_xor.at(sign, row[mine], bit[mine])
                signs.append(pa.array(sign.view(np.int64)[row[here]]))
            row = pa.array(row[here])
            out = [batch.column(c).take(row) for c in keep] + signs + [pa.array(flat[order][here]), pa.array(pos[here].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, [*keep, *SIGN, "tok", "pos"])

    return mark


def prefixes(u: DataFrame, scope: list[str], t: float, order: DataFrame) -> DataFrame:
    """(scope..., uid, kid, n_tok, key_len, s0.., tok, pos) for the prefix tokens of every unit; tok is the token's hash.

    Any one order of the tokens makes the prefix filter right; a good one puts rare tokens first. The COMMON most frequent
    tokens are broadcast with their frequencies, all others count as rarer and go by their hash, so tokens are ranked where
    their title lies and no token is shuffled. s0..: parities of the tokens' hashes, for sign_ok().
    """
    freq = order.where("df > 1").select(F.xxhash64("tok").alias("h"), "df").orderBy(F.desc("df"), "h").limit(COMMON).toArrow()
    h, df = np.asarray(freq.column("h").combine_chunks(), np.int64), np.asarray(freq.column("df").combine_chunks(), np.int64)
    h, at = np.unique(np.append(h, np.int64(0)), return_index=True)
    keep = [*scope, "uid", "kid", "n_tok", "key_len"]
    ex = u.select(*keep, F.transform("toks", lambda x: F.xxhash64(x)).alias("th"), prefix_len("n_tok", t).alias("_p"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in ex.schema.fields if f.name in keep]
    return ex.mapInArrow(_marked(h, np.append(df, 0)[at], keep), ", ".join([*kinds, *[f"{s} long" for s in SIGN], "tok long", "pos int"]))


def sign_ok(t: float) -> F.Column:
    """Bound by the parities: each token that only one of two titles has flips one bit, so the differing bits are at most
    those tokens' number, and Jaccard > t allows (na + nb) - 2 t (na + nb) / (1 + t) of them. Loses no pair."""
    differ = sum((F.bit_count(F.col(f"{s}a").bitwiseXOR(F.col(f"{s}b"))) for s in SIGN), F.lit(0))
    n = F.col("na") + F.col("nb")
    return differ <= n - F.lit(2) * F.ceil(n.cast("double") * F.lit(t / (1.0 + t)) - F.lit(1e-9))


def heavy_keys(left: DataFrame, right: DataFrame, keys: list[str], self_join: bool, rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys..., blocks_a, blocks_b): the keys that more than `rows` rows of a side share, where both sides have them.
    Counts combine map-side, so a hot key costs a row a task."""
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_na"))
    if self_join:
        n = a.withColumn("_nb", F.col("_na"))
    else:
        n = a.join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nb")), keys)
    blocks = lambda c: F.ceil(F.col(c) / F.lit(rows)).cast("int")
    return n.where((F.col("_na") > rows) | (F.col("_nb") > rows)).select(*keys, blocks("_na").alias("blocks_a"), blocks("_nb").alias("blocks_b"))


def token_join(left: DataFrame, right: DataFrame, keys: list[str], cond, self_join: bool, rows: int = BLOCK_ROWS) -> DataFrame:
    """left (keys..., uid_a, ...) and right (keys..., uid_b, ...) with equal keys and `cond`; in a self join each unordered
    pair of different units comes once, in either order of the sides. Both sides should be written tables."""
    once = (F.col("uid_a") < F.col("uid_b")) if self_join else F.lit(True)
    heavy = written(heavy_keys(left, right, keys, self_join, rows))
    if heavy.isEmpty():
        return left.join(right, keys).where(cond & once)
    light = left.join(heavy.select(*keys), keys, "left_anti").join(right, keys).where(cond & once)
    block = lambda uid, n: F.pmod(F.xxhash64(uid), F.col(n)).cast("int")
    a = left.join(heavy, keys).withColumn("_i", block("uid_a", "blocks_a"))
    b = right.join(heavy, keys).withColumn("_j", block("uid_b", "blocks_b"))
    if self_join:  # blocks i <= j meet once; inside a block the ids order a pair
        a = a.withColumn("_j", F.explode(F.sequence("_i", F.col("blocks_b") - 1)))
        b = b.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_j"))))
        once = (F.col("_i") < F.col("_j")) | once
    else:
        a = a.withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("blocks_b") - 1)))
        b = b.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("blocks_a") - 1)))
    a, b = a.drop("blocks_a", "blocks_b"), b.drop("blocks_a", "blocks_b")
    return light.unionByName(a.join(b, [*keys, "_i", "_j"]).where(cond & once).drop("_i", "_j"))


def _side(p: DataFrame, keys: list[str], side: str, *extra: str) -> DataFrame:
    """Prefix rows as one side of a token join: uid, kid, n_tok, key_len and pos under names of their own."""
    names = {"uid": "uid_", "kid": "k", "n_tok": "n", "key_len": "l", "pos": "p"} | {s: s for s in SIGN}
    return p.select(*keys, *extra, *[F.col(c).alias(n + side) for c, n in names.items()])


def candidate_pairs(left: DataFrame, right: DataFrame, join_keys: list[str], t: float, cfg: EngineConfig,
                    self_join: bool, guard_length: bool = True, unequal_keys: bool = False, rows: int = BLOCK_ROWS) -> DataFrame:
    """Distinct (join_keys minus tok..., uid_a, uid_b) sharing a prefix token within the size/length bounds."""
    a, b = _side(left, join_keys, "a"), _side(right, join_keys, "b")
    cond = size_ok("na", "nb", t) & position_ok("pa", "na", "pb", "nb", t) & sign_ok(t)
    if guard_length:
        cond = cond & length_ok("la", "lb", cfg)
    if unequal_keys:
        cond = cond & (F.col("ka") != F.col("kb"))
    keep = [c for c in join_keys if c != "tok"]
    pairs = token_join(a, b, join_keys, cond, self_join, rows).select(*keep, "uid_a", "uid_b")
    if self_join:
        pairs = pairs.select(*keep, F.least("uid_a", "uid_b").alias("uid_a"), F.greatest("uid_a", "uid_b").alias("uid_b"))
    return pairs.distinct()


def attach(pairs: DataFrame, ua: DataFrame, ub: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Join both sides' titles onto candidate id pairs, and make their keys and tokens anew: only titles move, and where the
    (written) pairs are few Spark broadcasts them."""
    v = written(pairs)
    for side, u in (("a", ua), ("b", ub)):
        v = v.join(u.select(F.col("uid").alias(f"uid_{side}"), F.col("title").alias(f"title_{side}")), f"uid_{side}")
    return with_keys(v, cfg)


def with_keys(pairs: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Pairs (title_a, title_b) with both sides' key, its length and tokens."""
    for x in "ab":
        pairs = pairs.withColumn(f"key_{x}", title_key(f"title_{x}"))
        pairs = pairs.withColumn(f"tok_{x}", tokens(f"title_{x}", f"key_{x}", cfg.token_mode)).withColumn(f"l{x}", F.length(f"key_{x}"))
    return pairs


def _edit_distances(batches):
    """For mapInArrow: rows (..., key_a, key_b, most) with `dist`, the keys' edit distance, in place of these three."""
    for batch in batches:
        found = [edits(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("key_a", "key_b", "most")))]
        names = [c for c in batch.schema.names if c not in ("key_a", "key_b", "most")]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(found, pa.int32())], [*names, "dist"])


def with_sim(pairs: DataFrame, keep: list[str], cfg: EngineConfig) -> DataFrame:
    """(keep..., sim) of pairs of with_keys(): P18, exact above the threshold. Where one Jaccard cannot pass, no distance is made."""
    m, jac = F.greatest("la", "lb"), F.col("jac")
    v = pairs.select(*keep, "key_a", "key_b", m.cast("int").alias("m"), F.explode(F.array(jaccard("tok_a", "tok_b"))).alias("jac"))
    most = F.when((F.col("key_a") == F.col("key_b")) | (jac * cfg.blend_jaccard + F.lit(cfg.blend_levenshtein) < F.lit(cfg.near_dup_threshold)), F.lit(-1))
    v = v.select(*keep, "m", "jac", (F.col("key_a") == F.col("key_b")).alias("eq"), "key_a", "key_b", most.otherwise(edit_budget(jac, F.col("m"), cfg)).alias("most"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in v.schema.fields if f.name not in ("key_a", "key_b", "most"))
    v = v.mapInArrow(_edit_distances, f"{kinds}, dist int")
    return v.select(*keep, F.when(F.col("eq"), F.lit(1.0)).otherwise(blended(jac, F.col("dist"), F.col("m"), cfg)).alias("sim"))


def _ordered(df: DataFrame, scope: list[str], value: str) -> DataFrame:
    """Report pairs with title_a < title_b whatever the id order."""
    lo = F.least("title_a", "title_b")
    hi = F.greatest("title_a", "title_b")
    return df.select(*scope, lo.alias("title_a"), hi.alias("title_b"), value)


def shared_tokens(toks: pa.ListArray, na: int, nb: int) -> np.ndarray:
    """Shared tokens of each of the first `na` sets with each of the last `nb`."""
    size = np.asarray(toks.value_lengths(), np.int64)
    ids = np.asarray(toks.flatten().dictionary_encode().indices, np.int64)
    many = np.bincount(ids) > 1
    keep = many[ids]
    row, ids = np.repeat(np.arange(len(size)), size)[keep], (np.cumsum(many) - 1)[ids[keep]]
    order = np.argsort(ids, kind="stable")
    row, ids = row[order], ids[order]
    counts = np.zeros((na, nb), np.float32)
    for lo in range(0, int(many.sum()), SLICE):
        a, b = np.searchsorted(ids, (lo, lo + SLICE))
        x = np.zeros((len(size), SLICE), np.float32)
        x[row[a:b], ids[a:b] - lo] = 1
        counts += x[:na] @ x[len(size) - nb :].T
    return counts


def _block_pairs(scope: list[str], t: float):
    """For applyInArrow over (scope..., _i, _j): the pairs of a block pair with Jaccard > t, as title_a < title_b."""

    def pairs(table: pa.Table) -> pa.Table:
        same = table.column("_i")[0] == table.column("_j")[0]
        table = table.filter(pc.greater(pc.list_value_length(table.column("toks")), 0)).sort_by("_blk").combine_chunks()
        blk, toks, titles = np.asarray(table.column("_blk")), table.column("toks").chunk(0), table.column("title")
        na = nb = len(blk)
        if not same:
            na = int(np.searchsorted(blk, table.column("_i")[0].as_py(), "right"))
            nb = len(blk) - na
        size = np.asarray(toks.value_lengths(), np.float64)
        c = shared_tokens(toks, na, nb).astype(np.float64)
        j = c / (size[:na, None] + size[None, len(blk) - nb :] - c)
        a, b = np.nonzero(np.triu(j > t, 1) if same else j > t)
        j, b = j[a, b], b + len(blk) - nb
        place = np.empty(len(blk), np.int64)
        place[sorted(range(len(blk)), key=[x.encode() for x in titles.to_pylist()].__getitem__)] = np.arange(len(blk))
        first = place[a] < place[b]
        out = [table.column(s).take(pa.array(a)) for s in scope]
        out += [titles.take(pa.array(np.where(first, a, b))), titles.take(pa.array(np.where(first, b, a))), pa.array(j)]
        return pa.table(out, [*scope, "title_a", "title_b", "jaccard"])

    return pairs


def group_pairs(df: DataFrame, scope: list[str], t: float, cfg: EngineConfig) -> DataFrame:
    """(scope..., title_a < title_b, jaccard) with Jaccard > t, all pairs of each scope's titles met in groups."""
    u = df.select(*scope, "title").repartition(*scope).distinct()
    blocks = F.ceil(F.count(F.lit(1)).over(Window.partitionBy(*scope)) / F.lit(GROUP_ROWS)).cast("int")
    u = u.withColumn("_n", blocks).withColumn("_blk", F.pmod(F.xxhash64("title"), F.col("_n")).cast("int"))
    # A block meets itself and every other once; in scopes of one block nothing is copied.
    u = u.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    # The titles are sorted, and their tokens made behind the sort.
    u = u.select(*scope, F.least("_blk", "_k").alias("_i"), F.greatest("_blk", "_k").alias("_j"), "_blk", "title").sortWithinPartitions(*scope, "_i", "_j")
    u = u.withColumn("toks", tokens("title", title_key("title"), cfg.token_mode))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in u.schema.fields if f.name in scope)
    return u.groupBy(*scope, "_i", "_j").applyInArrow(_block_pairs(scope, t), f"{kinds}, title_a string, title_b string, jaccard double")


def by_scope_size(df: DataFrame, scope: list[str], sizes: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows of scopes of at most SCOPE_ROWS rows, the others); None where there are none. sizes (scope..., _n): the rows of
    each scope, where they can be had for less than by counting `df`."""
    df = df.dropna(subset=[*scope, "title"])  # a null scope meets no one
    if not scope:
        return None, df
    sizes = df.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n")) if sizes is None else sizes
    large = written(sizes.where(F.col("_n") > SCOPE_ROWS).drop("_n"))
    if large.isEmpty():
        return df, None
    return df.join(large, scope, "left_anti"), df.join(large, scope, "left_semi")


def near_dup_edges(df: DataFrame, scope: list[str], cfg: EngineConfig = EngineConfig(), sizes: DataFrame | None = None) -> DataFrame:
    """(scope..., title_a < title_b, sim) with unequal keys and hybrid similarity > threshold.

    Equal keys (similarity 1) are the exact duplicates handled by W2 and are
    not emitted, so a key shared by many titles never yields all its pairs.
    """
    t = min_jaccard(cfg)
    small, large = by_scope_size(df, scope, sizes)
    v = None
    if small is not None:
        v = with_keys(group_pairs(small, scope, t - 1e-9, cfg), cfg).where(length_ok("la", "lb", cfg)).drop("jaccard")
    if large is not None:
        u = written(units(large, scope, cfg).where(F.col("n_tok") > 0))
        p = written(prefixes(u, scope, t, written(token_order(u))))
        pairs = candidate_pairs(p, p, scope + ["tok"], t, cfg, self_join=True, unequal_keys=True)
        w = attach(pairs, u, u, cfg).drop("uid_a", "uid_b")
        v = w if v is None else v.unionByName(w)
    e = with_sim(v.where(F.col("key_a") != F.col("key_b")), [*scope, "title_a", "title_b"], cfg).where(F.col("sim") > F.lit(cfg.near_dup_threshold))
    return _ordered(e, scope, "sim")


def jaccard_pairs(df: DataFrame, scope: list[str], t: float, cfg: EngineConfig = EngineConfig(), sizes: DataFrame | None = None) -> DataFrame:
    """(scope..., title_a < title_b, jaccard) with Jaccard > t (tokens per cfg.token_mode)."""
    small, large = by_scope_size(df, scope, sizes)
    if large is None:
        return group_pairs(small, scope, t, cfg)
    e = _prefix_jaccard(large, scope, t, cfg)
    return e if small is None else e.unionByName(group_pairs(small, scope, t, cfg))


def _prefix_jaccard(df: DataFrame, scope: list[str], t: float, cfg: EngineConfig) -> DataFrame:
    u = written(units(df, scope, cfg).where(F.col("n_tok") > 0))
    p = written(prefixes(u, scope, t, written(token_order(u))))
    pairs = candidate_pairs(p, p, scope + ["tok"], t, cfg, self_join=True, guard_length=False)
    v = attach(pairs, u, u, cfg)
    e = v.withColumn("jaccard", jaccard("tok_a", "tok_b")).where(F.col("jaccard") > F.lit(t))
    return _ordered(e, scope, "jaccard")


def _micros(ts) -> F.Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def session_buckets(sessions: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Sessions (first_ts, last_ts, ...) with `level` and `bucket` added: at most two rows each. Level l holds the intervals
    (first_ts, last_ts + window) of at most 2^l windows; its buckets are that wide."""
    width = cfg.history_days * 86_400_000_000
    start = _micros("first_ts")
    end = _micros("last_ts") + F.lit(width)
    s = sessions.withColumn("level", F.ceil(F.log2((end - start) / F.lit(width)) - F.lit(1e-12)).cast("int"))
    step = F.lit(width) * F.pow(F.lit(2), F.col("level")).cast("bigint")
    return s.withColumn("bucket", F.explode(F.sequence(F.floor(start / step).cast("bigint"), F.floor((end - F.lit(1)) / step).cast("bigint"))))


def points_met(points: DataFrame, sessions: DataFrame, ts: str, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Token rows of points with the bucket of `ts` on the levels on which a session has the token (17 at most): a row of a
    token that no session has goes, and most others need few levels."""
    met = sessions.groupBy("tok").agg(F.collect_set("level").alias("_levels"))
    return _bucketed(points.join(met, "tok").withColumn("level", F.explode("_levels")).drop("_levels"), ts, cfg)


def _bucketed(p: DataFrame, ts: str, cfg: EngineConfig) -> DataFrame:
    width = cfg.history_days * 86_400_000_000
    return p.withColumn("bucket", F.floor(_micros(ts) / (F.lit(width) * F.pow(F.lit(2), F.col("level")).cast("bigint"))).cast("bigint"))


def shared_between(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """Shared tokens of each set of `a` with each of `b`: pairs of rare tokens are listed, the others counted by matrix products."""
    na, nb = len(a), len(b)
    ids = np.asarray(pa.chunked_array([a.flatten(), b.flatten()]).combine_chunks().dictionary_encode().indices, np.int64)
    sides = []
    for toks, mine in ((a, ids[: len(a.flatten())]), (b, ids[len(a.flatten()) :])):
        row = np.repeat(np.arange(len(toks)), np.asarray(toks.value_lengths(), np.int64))
        order = np.argsort(mine, kind="stable")
        sides.append((row[order], mine[order], np.bincount(mine, minlength=int(ids.max(initial=-1)) + 1)))
    (ra, ta, ca), (rb, tb, cb) = sides
    counts = np.zeros((na, nb), np.float32)
    rare = ca * cb <= na * nb // RARE_SHARE
    begin = np.cumsum(cb) - cb
    own = np.flatnonzero(rare[ta] & (cb[ta] > 0))
    for lo in range(0, len(own), LISTED):
        at = own[lo : lo + LISTED]
        n = cb[ta[at]]
        with_b = rb[np.repeat(begin[ta[at]] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        counts += np.bincount(np.repeat(ra[at], n) * nb + with_b, minlength=na * nb).reshape(na, nb)
    dense = ~rare & (ca > 0) & (cb > 0)
    place = np.cumsum(dense) - 1
    ka, kb = dense[ta], dense[tb]
    ra, ta, rb, tb = ra[ka], place[ta[ka]], rb[kb], place[tb[kb]]
    for lo in range(0, int(dense.sum()), SLICE):
        x, y = np.zeros((na, SLICE), np.float32), np.zeros((nb, SLICE), np.float32)
        for m, row, tok in ((x, ra, ta), (y, rb, tb)):
            i, j = np.searchsorted(tok, (lo, lo + SLICE))
            m[row[i:j], tok[i:j] - lo] = 1
        counts += x @ y.T
    return counts


def _titles_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(row of each distinct title, number of each row's title)."""
    codes = np.asarray(table.column("title").combine_chunks().dictionary_encode().indices, np.int64)
    _, first, number = np.unique(codes, return_index=True, return_inverse=True)
    return first, number


def cell_hits(items: pa.Table, past: pa.Table, t: float, cfg: EngineConfig, equal_keys: bool = False):
    """Of a cell: (rows of the items of a crawl, their hits (row, number of a distinct history title) with Jaccard > t - or of
    equal keys - that are live at the crawl, live sightings) a crawl; and the first row and the number of the history titles."""
    items, past = items.combine_chunks(), past.combine_chunks()
    fa, xa = _titles_of(items)
    fb, xb = _titles_of(past)
    a, b = items.column("toks").chunk(0).take(pa.array(fa)), past.column("toks").chunk(0).take(pa.array(fb))
    c = shared_between(a, b).astype(np.float64)
    union = np.asarray(a.value_lengths(), np.float64)[:, None] + np.asarray(b.value_lengths(), np.float64)[None, :] - c
    hit = (c > 0) & (c / np.maximum(union, 1) > t)
    if equal_keys:
        kid = lambda table, first: np.asarray(table.column("kid").chunk(0), np.int64)[first]
        hit |= kid(items, fa)[:, None] == kid(past, fb)[None, :]
    us, seen = np.asarray(items.column("us").chunk(0), np.int64), np.asarray(past.column("us").chunk(0), np.int64)
    crawl = np.asarray(items.column("crawl_id").chunk(0).dictionary_encode(null_encoding="encode").indices, np.int64)
    by = np.lexsort((us, crawl))
    cuts = np.flatnonzero((np.diff(crawl[by]) != 0) | (np.diff(us[by]) != 0)) + 1

    def crawls():
        for rows in np.split(by, cuts):
            at = us[rows[0]]
            sightings = np.flatnonzero((seen < at) & (seen > at - cfg.history_days * 86_400_000_000))
            live = np.zeros(len(fb), bool)
            live[xb[sightings]] = True
            yield rows, hit[xa[rows]] & live, sightings

    return crawls(), fb, xb


def history_cells(items: DataFrame, history: DataFrame, cfg: EngineConfig, place: tuple = ()):
    """(items, history) grouped for a cogroup: every item meets every sighting of the window before its crawl.

    A sighting is live for crawls of its own window-wide bucket of time and of the next one, so it lies in two buckets and an
    item in one. Titles are shuffled once, tokens made behind the shuffle. A bucket with more than CELL_ROWS rows of a side is
    dealt into blocks by a hash of the title, and each item block meets each history block in a cell of its own. Items are
    (crawl_id, crawl_ts, title), history (crawl_ts, title, place...); rows without a time or title meet no one.
    """
    week = F.floor(F.col("us") / F.lit(cfg.history_days * 86_400_000_000)).cast("bigint")
    a = items.select("crawl_id", _micros("crawl_ts").alias("us"), "title").dropna(subset=["us", "title"]).withColumn("wk", week)
    # Names of its own: items and history may come from one frame.
    b = history.select(_micros("crawl_ts").alias("us"), *[F.col(c).alias(c) for c in ("title", *place)]).dropna(subset=["us", "title"])
    b = b.withColumn("wk", F.explode(F.array(week, week + 1)))
    sizes = [written(x.groupBy("wk").agg(F.ceil(F.count(F.lit(1)) / F.lit(CELL_ROWS)).cast("int").alias("n"))) for x in (a, b)]
    blocks = [n.select("wk", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias(uid)) for n, uid in zip(sizes, ("uid_a", "uid_b"))]
    cells = written(token_join(*blocks, ["wk"], F.lit(True), False).select("wk", "uid_a", "uid_b"))
    sides = []
    for x, n, uid in ((a, sizes[0], "uid_a"), (b, sizes[1], "uid_b")):
        x = x.join(n, "wk").withColumn(uid, F.pmod(F.xxhash64("title"), F.col("n")).cast("int")).drop("n").join(cells, ["wk", uid])
        x = x.repartition("wk", "uid_a", "uid_b")
        k = title_key("title")
        sides.append(x.withColumn("toks", tokens("title", k, cfg.token_mode)).withColumn("kid", F.xxhash64(k)).groupBy("wk", "uid_a", "uid_b"))
    return sides


def _live_pairs(t: float, cfg: EngineConfig):
    """For a cogroup's applyInArrow: (crawl_id, title, title_b) of the items and live history titles with Jaccard > t or equal keys."""

    def pairs(items: pa.Table, past: pa.Table) -> pa.Table:
        rows, titles = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(items) and len(past):
            crawls, first, _ = cell_hits(items, past, t, cfg, equal_keys=True)
            for mine, hits, _ in crawls:
                r, y = np.nonzero(hits)
                rows.append(mine[r])
                titles.append(first[y])
        at = pa.array(np.concatenate(rows))
        return pa.table([items.column("crawl_id").take(at), items.column("title").take(at), past.column("title").take(pa.array(np.concatenate(titles)))],
                        ["crawl_id", "title_a", "title_b"])

    return pairs


def near_dup_vs_history(items: DataFrame, history: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Items (crawl_id, crawl_ts, title, ...) with `hist_dup` = some history title
    seen in (crawl_ts - window, crawl_ts) has hybrid similarity > threshold.
    """
    a, b = history_cells(items, history, cfg)
    kind = items.schema["crawl_id"].dataType.simpleString()
    met = a.cogroup(b).applyInArrow(_live_pairs(min_jaccard(cfg) - 1e-9, cfg), f"crawl_id {kind}, title_a string, title_b string")
    v = with_keys(met, cfg).where((F.col("key_a") == F.col("key_b")) | length_ok("la", "lb", cfg))
    dups = with_sim(v, ["crawl_id", "title_a"], cfg).where(F.col("sim") > F.lit(cfg.near_dup_threshold)).select("crawl_id", F.col("title_a").alias("title")).distinct()
    return items.join(dups.withColumn("hist_dup", F.lit(True)), ["crawl_id", "title"], "left").withColumn("hist_dup", F.coalesce("hist_dup", F.lit(False)))
