"""Conversation prefix trie (11): nodes of shared turn prefixes, and subtree totals by centroid decomposition.

**Turns.** Rows are ordered by (conv_id, turn, role, text) with a range partitioning that may cut a long conversation; a
row's place is its offset in its part plus the rows of the conversation's earlier parts. A rebuilt conversation takes its
first turns from its donor and goes on with its own (`rebuilt`).

**Nodes.** A prefix is known by two 64-bit words: the exclusive or over its turns of a hash of (turn digest, place), so
prefixes of any length come from a running exclusive or that is blocked and needs no turn of a conversation in one task
beyond a block. A node's members, smallest member and so on are plain aggregates.

**Subtree totals.** Each node carries w, the summed lengths of its members' remainders, which is the weight of its subtree
when a node weighs its number of members: known from the aggregation, without a rollup. A round splits every component
of more than SMALL nodes at its centroid c, the deepest node that holds more than half of the component's weight. The
nodes with more than half are exactly the path from c to the component's top; c's total within the component is added
along that path, and its weight taken off above c. The subtrees of c's children and what is left above become
components with at most half the weight, so the rounds grow with the logarithm of the number of turns, whatever the
depth. To which child of c a node belongs is looked up in the membership table: the node's smallest member at c's depth
+ 1. Components of at most SMALL nodes are added up in one task each, many components a task, level by level.

Tables between rounds are written to the shared folder and deleted once replaced.

Defined cases: rows without conv_id belong to no conversation and are left out; equal turn numbers are ordered by role, then
by the text's md5, nulls first; null role or text is empty; repeated rows are repeated turns; c % 20 takes the sign of c; an
empty table gives no nodes, not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headline_engine.llm.common import delete_dir, saved

#: Nodes of a component that one task adds up at once.
SMALL = 1024
#: Turns of one conversation in a block of the running exclusive or.
BLOCK = 1024
#: Conversations that share a donor, and turns that it gives at most (exclusive).
FAMILY, GIVES = 20, 4
WORDS = r"[^\x20\x09-\x0D]+"

_KEY = "struct<a:bigint,b:bigint>"


def _root() -> Column:
    return F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, mid, digest, words): a row per turn; mid grows with the order and its upper bits name the row's part."""
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    t = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), role_.alias("role"), F.md5(text_).alias("tm"),
        F.unhex(F.md5(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_))).alias("digest"),
        F.regexp_count(text_, F.lit(WORDS)).cast("bigint").alias("words"))
    t, _ = saved(t)  # the range partitioning reads its input twice: once for the bounds
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "tm"]
    return t.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.monotonically_increasing_id().alias("mid"), "digest", "words")


def rebuilt(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From turns(): (rows, conversations). rows (conv_id, d, digest, words, len) hold the d-th turn of each rebuilt
    conversation; conversations (conv_id, len) holds all of them, turnless ones too."""
    part = F.shiftright("mid", 33)
    blocks = t.groupBy("conv_id", part.alias("part")).agg(F.min("mid").alias("m0"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0)))
    size = blocks.groupBy("conv_id").agg(F.sum("n").alias("n"))
    donor = F.col("conv_id") - F.col("conv_id") % FAMILY
    h = (F.crc32(F.col("conv_id").cast("string")) % GIVES).cast("bigint")
    gives = size.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("donor"), F.col("n").alias("has"))
    info = size.withColumn("donor", donor).withColumn("h", h).join(gives, "donor", "left").select(
        "conv_id", "donor", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("k"), "n")
    info = info.withColumn("len", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    placed = t.withColumn("part", part).join(blocks.join(info.drop("n", "donor"), "conv_id").drop("n"), ["conv_id", "part"])
    placed = placed.withColumn("pos", F.col("mid") - F.col("m0") + F.col("off") + 1)
    own = placed.where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("d"), "digest", "words", "len")
    heads = placed.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < GIVES)).select(
        F.col("conv_id").alias("donor"), F.col("pos").alias("d"), "digest", "words")
    given = heads.join(info.select("conv_id", "donor", "k", "len"), "donor").where("d <= k").select("conv_id", "d", "digest", "words", "len")
    return own.unionByName(given), info.select("conv_id", "len")


def members(rows: DataFrame) -> DataFrame:
    """(conv_id, d, len, words, node, parent): the prefix of each rebuilt conversation at each depth from 1."""
    x = [F.xxhash64("digest", "d"), F.xxhash64(F.lit("second"), "d", "digest")]
    r = rows.withColumn("a", x[0]).withColumn("b", x[1]).withColumn("blk", F.floor((F.col("d") - 1) / BLOCK))
    w = Window.partitionBy("conv_id", "blk").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("ra", F.bit_xor("a").over(w)).withColumn("rb", F.bit_xor("b").over(w))
    # What comes before a block; only conversations of more than a block have such rows.
    total = r.where(F.col("len") > BLOCK).groupBy("conv_id", "blk").agg(F.bit_xor("a").alias("ta"), F.bit_xor("b").alias("tb"))
    ahead = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("conv_id", "blk", F.bit_xor("ta").over(ahead).alias("ta"), F.bit_xor("tb").over(ahead).alias("tb")).where("blk > 0")
    r = r.join(total, ["conv_id", "blk"], "left")
    node = [F.col(f"r{c}").bitwiseXOR(F.coalesce(f"t{c}", F.lit(0))) for c in "ab"]
    r = r.withColumn("na", node[0]).withColumn("nb", node[1])
    return r.select("conv_id", "d", "len", "words", F.struct(F.col("na").alias("a"), F.col("nb").alias("b")).alias("node"),
                    F.struct(F.col("na").bitwiseXOR(F.col("a")).alias("a"), F.col("nb").bitwiseXOR(F.col("b")).alias("b")).alias("parent"))


def nodes(m: DataFrame, convs: DataFrame) -> DataFrame:
    """(node, parent, conv_id, depth, n_convs, words, w): every node, the root included."""
    rest = (F.col("len") - F.col("d") + 1)
    below = m.groupBy("node").agg(F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min("d").alias("depth"),
                                  F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.sum(rest).alias("w"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("len") + 1).alias("w")).where("n_convs > 0")
    return below.unionByName(root.select(_root().alias("node"), F.lit(None).cast(_KEY).alias("parent"), "conv_id",
                                         F.lit(0).cast("bigint").alias("depth"), "n_convs", F.lit(0).cast("bigint").alias("words"), "w"))


def _split(forest: DataFrame, big: DataFrame, m: DataFrame) -> tuple[DataFrame, str]:
    """One round: every component in `big` (comp, tot) is split at its centroid; nodes that need nothing more have a null
    comp."""
    f = forest.join(big, "comp")
    c = f.where("2 * w > tot").groupBy("comp").agg(F.max_by(F.struct("node", "depth", "w"), "depth").alias("c"))
    f = f.join(c, "comp")
    # The child of the centroid over a deeper node lies on the path of the node's smallest member.
    at = m.select(F.col("conv_id"), (F.col("d") - 1).alias("c_depth"), F.col("node").alias("u"), F.col("parent").alias("over"))
    f = f.withColumn("c_depth", F.when(F.col("depth") > F.col("c.depth"), F.col("c.depth"))).join(at, ["conv_id", "c_depth"], "left")
    f = f.withColumn("u", F.when(F.col("over") == F.col("c.node"), F.col("u"))).drop("over", "c_depth")
    is_c, on_path = F.col("node") == F.col("c.node"), F.col("twice") > F.col("tot")
    f, path = saved(f.withColumn("twice", 2 * F.col("w")))
    inside = f.where(is_c | F.col("u").isNotNull()).groupBy("comp").agg(F.sum("leaf").alias("t_leaves"), F.sum("saving").alias("t_saved"))
    f = f.join(inside, "comp")
    f = f.withColumn("n_leaves", F.col("n_leaves") + F.when(on_path, F.col("t_leaves")).otherwise(0)).withColumn(
        "saved_tokens", F.col("saved_tokens") + F.when(on_path, F.col("t_saved")).otherwise(0))
    f = f.withColumn("comp", F.when(~is_c, F.coalesce("u", "comp"))).withColumn("w", F.col("w") - F.when(on_path & ~is_c, F.col("c.w")).otherwise(0))
    out = saved(f.select(*forest.columns))
    delete_dir(forest.sparkSession, path)
    return out


def _add_up(columns: list[str]):
    """Subtree totals of whole small components, which come one after another (sorted by comp)."""

    def totals(t: pa.Table) -> pa.Table:
        key = np.empty(t.num_rows, [("a", np.int64), ("b", np.int64)])
        over = np.empty(t.num_rows, key.dtype)
        for x, name in ((key, "node"), (over, "parent")):
            col = t[name].combine_chunks()
            for f, part in zip("ab", col.flatten()):
                x[f] = part.fill_null(0).to_numpy(zero_copy_only=False)
        order = np.argsort(key, order=("a", "b"))
        sorted_ = key[order]
        up = order[np.minimum(np.searchsorted(sorted_, over), len(order) - 1)]
        comp = t["comp"].combine_chunks().flatten()
        same = (key[up] == over) & (up != np.arange(len(up)))
        for part in comp:  # a component's top has its parent in another one, or none
            v = part.to_numpy(zero_copy_only=False)
            same &= v[up] == v
        same &= t["parent"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        depth = t["depth"].to_numpy()
        sums = [t[c].to_numpy().copy() for c in ("leaf", "saving")]
        by_depth = np.argsort(-depth, kind="stable")
        cut = np.flatnonzero(np.diff(depth[by_depth])) + 1
        for level in np.split(by_depth, cut):
            level = level[same[level]]
            for s in sums:
                np.add.at(s, up[level], s[level])
        for name, s in zip(("n_leaves", "saved_tokens"), sums):
            t = t.set_column(t.column_names.index(name), name, pa.array(t[name].to_numpy() + s))
        return t.select(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if kept is None else pa.concat_tables([kept, t])
            a, b = (x.to_numpy(zero_copy_only=False) for x in t["comp"].combine_chunks().flatten())
            changes = np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1]))
            done = int(changes[-1]) + 1 if len(changes) else 0
            if done:
                yield from totals(t.slice(0, done).combine_chunks()).to_batches()
            kept = t.slice(done)
        if kept is not None and kept.num_rows:
            yield from totals(kept.combine_chunks()).to_batches()

    return run


def rollup(n: DataFrame, m: DataFrame, small: int = SMALL) -> tuple[DataFrame, int]:
    """Adds n_leaves and saved_tokens (subtree totals of leaf and saving) to the nodes n; also the rounds it took."""
    spark = n.sparkSession
    zero = F.lit(0).cast("bigint")
    forest, path = saved(n.withColumn("comp", _root()).withColumn("n_leaves", zero).withColumn("saved_tokens", zero))
    columns = [c for c in n.columns if c not in ("parent", "w", "leaf", "saving", "words")] + ["n_leaves", "saved_tokens"]
    done: DataFrame | None = None
    open_: DataFrame | None = None
    rounds = 0
    while True:
        sizes = forest.where("comp is not null").groupBy("comp").agg(F.count(F.lit(1)).alias("nodes"), F.max("w").alias("tot"))
        big, at = saved(sizes.where(F.col("nodes") > small).select("comp", "tot"))
        if big.isEmpty():
            delete_dir(spark, at)
            rest = forest
        else:  # a null comp passes the anti join
            rest, _ = saved(forest.join(big, "comp", "left_anti"))
        part = rest.where("comp is null").select(*columns)
        done = part if done is None else done.unionByName(part)
        part = rest.where("comp is not null")
        open_ = part if open_ is None else open_.unionByName(part)
        if rest is forest:
            break
        split, new_path = _split(forest, big, m)
        delete_dir(spark, path)
        delete_dir(spark, at)
        forest, path = split, new_path
        rounds += 1
    schema = done.schema
    added = open_.repartition("comp").sortWithinPartitions("comp").mapInArrow(_add_up(columns), schema)
    return done.unionByName(added), rounds


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, ids) in order of node and ids -> (a, b, sha256 of the node's ids joined by commas)."""
    now, state = None, None
    for batch in batches:
        a, b, ids = (c.to_pylist() for c in batch.columns)
        out: list[tuple] = []
        for x, y, s in zip(a, b, ids):
            if (x, y) == now:
                state.update(b"," + s.encode())
                continue
            if now is not None:
                out.append((*now, state.hexdigest()))
            now, state = (x, y), hashlib.sha256(s.encode())
        yield _ends_batch(out)
    if now is not None:
        yield _ends_batch([(*now, state.hexdigest())])


def _ends_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["a", "b", "ends_sha256"])


def ends(m: DataFrame, convs: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the nodes at which conversations end. Ids are joined by ranges of 256 first; a node's ranges
    then stream through one hash, in order, without being gathered."""
    e = m.where("d = len").select("node", "conv_id").unionByName(convs.where("len = 0").select(_root().alias("node"), "conv_id"))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    e = e.groupBy("node", F.shiftright("conv_id", 8).alias("range")).agg(ids.alias("ids"))
    e = e.select(F.col("node.a").alias("a"), F.col("node.b").alias("b"), "range", "ids").repartition("a", "b").sortWithinPartitions("a", "b", "range")
    h = e.select("a", "b", "ids").mapInArrow(_hash_ends, "a long, b long, ends_sha256 string")
    return h.select(F.struct("a", "b").alias("node"), "ends_sha256")


def trie(conversations: DataFrame, small: int = SMALL) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    t, t_path = saved(turns(conversations))
    rows, convs = rebuilt(t)
    convs, _ = saved(convs)
    m, _ = saved(members(rows))
    delete_dir(t.sparkSession, t_path)
    n, _ = saved(nodes(m, convs))
    children = n.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    parents = n.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    full = n.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).join(parents, "parent", "left")
    full = full.withColumn("leaf", (F.col("n_children") == 0).cast("bigint")).withColumn("saving", (F.col("n_convs") - 1) * F.col("words"))
    out, _ = rollup(full, m, small)
    empty: Column = F.lit(hashlib.sha256(b"").hexdigest())
    out = out.join(ends(m, convs), "node", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))
