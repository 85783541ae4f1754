"""Conversation prefix trie (11) against a plain trie."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from headline_engine.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, node string, depth int, w int, comp int"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """rows: (conv_id, turn, role, text)."""
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, r or "", hashlib.md5((x or "").encode()).hexdigest(), x or ""))
    own = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in by.items()}
    nodes = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        seq = tuple(own.get(donor, [])[:h] + mine[h:])
        for d in range(len(seq) + 1):
            node = nodes.setdefault(seq[:d], {"m": [], "ends": [], "kids": 0, "leaves": 0, "saved": 0})
            node["m"].append(c)
        nodes[seq]["ends"].append(c)
    for k in nodes:
        if k:
            nodes[k[:-1]]["kids"] += 1
    for k, n in nodes.items():
        saved = (len(n["m"]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            nodes[k[:d]]["leaves"] += not n["kids"]
            nodes[k[:d]]["saved"] += saved
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(n["m"]), len(k), -1 if not k else min(nodes[k[:-1]]["m"]), len(n["m"]), n["kids"], n["leaves"], n["saved"], sha(n["ends"])) for k, n in nodes.items())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, 3) for r in rows], SCHEMA).repartition(5)


def got(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in df.collect())


def conversations():
    rnd = random.Random(5)
    say = ["one two", "three", "", None, " \t\n", "漢字 かな", "a  b\vc\x1cd"]
    rows = []
    for c in [*range(0, 130), *range(1000, 1040), -3, -20, -40, -41, 5_000_000_007]:
        for t in range(rnd.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, None if rnd.random() < 0.05 else t, rnd.choice(["user", "assistant", None]), rnd.choice(say)))
    for c in range(300, 420):  # many equal conversations
        rows += [(c, t, "user", f"hot turn {t}") for t in range(6)]
    rows += [(500, t, "user", f"long {t}") for t in range(700)]  # one deep path, and another that leaves it half way
    rows += [(520, t, "user", f"long {t}" if t < 350 else f"other {t}") for t in range(600)]
    rows += rows[3:6] + [(None, 1, "user", "nobody"), (None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def case():
    rows = conversations()
    return rows, plain(rows)


@pytest.mark.parametrize("small", [1, 40, 100_000])
def test_trie_equals_plain(spark, case, small):
    rows, want = case
    assert got(prefixtrie.trie(frame(spark, rows), small=small)) == want


def test_long_conversations_over_blocks_and_parts(spark, case, monkeypatch):
    rows, want = case
    monkeypatch.setattr(prefixtrie, "BLOCK", 16)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a part per range: long conversations are cut
        t = prefixtrie.turns(frame(spark, rows))
        assert t.where("conv_id = 500").select(F.shiftright("mid", 33)).distinct().count() > 1
        assert got(prefixtrie.trie(frame(spark, rows), small=64)) == want
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_rounds_grow_with_the_logarithm_of_the_depth(spark):
    m = spark.range(2000).select(F.lit(7).cast("long").alias("conv_id"), (F.col("id") + 1).alias("d"), F.lit(2000).cast("long").alias("len"), F.lit(1).cast("long").alias("words"),
                                 F.struct((F.col("id") + 1).alias("a"), F.lit(0).cast("long").alias("b")).alias("node"),
                                 F.struct(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).alias("parent"))
    n = m.select("node", "parent", "conv_id", F.col("d").alias("depth"), F.lit(1).cast("long").alias("n_convs"), "words", (2001 - F.col("d")).alias("w"),
                 (F.col("d") == 2000).cast("long").alias("leaf"), F.col("d").alias("saving"))
    out, rounds = prefixtrie.rollup(n, m, small=100)
    assert 4 <= rounds <= 6  # 2000 nodes halve to at most 100
    total = {r["depth"]: (r["n_leaves"], r["saved_tokens"]) for r in out.collect()}
    assert total == {d: (1, sum(range(d, 2001))) for d in range(1, 2001)}


def test_empty_and_turnless(spark):
    assert prefixtrie.trie(frame(spark, [(1, 1, "a", "b")]).limit(0)).count() == 0
    rows = [(3, 0, "user", "only turn"), (None, 0, "user", "x")]  # its first turns come from an absent donor
    assert got(prefixtrie.trie(frame(spark, rows))) == plain(rows)
