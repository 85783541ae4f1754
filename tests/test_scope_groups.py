"""Pairs inside crawls met in groups (F1, F2): all pairs whatever the block and slice sizes, titles shuffled once."""

import itertools
import random

import pytest

from headline_engine.config import EngineConfig
from headline_engine.operators import simjoin

CFG = {m: EngineConfig(token_mode=m) for m in ("word", "char")}


def tokens_of(title, mode):
    return set(title.split()) if mode == "word" else set(title)


@pytest.mark.parametrize("mode,t,block,whole", [("word", 0.1, 512, 4096), ("word", 0.1, 7, 4096), ("char", 0.8, 30, 4096), ("word", 2 / 3, 5, 4096), ("word", 0.1, 5, 60)])
def test_pairs_equal_brute_force_for_any_block_size(spark, monkeypatch, mode, t, block, whole):
    monkeypatch.setattr(simjoin, "GROUP_ROWS", block)
    monkeypatch.setattr(simjoin, "SCOPE_ROWS", whole)
    rnd = random.Random(5)
    rows = [(c, "hot " + " ".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 6)))) for c in (1, 1, 1, 2) for _ in range(30)]
    rows += [(None, "hot a b"), (None, "hot a c"), (2, None), (1, "é zé"), (1, "\U0001f600 hot a")]
    df = spark.createDataFrame(rows + rows[:20], "crawl_id long, title string")
    got = sorted((r["crawl_id"], r["title_a"], r["title_b"]) for r in simjoin.jaccard_pairs(df, ["crawl_id"], t, CFG[mode]).collect())
    want = []
    for c in (1, 2):
        clean = sorted({x for k, x in rows if k == c and x and x.isascii()}, key=str.encode)
        toks = {x: tokens_of(x, mode) for x in clean}
        want += [(c, x, y) for x, y in itertools.combinations(clean, 2) if len(toks[x] & toks[y]) / len(toks[x] | toks[y]) > t]
    assert [g for g in got if g[1].isascii() and g[2].isascii()] == sorted(want)


def test_no_pair_is_shuffled(spark):
    """The plan shuffles the titles by crawl, and nothing after the pairs are made."""
    df = spark.createDataFrame([(1, "a b"), (1, "a c")], "crawl_id long, title string")
    plan = simjoin.jaccard_pairs(df, ["crawl_id"], 0.1, CFG["word"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
