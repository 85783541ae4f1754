"""Greedy/simple dedup (G1, G3), novelty (W3, ST3), similarity joins vs brute force."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from headline_engine.config import EngineConfig
from headline_engine.operators import dedup, novelty, simjoin

REF = EngineConfig()
A, B, C = "甲乙丙丁戊己庚辛壬癸", "甲乙丙丁戊己庚辛壬子", "甲乙丙丁戊己庚辛丑子"


@pytest.mark.parametrize("order,kept", [
    ([("A", 1), ("B", 2), ("C", 3)], ["C"]),
    ([("A", 2), ("B", 1), ("C", 3)], ["A", "C"]),
    ([("A", 3), ("B", 2), ("C", 1)], ["A", "C"]),
    ([("A", 1), ("C", 1), ("B", 2)], ["B", "C"]),
    ([("B", 1), ("A", 2), ("C", 2)], ["A", "C"]),
])
def test_greedy_golden(spark, order, kept):
    names = {"A": A, "B": B, "C": C}
    rows = [(1, names[n], float(w), 1, i, "", "s") for i, (n, w) in enumerate(order)]
    df = spark.createDataFrame(rows, "crawl_id long, title string, weight double, key_ord int, rank_in_group int, url string, source string")
    out = dedup.greedy_dedup(df, REF).orderBy("slot").collect()
    inv = {v: k for k, v in names.items()}
    assert [inv[r["title"]] for r in out] == kept


def _model_greedy(order, weights, sim):
    kept = []
    for t in order:
        for i, s in enumerate(kept):
            if sim(t, s):
                if weights[t] > weights[s]:
                    kept[i] = t
                break
        else:
            kept.append(t)
    return kept


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 9), st.floats(0.05, 0.6), st.integers(0, 10_000))
def test_greedy_fold_equals_sequential_model(n, p, seed):
    rnd = random.Random(seed)
    items = [f"t{i}" for i in range(n)]
    edges = {frozenset(e) for e in itertools.combinations(items, 2) if rnd.random() < p}
    weights = {t: rnd.choice([1.0, 2.0, 3.0]) for t in items}
    nb = {}
    for e in edges:
        a, b = tuple(e)
        nb.setdefault(a, set()).add(b)
        nb.setdefault(b, set()).add(a)
    assert dedup.greedy_fold(items, weights, nb) == _model_greedy(items, weights, lambda x, y: frozenset((x, y)) in edges)


def test_simple_fold():
    lowered = {"a": "a", "A": "a", "b": "b", "c": "c"}
    assert dedup.simple_fold(["a", "A", "b", "c"], lowered, {"b": {"a"}, "a": {"b"}}) == ["a", "c"]


def _sightings(spark, days):
    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame([("k", t0 + timedelta(days=d - 1), d) for d in days], "title_key string, crawl_ts timestamp, crawl_id long")


def test_novelty_golden(spark):
    n = novelty.novelty(_sightings(spark, [1, 4, 7, 13, 20, 21]), cfg=REF)
    assert sorted(r["crawl_id"] for r in n.where("is_new").collect()) == [1, 20]
    n = novelty.novelty(_sightings(spark, list(range(1, 40, 3))), cfg=REF)
    assert [r["crawl_id"] for r in n.where("is_new").collect()] == [1]


def test_presence_sessions_and_window_counts(spark):
    days = [1, 4, 7, 13, 20, 21, 35]
    s = _sightings(spark, days)
    t0 = datetime(2024, 1, 1)
    sess = sorted(((r["first_ts"] - t0).days + 1, (r["last_ts"] - t0).days + 1, r["sightings"])
                  for r in novelty.presence_sessions(s, cfg=REF).collect())
    assert sess == [(1, 13, 4), (20, 21, 2), (35, 35, 1)]
    q = spark.createDataFrame([(datetime(2024, 1, 1) + timedelta(days=d - 1),) for d in range(1, 40)], "crawl_ts timestamp")
    got = {r["crawl_ts"].date(): r["n"] for r in novelty.window_distinct_counts(s, q, "title_key", "crawl_ts", REF).collect()}
    for d in range(1, 40):
        t = datetime(2024, 1, 1) + timedelta(days=d - 1)
        brute = int(any(0 < (t - (datetime(2024, 1, 1) + timedelta(days=x - 1))).total_seconds() < 7 * 86400 for x in days))
        assert got[t.date()] == brute, d


def _brute_jaccard(titles, t):
    import re

    tok = {x: set(re.findall(r"[一-龥]|[a-z0-9]+", x.lower())) for x in titles}
    out = set()
    for a, b in itertools.combinations(sorted(set(titles)), 2):
        if tok[a] and tok[b]:
            j = len(tok[a] & tok[b]) / len(tok[a] | tok[b])
            if j > t:
                out.add((a, b))
    return out


@pytest.mark.parametrize("t", [0.1, 0.5, 2 / 3])
def test_prefix_join_equals_brute_force(spark, t):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(12)] + ["the", "a"]
    titles = {" ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 6))) for _ in range(120)}
    df = spark.createDataFrame([(1, x) for x in titles], "crawl_id long, title string")
    cfg = EngineConfig(token_mode="word")
    got = {(r["title_a"], r["title_b"]) for r in simjoin.jaccard_pairs(df, ["crawl_id"], t, cfg).collect()}
    assert got == _brute_jaccard(titles, t)


def test_near_dup_edges_equal_brute_force(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(8)]
    titles = {" ".join(rnd.choice(vocab) for _ in range(rnd.randint(2, 6))) for _ in range(150)}
    df = spark.createDataFrame([(1, x) for x in titles], "crawl_id long, title string")
    cfg = EngineConfig(token_mode="word")
    got = {(r["title_a"], r["title_b"]) for r in simjoin.near_dup_edges(df, ["crawl_id"], cfg).collect()}
    # brute force over all pairs with the same hybrid expression, no prefix filter
    from headline_engine.functions import similarity as S, text as X

    u = df.select(F.col("title").alias("a")).crossJoin(df.select(F.col("title").alias("b"))).where("a < b")
    ka, kb = X.title_key("a"), X.title_key("b")
    ta, tb = X.tokens("a", None, "word"), X.tokens("b", None, "word")
    sim = S.hybrid_sim(ka, kb, ta, tb, F.length(ka), F.length(kb), cfg, budget=False)
    ok = S.length_ok(F.length(ka), F.length(kb), cfg) & (ka != kb) & (F.size(ta) > 0) & (F.size(tb) > 0)
    brute = {(r["a"], r["b"]) for r in u.where(ok & (sim > 0.8)).collect()}
    assert got == brute


def test_equal_keys_give_no_candidates(spark):
    """300 titles of one key: nothing is paired."""
    from headline_engine.operators import simjoin
    from headline_engine.config import DRIVER_CONFIG

    df = spark.createDataFrame([(1, "Same key title" + "!" * i) for i in range(300)], "crawl_id long, title string")
    u = simjoin.units(df, ["crawl_id"], DRIVER_CONFIG)
    p = simjoin.prefixes(u, ["crawl_id"], 2 / 3, simjoin.token_order(u))
    assert simjoin.candidate_pairs(p, p, ["crawl_id", "tok"], 2 / 3, DRIVER_CONFIG, self_join=True, unequal_keys=True).count() == 0
    assert simjoin.near_dup_edges(df, ["crawl_id"], DRIVER_CONFIG).count() == 0


def test_greedy_keeps_edge_free_items_and_hot_components(spark):
    """Edge-free items keep their place; a component of 60 near duplicates keeps its heaviest in the opener's slot; no cap needed."""
    from dataclasses import replace as rep

    from headline_engine.config import DRIVER_CONFIG
    from headline_engine.operators import dedup

    base = " ".join(f"word{i}" for i in range(40))
    rows = [(1, "alpha only", 1.0), (1, base + " tail0", 2.0)]
    rows += [(1, base + f" tail{i}", 2.0 + i / 100) for i in range(1, 60)] + [(1, "omega only", 9.0)]
    df = spark.createDataFrame([(c, t, w, 1, i, "", "s") for i, (c, t, w) in enumerate(rows)],
                               "crawl_id long, title string, weight double, key_ord int, rank_in_group int, url string, source string")
    got = [(r["slot"], r["title"]) for r in dedup.greedy_dedup(df, rep(DRIVER_CONFIG, default_cap=0)).orderBy("slot").collect()]
    assert got == [(0, "alpha only"), (1, base + " tail59"), (2, "omega only")]


def test_vs_history_flags_equal_empty_keys(spark):
    import datetime as dt

    from headline_engine.operators import simjoin

    at = lambda d: dt.datetime(2024, 1, d)
    items = spark.createDataFrame([(1, at(10), "!!!"), (1, at(10), "real words here"), (2, at(25), "???")], "crawl_id long, crawl_ts timestamp, title string")
    history = spark.createDataFrame([(at(8), "..."), (at(9), "?!"), (at(10), "---")], "crawl_ts timestamp, title string")
    got = simjoin.near_dup_vs_history(items, history).collect()
    assert sorted((r["crawl_id"], r["title"], r["hist_dup"]) for r in got) == [(1, "!!!", True), (1, "real words here", False), (2, "???", False)]
