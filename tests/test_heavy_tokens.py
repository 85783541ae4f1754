"""Heavy tokens in blocks, and history by presence sessions."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from headline_engine.config import EngineConfig
from headline_engine.operators import simjoin

WORD = EngineConfig(token_mode="word")
T0 = datetime(2024, 1, 1)


def rows_of(spark, n, key="hot"):
    return spark.createDataFrame([(1, key, i.to_bytes(4, "big")) for i in range(n)], "crawl_id long, tok string, uid binary")


def sides(df):
    return df.withColumnRenamed("uid", "uid_a"), df.withColumnRenamed("uid", "uid_b")


def test_heavy_token_pairs_come_once_and_tasks_hold_a_block_pair(spark):
    """A token of every row: each pair once, and the join's keys hold two blocks at most."""
    df = rows_of(spark, 900).unionByName(rows_of(spark, 30, "light"))
    a, b = sides(df)
    keys = ["crawl_id", "tok"]
    got = [tuple(sorted((bytes(r["uid_a"]), bytes(r["uid_b"])))) + (r["tok"],) for r in simjoin.token_join(a, b, keys, F.lit(True), True, rows=100).collect()]
    want = [(i.to_bytes(4, "big"), j.to_bytes(4, "big"), k) for k, n in (("hot", 900), ("light", 30)) for i, j in itertools.combinations(range(n), 2)]
    assert sorted(got) == sorted(want)
    heavy = simjoin.heavy_keys(a, b, keys, True, rows=100).collect()
    assert [(r["tok"], r["blocks_a"], r["blocks_b"]) for r in heavy] == [("hot", 9, 9)]
    plan = simjoin.token_join(a, b, keys, F.lit(True), True, rows=100)._jdf.queryExecution().executedPlan().toString()
    assert "_i" in plan and "_j" in plan and "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    dealt = a.join(F.broadcast(spark.createDataFrame(heavy)), keys).groupBy(*keys, F.pmod(F.xxhash64("uid_a"), F.col("blocks_a"))).count()
    assert dealt.agg(F.max("count")).first()[0] <= 200


def test_two_sided_heavy_join(spark):
    a, _ = sides(rows_of(spark, 400))
    _, b = sides(rows_of(spark, 7))
    assert simjoin.token_join(a, b, ["crawl_id", "tok"], F.col("uid_a") != F.col("uid_b"), False, rows=50).count() == 400 * 7 - 7


@pytest.mark.parametrize("t", [0.1, 2 / 3])
def test_prefix_join_with_a_token_in_every_title(spark, t, monkeypatch):
    monkeypatch.setattr(simjoin.candidate_pairs, "__defaults__", (True, False, 20))
    rnd = random.Random(2)
    titles = sorted({"hot " + " ".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(0, 4))) for _ in range(200)})
    df = spark.createDataFrame([(1, x) for x in titles], "crawl_id long, title string")
    got = {(r["title_a"], r["title_b"]) for r in simjoin.jaccard_pairs(df, ["crawl_id"], t, WORD).collect()}
    tok = {x: set(x.split()) for x in titles}
    assert got == {(x, y) for x, y in itertools.combinations(titles, 2) if len(tok[x] & tok[y]) / len(tok[x] | tok[y]) > t}


def test_recurring_title_is_one_session_row(spark):
    """A title of every crawl for two years, and one of every ninth day: rows grow with sessions, not with crawls."""
    often = [(T0 + timedelta(hours=12 * i), "again and again the same") for i in range(1460)]
    gaps = [(T0 + timedelta(days=9 * i), "seldom but for ever here") for i in range(80)]
    hist = spark.createDataFrame(often + gaps, "crawl_ts timestamp, title string")
    s = simjoin.presence_sessions(hist, "title", "crawl_ts", WORD)
    b = simjoin.session_buckets(s, WORD).groupBy("title").count().collect()
    assert {r["title"]: r["count"] for r in b}["again and again the same"] <= 2
    assert {r["title"]: r["count"] for r in b}["seldom but for ever here"] <= 160


def test_history_flags_equal_brute_force(spark):
    """Open window on both ends, sessions of all lengths, items at and around every boundary."""
    rnd = random.Random(4)
    base = {k: " ".join(f"{k}{i}" for i in range(12)) for k in "abcde"}
    seen = []
    for k, title in base.items():
        day = rnd.randint(0, 5)
        for _ in range(14):
            seen.append((T0 + timedelta(days=day), title))
            day += rnd.choice([1, 1, 3, 6, 7, 8, 15])
    seen += [(T0 + timedelta(days=d), "!!") for d in (3, 8, 30)]
    items = []
    for n, d in enumerate([x / 2 for x in range(0, 320)]):
        for k in "abcde":
            items.append((n, T0 + timedelta(days=d), base[k] + " more"))
        items.append((n, T0 + timedelta(days=d), "??"))
    got = simjoin.near_dup_vs_history(spark.createDataFrame(items, "crawl_id long, crawl_ts timestamp, title string"),
                                      spark.createDataFrame(seen, "crawl_ts timestamp, title string"), WORD)
    for r in got.collect():
        like = "!!" if r["title"] == "??" else r["title"].removesuffix(" more")
        assert r["hist_dup"] == any(timedelta(0) < r["crawl_ts"] - ts < timedelta(days=7) for ts, x in seen if x == like), r
