"""Prefix joins (F3, F10): bounds before pairs are shuffled, points only on the levels where their token is met."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from headline_engine.config import EngineConfig
from headline_engine.operators import simjoin

WORD = EngineConfig(token_mode="word")


@pytest.mark.parametrize("common", [1, 5, 65_536])
def test_prefix_join_loses_no_pair_whatever_the_table(spark, monkeypatch, common):
    """The order of the tokens and the parities are bounds only: all pairs above t are candidates, few others are."""
    monkeypatch.setattr(simjoin, "COMMON", common)
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    titles = ["the " + " ".join(rnd.sample(words, rnd.randint(1, 30))) for _ in range(120)]
    titles += [" ".join(x.split()[: max(2, len(x.split()) - rnd.randint(0, 6))]) for x in titles]
    titles = sorted(set(titles))
    t = 2 / 3
    u = simjoin.written(simjoin.units(spark.createDataFrame([(x,) for x in titles], "title string"), [], WORD))
    p = simjoin.written(simjoin.prefixes(u, [], t, simjoin.token_order(u)))
    pairs = simjoin.candidate_pairs(p, p, ["tok"], t, WORD, self_join=True, guard_length=False)
    got = {tuple(sorted((r["title_a"], r["title_b"]))) for r in simjoin.attach(pairs, u, u, WORD).collect()}
    tok = {x: set(x.split()) for x in titles}
    want = {(x, y) for x, y in itertools.combinations(titles, 2) if len(tok[x] & tok[y]) / len(tok[x] | tok[y]) > t}
    assert want <= got and len(got) < 3 * len(want)
    # The parities alone keep every wanted pair.
    s = p.where("pos = 1").select("uid", "n_tok", *simjoin.SIGN)
    side = lambda x: s.select(F.col("uid").alias(f"uid_{x}"), F.col("n_tok").alias(f"n{x}"), *[F.col(c).alias(c + x) for c in simjoin.SIGN])
    kept = side("a").crossJoin(side("b")).where(simjoin.sign_ok(t) & (F.col("uid_a") < F.col("uid_b"))).select("uid_a", "uid_b")
    assert want <= {tuple(sorted((r["title_a"], r["title_b"]))) for r in simjoin.attach(kept, u, u, WORD).collect()}


def test_points_come_on_the_levels_of_their_token_only(spark):
    """One row a token and level that a session has, though another title's session spans two years."""
    t0 = datetime(2024, 1, 1)
    sessions = spark.createDataFrame([("rare", 0), ("often", 0), ("often", 7), ("often", 7)], "tok string, level int")
    points = spark.createDataFrame([(tok, t0 + timedelta(days=d)) for tok in ("rare", "often", "unmet") for d in range(5)], "tok string, crawl_ts timestamp")
    got = {(r["tok"], r["level"]): r["count"] for r in simjoin.points_met(points, sessions, "crawl_ts", WORD).groupBy("tok", "level").count().collect()}
    assert got == {("rare", 0): 5, ("often", 0): 5, ("often", 7): 5}
