"""Triage (F6 to F8): a crawl's own items meet in groups, and only pairs with the history are counted token by token."""

from datetime import datetime

from headline_engine.config import EngineConfig
from headline_engine.operators import review, simjoin


def test_items_of_a_crawl_are_not_joined_by_token(spark, monkeypatch):
    seen = []
    join = simjoin.token_join
    monkeypatch.setattr(simjoin, "token_join", lambda a, b, keys, cond, self_join, *x: seen.append(self_join) or join(a, b, keys, cond, self_join, *x))
    t = datetime(2024, 1, 2)
    items = spark.createDataFrame([(1, t, 0, "red fox runs"), (1, t, 1, "red fox sleeps"), (1, t, 2, "old news"), (1, t, 3, "alone")],
                                  "crawl_id long, crawl_ts timestamp, pos long, title string")
    history = spark.createDataFrame([(datetime(2024, 1, 1), "old news again", 1, 1)], "crawl_ts timestamp, title string, key_ord int, rank_in_group int")
    flags, _ = review.triage(items, history, EngineConfig(token_mode="word"))
    assert {r["title"]: r["item_id"] for r in flags.collect()} == {"red fox runs": 0, "red fox sleeps": 1, "old news": 2, "alone": None}
    assert seen == [False]
