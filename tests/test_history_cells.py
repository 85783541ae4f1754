"""Items meet their history in cells of a week (F2, F4, F5, F7): no token or pair is shuffled, all pairs for any block size."""

import random
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest

from headline_engine.config import EngineConfig
from headline_engine.operators import review, simjoin

WORD = EngineConfig(token_mode="word", triage_context=4)
T0 = datetime(2024, 1, 1)
ITEM, SEEN = "crawl_id long, crawl_ts timestamp, pos long, title string", "crawl_ts timestamp, title string, key_ord int, rank_in_group int"


@pytest.fixture
def rows():
    rnd = random.Random(7)
    title = lambda: " ".join(rnd.choice("abcdefghijklmnopqrstuvw") * 2 for _ in range(rnd.randint(1, 5)))
    items = sorted({(c, T0 + timedelta(hours=12 * c), title()) for c in range(0, 60, 3) for _ in range(3)})
    items = [(c, at, n, x) for n, (c, at, x) in enumerate(items)] + [(None, T0 + timedelta(days=9), 900, "aa bb"), (70, None, 901, "aa bb"), (70, T0, 902, "!!")]
    seen = [(T0 + timedelta(hours=12 * rnd.randint(0, 60)), title(), rnd.randint(0, 2), rnd.randint(1, 9)) for _ in range(150)]
    return items, seen + seen[:9] + [(None, "aa bb", 0, 1), (T0, "??", 0, 1)]


def live(at, seen):
    return [s for s in seen if at and s[0] and timedelta(0) < at - s[0] < timedelta(days=7)]


def jaccard(x, y):
    a, b = set(x.split()), set(y.split())
    return len(a & b) / len(a | b) if x.isascii() and x.strip("!?") and y.strip("!?") else 0.0


@pytest.mark.parametrize("rows_of_cell", [2048, 5])
def test_triage_equals_brute_force(spark, rows, monkeypatch, rows_of_cell):
    monkeypatch.setattr(simjoin, "CELL_ROWS", rows_of_cell)
    items, seen = rows
    flags, context = review.triage(spark.createDataFrame(items, ITEM), spark.createDataFrame(seen, SEEN), WORD)
    t = WORD.triage_threshold
    inner = lambda i: any(jaccard(i[3], j[3]) > t for j in items if j[0] == i[0] and j[3] != i[3])
    want = {(i[0], i[3]): i[0] is not None and (inner(i) or any(jaccard(i[3], s[1]) > t for s in live(i[1], seen))) for i in items}
    assert {(r["crawl_id"], r["title"]): r["ambiguous"] for r in flags.collect()} == want
    got = {}
    for r in sorted(context.where("crawl_id is not null").collect(), key=lambda r: r["ctx_ord"]):
        got.setdefault(r["crawl_id"], []).append(r["title"])
    for c in {i[0] for i in items if i[0] is not None}:
        first = {}
        for i in items:
            for s in live(i[1], seen) if i[0] == c else ():
                if jaccard(i[3], s[1]) > t:
                    first[s[1]] = min(first.get(s[1], (s[0], *s[2:])), (s[0], *s[2:]))
        assert got.get(c, []) == sorted(first, key=lambda x: (first[x], x))[: WORD.triage_context]


@pytest.mark.parametrize("rows_of_cell", [2048, 5])
def test_near_dup_flags_of_blocks_and_equal_keys(spark, rows, monkeypatch, rows_of_cell):
    """Equal keys are similarity 1 whatever their tokens."""
    monkeypatch.setattr(simjoin, "CELL_ROWS", rows_of_cell)
    items, seen = rows
    old = "a very long line of words that is seen again with one word more"
    items = items + [(80, T0 + timedelta(days=8), 903, old + " at"), (80, T0 + timedelta(days=8), 904, "x yz")]
    seen = seen + [(T0 + timedelta(days=2), old, 0, 1), (T0 + timedelta(days=2), "xy z", 0, 1)]
    got = {(r["crawl_id"], r["title"]): r["hist_dup"] for r in simjoin.near_dup_vs_history(spark.createDataFrame(items, ITEM), spark.createDataFrame(seen, SEEN), WORD).collect()}
    assert got[80, old + " at"] and got[80, "x yz"] and len(got) == len(items)
    key = lambda x: "".join(c for c in x if c.isalnum())
    for i in items:
        if i[0] is None or any(key(s[1]) == key(i[3]) for s in live(i[1], seen)) or all(jaccard(i[3], s[1]) <= 2 / 3 for s in live(i[1], seen)):
            assert got[i[0], i[3]] == (i[0] is not None and any(key(s[1]) == key(i[3]) for s in live(i[1], seen)))


def test_items_and_history_of_one_frame(spark):
    df = spark.createDataFrame([(1, T0, 0, "aa bb", 0, 1), (2, T0 + timedelta(days=1), 1, "aa bb", 0, 1)], ITEM + ", key_ord int, rank_in_group int").where("pos >= 0")
    flags, context = review.triage(df, df.where("pos < 9"), WORD)
    assert sorted((r["crawl_id"], r["ambiguous"]) for r in flags.collect()) == [(1, False), (2, True)]
    assert [tuple(r) for r in context.collect()] == [(2, 0, "aa bb")]
    assert {r["crawl_id"]: r["hist_dup"] for r in simjoin.near_dup_vs_history(df, df.limit(9), WORD).collect()} == {1: False, 2: True}


def test_only_blocks_of_weeks_are_joined(spark, rows, monkeypatch):
    met = []
    join = simjoin.token_join
    monkeypatch.setattr(simjoin, "token_join", lambda a, b, keys, *x: met.append(keys) or join(a, b, keys, *x))
    items, seen = (spark.createDataFrame(x, s) for x, s in zip(rows, (ITEM, SEEN)))
    review.triage(items, seen, WORD)
    simjoin.near_dup_vs_history(items, seen, WORD)
    assert met == [["wk"], ["wk"]]


@pytest.mark.parametrize("share,listed", [(1, 3), (10**9, 7), (8, 65_536)])
def test_shared_tokens_listed_or_multiplied(monkeypatch, share, listed):
    monkeypatch.setattr(simjoin, "RARE_SHARE", share)
    monkeypatch.setattr(simjoin, "LISTED", listed)
    monkeypatch.setattr(simjoin, "SLICE", 4)
    rnd = random.Random(1)
    a, b = ([sorted({rnd.choice("abcdefghijklmn" + only) for _ in range(rnd.randint(0, 6))}) for _ in range(n)] for n, only in ((20, "XY"), (30, "Z")))
    got = simjoin.shared_between(pa.array(a, pa.list_(pa.string())), pa.array(b, pa.list_(pa.string())))
    assert np.array_equal(got, [[len({*x} & {*y}) for y in b] for x in a])
