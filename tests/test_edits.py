"""The edit distance of the similarity joins (F3): exact within its bound, -1 beyond, and no more work where a pair is far apart."""

import random

import pytest

from headline_engine.config import EngineConfig
from headline_engine.functions.similarity import edits
from headline_engine.operators import simjoin


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edits_equal_the_table():
    rnd = random.Random(3)
    for _ in range(400):
        a, b = ("".join(rnd.choice("abé文\U0001f600") for _ in range(rnd.choice([0, 1, 5, 63, 64, 65, 130]))) for _ in "ab")
        d = plain(a, b)
        assert edits(a, b, 999) == d == edits(a, b, d) and edits(a, b, d - 1) == -1
    assert edits("x", "x", -1) == -1 and edits("", "", 0) == 0


@pytest.mark.parametrize("scope", [[], ["crawl_id"]])
def test_long_near_copies_with_exact_similarities(spark, scope):
    """Values above the threshold equal the unbounded formula; before, the JVM filled a band of half the longer title a pair."""
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(12):
        base = [rnd.choice(words) for _ in range(80)]
        rows += [(1, " ".join(w if rnd.random() > p else "x" + w for w in base)) for p in (0, 0.02, 0.05, 0.1, 0.2)]
    cfg = EngineConfig(token_mode="word")
    df = spark.createDataFrame(rows, "crawl_id long, title string")
    e = simjoin.near_dup_edges(df, scope, cfg)
    plan = e._jdf.queryExecution().executedPlan().toString()
    assert "levenshtein" not in plan.lower()
    got = {(r["title_a"], r["title_b"]): r["sim"] for r in e.collect()}
    titles = sorted({x for _, x in rows})
    want = {}
    for i, x in enumerate(titles):
        for y in titles[i + 1 :]:
            a, b, k, m = set(x.split()), set(y.split()), x.replace(" ", ""), y.replace(" ", "")
            j = len(a & b) / len(a | b)
            if j > 0.6:
                s = j * 0.6 + (1.0 - plain(k, m) / max(len(k), len(m))) * 0.4
                if s > 0.8:
                    want[x, y] = s
    assert len(want) > 12 and got == pytest.approx(want, abs=1e-12)
