"""Many rules by the gram index: equal to the broadcast form, without a nested loop."""

import random

from pyspark.sql import functions as F

from headline_engine.operators import match, ruleindex
from headline_engine.sources import rules as R


def titles(n=300, seed=4):
    rnd = random.Random(seed)
    bits = ["nation", "Motion", "ab", "x", "漢字", "sher", "thre", "the", " ", "ÉT", "hot"]
    return sorted({"hot " + "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 7))) for _ in range(n)} | {"x", "a", "zz top"})


def test_index_equals_broadcast(spark, monkeypatch):
    rnd = random.Random(6)
    words = ["nation", "motion", "ab", "x", "漢", "漢字", "sher", "threa", "he", "ét", "hot", "otio", "nowhere", "b", "on"]
    groups = ["\n".join(rnd.choice(["", "+", "", ""]) + rnd.choice(words) for _ in range(rnd.randint(1, 4))) + rnd.choice(["", "\n@3"]) for _ in range(40)]
    text = "\n\n".join(groups) + "\n\n!sherab\n!nowhere\n!zz"
    h = spark.createDataFrame([(i, t) for i, t in enumerate(titles())], "n long, title string")
    want = match.matched(h, *R.load_rules(spark, text)).select("n", "title", "group_ord", "group_key").collect()
    monkeypatch.setattr(ruleindex.contained_words, "__defaults__", (3, 50))  # grams of many titles go in blocks
    got = match.matched(h, *R.load_rules(spark, text, indexed=True), indexed=True).select("n", "title", "group_ord", "group_key").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 300


def test_hundred_thousand_rules(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("bcdfghjklmnpqrstvwz") + rnd.choice("aeiou") for _ in range(4)) for _ in range(100_000)]
    text = "\n\n".join(words)
    assert not R.is_large(text[:1000])
    h = spark.createDataFrame([(i, f"{rnd.choice(words)} and {rnd.choice(words)} {i}") for i in range(400)], "n long, title string")
    m = match.matched(h, *R.load_rules(spark, text, indexed=True), indexed=True)
    plan = m._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    got = m.groupBy("n").agg(F.collect_set("group_key").alias("g")).collect()
    have = set(words)
    for r in got:
        title = h.where(F.col("n") == r["n"]).first()["title"] if r["n"] < 3 else None
        if title:
            assert set(r["g"]) == {w for w in have if w in title}
    assert len(got) == 400
