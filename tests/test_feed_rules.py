"""Feed explode/collapse (P1, P2, A1, S1, S3) and rule parsing (P5) golden rows."""

from datetime import datetime

from pyspark.sql import functions as F

from headline_engine import schemas
from headline_engine.operators import feed, match, report
from headline_engine.sources.rules import group_caps, load_rules
from headline_engine.config import EngineConfig


def snaps(spark, rows):
    return spark.createDataFrame(rows, schemas.SNAPSHOTS)


def item(t, url=""):
    return {"title": t, "url": url, "mobileUrl": ""}


def test_explode_and_collapse(spark):
    ts = datetime(2024, 1, 1)
    s = snaps(spark, [
        (1, ts, "p1", "success", [item("A", "u1"), item(" "), item(None), item("B"), item(" A ", "u5")]),
        (1, ts, "p2", "error", [item("X")]),
        (1, ts, "p3", "cache", []),
        (1, ts, "p4", "success", None),
    ])
    got = {r["title"]: (list(r["ranks"]), r["url"]) for r in feed.collapse_items(s).collect()}
    assert got == {"A": ([1, 5], "u1"), "B": ([4], "")}
    rows_ = {r["title"]: (r["appearances"], r["first_rank"], r["url"]) for r in feed.collapse_rows(feed.explode_feed(s)).collect()}
    assert rows_ == {"A": (2, 1, "u1"), "B": (1, 4, "")}
    registry = spark.createDataFrame([(i, f"p{i}", f"p{i}") for i in range(1, 6)], schemas.PLATFORMS)
    out = report.crawl_outcome(s, registry).first()
    assert (out["ok_platforms"], out["failed_platforms"], out["has_report"]) == (2, 3, True)
    twice = s.unionByName(snaps(spark, [(1, ts, "p1", "success", [item("A")]), (1, ts, "unknown", "success", [])]))
    out = report.crawl_outcome(twice, registry).first()
    assert (out["ok_platforms"], out["failed_platforms"]) == (2, 3)


def parsed(spark, text):
    rules, filters = load_rules(spark, text)
    r = sorted((x["group_ord"], x["group_key"], list(x["required"]), list(x["normal"]), x["max_count"]) for x in rules.collect())
    return r, sorted(x["word"] for x in filters.collect())


def test_rules_golden(spark):
    r, f = parsed(spark, "AI\nRobot\n@15\n\n+Car\nVolt\n!ad\n\n+Car\n\n!x\n@3\n\n# note\nAI\n\n@0\n@-5\n@x\nZ\n\n@ 7abc\nQ")
    assert r == [
        (1, "ai robot", [], ["ai", "robot"], 15),
        (2, "volt", ["car"], ["volt"], 0),
        (3, "car", ["car"], [], 0),
        (5, "# note ai", [], ["# note", "ai"], 0),
        (6, "z", [], ["z"], 0),
        (7, "q", [], ["q"], 7),
    ]
    assert f == ["ad", "x"]
    caps = {x["group_key"]: x["cap"] for x in group_caps(load_rules(spark, "a\n@3\n\nb\n\na\n@9")[0], 10).collect()}
    assert caps == {"a": 3, "b": 10}


def test_empty_rules_give_no_groups(spark):
    r, f = parsed(spark, "")
    assert r == [] and f == []


def test_match_and_cap(spark):
    ts = datetime(2024, 1, 1)
    s = snaps(spark, [(1, ts, "p", "success", [item(t) for t in
                       ["Car volt news", "car only", "ad car volt", "VOLT car again", "Robot AI", "x"]])])
    h = feed.collapse_items(s).withColumn("platform_ord", F.lit(1))
    rules, filters = load_rules(spark, "+car\nvolt\n!ad\n@1\n\nai\nrobot\n\n+car")
    m = match.matched(h, rules, filters)
    got = sorted((r["group_key"], r["title"]) for r in m.collect())
    # substring semantics: "again" contains "ai"
    assert got == [("ai robot", "Robot AI"), ("ai robot", "VOLT car again"), ("car", "Car volt news"), ("car", "VOLT car again"), ("car", "car only"),
                   ("volt", "Car volt news"), ("volt", "VOLT car again")]
    top = match.top_per_group(m, rules, EngineConfig())
    capped = sorted((r["group_key"], r["title"]) for r in top.collect())
    # the volt group is capped at 1: equal appearances, higher weight (rank 1) wins
    assert ("volt", "Car volt news") in capped and ("volt", "VOLT car again") not in capped
    assert len([c for c in capped if c[0] == "car"]) == 3
