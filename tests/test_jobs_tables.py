"""Sinks/scans (S1, S4-S9) and the crawl / push jobs: stored history, modes, gate, empty and odd crawls, reruns."""

import json
import os
import tempfile
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from oracle_harness import SF_SMALL
from headline_engine import schemas
from headline_engine.config import DRIVER_CONFIG, EngineConfig
from headline_engine.functions.text import title_key
from headline_engine.operators import report
from headline_engine.plans import jobs
from headline_engine.sources import adapters as A, rules, tables

CFG = EngineConfig(token_mode="word", rules_text="news\n\nmarket")


def snap(spark, crawls):
    """crawls: (crawl_id, day, hour, {platform: titles or None})."""
    rows = []
    for cid, day, hour, by in crawls:
        ts = datetime(2024, 1, 1, hour) + timedelta(days=day)
        for p, titles in by.items():
            items = None if titles is None else [{"title": t, "url": "", "mobileUrl": ""} for t in titles]
            rows.append((cid, ts, p, "success" if titles is not None else "error", items))
    return spark.createDataFrame(rows, schemas.SNAPSHOTS)


@pytest.fixture(scope="module")
def plats(spark):
    return spark.createDataFrame([(1, "p1", "P1"), (2, "p2", "P2")], schemas.PLATFORMS)


def bodies(msgs):
    return {r["crawl_id"]: r["body"] for r in msgs.where("channel = 'feishu' and part = 1").collect()}


def titles(body):
    return [x.split(". ", 1)[1].rsplit(" - ", 1)[0] for x in body.split("\n")[3:] if x]


def fresh(name):
    return tempfile.mkdtemp(prefix=f"hl-{name}-")


def test_second_call_reports_only_unseen_titles(spark, plats):
    one = snap(spark, [(1, 0, 1, {"p1": ["big news today", "quiet market"], "p2": ["other news"]})])
    two = snap(spark, [(2, 1, 1, {"p1": ["big news today", "fresh market story"], "p2": []})])
    out = fresh("two")
    jobs.run_crawl(one, plats, out, CFG)
    got = bodies(jobs.run_crawl(two, plats, out, CFG))
    assert titles(got[2]) == ["fresh market story"]
    both = bodies(jobs.run_crawl(one.unionByName(two), plats, fresh("both"), CFG))
    assert both[2] == got[2] and sorted(titles(both[1])) == ["big news today", "other news", "quiet market"]
    # A rerun of the same crawl changes neither history nor messages nor the push log.
    count = lambda: [spark.read.parquet(f"{out}/{t}").count() for t in ("history", "messages", "push_log")]
    before = count()
    assert bodies(jobs.run_crawl(two, plats, out, CFG)) == got and count() == before


def test_modes_and_notification_off(spark, plats):
    one = snap(spark, [(1, 0, 1, {"p1": ["big news today"]}), (2, 1, 1, {"p1": ["big news today"]})])
    out = fresh("daily")
    got = bodies(jobs.run_crawl(one, plats, out, replace(CFG, mode="daily")))
    assert titles(got[1]) == titles(got[2]) == ["big news today"]
    assert not os.path.exists(f"{out}/history")
    assert {r["report_type"] for r in spark.read.parquet(f"{out}/push_log").collect()} == {"daily"}
    out = fresh("off")
    assert jobs.run_crawl(one, plats, out, replace(CFG, notification=False)).count() == 0
    assert os.path.exists(f"{out}/reports") and not os.path.exists(f"{out}/history") and not os.path.exists(f"{out}/messages")


def test_holiday_gate_and_force(spark, plats):
    # Sat 2024-01-06 03:00 UTC is 11:00 in UTC+8 (no push hour), 02:00 is 10:00.
    s = snap(spark, [(1, 5, 3, {"p1": ["big news"]}), (2, 5, 2, {"p1": ["quiet market"]})])
    cal = A.calendar(spark, ())
    assert set(bodies(jobs.run_crawl(s, plats, fresh("gate"), CFG, calendar=cal))) == {2}
    assert set(bodies(jobs.run_crawl(s, plats, fresh("gate"), CFG, calendar=cal, force=True))) == {1, 2}


def test_translated_titles_are_reported_and_remembered(spark, plats):
    cache = spark.createDataFrame([("big news", '"BIG NEWS (translated)"', datetime(2023, 12, 31))], "t string, translated string, written_ts timestamp")
    cache = cache.select(F.sha2("t", 256).alias("text_hash"), "translated", "written_ts")
    out = fresh("tr")
    got = bodies(jobs.run_crawl(snap(spark, [(1, 0, 1, {"p1": ["big news"]})]), plats, out, CFG, translations=cache))
    assert titles(got[1]) == ["BIG NEWS (translated)"]
    assert [r["title"] for r in spark.read.parquet(f"{out}/history").collect()] == ["BIG NEWS (translated)"]


def test_empty_and_failed_crawls(spark, plats):
    out = fresh("empty")
    s = snap(spark, [(1, 0, 1, {"p1": ["big news"], "p2": None}), (2, 0, 2, {"p1": ["nothing here"]}), (3, 1, 1, {"p1": None, "p2": None})])
    got = bodies(jobs.run_crawl(s, plats, out, CFG))
    assert set(got) == {1}
    day = "20240101"
    # The day's last crawl matched nothing and replaces the report; the failed crawl has none.
    assert tables.read_report(spark, f"{out}/reports", day).count() == 0
    t = tables.read_totals(spark, f"{out}/reports", day).collect()
    assert [(r["crawl_id"], r["total_news"], r["hot_news"]) for r in t] == [(2, 0, 0)]
    assert tables.read_totals(spark, f"{out}/reports", "20240102").count() == 0
    o = {r["crawl_id"]: (r["ok_platforms"], r["failed_platforms"], r["has_report"]) for r in report.crawl_outcome(s, plats).collect()}
    assert o == {1: (1, 1, True), 2: (1, 1, True), 3: (0, 2, False)}


def test_all_new_items_dropped_gives_an_empty_text(spark, plats):
    """A new title that is a near duplicate of history: the crawl is pushed with a header that counts 0."""
    base = "the market report of the week says that prices went up again in most of the regions"
    s = snap(spark, [(1, 0, 1, {"p1": [base]}), (2, 1, 1, {"p1": [base + " s"]})])
    got = bodies(jobs.run_crawl(s, plats, fresh("dup"), CFG))
    assert titles(got[2]) == [] and " 0条 |" in got[2]


def test_duplicate_responses(spark, plats):
    s = snap(spark, [(1, 0, 1, {"p1": ["old news"]})]).withColumn("seq", F.lit(1))
    s = s.unionByName(snap(spark, [(1, 0, 1, {"p1": ["new news"]})]).withColumn("seq", F.lit(2)))
    got = bodies(jobs.run_crawl(s, plats, fresh("resp"), CFG, response_order="seq"))
    assert titles(got[1]) == ["new news"]
    o = report.crawl_outcome(s, plats).first()
    assert (o["ok_platforms"], o["failed_platforms"]) == (1, 1)


def test_reviewer_branch(spark, plats):
    s = snap(spark, [(1, 0, 1, {"p1": ["market one two three", "market one four five", "unrelated news"]})])
    cfg = replace(CFG, reviewer=True)
    verdicts = spark.createDataFrame([(1, 0), (1, 99)], "crawl_id long, item_id int")
    got = titles(bodies(jobs.run_crawl(s, plats, fresh("rev"), cfg, verdicts=verdicts))[1])
    assert "unrelated news" in got and len(got) == 2
    assert len(titles(bodies(jobs.run_crawl(s, plats, fresh("rev"), cfg))[1])) == 3  # no verdicts: the greedy result


def test_run_push(spark, plats):
    out = fresh("push")
    s = snap(spark, [(1, 0, 1, {"p1": ["big news", "quiet market"]}), (2, 1, 1, {"p1": ["big news", "new market"]})])
    jobs.run_crawl(s, plats, out, CFG)
    as_of = F.lit(datetime(2024, 1, 2, 5)).cast("timestamp")
    for _ in range(2):  # a repeated push appends nothing twice
        msgs = jobs.run_push(spark, out, "20240102", as_of, CFG)
        assert titles(bodies(msgs)[2]) == ["new market"]
        log = spark.read.parquet(f"{out}/push_log")
        assert sorted(r["report_type"] for r in log.collect()) == ["incremental", "incremental", "manual"]
        hist = spark.read.parquet(f"{out}/history")
        assert hist.where("crawl_id < 0").count() == 2
    assert jobs.run_push(spark, out, "20230101", as_of, CFG).count() == 0


def test_run_crawl_on_driver_tables(spark):
    out = fresh("jobs")
    snaps, plats = A.documents_snapshots(spark, SF_SMALL), A.documents_platforms(spark, SF_SMALL)
    assert jobs.run_crawl(snaps, plats, out, DRIVER_CONFIG).count() > 0
    rep = spark.read.parquet(f"{out}/reports")
    per_day = rep.groupBy("report_day").agg(F.count_distinct("crawl_id").alias("n")).collect()
    assert per_day and all(r["n"] == 1 for r in per_day)
    before = rep.select("report_day").distinct().count()
    one = jobs.report_items(snaps.where(F.col("crawl_id") <= 2), plats, DRIVER_CONFIG)
    tables.write_report(one, f"{out}/reports", DRIVER_CONFIG)
    assert spark.read.parquet(f"{out}/reports").select("report_day").distinct().count() == before


def test_read_snapshots_json(spark):
    d = fresh("snap")
    recs = [
        {"crawl_id": 1, "crawl_ts": "2024-01-01T00:00:00Z", "platform_id": "a", "status": "success",
         "items": [{"title": " A ", "url": "u"}, {"title": 5}, {"title": {"x": 1}}, {"title": None}, {"title": "5"}]},
        {"crawl_id": 1, "crawl_ts": "2024-01-01T00:00:00Z", "platform_id": "b", "status": "error", "items": None},
    ]
    with open(os.path.join(d, "s.json"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in recs))
    s = tables.read_snapshots(spark, d)
    assert s.count() == 2 and tables.accepted(s).count() == 1
    items = s.where("platform_id = 'a'").first()["items"]
    assert [x["title"] for x in items] == [" A ", None, None, None, "5"]  # a title that is no string is no title


def test_rules_default_and_saved(spark):
    groups = lambda t: [r["group_key"] for r in rules.load_rules(spark, rules.effective_rules(t))[0].orderBy("group_ord").collect()]
    assert groups("") == groups(None) and len(groups("")) > 2
    path = fresh("rules") + "/r"
    rules.save_rules(spark, "alpha\n\nbeta", path)
    assert groups(rules.stored_rules(spark, path)) == ["alpha", "beta"]
    with pytest.raises(ValueError):
        rules.load_rules(spark, "x" * (2 << 20))


def test_appends_and_retention(spark):
    d = fresh("logs")
    rec = spark.createDataFrame([(datetime(2024, 1, 1, 16, 30), "m", "x", 5)], schemas.TOKEN_LOG)
    tables.append_token_log(rec, f"{d}/tok")
    tables.append_token_log(rec, f"{d}/tok")
    assert [r["day"] for r in spark.read.parquet(f"{d}/tok").collect()] in ([20240102] * 2, ["20240102"] * 2)
    tr = spark.createDataFrame([("h", "t", datetime(2024, 1, 1))], schemas.TRANSLATIONS)
    tables.append_translations(tr, f"{d}/tr")
    assert spark.read.parquet(f"{d}/tr").count() == 1
    for table, days in CFG.retention_days.items():
        as_of = lambda n: F.lit(datetime(2024, 1, 1) + timedelta(days=n)).cast("timestamp")
        assert tables.expire(tr, table, "written_ts", as_of(days - 0.5), CFG).count() == 1
        assert tables.expire(tr, table, "written_ts", as_of(days), CFG).count() == 0


def test_day_keys_in_another_session_zone(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1, 16, 30))], "crawl_id long, crawl_ts timestamp")
    items = df.withColumn("appearances", F.lit(1))
    utc = report.report_totals(items, CFG).first()
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        other = report.report_totals(items, CFG).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (utc["report_day"], utc["generate_time"]) == (other["report_day"], other["generate_time"]) == ("20240102", "00时30分")


def test_scratch_folder_needs_a_local_master():
    from types import SimpleNamespace

    from headline_engine.session import ensure_checkpoint_dir

    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="yarn")
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d: d)))
