"""Committed day tables (S5-S12): one commit for several tables, folders by day, retention; the bucketed translation cache."""

import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from headline_engine.config import EngineConfig
from headline_engine.operators import language
from headline_engine.sources import tables
from headline_engine.sources.daytables import Change, DayTables
from headline_engine.sources.translations import TranslationCache

SCHEMA = "crawl_id long, ts timestamp, x string"
T0 = datetime(2024, 1, 1)


def rows(spark, crawls, x="a"):
    return spark.createDataFrame([(c, T0 + timedelta(hours=2 * c), x) for c in crawls], SCHEMA).withColumn("day", F.date_format("ts", "yyyyMMdd"))


def change(df, table="t"):
    return Change(table, df, tables.days_of(df, "day"), (["crawl_id"], df), sort=["crawl_id"])


def got(store, table="t", **k):
    return sorted((r["crawl_id"], r["x"]) for r in store.read(table, SCHEMA, **k).collect())


def test_commit_is_visible_as_a_whole_and_reruns_replace(spark, monkeypatch):
    store = DayTables(spark, tempfile.mkdtemp(prefix="hl-days-"))
    assert got(store) == []
    store.commit([change(rows(spark, range(30))), change(rows(spark, range(30)), "u")], {"epoch": 0})
    store.commit([change(rows(spark, range(12, 20), "b"))], {"epoch": 1})  # in the middle of two days
    want = [(c, "b" if 12 <= c < 20 else "a") for c in range(30)]
    assert got(store) == want and got(store, "u") == [(c, "a") for c in range(30)]
    assert [c for c, _ in got(store, lo="20240102", hi="20240102")] == list(range(12, 24))
    with monkeypatch.context() as m:
        m.setattr(DayTables, "_publish", lambda self, x: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            store.commit([change(rows(spark, range(40), "c")), change(rows(spark, range(40), "c"), "u")], {"epoch": 2})
    assert got(store) == want and store.manifest().notes == {"epoch": 1}
    store.commit([change(rows(spark, [1], "d"), "u")])  # takes the killed commit's number: what it left is overwritten or gone
    assert got(store) == want and got(store, "u")[1] == (1, "d")
    # Stale writer: its number is taken.
    old = store.manifest()
    monkeypatch.setattr(store, "manifest", lambda name=None: old if name is None else DayTables.manifest(store, name))
    DayTables(spark, store.root).commit([])
    with pytest.raises(RuntimeError):
        store.commit([])


def test_many_crawls_make_a_folder_a_day(spark):
    """1,000 crawls in five commits, one of them a rerun: at most a folder per day."""
    store = DayTables(spark, tempfile.mkdtemp(prefix="hl-days-"))
    for part in (range(0, 300), range(300, 305), range(305, 900), range(300, 310), range(900, 1000)):
        store.commit([change(rows(spark, part))])
    folders = [d for v in store._children("t") if v.startswith("v=") for d in store._children("t", v) if d.startswith("day=")]
    assert len(folders) == len(store.days("t")) == 84 and [c for c, _ in got(store)] == list(range(1000))


def test_retention_drops_days_and_filters_the_border(spark):
    store = DayTables(spark, tempfile.mkdtemp(prefix="hl-days-"))
    store.commit([change(rows(spark, range(100))), change(rows(spark, range(100)), "u")])
    as_of = F.lit(T0 + timedelta(hours=198)).cast("timestamp")
    schema = rows(spark, [1]).drop("day").schema
    day = lambda c: F.date_format(c, "yyyyMMdd")
    store.expire({"t": ("ts", 2), "u": ("ts", 5)}, as_of, day, {"t": schema, "u": schema})
    assert [c for c, _ in got(store)] == list(range(76, 100)) and [c for c, _ in got(store, "u")] == list(range(40, 100))
    assert store.days("t")[0] == "20240107"
    seq = store.manifest().seq
    store.expire({"none": ("ts", 2)}, as_of, day, {})
    assert store.manifest().seq == seq


def test_bucketed_cache_is_not_shuffled_and_compaction_keeps_what_can_be_seen(spark):
    cfg = EngineConfig()
    path = tempfile.mkdtemp(prefix="hl-cache-")
    cache = TranslationCache(spark, path, buckets=4)
    h = lambda t: F.sha2(F.lit(t), 256)
    row = lambda t, s, d: spark.range(1).select(h(t).alias("text_hash"), F.lit(s).alias("translated"), F.lit(T0 + timedelta(days=d)).alias("written_ts"))
    items = spark.createDataFrame([(c, T0 + timedelta(days=d), t) for c, d in ((1, 10), (2, 20), (3, 60)) for t in ("big news", "old news", "no news")],
                                  "crawl_id long, crawl_ts timestamp, title string")
    raw = row("big news", "one", 1).unionByName(row("big news", "two", 8)).unionByName(row("big news", "three", 15)).unionByName(row("old news", "gone", -40))
    assert language.translate(items, cache.read(), cfg).where("hit").count() == 0
    cache.append(raw)
    cache.compact(F.lit(T0 + timedelta(days=10)), cfg)
    show = lambda df: sorted((r["crawl_id"], r["title"], r["display_title"]) for r in df.collect())
    assert show(language.translate(items, cache.read(), cfg)) == show(language.translate(items, raw, cfg))
    assert sorted(r["translated"] for r in cache.read().collect()) == ["three", "two"]
    cache.append(row("no news", "late", 55))
    again = TranslationCache(spark, path, buckets=4)
    again.compact(F.lit(T0 + timedelta(days=60)), cfg)
    assert [r["translated"] for r in again.read().collect()] == ["late"]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = language.live_cache(items, again.read(), cfg)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    scan = plan[plan.index("SortMergeJoin") :].split("FileScan")[0]
    cache_side = scan.split("Scan ExistingRDD")[-1]
    assert "Bucketed: true" in plan and "Exchange" not in cache_side, plan
