"""Keyed-state novelty (ST2): equal to the batch rule for files in any order; the state empties after idle days."""

import random
import tempfile
from datetime import datetime, timedelta

from headline_engine.config import EngineConfig
from headline_engine.streaming import keyed

DAY = 86_400_000_000
T0 = datetime(2024, 1, 1)


def plain(rows):
    """rows (key, crawl, ts): new if no sighting of the key lies in (ts - 7 d, ts)."""
    return sorted((k, c, not any(k == x and timedelta(0) < ts - u < timedelta(days=7) for x, _, u in rows)) for k, c, ts in set(rows))


def test_decide():
    seen = [(0, 1), (3 * DAY, 2), (10 * DAY, 3), (10 * DAY, 4), (20 * DAY, 5)]
    out, waiting, last = keyed.decide(seen, None, 12 * DAY, 7 * DAY)
    assert out == [(1, True), (2, False), (3, True), (4, True)] and waiting == [(20 * DAY, 5)] and last == 10 * DAY
    assert keyed.decide(waiting, last, 20 * DAY, 7 * DAY) == ([(5, True)], [], 20 * DAY)


def test_any_file_layout_equals_the_batch_rule_and_state_expires(spark):
    rnd = random.Random(1)
    rows = [(k, c, T0 + timedelta(hours=12 * c)) for c in range(70) for k in ["", "often", "half", "seldom", "once"]
            if k in ("", "often") or k == "half" and c % 17 == 0 or k == "seldom" and c % 14 == 3 or (k, c) == ("once", 9)]
    base = tempfile.mkdtemp(prefix="hl-keyed-")
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):  # crawls of a run come in any order, over several files
        part = [part[i] for i in sorted(range(len(part)), key=lambda i: part[i][1] + rnd.uniform(0, 12))]
        spark.createDataFrame(part + part[:3], keyed.SIGHTINGS).repartition(3).write.mode("append").parquet(f"{base}/src")
        q = keyed.run_novelty_state(spark, f"{base}/src", f"{base}/out", EngineConfig(), files_per_trigger=100)
    read = lambda: sorted((r["title_key"], r["crawl_id"], r["is_new"]) for r in spark.read.parquet(f"{base}/out").collect())
    assert 0 < len(read()) < len(rows)  # the last days wait for the watermark
    assert q.lastProgress.stateOperators[0].numRowsTotal > 0
    for day in (35 + 8, 35 + 16):  # idle days: only the clock
        spark.createDataFrame([(None, None, T0 + timedelta(days=day))], keyed.SIGHTINGS).write.mode("append").parquet(f"{base}/src")
        q = keyed.run_novelty_state(spark, f"{base}/src", f"{base}/out", EngineConfig())
    assert read() == plain(rows)
    assert q.lastProgress.stateOperators[0].numRowsTotal == 0


def test_keys_share_states(spark):
    """states (and with them calls) go with the buckets, not with the keys; ids of any size or null stay exact."""
    keys = [f"k{i}" for i in range(keyed.BUCKETS + 500)]
    rows = [(k, (1 << 60) + c, T0 + timedelta(days=c)) for i, k in enumerate(keys) for c in ((0, 3), (0, 7), (2, 3))[i % 3]]
    rows += [("k0", None, T0 + timedelta(days=3)), ("unknown", None, T0 + timedelta(days=1)), ("unknown", None, T0 + timedelta(days=20))]
    base = tempfile.mkdtemp(prefix="hl-keyed-")
    spark.createDataFrame(rows + rows[:5], keyed.SIGHTINGS).repartition(2).write.parquet(f"{base}/src")
    q = keyed.run_novelty_state(spark, f"{base}/src", f"{base}/out", EngineConfig())
    assert max(p.stateOperators[0].numRowsTotal for p in q.recentProgress) <= keyed.BUCKETS < len(keys)
    spark.createDataFrame([(None, None, T0 + timedelta(days=40))], keyed.SIGHTINGS).write.mode("append").parquet(f"{base}/src")
    q = keyed.run_novelty_state(spark, f"{base}/src", f"{base}/out", EngineConfig())
    got = [(r["title_key"], r["crawl_id"], r["is_new"]) for r in spark.read.parquet(f"{base}/out").collect()]
    by_key = {}
    for k, c, ts in set(rows):
        by_key.setdefault(k, []).append((k, c, ts))
    want = [(k, c, not any(timedelta(0) < ts - u < timedelta(days=7) for _, _, u in own)) for own in by_key.values() for k, c, ts in own]
    order = lambda r: (r[0], r[1] is None, r[1] or 0, r[2])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert q.lastProgress.stateOperators[0].numRowsTotal == 0
