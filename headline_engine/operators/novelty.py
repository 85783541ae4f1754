"""Novelty against a rolling history (W3, J3, ST3, W7, W8, A7, A9).

History holds, per crawl, the distinct titles of that crawl's report; an item is
new at crawl time T iff its key was not seen in (T - 7 d, T). With one history
write per crawl this equals: the previous sighting of the key is absent or at
least 7 days earlier.

Skew: a key may be hot (every title without Latin/CJK characters has the empty
key). Windows are therefore partitioned by (key, 7-day bucket), with every
sighting also copied into the next bucket, so `lag` finds the previous sighting
of the same or the previous week (anything older is >= 7 d away). A (key,
bucket) holds at most two weeks of crawls, whatever the key's total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headline_engine.config import EngineConfig


def _secs(col):
    return F.unix_micros(F.col(col).cast("timestamp")) / F.lit(1_000_000)


def previous_sighting(sightings: DataFrame, key: str, ts: str, window_days: int) -> DataFrame:
    """Add `prev_ts`: the latest earlier sighting of `key` if it lies within
    `window_days` (else null). Input rows must be distinct (key, ts).

    Every sighting is also copied into the next window-wide bucket, so one lag
    over (key, bucket) sees the previous bucket's sightings before the bucket's
    own; older sightings are at least a window away. One shuffle, no join, and
    a (key, bucket) holds at most two windows of one key's sightings.
    """
    width = window_days * 86400
    b = F.floor(_secs(ts) / F.lit(width)).cast("bigint")
    df = sightings.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_b", b + F.col("_copy"))
    w = Window.partitionBy(key, "_b").orderBy(ts)
    df = df.withColumn("_lag", F.lag(ts).over(w)).where(F.col("_copy") == 0)
    prev = F.col("_lag")
    within = (_secs(ts) - F.unix_micros(prev.cast("timestamp")) / F.lit(1_000_000)) < F.lit(width)
    return df.withColumn("prev_ts", F.when(prev.isNotNull() & within, prev)).drop("_b", "_lag", "_copy")


def novelty(items: DataFrame, key: str = "title_key", ts: str = "crawl_ts",
            cfg: EngineConfig = EngineConfig(), extra: tuple = ("crawl_id",)) -> DataFrame:
    """Distinct (key, crawl) with `is_new` (first sighting, or gap >= window)."""
    s = items.select(key, ts, *extra).distinct()
    s = previous_sighting(s, key, ts, cfg.history_days)
    return s.withColumn("is_new", F.col("prev_ts").isNull())


def presence_sessions(items: DataFrame, key: str = "title_key", ts: str = "crawl_ts",
                      cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """ST3: (key, first_ts, last_ts, sightings) islands with gaps < window.

    A sighting at T is 'in history' iff first_ts < T < last_ts + window for the
    key's session. Session starts are the new sightings; every sighting is
    assigned the latest start at or before it, found inside its (key, week)
    window or, failing that, from the running maximum of earlier weeks' starts.
    """
    width = cfg.history_days * 86400
    s = novelty(items, key, ts, cfg, extra=()).withColumn("_b", F.floor(_secs(ts) / F.lit(width)).cast("bigint"))
    start = F.when(F.col("is_new"), F.col(ts))
    w_in = Window.partitionBy(key, "_b").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("_start_in", F.max(start).over(w_in))
    per_b = s.groupBy(key, "_b").agg(F.max(start).alias("_bmax"))
    w_key = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_b.withColumn("_carry", F.max("_bmax").over(w_key)).select(key, "_b", "_carry")
    s = s.join(carry, [key, "_b"], "left").withColumn("_sess", F.coalesce("_start_in", "_carry"))
    return s.groupBy(key, F.col("_sess").alias("first_ts")).agg(
        F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("sightings")
    )


def history_rows(report_items: DataFrame) -> DataFrame:
    """What each crawl appends to history: its distinct report titles."""
    from headline_engine.functions.text import title_key

    return report_items.select("crawl_id", "crawl_ts", "title").distinct().withColumn("title_key", title_key("title"))


def history_asof(history: DataFrame, as_of, cfg: EngineConfig = EngineConfig(), exclude_today: bool = False) -> DataFrame:
    """History rows live at `as_of` (strictly newer than as_of - window),
    optionally without rows of the as-of UTC+8 day (manual push)."""
    from headline_engine.functions.timefmt import day_key

    lo = as_of - F.make_interval(days=F.lit(cfg.history_days))
    h = history.where((F.col("crawl_ts") > lo) & (F.col("crawl_ts") <= as_of))
    if exclude_today:
        h = h.where(day_key("crawl_ts", cfg.local_tz) != day_key(as_of, cfg.local_tz))
    return h


def window_distinct_counts(sightings: DataFrame, query_times: DataFrame, key: str, ts: str,
                           cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """Distinct keys with a sighting in (T - window, T) for every T in query_times.

    Uses presence sessions: a key counts at T iff first_ts < T < last_ts + window.
    Session boundaries aggregate to per-time deltas (at most two per crawl time),
    and a running sum over time points answers every T. The running sum goes by
    week: totals of whole weeks are summed first (one row per week of the
    archive), and each week continues from the total before it. No history row
    is replicated per query time.
    """
    sess = presence_sessions(sightings, key, ts, cfg)
    end = F.col("last_ts") + F.make_interval(days=F.lit(cfg.history_days))
    # At one time, sessions end before it is asked for and begin after it (both bounds are open).
    edges = F.array(F.struct(F.col("first_ts").alias("t"), F.lit(2).alias("kind"), F.lit(1).cast("bigint").alias("d")),
                    F.struct(end.alias("t"), F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("d")))
    moves = sess.select(F.explode(edges).alias("e")).groupBy("e.t", "e.kind").agg(F.sum("e.d").alias("d"))
    qs = query_times.select(F.col(ts).alias("t")).distinct().select("t", F.lit(1).alias("kind"), F.lit(0).cast("bigint").alias("d"))
    ev = moves.unionByName(qs).withColumn("_w", F.floor(_secs("t") / F.lit(7 * 86400)).cast("bigint"))
    weeks = ev.groupBy("_w").agg(F.sum("d").alias("_sum"))
    before = Window.orderBy("_w").rowsBetween(Window.unboundedPreceding, -1)
    weeks = weeks.select("_w", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    w = Window.partitionBy("_w").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ev = ev.withColumn("_in", F.sum("d").over(w)).where(F.col("kind") == 1).join(weeks, "_w")
    return ev.select(F.col("t").alias(ts), (F.col("_base") + F.col("_in")).alias("n"))
