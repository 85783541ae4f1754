"""Keyed-state novelty (ST2): a state of title keys, each refreshed by every sighting and expired in event time.

Sightings (title_key, crawl_id, crawl_ts) arrive in files of any layout. The watermark lies DELAY days behind the newest
crawl seen; sightings behind it are late and dropped by the stream. A key's sightings wait in its state, in time order,
until the watermark reaches them, so their decisions do not depend on the order of arrival: a sighting is new if the one
before it lies a window or more back (W3). A key's state ends at `last_seen + window`; every sighting moves that on.

A call of the state function costs milliseconds whatever it holds, so keys share states: a state holds the keys of one
bucket of their hash, and is called once a micro-batch for all of them, not once a key. Its timeout is set to the first
sighting that waits in it, or else to the end of its last key's window; keys whose window is over are dropped whenever it is
called. So the state holds the keys of two windows and one delay at most, whatever the length of the stream.

A row without a key is a clock: it moves the watermark and has no other effect (a crawl that reports nothing still tells
the time).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

import headline_engine
from headline_engine.config import EngineConfig

cloudpickle.register_pickle_by_value(headline_engine)

SIGHTINGS = "title_key string, crawl_id long, crawl_ts timestamp"
#: How far behind the newest crawl a sighting may arrive (days).
DELAY = 7
#: States that the title keys share. A checkpoint holds on to its number: a stream that goes on has to keep it.
BUCKETS = 1024
_OUT = "title_key string, crawl_id long, is_new boolean"
_STATE = "keys array<string>, last array<long>, at array<array<long>>, ids array<array<long>>"
_CLOCK = -1  # no bucket has this number


def decide(waiting: list[tuple[int, int]], last: int | None, ready: int, window: int) -> tuple[list[tuple[int, bool]], list[tuple[int, int]], int | None]:
    """(decisions (crawl_id, is_new), what still waits, last sighting) of a key whose sightings up to `ready` are complete;
    all times in microseconds. Crawls of one time see the same past."""
    out, before = [], last
    waiting = sorted(set(waiting), key=lambda w: (w[0], w[1] is not None, w[1]))
    n = sum(ts <= ready for ts, _ in waiting)
    for ts, crawl in waiting[:n]:
        if last is None or ts > last:
            before, last = last, ts
        out.append((crawl, before is None or last - before >= window))
    return out, waiting[n:], last


def _step(window: int):
    def step(bucket: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if bucket[0] == _CLOCK:
            return
        held = {k: (last, list(zip(at, ids))) for k, last, at, ids in zip(*state.get)} if state.exists else {}
        for pdf in pdfs:
            if not state.hasTimedOut:
                for k, ts, crawl, known in zip(*(pdf[c].tolist() for c in ("title_key", "us", "id", "known"))):
                    held.setdefault(k, (None, []))[1].append((ts, crawl if known else None))
        mark = state.getCurrentWatermarkMs()
        out, kept = [], []
        for k, (last, waiting) in held.items():
            decided, waiting, last = decide(waiting, last, mark * 1000, window)
            out += ((k, crawl, new) for crawl, new in decided)
            if waiting or mark * 1000 < last + window - 1000:
                kept.append((k, last, [ts for ts, _ in waiting], [crawl for _, crawl in waiting]))
        if out:
            keys, crawls, new = zip(*out)
            yield pd.DataFrame({"title_key": keys, "crawl_id": pd.Series(crawls, dtype=object), "is_new": new})
        if not kept:
            state.remove()
            return
        state.update(tuple(map(list, zip(*kept))))
        over = min((at[0] for _, _, at, _ in kept if at), default=None)
        if over is None:
            over = max(last for _, last, _, _ in kept) + window
        state.setTimeoutTimestamp(max(mark + 1, -(-over // 1000) - 1))

    return step


def novelty_state(sightings: DataFrame, cfg: EngineConfig = EngineConfig(), delay_days: int = DELAY, buckets: int = BUCKETS) -> DataFrame:
    """(title_key, crawl_id, is_new) of a stream of sightings (append mode)."""
    # Clock rows pass as a bucket of their own: a filter on the key would be pushed below the watermark, which they have to move.
    # An id and whether it is known go apart, as pandas would turn ids beside a null into doubles.
    s = sightings.withWatermark("crawl_ts", f"{delay_days} days").select(
        F.when(F.col("title_key").isNull(), _CLOCK).otherwise(F.pmod(F.xxhash64("title_key"), F.lit(buckets)).cast("int")).alias("bucket"),
        "title_key", "crawl_ts", F.unix_micros("crawl_ts").alias("us"),
        F.coalesce("crawl_id", F.lit(0)).alias("id"), F.col("crawl_id").isNotNull().alias("known"))
    return s.groupBy("bucket").applyInPandasWithState(_step(cfg.history_days * 86_400_000_000), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_novelty_state(spark: SparkSession, src: str, out: str, cfg: EngineConfig = EngineConfig(), files_per_trigger: int = 16, delay_days: int = DELAY):
    """Decide all sightings available now into `out` (parquet, exactly once by the file sink) and return the query, whose
    lastProgress tells the state's size. Sightings that the watermark has not reached wait for the next run."""
    stream = spark.readStream.schema(SIGHTINGS).option("maxFilesPerTrigger", files_per_trigger).parquet(src)
    q = (novelty_state(stream, cfg, delay_days).writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", f"{out}_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return q
