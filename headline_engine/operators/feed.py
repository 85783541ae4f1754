"""Feed operators: explode responses (P1-P3), collapse repeated placements (A1), score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headline_engine.config import EngineConfig
from headline_engine.functions.score import weight
from headline_engine.functions.text import clean_title

OK_STATUS = ("success", "cache")


def ok_snapshots(snapshots: DataFrame) -> DataFrame:
    """Responses with an accepted status and an items array (an empty array is ok)."""
    return snapshots.where(F.col("status").isin(*OK_STATUS) & F.col("items").isNotNull())


def explode_feed(snapshots: DataFrame) -> DataFrame:
    """One row per valid item; rank counts every raw position, titles trimmed."""
    ok = ok_snapshots(snapshots)
    return ok.select(
        "crawl_id", "crawl_ts", "platform_id", F.posexplode("items").alias("pos", "item")
    ).select(
        "crawl_id",
        "crawl_ts",
        "platform_id",
        (F.col("pos") + 1).cast("int").alias("rank"),
        clean_title(F.col("item.title")).alias("title"),
        F.coalesce(F.col("item.url"), F.lit("")).alias("url"),
        F.coalesce(F.col("item.mobileUrl"), F.lit("")).alias("mobile_url"),
    ).where(F.col("title").isNotNull() & (F.col("title") != ""))


def collapse_items(snapshots: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """A1 inside each response row: every placement of a (crawl, platform, title)
    comes from one snapshot row, so the collapse needs no shuffle.

    Items are tagged with their raw position, invalid titles dropped, sorted by
    (title, rank); run starts give one group per title with ranks ascending and
    the url of the first placement. All steps are linear array functions after
    the sort.
    """
    ok = ok_snapshots(snapshots)
    tagged = F.transform(
        "items",
        lambda x, i: F.struct(
            clean_title(x["title"]).alias("title"),
            (i + 1).cast("int").alias("rank"),
            F.coalesce(x["url"], F.lit("")).alias("url"),
            F.coalesce(x["mobileUrl"], F.lit("")).alias("mobile_url"),
        ),
    )
    step1 = ok.select(
        "crawl_id", "crawl_ts", "platform_id",
        F.array_sort(F.filter(tagged, lambda x: x["title"] != "")).alias("_s"),
    )
    starts = F.filter(
        F.transform(
            "_s",
            lambda x, i: F.when(F.coalesce(x["title"] != F.get("_s", i - 1)["title"], F.lit(True)), i).otherwise(F.lit(-1)),
        ),
        lambda i: i >= 0,
    )
    step2 = step1.select("crawl_id", "crawl_ts", "platform_id", "_s", starts.alias("_st"))
    groups = F.transform(
        "_st",
        lambda s, k: F.slice(
            "_s",
            s + 1,
            F.coalesce(F.get("_st", k + 1), F.size("_s")) - s,
        ),
    )
    step3 = step2.select("crawl_id", "crawl_ts", "platform_id", F.explode(groups).alias("_g"))
    return headline_columns(
        step3.select(
            "crawl_id", "crawl_ts", "platform_id",
            F.col("_g")[0]["title"].alias("title"),
            F.transform("_g", lambda g: g["rank"]).alias("ranks"),
            F.col("_g")[0]["url"].alias("url"),
            F.col("_g")[0]["mobile_url"].alias("mobile_url"),
        ),
        cfg,
    )


def headline_columns(df: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """P9-P10 from a ranks array: appearances, first rank, rank sum, hot-rank count, weight."""
    ranks = F.col("ranks")
    return (
        df.withColumn("appearances", F.size(ranks))
        .withColumn("first_rank", F.array_min(ranks))
        .withColumn("rank_sum", F.aggregate(ranks, F.lit(0).cast("bigint"), lambda a, x: a + x))
        .withColumn("top_count", F.size(F.filter(ranks, lambda r: r <= cfg.hotness_rank)))
        .withColumn("weight", weight("appearances", "rank_sum", "top_count", cfg))
    )


def collapse_rows(feed: DataFrame, cfg: EngineConfig = EngineConfig()) -> DataFrame:
    """A1 over item rows that are not grouped by response (e.g. pages).

    Aggregates are algebraic (count, sum, count_if, min, min_by), so a title
    repeated very often combines map-side before the shuffle; no rank list is
    collected.
    """
    agg = feed.groupBy("crawl_id", "crawl_ts", "platform_id", "title").agg(
        F.count(F.lit(1)).cast("int").alias("appearances"),
        F.min("rank").alias("first_rank"),
        F.sum("rank").cast("bigint").alias("rank_sum"),
        F.count_if(F.col("rank") <= cfg.hotness_rank).cast("int").alias("top_count"),
        F.min_by("url", "rank").alias("url"),
        F.min_by("mobile_url", "rank").alias("mobile_url"),
    )
    return agg.withColumn("weight", weight("appearances", "rank_sum", "top_count", cfg))


def with_platforms(headlines: DataFrame, platforms: DataFrame) -> DataFrame:
    """Registry order and display name (name, else id). The registry is a
    small dimension; AQE turns the join into a broadcast once its size is measured."""
    p = platforms.select("platform_id", "platform_ord", F.col("source").alias("_name"))
    return (
        headlines.join(p, "platform_id", "left")
        .withColumn("source", F.coalesce(F.col("_name"), F.col("platform_id")))
        .drop("_name")
    )
