"""Adapters from the driver tables to the engine's input tables (FIXTURES §2).

documents -> snapshots   one document = one platform response, one line = one item
pages     -> feed rows   <title> text per page, host = platform, ordered by page_id
events    -> token_log / push_log / crawl times
conversations -> report_text
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headline_engine.functions.timefmt import from_utc_wall

# Fixed values of the adapter: crawl epoch and spacing.
CRAWL_EPOCH_SECONDS = 1704067200  # 2024-01-01 00:00:00 UTC
CRAWL_SPACING_SECONDS = 12 * 3600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one numbering task holds.
ROWS_PER_BUCKET = 500_000


def _bucket(x: F.Column, bounds: list, lo: int, hi: int) -> F.Column:
    """Number of bounds at or below x, by binary search (log2 comparisons a row)."""
    if lo == hi:
        return F.lit(lo)
    m = (lo + hi) // 2
    return F.when(x >= F.lit(bounds[m]), _bucket(x, bounds, m + 1, hi)).otherwise(_bucket(x, bounds, lo, m))


def ordinal_within(df: DataFrame, key: str, order: str, buckets: int | None = None, keep: tuple = ()) -> DataFrame:
    """Return (key, order, keep..., ordinal): 1-based row number of `order` within `key`.

    A window partitioned by `key` alone runs each key in one task, so a key
    holding a third of the rows would stall. Rows are first cut into
    `order`-range buckets (approximate quantiles; exactness does not depend on
    them), numbered inside (key, bucket), and shifted by the row counts of the
    earlier buckets of the same key. Only (key, order, keep) is shuffled.
    """
    spark = df.sparkSession
    narrow = df.select(key, order, *keep)
    # One bucket per ROWS_PER_BUCKET rows (the shuffle partitions at least), with quantile errors well under a bucket.
    nb = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-narrow.count() // ROWS_PER_BUCKET))
    bounds = sorted(set(narrow.approxQuantile(order, [i / nb for i in range(1, nb)], 1 / (8 * nb)))) if nb > 1 else []
    bucket = _bucket(F.col(order), bounds, 0, len(bounds))
    narrow = narrow.withColumn("_b", bucket)
    counts = narrow.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rn = F.row_number().over(Window.partitionBy(key, "_b").orderBy(order))
    return (
        narrow.withColumn("_rn", rn)
        .join(offsets, [key, "_b"])
        .select(key, order, *keep, (F.col("_off") + F.col("_rn")).cast("bigint").alias("ordinal"))
    )


def crawl_ts_of(crawl_id) -> F.Column:
    c = F.col(crawl_id) if isinstance(crawl_id, str) else crawl_id
    return F.timestamp_seconds(F.lit(CRAWL_EPOCH_SECONDS) + (c - F.lit(1)) * F.lit(CRAWL_SPACING_SECONDS))


def platforms_from_sources(df: DataFrame, col: str = "source") -> DataFrame:
    """M1 from the distinct sources: platform_ord = order of the id as text; name = id.
    The ordering window runs over the distinct platforms only (a registry-sized dimension)."""
    distinct = df.select(F.col(col).alias("platform_id")).where(F.col("platform_id").isNotNull()).distinct()
    return distinct.select(
        F.row_number().over(Window.orderBy("platform_id")).cast("int").alias("platform_ord"),
        "platform_id",
        F.col("platform_id").alias("source"),
    )


def _items(text: str) -> F.Column:
    return F.transform(
        F.split(F.col(text), "\n"),
        lambda line: F.struct(line.alias("title"), F.lit("").alias("url"), F.lit("").alias("mobileUrl")),
    )


def documents_crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES §2.1: (platform_id, doc_id, crawl_id, crawl_ts, has_items); crawl_id = row number per source by doc_id,
    12 h apart from 2024-01-01. No text but its being there is read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").isNotNull().alias("has_items"))
    ords = ordinal_within(docs, "source", "doc_id", keep=("has_items",))
    return ords.select(F.col("source").alias("platform_id"), "doc_id", F.col("ordinal").alias("crawl_id"), crawl_ts_of("ordinal").alias("crawl_ts"), "has_items")


def documents_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The responses as they are scanned: snapshots whose crawl_id is still the doc_id and whose crawl_ts is null."""
    return table(spark, sf_dir, "documents").where(F.col("source").isNotNull()).select(
        F.col("doc_id").alias("crawl_id"), F.lit(None).cast("timestamp").alias("crawl_ts"), F.col("source").alias("platform_id"),
        F.lit("success").alias("status"), _items("text").alias("items"))


def documents_snapshots(spark: SparkSession, sf_dir: str, crawls: DataFrame | None = None) -> DataFrame:
    """The responses with their crawl (documents_crawls())."""
    crawls = documents_crawls(spark, sf_dir) if crawls is None else crawls
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("platform_id"), "text")
    return docs.join(crawls.drop("has_items"), ["platform_id", "doc_id"]).select(
        "crawl_id", "crawl_ts", "platform_id", F.lit("success").alias("status"), _items("text").alias("items"))


def documents_platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return platforms_from_sources(table(spark, sf_dir, "documents"), "source")


def pages_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES §2.3: one crawl; platform = url host; rank = position by page_id within host."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        "url",
        F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1).alias("platform_id"),
        F.regexp_extract(F.col("html"), r"(?is)<title[^>]*>(.*?)</title>", 1).alias("raw_title"),
    )
    from headline_engine.functions.text import clean_title

    pages = pages.withColumn("title", clean_title("raw_title")).drop("raw_title")
    ords = ordinal_within(pages, "platform_id", "page_id")
    return pages.join(ords, ["platform_id", "page_id"]).select(
        F.lit(1).cast("bigint").alias("crawl_id"),
        crawl_ts_of(F.lit(1)).alias("crawl_ts"),
        "platform_id",
        F.col("ordinal").cast("int").alias("rank"),
        "title",
        F.col("url"),
        F.lit("").alias("mobile_url"),
    )


def events_token_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES §2.3: ts, module = event_type, total_tokens = floor(value)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        from_utc_wall("ts").alias("ts"),
        F.col("event_type").alias("module"),
        F.lit("driver").alias("model"),
        F.floor(F.col("value")).cast("bigint").alias("total_tokens"),
        F.col("event_id"),
    )


def events_push_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES §2.3: purchase events are pushes; push_ts = ts, report_type = event_type."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    return ev.select(from_utc_wall("ts").alias("push_ts"), F.col("event_type").alias("report_type"), "event_id")


def conversations_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FIXTURES §2.3: each conversation turn is one report body."""
    cv = table(spark, sf_dir, "conversations")
    return cv.select("conv_id", "turn", F.col("text").alias("body"))


def benchmark_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translation cache stand-in: one row per line of a benchmark passage (passages also
    occur as document lines, so some headlines hit it). The cached value is the quoted upper-cased
    passage, written item_id hours before the crawl epoch (live for the first 30 days of
    crawls, so the TTL is exercised too)."""
    from headline_engine.functions.text import clean_title

    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", "\n")).alias("line"))
    t = clean_title("line")
    b = b.where(t != "")
    return b.select(
        F.sha2(t, 256).alias("text_hash"),
        F.concat(F.lit('"'), F.upper(t), F.lit('"')).alias("translated"),
        F.timestamp_seconds(F.lit(CRAWL_EPOCH_SECONDS) - F.col("item_id") * F.lit(3600)).alias("written_ts"),
    )


def calendar(spark: SparkSession, rows) -> DataFrame:
    """M10 calendar dimension from (day, status) pairs."""
    return spark.createDataFrame([(d, s) for d, s in rows], "day string, status string").select(
        F.to_date("day").alias("day"), "status")
