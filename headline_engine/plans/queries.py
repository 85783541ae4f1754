"""Named queries over the driver tables: each takes (spark, sf_dir) -> DataFrame.

Every query reads the driver tables through the adapters, so its work grows
with them. Computed columns are aliased to the names used by the oracle SQL;
doubles are rounded to 9 places and timestamps rendered as text so both engines
print the same values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headline_engine.config import DRIVER_CALENDAR, DRIVER_CONFIG, EngineConfig
from headline_engine.functions.timefmt import ts_text
from headline_engine.functions.text import title_key, tokens
from headline_engine.operators import dedup, feed, language, logs, match, messages, novelty as nov, report, review, simjoin
from headline_engine.functions.text import escape_html, is_english, mode_label, report_line, strip_markdown
from headline_engine.functions.timefmt import day_key, from_utc_wall
from headline_engine.session import written
from headline_engine.sources import adapters as A
from headline_engine.sources.rules import group_caps, load_rules

CFG = DRIVER_CONFIG


def _r(col, places: int = 9):
    return F.round(F.col(col) if isinstance(col, str) else col, places)


# ---------------------------------------------------------------- building blocks
# Base frames are built once per (session, tables, config) and reused inside a
# query, so a plan that reads the report items several times shares one
# subtree; every registered query call starts with an empty memo. The report items (bounded by caps x crawls) are written to the
# session's checkpoint folder, which also cuts their lineage.

_MEMO: dict = {}


def reset_memo() -> None:
    _MEMO.clear()


def _memo(kind: str, spark: SparkSession, sf_dir: str, cfg: EngineConfig, build):
    key = (kind, spark.sparkContext.applicationId, sf_dir, repr(cfg))
    if key not in _MEMO:
        _MEMO[key] = build()
    return _MEMO[key]


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo("snapshots", spark, sf_dir, CFG, lambda: A.documents_snapshots(spark, sf_dir, crawl_numbers(spark, sf_dir)))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshots without their items' text (S3 needs to know only that there are any)."""
    return crawl_numbers(spark, sf_dir).select("crawl_id", "crawl_ts", "platform_id", F.lit("success").alias("status"), F.col("has_items").alias("answered"))


def platforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo("platforms", spark, sf_dir, CFG, lambda: A.documents_platforms(spark, sf_dir))


def headlines(spark: SparkSession, sf_dir: str, cfg: EngineConfig = CFG) -> DataFrame:
    """M3 rows: collapsed per (crawl, platform, title) with registry order and name."""
    return _memo("headlines", spark, sf_dir, cfg, lambda: feed.with_platforms(
        feed.collapse_items(snapshots(spark, sf_dir), cfg), platforms(spark, sf_dir)))


def crawl_sizes(spark: SparkSession, sf_dir: str, cfg: EngineConfig = CFG) -> DataFrame:
    """(crawl_id, _n): the headlines of each crawl, counted on the scan, so no text is shuffled for it."""
    per = feed.collapse_items(A.documents_responses(spark, sf_dir), cfg).groupBy("platform_id", F.col("crawl_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("_n"))
    return per.join(crawl_numbers(spark, sf_dir), ["platform_id", "doc_id"]).groupBy("crawl_id").agg(F.sum("_n").alias("_n"))


def rules_of(spark: SparkSession, cfg: EngineConfig = CFG):
    return _memo("rules", spark, "", cfg, lambda: load_rules(spark, cfg.rules_text))


def crawl_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(platform_id, doc_id, crawl_id, crawl_ts) of every response (written: narrow, and read by many parts of a plan)."""
    return _memo("numbers", spark, sf_dir, CFG, lambda: written(A.documents_crawls(spark, sf_dir)))


def matched_headlines(spark: SparkSession, sf_dir: str, cfg: EngineConfig = CFG) -> DataFrame:
    """The matches of every crawl. Responses are collapsed and matched on the scan, and only what matches meets the crawl
    numbers, so no text is shuffled."""
    rules, filters = rules_of(spark, cfg)
    h = feed.with_platforms(feed.collapse_items(A.documents_responses(spark, sf_dir), cfg), platforms(spark, sf_dir))
    m = match.matched(h, rules, filters).withColumnRenamed("crawl_id", "doc_id").drop("crawl_ts")
    return m.join(crawl_numbers(spark, sf_dir), ["platform_id", "doc_id"]).drop("doc_id")


def capped(spark: SparkSession, sf_dir: str, cfg: EngineConfig = CFG) -> DataFrame:
    """M5 after W1: the per-crawl report items (written)."""
    def build():
        rules, _ = rules_of(spark, cfg)
        return written(match.top_per_group(matched_headlines(spark, sf_dir, cfg), rules, cfg))

    return _memo("capped", spark, sf_dir, cfg, build)


def crawls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawls that have a report: at least one registry platform answered (S3)."""
    return report.crawl_outcome(responses(spark, sf_dir), platforms(spark, sf_dir)).where("has_report").select("crawl_id", "crawl_ts")


def totals_of(spark: SparkSession, sf_dir: str, cfg: EngineConfig = CFG) -> DataFrame:
    return report.report_totals(capped(spark, sf_dir, cfg), cfg, crawls(spark, sf_dir))


# ---------------------------------------------------------------- step 0-1

def q_feed_explode(spark, sf_dir):
    """Valid items with their raw position as rank."""
    items = feed.explode_feed(snapshots(spark, sf_dir))
    items = feed.with_platforms(items, platforms(spark, sf_dir))
    return items.select(
        "crawl_id", ts_text("crawl_ts").alias("crawl_ts"), "platform_ord", "platform_id", "rank", "title"
    )


def q_rank_collapse(spark, sf_dir):
    """Ranks ascending, first rank, appearances, url of the first placement."""
    h = headlines(spark, sf_dir)
    return h.select(
        "crawl_id", "platform_id", "title",
        F.array_join(F.transform("ranks", lambda r: r.cast("string")), ",").alias("ranks"),
        F.col("appearances").cast("bigint").alias("appearances"),
        F.col("first_rank").cast("bigint").alias("first_rank"),
        "url", "mobile_url",
    )


def q_weights(spark, sf_dir):
    """Weight and hot flag per headline."""
    h = headlines(spark, sf_dir)
    return h.select(
        "crawl_id", "platform_id", "title",
        _r("weight").alias("weight"),
        (F.col("appearances") >= CFG.hot_appearances).alias("is_hot"),
    )


def q_match_groups(spark, sf_dir):
    """Every (headline, group) match after the global exclude words."""
    m = matched_headlines(spark, sf_dir)
    return m.select(
        "crawl_id", "platform_id", "source", "title",
        F.col("group_ord").cast("bigint").alias("group_ord"), "group_key",
        _r("weight").alias("weight"),
    )


def q_top_headlines(spark, sf_dir):
    """Top items per (crawl, group key) under the group cap."""
    t = capped(spark, sf_dir)
    return t.select(
        "crawl_id", "group_key",
        F.col("rank_in_group").cast("bigint").alias("rank_in_group"),
        "platform_id", "title",
        _r("weight").alias("weight"),
        F.col("appearances").cast("bigint").alias("appearances"),
        F.col("first_rank").cast("bigint").alias("first_rank"),
    )


# ---------------------------------------------------------------- step 2: report facts

def q_report_totals(spark, sf_dir):
    """Per crawl report header facts."""
    t = totals_of(spark, sf_dir)
    return t.select("crawl_id", "report_day", "report_mode", mode_label("report_mode").alias("mode_label"), "total_news", "hot_news",
                    "generate_date", "generate_time")


def q_group_summary(spark, sf_dir):
    """Per crawl and non-empty group key."""
    rules, _ = rules_of(spark)
    g = report.group_summary(capped(spark, sf_dir), group_caps(rules, CFG.default_cap))
    return g.select(
        "crawl_id", "group_key", "item_count", "heat",
        F.col("group_index").cast("bigint").alias("group_index"),
        F.col("total_groups").cast("bigint").alias("total_groups"),
    )


def q_report_view(spark, sf_dir):
    """Escaped report rows with rank badge and the real W3 `is_new` flag."""
    v = report.report_view(report_items_new(spark, sf_dir), extra=("is_new",))
    return v.select(
        "crawl_id", "group_key", F.col("rank_in_group").cast("bigint").alias("rank_in_group"),
        "source_html", F.col("first_rank").cast("bigint").alias("first_rank"), "rank_badge", "title_html", "url_html",
        "is_new",
    )


def q_report_latest_per_day(spark, sf_dir):
    """The report kept for each UTC+8 day (last crawl of the day)."""
    t = totals_of(spark, sf_dir)
    d = report.latest_per_day(t)
    return d.select("report_day", "crawl_id", "total_news", "hot_news", "generate_date", "generate_time")


def q_crawl_outcome(spark, sf_dir):
    """S3: ok / failed registry platforms per crawl."""
    o = report.crawl_outcome(responses(spark, sf_dir), platforms(spark, sf_dir))
    return o.select("crawl_id", "ok_platforms", "failed_platforms", "has_report")


# ---------------------------------------------------------------- step 3: keys and novelty

def q_title_keys(spark, sf_dir):
    """Distinct titles with key, key length and token counts (both modes)."""
    h = headlines(spark, sf_dir).select("title").distinct()
    k = title_key("title")
    return h.select(
        "title", k.alias("title_key"), F.length(k).cast("bigint").alias("key_len"),
        F.size(tokens("title", k, "reference")).cast("bigint").alias("n_tokens"),
        F.size(tokens("title", None, "word")).cast("bigint").alias("n_words"),
    )


def q_novelty(spark, sf_dir):
    """Is each (key, crawl) new against the rolling 7-day history of all headlines."""
    h = headlines(spark, sf_dir).withColumn("title_key", title_key("title"))
    n = nov.novelty(h, "title_key", "crawl_ts", CFG)
    return n.select("title_key", "crawl_id", "is_new")


def q_presence_sessions(spark, sf_dir):
    """ST3: key presence islands (gap < 7 d) over all headlines."""
    h = headlines(spark, sf_dir).withColumn("title_key", title_key("title"))
    s = nov.presence_sessions(h, "title_key", "crawl_ts", CFG)
    return s.select("title_key", ts_text("first_ts").alias("first_ts"), ts_text("last_ts").alias("last_ts"),
                    F.col("sightings").cast("bigint").alias("sightings"))


def report_items_new(spark, sf_dir, cfg: EngineConfig = CFG):
    """Report items with the key-level novelty of their crawl (history = earlier reports)."""
    c = capped(spark, sf_dir, cfg).withColumn("title_key", title_key("title"))
    n = nov.novelty(c, "title_key", "crawl_ts", cfg).select("title_key", "crawl_id", "is_new")
    return c.join(n, ["title_key", "crawl_id"])


def q_strict_dedup(spark, sf_dir):
    """New report items flattened (key order, rank in group), first per key."""
    c = report_items_new(spark, sf_dir).where("is_new")
    w = Window.partitionBy("crawl_id", "title_key").orderBy("key_ord", "rank_in_group")
    d = c.withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return d.select("crawl_id", "title_key", "title", "group_key", F.col("rank_in_group").cast("bigint").alias("rank_in_group"))


def _as_of(spark, sf_dir):
    """As-of time of the history queries: one hour after the last crawl (a manual push)."""
    last = crawl_numbers(spark, sf_dir).agg(F.max("crawl_ts")).first()[0]
    return F.lit(last).cast("timestamp") + F.expr("INTERVAL 1 HOUR")


def q_history_asof(spark, sf_dir):
    """Distinct live history titles at the as-of time, today's rows excluded."""
    hist = nov.history_rows(capped(spark, sf_dir))
    h = nov.history_asof(hist, _as_of(spark, sf_dir), CFG, exclude_today=True)
    return h.select("title", "title_key").distinct()


def q_history_stats(spark, sf_dir):
    """Live records, total titles and distinct titles of the history at the as-of time."""
    hist = nov.history_rows(capped(spark, sf_dir))
    h = nov.history_asof(hist, _as_of(spark, sf_dir), CFG)
    return h.agg(
        F.count_distinct("crawl_ts").alias("live_records"),
        F.count(F.lit(1)).alias("total_titles"),
        F.count_distinct("title").alias("distinct_titles"),
    )


def new_counts(spark, sf_dir, cfg: EngineConfig = CFG):
    """New report items of every crawl that has a report (0 where nothing matched)."""
    c = report_items_new(spark, sf_dir, cfg).groupBy("crawl_id").agg(F.count_if("is_new").alias("new_items"))
    return crawls(spark, sf_dir).select("crawl_id").join(c, "crawl_id", "left").fillna(0, ["new_items"])


def increment_frame(spark, sf_dir, cfg: EngineConfig = CFG):
    c = report_items_new(spark, sf_dir, cfg)
    per = c.groupBy("crawl_id", "crawl_ts").agg(
        F.count_distinct("title").alias("current_titles"), F.count_if("is_new").alias("new_items"))
    per = crawls(spark, sf_dir).join(per, ["crawl_id", "crawl_ts"], "left").fillna(0, ["current_titles", "new_items"])
    # The first three new items, ranked before they are gathered.
    w = Window.partitionBy("crawl_id").orderBy("key_ord", "rank_in_group")
    top = c.where("is_new").withColumn("_i", F.row_number().over(w)).where("_i <= 3")
    top = top.groupBy("crawl_id").agg(F.sort_array(F.collect_list(F.struct("_i", "title"))).alias("_s"))
    hist = nov.history_rows(capped(spark, sf_dir, cfg)).select("title", "crawl_ts").distinct()
    hn = nov.window_distinct_counts(hist, per.select("crawl_ts"), "title", "crawl_ts", cfg)
    samples = F.array_join(F.transform("_s", lambda x: F.concat(F.substring(x["title"], 1, 30), F.lit("..."))), " | ")
    return per.join(hn, "crawl_ts", "left").join(top, "crawl_id", "left").select(
        "crawl_id", "crawl_ts", F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("history_titles"),
        "current_titles", "new_items", F.coalesce(samples, F.lit("")).alias("samples"),
    )


def q_increment_stats(spark, sf_dir):
    """Per crawl history/current distinct titles, new items, three samples."""
    return increment_frame(spark, sf_dir).drop("crawl_ts")


def q_push_decision(spark, sf_dir):
    """Push iff new items (incremental mode), with the reason text."""
    p = report.push_decision(new_counts(spark, sf_dir), CFG)
    return p.select("crawl_id", "new_items", "push", "push_reason")


def q_crawl_summary(spark, sf_dir):
    """Totals, platform outcome and push decision per crawl."""
    t = totals_of(spark, sf_dir).select("crawl_id", "total_news", "hot_news")
    o = report.crawl_outcome(responses(spark, sf_dir), platforms(spark, sf_dir))
    p = report.push_decision(new_counts(spark, sf_dir), CFG)
    return o.join(t, "crawl_id", "left").join(p, "crawl_id", "left").select(
        "crawl_id", F.coalesce("total_news", F.lit(0)).alias("total_news"), F.coalesce("hot_news", F.lit(0)).alias("hot_news"),
        "ok_platforms", "failed_platforms",
        F.coalesce("push", F.lit(False)).alias("notification_sent"),
        F.coalesce("push_reason", F.lit(report.REASON_NONE)).alias("push_reason"),
    )


# ---------------------------------------------------------------- step 4: similarity

def q_jaccard_pairs(spark, sf_dir):
    """Within-crawl title pairs with token Jaccard above the triage threshold."""
    h = headlines(spark, sf_dir)
    p = simjoin.jaccard_pairs(h, ["crawl_id"], CFG.triage_threshold, CFG, crawl_sizes(spark, sf_dir))
    return p.select("crawl_id", "title_a", "title_b", _r("jaccard").alias("jaccard"))


def q_char_jaccard_pairs(spark, sf_dir):
    """Within-crawl title pairs with character-set Jaccard above the threshold."""
    from dataclasses import replace

    h = headlines(spark, sf_dir)
    p = simjoin.jaccard_pairs(h, ["crawl_id"], CFG.near_dup_threshold, replace(CFG, token_mode="char"), crawl_sizes(spark, sf_dir))
    return p.select("crawl_id", "title_a", "title_b", _r("jaccard").alias("jaccard"))


def q_near_dup_edges(spark, sf_dir):
    """Within-crawl near-duplicate title pairs (hybrid similarity > 0.8, unequal keys)."""
    e = simjoin.near_dup_edges(headlines(spark, sf_dir), ["crawl_id"], CFG, crawl_sizes(spark, sf_dir))
    return e.select("crawl_id", "title_a", "title_b", _r("sim").alias("sim"))


def q_near_dup_edges_global(spark, sf_dir):
    """J5 over the whole table: near-duplicate pairs among all distinct titles."""
    e = simjoin.near_dup_edges(headlines(spark, sf_dir), [], CFG)
    return e.select("title_a", "title_b", _r("sim").alias("sim"))


def dedup_input(spark, sf_dir, cfg: EngineConfig = CFG):
    """G2 input: new report items, first per key in flatten order (W2), with J4 flags (written)."""
    def build():
        c = report_items_new(spark, sf_dir, cfg)
        hist = nov.history_rows(capped(spark, sf_dir, cfg)).select("crawl_ts", "title")
        items = c.where("is_new")
        w = Window.partitionBy("crawl_id", "title_key").orderBy("key_ord", "rank_in_group")
        items = items.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
        return written(simjoin.near_dup_vs_history(written(items), hist, cfg))

    return _memo("dedup_input", spark, sf_dir, cfg, build)


def q_near_dup_vs_history(spark, sf_dir):
    """New items flagged when a 7-day history title is a near duplicate."""
    d = dedup_input(spark, sf_dir)
    return d.select("crawl_id", "title", "hist_dup")


def greedy_frame(spark, sf_dir, cfg: EngineConfig = CFG):
    d = dedup_input(spark, sf_dir, cfg).where(~F.col("hist_dup"))
    return dedup.greedy_dedup(d, cfg)


def q_greedy_dedup(spark, sf_dir):
    """Greedy representative dedup per crawl; slot order of the kept items."""
    g = greedy_frame(spark, sf_dir)
    return g.select("crawl_id", F.col("slot").cast("bigint").alias("slot"), "title", _r("weight").alias("weight"))


def q_simple_dedup(spark, sf_dir):
    """First-wins dedup on character-set Jaccard > 0.8 over each crawl's report items."""
    c = capped(spark, sf_dir)
    s = dedup.simple_dedup(c, CFG)
    return s.select("crawl_id", F.col("pos").cast("bigint").alias("pos"), "title")


def candidate_list(spark, sf_dir, cfg: EngineConfig = CFG):
    """The reviewer's input (G2): the greedy result, its slot as list position (written)."""
    return _memo("candidates", spark, sf_dir, cfg, lambda: written(greedy_frame(spark, sf_dir, cfg).withColumn("pos", F.col("slot"))))


def _history_report_rows(spark, sf_dir, cfg: EngineConfig = CFG):
    return capped(spark, sf_dir, cfg).select("crawl_ts", "title", "key_ord", "rank_in_group")


def q_triage(spark, sf_dir):
    """Ambiguous items (Jaccard > 0.1 with 7-day history or another item) and their ids."""
    flags, _ = review.triage(candidate_list(spark, sf_dir), _history_report_rows(spark, sf_dir), CFG)
    return flags.select("crawl_id", F.col("pos").cast("bigint").alias("pos"), "title", "ambiguous",
                        F.col("item_id").cast("bigint").alias("item_id"))


def q_triage_context(spark, sf_dir):
    """The first 50 related history titles per crawl, in history order."""
    _, ctx = review.triage(candidate_list(spark, sf_dir), _history_report_rows(spark, sf_dir), CFG)
    return ctx.select("crawl_id", F.col("ctx_ord").cast("bigint").alias("ctx_ord"), "title")


def label_verdicts(spark, sf_dir, flags):
    """Verdicts from `labels`: the reviewer removes the ambiguous items that came from a
    response whose document is labelled toxic."""
    docs = A.table(spark, sf_dir, "documents").select("doc_id", "source")
    ords = A.ordinal_within(docs, "source", "doc_id")
    toxic = A.table(spark, sf_dir, "labels").where(F.col("toxic") == 1).select("doc_id")
    resp = toxic.join(ords, "doc_id").select(F.col("ordinal").alias("crawl_id"), F.col("source").alias("source"))
    return flags.where("ambiguous").join(resp, ["crawl_id", "source"]).select("crawl_id", "item_id")


def q_apply_verdicts(spark, sf_dir):
    """Safe items then the ambiguous items the verdicts keep, first per exact title."""
    flags, _ = review.triage(candidate_list(spark, sf_dir), _history_report_rows(spark, sf_dir), CFG)
    final = review.apply_verdicts(flags, label_verdicts(spark, sf_dir, flags))
    return final.select("crawl_id", F.col("final_pos").cast("bigint").alias("final_pos"), "title")


def q_text_report(spark, sf_dir):
    """The pushed text per crawl (header + lines by weight, ties in slot order)."""
    g = greedy_frame(spark, sf_dir)
    totals = totals_of(spark, sf_dir)
    pushed = report_items_new(spark, sf_dir).where("is_new").select("crawl_id")
    t = report.text_report(g, totals, pushed)
    return t.select("crawl_id", F.col("items").cast("bigint").alias("items"), "body")


# ---------------------------------------------------------------- step 5: language

def q_english_titles(spark, sf_dir):
    """P20: distinct titles with the English flag."""
    h = headlines(spark, sf_dir).select("title").distinct()
    return h.select("title", is_english("title").alias("is_english"))


def q_translate_lookup(spark, sf_dir):
    """Every headline with its live cached translation, else the title."""
    c = headlines(spark, sf_dir).select("crawl_id", "crawl_ts", "platform_id", "title")
    t = language.translate(c, A.benchmark_translations(spark, sf_dir), CFG)
    return t.select("crawl_id", "platform_id", "title", "hit", "display_title")


def q_translation_backlog(spark, sf_dir):
    """English headlines with no live cache row at their crawl."""
    c = headlines(spark, sf_dir).select("crawl_id", "crawl_ts", "title")
    b = language.backlog(c, A.benchmark_translations(spark, sf_dir), CFG)
    return b.select("crawl_id", "title", "text_hash")


# ---------------------------------------------------------------- step 6: logs and calendar

def _token_log(spark, sf_dir):
    return A.events_token_log(spark, sf_dir)


def _latest_day(df, ts):
    return df.agg(F.max(day_key(ts, CFG.local_tz))).first()[0]


def q_token_daily(spark, sf_dir):
    """Per UTC+8 day token totals, records and modules."""
    return logs.token_daily(_token_log(spark, sf_dir), CFG).select(
        "day", F.col("total_tokens").cast("bigint").alias("total_tokens"), "records", "modules")


def q_token_total(spark, sf_dir):
    """A5: grand total over the 7 days ending at the latest logged day."""
    tl = _token_log(spark, sf_dir)
    d = logs.last_days(logs.token_daily(tl, CFG), _latest_day(tl, "ts"), 7)
    return d.agg(F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("bigint").alias("total_tokens"),
                 F.count(F.lit(1)).alias("days"))


def q_push_daily(spark, sf_dir):
    """Last push per UTC+8 day over the 7 days ending at the latest push day."""
    pl = A.events_push_log(spark, sf_dir)
    d = logs.last_days(logs.push_daily(pl, CFG), _latest_day(pl, "push_ts"), 7)
    return d.select("day", ts_text("push_ts").alias("push_ts"), "report_type")


def q_schedule_gate(spark, sf_dir):
    """Would a scheduled crawl at each event time run."""
    ev = A.table(spark, sf_dir, "events").select("event_id", from_utc_wall("ts").alias("ts"))
    g = logs.schedule_gate(ev, A.calendar(spark, DRIVER_CALENDAR), "ts", CFG)
    return g.select("event_id", F.col("local_hour").cast("bigint").alias("local_hour"), "is_holiday", "run")


def q_retention(spark, sf_dir):
    """Rows kept per log table as of one day after the last event."""
    tl = _token_log(spark, sf_dir)
    pl = A.events_push_log(spark, sf_dir)
    last = tl.agg(F.max("ts")).first()[0]
    as_of = F.lit(last).cast("timestamp") + F.expr("INTERVAL 1 DAY")
    a = logs.prune(tl, "ts", CFG.retention_days["token_log"], as_of).agg(F.count(F.lit(1)).alias("kept_rows")).withColumn("log", F.lit("token_log"))
    b = logs.prune(pl, "push_ts", CFG.retention_days["push_log"], as_of).agg(F.count(F.lit(1)).alias("kept_rows")).withColumn("log", F.lit("push_log"))
    return a.unionByName(b).select("log", "kept_rows")


def _stored(spark, sf_dir):
    """The six expiring tables of the service as day tables, filled from the driver tables: (store, {table: schema})."""
    from headline_engine.sources import tables
    from headline_engine.sources.daytables import Change, DayTables
    from headline_engine.streaming.stream import scratch_dir

    store = DayTables(spark, scratch_dir(spark, "stored"))
    items = capped(spark, sf_dir).withColumn("crawl_ts", F.col("crawl_ts").cast("timestamp"))
    rep = items.select("crawl_id", "crawl_ts", "group_key", "rank_in_group", "title").withColumn("report_day", day_key("crawl_ts", CFG.local_tz))
    log = lambda name, rows, ts: tables.append_change(name, rows, ts, "all", CFG)
    changes = [
        Change("reports", rep, tables.days_of(rep, "report_day"), by="report_day", sort=["crawl_id", "group_key", "rank_in_group"]),
        tables.history_change(items, items.select("crawl_id", "crawl_ts").distinct(), cfg=CFG),
        log("push_log", A.events_push_log(spark, sf_dir).select("push_ts", "report_type"), "push_ts"),
        log("token_log", _token_log(spark, sf_dir).select("ts", "module", "model", "total_tokens"), "ts"),
        log("translations", A.benchmark_translations(spark, sf_dir), "written_ts"),
        log("calendar", A.calendar(spark, DRIVER_CALENDAR).select(F.col("day").cast("timestamp").alias("day_ts"), "status"), "day_ts"),
    ]
    store.commit(changes)
    return store, {c.table: c.rows.drop(c.by).schema for c in changes}


def q_retention_stored(spark, sf_dir):
    """S12 on six stored tables: what each keeps half a day after its newest row (whole days dropped, the border day filtered)."""
    from headline_engine.sources import tables

    store, types = _stored(spark, sf_dir)
    out = None
    for table, (ts, _, by) in tables.EXPIRING.items():
        last = store.read(table, types[table], by=by).agg(F.max(ts)).first()[0]
        if last is not None:
            tables.expire_stored(store, F.lit(last).cast("timestamp") + F.expr("INTERVAL 12 HOURS"), types, CFG, only=(table,))
        n = store.read(table, types[table], by=by).agg(F.count(F.lit(1)).alias("kept_rows"), F.count_distinct(by).alias("kept_days")).withColumn("log", F.lit(table))
        out = n if out is None else out.unionByName(n)
    return out.select("log", "kept_rows", "kept_days")


def q_report_page(spark, sf_dir):
    """The page rows of every stored day (the last crawl of the day), read back from the stored report."""
    from headline_engine import schemas
    from headline_engine.sources import tables
    from headline_engine.sources.daytables import DayTables
    from headline_engine.streaming.stream import scratch_dir

    out = scratch_dir(spark, "pages")
    items = capped(spark, sf_dir)
    tables.write_report(items, f"{out}/reports", CFG, written(totals_of(spark, sf_dir)))
    stored = DayTables(spark, out).read("reports", schemas.REPORT, by="report_day")
    v = report.report_view(stored, extra=("report_day",))
    return v.select("report_day", "crawl_id", "group_key", F.col("rank_in_group").cast("bigint").alias("rank_in_group"),
                    "source_html", F.col("first_rank").cast("bigint").alias("first_rank"), "rank_badge", "title_html", "url_html")


def q_translate_cached(spark, sf_dir):
    """The lookup against the bucketed cache (the cache side is not shuffled)."""
    from headline_engine.sources.translations import TranslationCache
    from headline_engine.streaming.stream import scratch_dir

    c = headlines(spark, sf_dir).select("crawl_id", "crawl_ts", "platform_id", "title")
    cache = TranslationCache(spark, scratch_dir(spark, "translations"), buckets=8)
    cache.append(A.benchmark_translations(spark, sf_dir))
    cache.compact(F.timestamp_seconds(F.lit(A.CRAWL_EPOCH_SECONDS)), CFG)
    t = language.translate(c, cache.read(), CFG)
    return t.select("crawl_id", "platform_id", "title", "hit", "display_title")


# ---------------------------------------------------------------- step 7: text out

def q_strip_markdown(spark, sf_dir):
    """Every document line, stripped of markdown marks."""
    items = feed.explode_feed(snapshots(spark, sf_dir))
    return items.select("crawl_id", "platform_id", "rank", strip_markdown("title").alias("stripped"))


def q_pack_messages(spark, sf_dir):
    """Conversation turns packed into parts of at most 200 bytes (+ footer)."""
    rt = A.conversations_report_text(spark, sf_dir)
    p = messages.parts(rt, "body", 200, ["conv_id", "turn"])
    return p.select("conv_id", "turn", F.col("part").cast("bigint").alias("part"),
                    F.col("parts").cast("bigint").alias("parts"), "body")


def q_channel_messages(spark, sf_dir):
    """Conversation turns per channel at the channels' own limits and footers."""
    rt = A.conversations_report_text(spark, sf_dir)
    p = messages.channel_messages(rt, "body", ["conv_id", "turn"], CFG)
    return p.select("conv_id", "turn", "channel", F.col("part").cast("bigint").alias("part"),
                    F.col("parts").cast("bigint").alias("parts"), "body")


def q_channel_conversations(spark, sf_dir):
    """G4-G6 on long bodies: a whole conversation as one report per channel (many pass the smallest channel limit)."""
    rt = A.conversations_report_text(spark, sf_dir).groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "body"))), lambda x: x["body"]), "\n").alias("body"))
    p = messages.channel_messages(rt, "body", ["conv_id"], CFG)
    return p.select("conv_id", "channel", F.col("part").cast("bigint").alias("part"), F.col("parts").cast("bigint").alias("parts"), "body")


def q_page_lines(spark, sf_dir):
    """P3, P26, P28 over `pages`: titled feed per host with urls, report lines and escaped titles."""
    h = feed.collapse_rows(A.pages_feed(spark, sf_dir), CFG)
    h = h.where(F.col("title") != "")
    return h.select(
        "platform_id", F.col("first_rank").cast("bigint").alias("first_rank"),
        report_line("first_rank", "title", "url", "platform_id").alias("line"),
        escape_html("title").alias("title_html"), escape_html("url").alias("url_html"),
    )


# ---------------------------------------------------------------- step 8: streaming

def q_stream_novelty(spark, sf_dir):
    """ST1, ST2, ST5: the archive replayed as a file stream in crawl order; per micro-batch
    report items and their novelty against the streaming history table (= batch W3)."""
    from headline_engine.streaming import stream

    base = stream.scratch_dir(spark, "crawl-stream")
    stream.stage_snapshot_files(snapshots(spark, sf_dir), f"{base}/src", batches=3)
    stream.run_crawl_stream(spark, f"{base}/src", f"{base}/out", platforms(spark, sf_dir), CFG, push=False)
    return stream.read_stream(spark, f"{base}/out", "novelty", stream.NOVELTY).select("title_key", "crawl_id", "is_new")


def q_stream_text_report(spark, sf_dir):
    """ST1, A10, T2: the archive replayed as a file stream through all stages of the job; the texts of its commits (= batch)."""
    from headline_engine.streaming import stream

    base = stream.scratch_dir(spark, "crawl-job")
    stream.stage_snapshot_files(snapshots(spark, sf_dir), f"{base}/src", batches=2)
    stream.run_crawl_stream(spark, f"{base}/src", f"{base}/out", platforms(spark, sf_dir), CFG, files_per_trigger=10_000)
    return stream.read_stream(spark, f"{base}/out", "texts", stream.TEXTS).select("crawl_id", F.col("items").cast("bigint").alias("items"), "body")


def q_stream_keyed_novelty(spark, sf_dir):
    """ST2: the report items' sightings replayed as files through keyed state with refreshed expiry (= batch W3)."""
    from headline_engine.streaming import keyed, stream

    base = stream.scratch_dir(spark, "keyed")
    s = written(capped(spark, sf_dir).select(title_key("title").alias("title_key"), "crawl_id", F.col("crawl_ts").cast("timestamp").alias("crawl_ts")).distinct())
    lo, hi = s.agg(F.min("crawl_id"), F.max("crawl_id")).first()
    if lo is not None:
        step = -(-(hi - lo + 1) // 3)
        for a in range(lo, hi + 1, step):
            s.where((F.col("crawl_id") >= a) & (F.col("crawl_id") < a + step)).write.mode("append").parquet(f"{base}/src")
    for days in (2 * keyed.DELAY, 4 * keyed.DELAY):  # the clock goes on after the last crawl: what waits is decided
        tick = s.agg((F.max("crawl_ts") + F.make_interval(days=F.lit(days))).alias("crawl_ts"))
        tick.select(F.lit(None).cast("string").alias("title_key"), F.lit(None).cast("long").alias("crawl_id"), "crawl_ts").write.mode("append").parquet(f"{base}/src")
        keyed.run_novelty_state(spark, f"{base}/src", f"{base}/out", CFG, files_per_trigger=1000)
    return spark.read.schema("title_key string, crawl_id long, is_new boolean").parquet(f"{base}/out")


def q_stream_token_daily(spark, sf_dir):
    """ST4: daily UTC+8 token totals computed by a streaming window aggregation."""
    from headline_engine.streaming import stream

    base = stream.scratch_dir(spark, "token-stream")
    tl = _token_log(spark, sf_dir).select("ts", "module", "model", "total_tokens")
    lo, hi = tl.agg(F.min("ts"), F.max("ts")).first()
    if lo is not None:
        step = (hi - lo) / 3
        for i in range(3):
            a, b = lo + step * i, (lo + step * (i + 1) if i < 2 else hi)
            part = tl.where((F.col("ts") >= F.lit(a)) & ((F.col("ts") < F.lit(b)) if i < 2 else (F.col("ts") <= F.lit(b))))
            part.write.mode("append").parquet(f"{base}/src")
    stream.token_window_stream(spark, f"{base}/src", f"{base}/out", CFG)
    return spark.read.parquet(f"{base}/out/token_daily").select("day", F.col("total_tokens").cast("bigint").alias("total_tokens"), "records")


QUERIES = {
    "feed_explode": q_feed_explode,
    "rank_collapse": q_rank_collapse,
    "weights": q_weights,
    "match_groups": q_match_groups,
    "top_headlines": q_top_headlines,
    "report_totals": q_report_totals,
    "group_summary": q_group_summary,
    "report_view": q_report_view,
    "report_latest_per_day": q_report_latest_per_day,
    "crawl_outcome": q_crawl_outcome,
    "title_keys": q_title_keys,
    "novelty": q_novelty,
    "presence_sessions": q_presence_sessions,
    "strict_dedup": q_strict_dedup,
    "history_asof": q_history_asof,
    "history_stats": q_history_stats,
    "increment_stats": q_increment_stats,
    "push_decision": q_push_decision,
    "crawl_summary": q_crawl_summary,
    "jaccard_pairs": q_jaccard_pairs,
    "char_jaccard_pairs": q_char_jaccard_pairs,
    "near_dup_edges": q_near_dup_edges,
    "near_dup_edges_global": q_near_dup_edges_global,
    "near_dup_vs_history": q_near_dup_vs_history,
    "greedy_dedup": q_greedy_dedup,
    "simple_dedup": q_simple_dedup,
    "triage": q_triage,
    "triage_context": q_triage_context,
    "apply_verdicts": q_apply_verdicts,
    "text_report": q_text_report,
    "english_titles": q_english_titles,
    "translate_lookup": q_translate_lookup,
    "translation_backlog": q_translation_backlog,
    "token_daily": q_token_daily,
    "token_total": q_token_total,
    "push_daily": q_push_daily,
    "schedule_gate": q_schedule_gate,
    "retention": q_retention,
    "retention_stored": q_retention_stored,
    "report_page": q_report_page,
    "translate_cached": q_translate_cached,
    "strip_markdown": q_strip_markdown,
    "pack_messages": q_pack_messages,
    "channel_messages": q_channel_messages,
    "channel_conversations": q_channel_conversations,
    "page_lines": q_page_lines,
    "stream_novelty": q_stream_novelty,
    "stream_text_report": q_stream_text_report,
    "stream_keyed_novelty": q_stream_keyed_novelty,
    "stream_token_daily": q_stream_token_daily,
}
