"""Rule matching (P6, P7, J1, J2) and the per-group top-N."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from headline_engine.config import EngineConfig
from headline_engine.operators import ruleindex
from headline_engine.sources.rules import group_caps


def drop_excluded(headlines: DataFrame, filters: DataFrame) -> DataFrame:
    """Drop a headline whose lowercased title contains any exclude word.

    The exclude list comes from the rule text (bounded config), so it is
    broadcast; the anti join is a broadcast nested loop with no shuffle.
    """
    lt = F.lower(F.col("title"))
    return headlines.join(F.broadcast(filters), F.contains(lt, F.col("word")), "left_anti")


def match_rules(headlines: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per (headline, matching group): every required word and,
    if the group has normal words, at least one of them (substring match)."""
    # A column of its own: an expression inside the lambdas of a nested loop's condition can be bound to one side only.
    lt = F.col("_lt")
    cond = F.forall("required", lambda w: F.contains(lt, w)) & (
        (F.size("normal") == 0) | F.exists("normal", lambda w: F.contains(lt, w))
    )
    r = rules.select("group_ord", "group_key", "required", "normal")
    return headlines.withColumn("_lt", F.lower("title")).join(F.broadcast(r), cond, "inner").drop("required", "normal", "_lt")


def matched_by_index(headlines: DataFrame, rules: DataFrame, filters: DataFrame) -> DataFrame:
    """The same matches by the gram index of ruleindex: for rule sets that are too large to broadcast and to test one by one."""
    kept = headlines.join(ruleindex.excluded_titles(headlines, filters), "title", "left_anti")
    return kept.join(ruleindex.matching_groups(headlines, rules), "title")


def matched(headlines: DataFrame, rules: DataFrame, filters: DataFrame, indexed: bool = False) -> DataFrame:
    """Exclude words first (fail fast), then groups. `indexed`: by the gram index (rules.is_large() of the rule text)."""
    if indexed:
        return matched_by_index(headlines, rules, filters).select(*headlines.columns, "group_ord", "group_key")
    return match_rules(drop_excluded(headlines, filters), rules)


def group_order(cfg: EngineConfig):
    """Appearances desc, weight desc (or weight desc only); the reference's
    stable sort keeps insertion order, i.e. platform order, first rank, group order."""
    tail = [F.col("platform_ord").asc(), F.col("first_rank").asc(), F.col("group_ord").asc()]
    if cfg.sort_by_weight_first:
        return [F.col("weight").desc()] + tail
    return [F.col("appearances").desc(), F.col("weight").desc()] + tail


def top_per_group(matched_df: DataFrame, rules: DataFrame, cfg: EngineConfig, max_cap: int | None = None, indexed: bool = False) -> DataFrame:
    """Keep the first `cap` items per (crawl, group key) in T1 order.

    A literal bound next to the per-key cap lets Spark insert a partial
    WindowGroupLimit before the shuffle, so each map task ships at most
    `max_cap` rows per (crawl, key) instead of every match. Caps are broadcast unless the rule set is large (`indexed`).
    """
    caps = group_caps(rules, cfg.default_cap)
    few = caps.select("group_key", "key_ord", "cap")
    df = matched_df.join(few if indexed else F.broadcast(few), "group_key")
    w = Window.partitionBy("crawl_id", "group_key").orderBy(*group_order(cfg))
    ranked = df.withColumn("rank_in_group", F.row_number().over(w))
    if cfg.default_cap <= 0:
        # no default cap: only explicit @n caps limit a group
        return ranked.where((F.col("cap") <= 0) | (F.col("rank_in_group") <= F.col("cap")))
    if max_cap is None:
        max_cap = caps.agg(F.max("cap")).first()[0] or cfg.default_cap
    return ranked.where((F.col("rank_in_group") <= F.lit(int(max_cap))) & (F.col("rank_in_group") <= F.col("cap")))
