"""Scoring expressions (P9-P11) built from algebraic per-headline statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from headline_engine.config import EngineConfig


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def weight(appearances, rank_sum, top_count, cfg: EngineConfig = EngineConfig()) -> Column:
    """rw*(1/avg rank) + fw*appearances + hw*(share of ranks <= hotness rank).

    Inputs are the count, the sum of ranks and the count of ranks within the
    hotness bound, so the score needs no rank list (hot keys combine map-side).
    The operation order matches the reference so equal inputs give equal doubles.
    """
    n = _c(appearances).cast("double")
    avg_rank = _c(rank_sum).cast("double") / n
    rank_score = F.lit(1.0) / avg_rank
    hotness = _c(top_count).cast("double") / n
    return rank_score * F.lit(cfg.rank_weight) + n * F.lit(cfg.frequency_weight) + hotness * F.lit(cfg.hotness_weight)


def weight_of_ranks(ranks, cfg: EngineConfig = EngineConfig()) -> Column:
    """P9 over an explicit rank array."""
    r = _c(ranks)
    total = F.aggregate(r, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    top = F.size(F.filter(r, lambda x: x <= cfg.hotness_rank))
    return weight(F.size(r), total, top, cfg)


def is_hot(appearances, cfg: EngineConfig = EngineConfig()) -> Column:
    """Appears at least `hot_appearances` times."""
    return _c(appearances) >= cfg.hot_appearances
