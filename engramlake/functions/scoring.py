"""Decay, relevance and scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from engramlake.config import Config

BOOST = 0.05
MAX_COUNT = 4_294_967_295


def half_life(section: Column, cfg: Config) -> Column:
    """Seconds; 0 (never decays) for anything but context and project."""
    return F.when(section == "context", cfg.context_half_life).when(section == "project", cfg.project_half_life).otherwise(0)


def decay_factor(elapsed: Column, life: Column) -> Column:
    """A half for every half-life; 1 where there is no half-life or no time has passed."""
    return F.when((life <= 0) | (elapsed <= 0), F.lit(1.0)).otherwise(F.pow(F.lit(0.5), elapsed / life))


def effective_relevance(now: int, cfg: Config) -> Column:
    return F.col("relevance") * decay_factor(F.lit(now) - F.col("last_access"), half_life(F.col("section"), cfg))


def score(cos: Column, now: int, cfg: Config) -> Column:
    fresh = decay_factor(F.lit(now) - F.col("updated_at"), half_life(F.col("section"), cfg))
    return cfg.w_similarity * cos + cfg.w_relevance * effective_relevance(now, cfg) + cfg.w_recency * fresh


def boosted(relevance: Column, times: Column) -> Column:
    """After so many boosts; nothing lowers relevance, so the steps add up."""
    return F.least(F.lit(1.0), relevance + BOOST * times)


def clamp_relevance(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def clamp_count(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(MAX_COUNT), c)).cast("bigint")
