"""Fallback tiers for candidates the engine found no match for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from .views import open_offers

NEWEST_OPEN = 50  # fixed value: offers looked at in the second tier
TASKS_PER_CORE = 4
NEWEST_ANY = 10  # fixed value: offers looked at in the last tier
PAIR = ["candidate_id", "job_offer_id"]
MATCH_COLUMNS = [*PAIR, "similarity_score", "distance"]


def newest_offers(offers: DataFrame, n: int) -> DataFrame:
    return offers.orderBy(F.desc_nulls_last("created_at"), "job_offer_id").limit(n)


def _listed(offers: DataFrame, n: int) -> Column:
    """The newest ``n`` offers as one array value, newest first."""
    newest = Window.orderBy(F.desc_nulls_last("created_at"), "job_offer_id")
    placed = newest_offers(offers, n).withColumn("position", F.row_number().over(newest))
    entry = F.struct("position", "job_offer_id", "job_category")
    return placed.agg(F.array_sort(F.collect_list(entry))).scalar()


def _spread(candidates: DataFrame) -> DataFrame:
    """Candidates dealt over all cores: few bytes, read by few tasks, become many pairs."""
    return candidates.repartition(TASKS_PER_CORE * candidates.sparkSession.sparkContext.defaultParallelism)


def category_tier(
    candidates: DataFrame,
    offers: DataFrame,
    newest: int = NEWEST_OPEN,
    noise: float = 0.0,
    seed: int = 0,
) -> DataFrame:
    """Second tier: every candidate against the newest open offers, by category.

    ``noise`` is the width of the tie-breaking bonus (0.3 in the original rule); it is
    off by default, and repeatable for a seed when on.
    """
    listed = _listed(open_offers(offers, lenient=True), newest)
    score = scores.tier_score(F.col("job_category"), F.col("o.job_category"))
    if noise:
        score = score + scores.jitter(
            [F.col("candidate_id"), F.col("o.job_offer_id")], 0.0, noise, seed
        )
    return (
        _spread(candidates.select("candidate_id", "job_category"))
        .select("candidate_id", "job_category", F.explode(listed).alias("o"))
        .withColumn("similarity_score", F.least(score, F.lit(0.95)))
        .filter(F.col("similarity_score") >= scores.MIN_SIMILARITY)
        .select(
            "candidate_id",
            "o.job_offer_id",
            "similarity_score",
            (F.lit(1.0) - F.col("similarity_score")).alias("distance"),
        )
    )


def last_resort_tier(
    candidates: DataFrame,
    offers: DataFrame,
    matches: DataFrame,
    newest: int = NEWEST_ANY,
    cap: float | None = None,
) -> DataFrame:
    """Last tier: the newest offers of any status, scored by position.

    The position counts offers whose pair exists already; such pairs are then left out.
    """
    listed = _listed(offers, newest)
    score = F.lit(0.6) + (F.col("o.position") - 1) * F.lit(0.05)
    if cap is not None:
        score = F.least(score, F.lit(cap))
    return (
        _spread(candidates.select("candidate_id"))
        .select("candidate_id", F.explode(listed).alias("o"))
        .select("candidate_id", "o.job_offer_id", score.alias("similarity_score"))
        .withColumn("distance", F.lit(1.0) - F.col("similarity_score"))
        .join(matches.select(*PAIR), PAIR, "left_anti")
    )


def fallback_cascade(
    candidates: DataFrame,
    offers: DataFrame,
    engine_matches: DataFrame,
    min_category: float = scores.MIN_SIMILARITY,
) -> DataFrame:
    """Engine matches; the second tier for candidates without one; else the last.

    Each tier serves the candidates that the tiers before it gave nothing to.
    """
    engine = engine_matches.select(*MATCH_COLUMNS)
    lost = candidates.join(engine.select("candidate_id").distinct(), "candidate_id", "left_anti")
    second = category_tier(lost, offers).filter(F.col("similarity_score") >= min_category)
    still = lost.join(second.select("candidate_id").distinct(), "candidate_id", "left_anti")
    tiers = [engine, second, last_resort_tier(still, offers, engine)]
    found = [t.select(*MATCH_COLUMNS).withColumn("tier", F.lit(i)) for i, t in enumerate(tiers, 1)]
    return found[0].unionByName(found[1]).unionByName(found[2])
