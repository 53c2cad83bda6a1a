"""The tables behind each dashboard, by name."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analytics, views


@contextmanager
def cached(*tables: DataFrame) -> Iterator[None]:
    """Keep tables that several queries of one dashboard read; released afterwards."""
    for table in tables:
        table.persist()
    try:
        yield
    finally:
        for table in tables:
            table.unpersist()


def skills_analytics(candidates: DataFrame) -> dict[str, DataFrame]:
    return {
        "technical_skills": analytics.skill_frequency(candidates, "technical_skills"),
        "soft_skills": analytics.skill_frequency(candidates, "soft_skills"),
        "categories": analytics.candidates_per_category(candidates),
        "experience": analytics.candidates_per_experience(candidates),
        "education": analytics.candidates_per_education(candidates),
    }


def global_statistics(
    candidates: DataFrame, offers: DataFrame, matches: DataFrame, clients: DataFrame
) -> DataFrame:
    """Row counts, mean score and excellent matches as one row."""

    def size(df: DataFrame):
        return df.agg(F.count("*")).scalar()

    score = F.col("similarity_score")
    return matches.agg(
        F.count("*").alias("nb_matches"),
        F.coalesce(F.avg(score), F.lit(0.0)).alias("avg_match_score"),
        F.count_if(score > 0.8).alias("excellent_matches"),
    ).select(
        size(candidates).alias("nb_candidates"),
        size(offers).alias("nb_offers"),
        "nb_matches",
        size(clients).alias("nb_clients"),
        "avg_match_score",
        "excellent_matches",
    )


def experience_dashboard(candidates: DataFrame) -> dict[str, DataFrame]:
    """Five results of one table of groups; wrap their use in ``cached(result["groups"])``."""
    groups = analytics.experience_groups(candidates)
    return {
        "groups": groups,
        "rollups": analytics.experience_rollups(groups),
        "summary": analytics.experience_summary(groups),
        "by_category": analytics.five_numbers(groups, "job_category"),
        "by_education": analytics.five_numbers(groups, "education_level"),
        "diversity": analytics.diversity(groups),
    }


def timeline_dashboard(candidates: DataFrame) -> dict[str, DataFrame]:
    daily = analytics.daily_registrations(candidates)
    return {"daily": daily, "running": analytics.running_registrations(daily)}


def candidate_dashboard(
    matches: DataFrame, offers: DataFrame, candidate_id: int
) -> dict[str, DataFrame]:
    mine = views.by_key(matches, "candidate_id", candidate_id)
    return {
        "matches": views.candidate_matches(matches, offers, candidate_id),
        "summary": analytics.match_summary(mine),
        "histogram": analytics.score_histogram(mine),
        "companies": analytics.top_companies(mine, offers),
        "categories": analytics.categories_of_matches(mine, offers),
    }


def recruiter_dashboard(
    matches: DataFrame, offers: DataFrame, client_id: int
) -> dict[str, DataFrame]:
    mine = views.by_key(offers, "client_id", client_id)
    theirs = matches.join(mine.select("job_offer_id"), "job_offer_id", "left_semi")
    statistics = analytics.offer_statistics(mine, theirs)
    return {
        "offers": views.client_offers(offers, client_id),
        "statistics": statistics.orderBy(F.desc("candidate_count"), "job_offer_id"),
        "summary": analytics.recruiter_summary(statistics),
    }
