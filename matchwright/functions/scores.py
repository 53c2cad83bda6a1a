"""Score expressions: rules on category and experience, grades and their texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_SIMILARITY = 0.2  # fixed value: weakest match that is stored
MATCHES_PER_OFFER = 15  # fixed value: matches kept per offer
RULE_MINIMUM = 0.4  # fixed value: weakest rule match that is kept


def _present(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def experience_met(years: Column, required: Column) -> Column:
    return F.coalesce(years, F.lit(0)) >= F.coalesce(required, F.lit(0))


def rule_score(
    candidate_category: Column, offer_category: Column, years: Column, required: Column
) -> Column:
    """Category and experience score before the 0.95 cap."""
    mine, theirs = F.lower(candidate_category), F.lower(offer_category)
    both = _present(candidate_category) & _present(offer_category)
    base = (
        F.when(both & (mine == theirs), F.lit(0.8))
        .when(both & F.contains(theirs, mine), F.lit(0.6))
        .otherwise(F.lit(0.3))
    )
    return base + F.when(experience_met(years, required), F.lit(0.1)).otherwise(F.lit(0.0))


def flag_score(candidate_category: Column, offer_category: Column) -> Column:
    return F.when(candidate_category == offer_category, F.lit(0.8)).otherwise(F.lit(0.5))


def tier_score(candidate_category: Column, offer_category: Column) -> Column:
    """Category score of the second tier: contained counts in both directions."""
    mine, theirs = F.lower(candidate_category), F.lower(offer_category)
    both = _present(candidate_category) & _present(offer_category)
    within = F.contains(theirs, mine) | F.contains(mine, theirs)
    return (
        F.when(both & (mine == theirs), F.lit(0.8))
        .when(both & within, F.lit(0.6))
        .otherwise(F.lit(0.4))
    )


def clamp(score: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(score, F.lit(low)), F.lit(high))


def overlap(candidate_skills: Column, offer_skills: Column) -> Column:
    """Share of the offer's skills the candidate has; both sides folded sets."""
    wanted = F.size(F.coalesce(offer_skills, F.array().cast("array<string>")))
    common = F.size(F.array_intersect(candidate_skills, offer_skills))
    return F.when(wanted == 0, F.lit(1.0)).otherwise(
        F.coalesce(common / F.nullif(wanted, F.lit(0)), F.lit(0.0))
    )


def jitter(keys: list[Column], low: float, high: float, seed: int) -> Column:
    """Tie-breaking noise in ``[low, high)`` that depends on keys and seed only."""
    named = F.concat_ws("\u001f", *[k.cast("string") for k in keys], F.lit(str(seed)))
    digits = F.conv(F.substring(F.md5(named.cast("binary")), 1, 13), 16, 10).cast("long")
    return F.lit(low) + digits / F.lit(float(1 << 52)) * F.lit(high - low)


def status(score: Column) -> Column:
    return F.when(score > 0.6, "good").when(score > 0.3, "fair").otherwise("poor")


def match_class(score: Column) -> Column:
    return (
        F.when(score > 0.8, "excellent-match")
        .when(score > 0.6, "good-match")
        .otherwise("average-match")
    )


def percent_text(value: Column) -> Column:
    """``0.4125`` style shares as text with one decimal; NULL gives N/A."""
    return F.when(value.isNull(), "N/A").otherwise(F.format_string("%.1f%%", value * 100))


def percent_1(score: Column) -> Column:
    """Share to percent, one decimal, half to even."""
    return F.rint(score * 100 * 10) / 10


def rank_label(position: Column) -> Column:
    # The three medals.
    return (
        F.when(position == 1, "\U0001f947")
        .when(position == 2, "\U0001f948")
        .when(position == 3, "\U0001f949")
        .otherwise(F.concat(F.lit("#"), position.cast("string")))
    )
