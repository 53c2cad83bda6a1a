"""Filters, joins and searches over candidates, offers and matches."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores

OFFER_CARD = [
    "job_title",
    "company_name",
    "city",
    "country",
    "job_type",
    "description",
    "job_category",
]


# -- filters and projections ---------------------------------------------------


def open_offers(offers: DataFrame, lenient: bool = False) -> DataFrame:
    """Offers with status ``active``; leniently also those without a status."""
    active = F.col("status") == "active"
    return offers.filter(active | F.col("status").isNull() if lenient else active)


def filled(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text column is neither NULL nor empty."""
    return df.filter(F.col(column).isNotNull() & (F.col(column) != ""))


def known(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def client_offers(offers: DataFrame, client_id: int | None = None) -> DataFrame:
    """A client's offers, newest first; all clients', grouped by client, when not given."""
    mine = offers if client_id is None else by_key(offers, "client_id", client_id)
    return mine.orderBy("client_id", F.desc_nulls_last("created_at"), "job_offer_id")


def choices(df: DataFrame, column: str) -> DataFrame:
    """The values a filter can take."""
    return df.select(column).distinct()


# The three sort orders of the match list.
MATCH_ORDERS = {
    "Match Score": [F.desc, "similarity_score"],
    "Date": [F.desc, "updated_at"],
    "Company Name": [F.asc, "company_name"],
}


def browse_matches(
    matches: DataFrame,
    min_score: float = 0.5,
    job_type: str = "All",
    sort_by: str = "Match Score",
) -> DataFrame:
    """A match list filtered and sorted the way its user asks."""
    kept = matches.filter(F.col("similarity_score") >= min_score)
    if job_type != "All":
        kept = kept.filter(F.col("job_type") == job_type)
    direction, column = MATCH_ORDERS.get(sort_by, MATCH_ORDERS["Company Name"])
    return kept.orderBy(direction(column), "candidate_id", "job_offer_id")


# -- joins ---------------------------------------------------------------------


def _best_first(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    """Rows of a key side by side, in order; no global sort over the keys."""
    return rows.repartition(key).sortWithinPartitions(key, *order)


def candidate_matches(
    matches: DataFrame, offers: DataFrame, candidate_id: int | None = None
) -> DataFrame:
    """Matches with their offers, best first; for one candidate, or for each of all."""
    mine = matches if candidate_id is None else by_key(matches, "candidate_id", candidate_id)
    card = offers.select("job_offer_id", *[c for c in OFFER_CARD if c in offers.columns])
    order = [F.desc("similarity_score"), F.desc_nulls_last("created_at"), F.col("job_offer_id")]
    joined = mine.join(card, "job_offer_id")
    if candidate_id is None:
        return _best_first(joined, "candidate_id", *order)
    return joined.orderBy(*order)


def job_candidates(
    candidates: DataFrame, matches: DataFrame, job_offer_id: int | None = None
) -> DataFrame:
    """Matched candidates, best first; for one offer, or for each of all."""
    mine = matches if job_offer_id is None else by_key(matches, "job_offer_id", job_offer_id)
    scored = mine.select(
        "candidate_id",
        "job_offer_id",
        "similarity_score",
        "distance",
        "overall_evaluation",
        F.col("created_at").alias("match_created_at"),
    )
    order = [F.desc("similarity_score"), F.col("candidate_id")]
    joined = candidates.join(scored, "candidate_id")
    if job_offer_id is None:
        return _best_first(joined, "job_offer_id", *order)
    return joined.orderBy(*order)


def match_sample(matches: DataFrame, offers: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` best matches of every candidate, with the offer where it still exists."""
    best = Window.partitionBy("candidate_id").orderBy(
        F.desc("similarity_score"), "job_offer_id"
    )
    top = (
        matches.select("candidate_id", "job_offer_id", "similarity_score", "created_at")
        .withColumn("at", F.row_number().over(best))
        .filter(F.col("at") <= n)
        .drop("at")
    )
    return top.join(
        offers.select("job_offer_id", "job_title", "company_name"), "job_offer_id", "left"
    )


def unmatched_pairs(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """Pairs no stored match exists for."""
    keys = ["candidate_id", "job_offer_id"]
    return pairs.join(matches.select(*keys), keys, "left_anti")


def existing(df: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``keys_df``."""
    return df.join(keys_df.select(*keys).distinct(), list(keys), "left_semi")


def ranked_candidates(matches: DataFrame, candidates: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` candidates of every offer with position, label and class."""
    best = Window.partitionBy("job_offer_id").orderBy(
        F.desc("similarity_score"), "candidate_id"
    )
    top = (
        matches.select("job_offer_id", "candidate_id", "similarity_score")
        .withColumn("position", F.row_number().over(best))
        .filter(F.col("position") <= n)
    )
    names = candidates.select("candidate_id", "first_name", "last_name")
    return top.join(names, "candidate_id").select(
        "job_offer_id",
        "candidate_id",
        "first_name",
        "last_name",
        "position",
        scores.rank_label(F.col("position")).alias("label"),
        scores.match_class(F.col("similarity_score")).alias("match_class"),
        scores.percent_text(F.col("similarity_score")).alias("match_text"),
    )


# -- search --------------------------------------------------------------------


def search_filter(
    min_experience: int = 0,
    education: str = "All",
    location: str = "",
    skills: Sequence[str] = (),
    skills_column: str = "skills",
) -> list[Column]:
    """Conditions of a candidate search; texts are literal, without wildcards."""
    conditions: list[Column] = []
    if min_experience > 0:
        conditions.append(F.col("experience_years") >= min_experience)
    if education != "All":
        conditions.append(F.col("education_level") == education)
    if location:
        part = F.lit(location.lower())
        conditions.append(
            F.lower("city").contains(part) | F.lower("country").contains(part)
        )
    wanted = [s.strip().lower() for s in skills if s.strip()]
    if wanted:
        both = F.concat(
            F.coalesce(F.col(f"{skills_column}.technical_skills"), F.array().cast("array<string>")),
            F.coalesce(F.col(f"{skills_column}.soft_skills"), F.array().cast("array<string>")),
        )
        conditions.append(
            F.exists(
                both,
                lambda s: reduce(
                    lambda a, b: a | b, [F.lower(s).contains(F.lit(w)) for w in wanted]
                ),
            )
        )
    return conditions


def search_candidates(
    candidates: DataFrame,
    matches: DataFrame,
    limit: int | None = 50,
    **criteria,
) -> DataFrame:
    """Candidates that fit the criteria, ranked by average score and match count.

    The average is ranked to nine decimals: adding in another order changes nothing.
    """
    found = reduce(lambda df, c: df.filter(c), search_filter(**criteria), candidates)
    theirs = matches.join(found.select("candidate_id"), "candidate_id", "left_semi")
    totals = theirs.groupBy("candidate_id").agg(
        F.avg("similarity_score").alias("avg_match_score"),
        F.count("match_id").alias("total_matches"),
    )
    ranked = (
        found.join(totals, "candidate_id", "left")
        .withColumn("avg_match_score", F.coalesce("avg_match_score", F.lit(0.0)))
        .withColumn("total_matches", F.coalesce("total_matches", F.lit(0)))
        .orderBy(
            F.round("avg_match_score", 9).desc(), F.desc("total_matches"), "candidate_id"
        )
    )
    return ranked if limit is None else ranked.limit(limit)
