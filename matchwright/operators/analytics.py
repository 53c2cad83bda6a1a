"""Counts, distributions and rankings over candidates, offers and matches.

All groupings are plain aggregates, so Spark combines them before the shuffle; a
value or key that holds a large part of the rows costs no single task more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import staged
from .views import filled, known

TOP_COMPANIES = 10  # fixed value: companies shown
TOP_SKILLS = 15  # fixed value: skills in the co-occurrence matrix

# Score bands, open on the left and closed on the right.
SCORE_BANDS = [
    (0.0, 0.2, "Very Low"),
    (0.2, 0.4, "Low"),
    (0.4, 0.6, "Medium"),
    (0.6, 0.8, "High"),
    (0.8, 1.0, "Excellent"),
]


# -- skills, categories, education, experience ---------------------------------


def mentions(candidates: DataFrame, kind: str) -> DataFrame:
    """One row per mentioned skill; ``kind`` is a field of the skill document."""
    return candidates.select(F.explode(F.col(f"skills.{kind}")).alias("skill"))


def skill_frequency(candidates: DataFrame, kind: str = "technical_skills") -> DataFrame:
    return (
        mentions(candidates, kind)
        .groupBy("skill")
        .agg(F.count("*").alias("frequency"))
        .orderBy(F.desc("frequency"), "skill")
    )


def most_frequent(counts: DataFrame, name: str, count: str, n: int) -> DataFrame:
    return counts.orderBy(F.desc(count), name).limit(n)


def skill_ranks(candidates: DataFrame, kind: str = "technical_skills", n: int = 5) -> DataFrame:
    """The ``n`` most frequent skills with their position, #1 first."""
    top = most_frequent(skill_frequency(candidates, kind), "skill", "frequency", n)
    order = Window.orderBy(F.desc("frequency"), "skill")
    return top.withColumn("position", F.row_number().over(order)).withColumn(
        "label", F.concat(F.lit("#"), F.col("position").cast("string"))
    )


def count_by(df: DataFrame, column: str, name: str = "count") -> DataFrame:
    """Rows per value, NULL being a value of its own; largest first."""
    return df.groupBy(column).agg(F.count("*").alias(name)).orderBy(F.desc(name), column)


def candidates_per_category(candidates: DataFrame) -> DataFrame:
    return count_by(filled(candidates, "job_category"), "job_category")


def candidates_per_education(candidates: DataFrame) -> DataFrame:
    return count_by(filled(candidates, "education_level"), "education_level")


def candidates_per_experience(candidates: DataFrame) -> DataFrame:
    counted = candidates.groupBy("experience_years").agg(F.count("*").alias("count"))
    return counted.orderBy(F.asc_nulls_last("experience_years"))


def mention_totals(candidates: DataFrame) -> DataFrame:
    """Technical against soft mentions."""
    kinds = [("technical_skills", "Technical Skills"), ("soft_skills", "Soft Skills")]
    tagged = F.array(
        *[
            F.struct(
                F.lit(label).alias("skill_type"),
                F.coalesce(F.size(F.col(f"skills.{kind}")), F.lit(0)).alias("n"),
            )
            for kind, label in kinds
        ]
    )
    return (
        candidates.select(F.explode(tagged).alias("t"))
        .groupBy("t.skill_type")
        .agg(F.sum(F.greatest("t.n", F.lit(0))).cast("bigint").alias("total_mentions"))
    )


def co_occurrence(candidates: DataFrame, n: int = TOP_SKILLS) -> DataFrame:
    """How many candidates hold both skills, for the ``n`` most mentioned ones.

    Each candidate is reduced to the top skills it holds; equal reductions are counted
    first, and only the counted patterns (at most 2**n) are spread to skill pairs.
    """
    top = staged(
        most_frequent(skill_frequency(candidates), "skill", "frequency", n), "top-skills"
    )
    # ``n`` skills at most: small enough to be one value.
    listed = top.agg(F.array_sort(F.collect_list("skill"))).scalar()
    held = F.array_intersect(listed, F.col("skills.technical_skills"))
    patterns = candidates.select(held.alias("held")).groupBy("held").agg(F.count("*").alias("n"))
    together = patterns.select(F.explode("held").alias("skill_1"), "held", "n").select(
        "skill_1", F.explode("held").alias("skill_2"), "n"
    )
    square = top.select(F.col("skill").alias("skill_1"), F.explode(listed).alias("skill_2"))
    cells = square.withColumn("n", F.lit(0)).unionByName(together)
    return cells.groupBy("skill_1", "skill_2").agg(F.sum("n").alias("candidates"))


# -- places ----------------------------------------------------------------------


def by_place(candidates: DataFrame) -> DataFrame:
    """Candidates per country and city and, in the same pass, per country.

    ``level`` is ``city`` or ``country``.
    """
    return (
        filled(candidates, "country")
        .groupingSets([["country", "city"], ["country"]], "country", "city")
        .agg(F.grouping("city").alias("rolled"), F.count("*").alias("candidate_count"))
        .select(
            F.when(F.col("rolled") == 1, "country").otherwise("city").alias("level"),
            "country",
            "city",
            "candidate_count",
        )
    )


# -- experience ------------------------------------------------------------------


def experience_bubbles(candidates: DataFrame) -> DataFrame:
    """Distinct names per experience, education and category."""
    named = F.struct(
        F.col("first_name").isNull(), "first_name", F.col("last_name").isNull(), "last_name"
    )
    return (
        known(candidates, "experience_years", "education_level", "job_category")
        .groupBy("experience_years", "education_level", "job_category")
        .agg(F.count_distinct(named).alias("count"))
    )


def experience_groups(candidates: DataFrame) -> DataFrame:
    return (
        known(candidates, "experience_years")
        .groupBy("experience_years", "job_category", "education_level")
        .agg(F.count("*").alias("count"))
    )


def experience_rollups(groups: DataFrame) -> DataFrame:
    """Counted groups re-added by year, year and education, category and year.

    One pass; ``grouping`` names the level, and a level's NULL keys are left out.
    """
    levels = groups.groupingSets(
        [
            ["experience_years"],
            ["experience_years", "education_level"],
            ["experience_years", "job_category"],
        ],
        "experience_years",
        "education_level",
        "job_category",
    ).agg(
        F.sum("count").alias("count"),
        F.grouping("education_level").alias("no_edu"),
        F.grouping("job_category").alias("no_cat"),
    )
    level = (
        F.when((F.col("no_edu") == 1) & (F.col("no_cat") == 1), "year")
        .when(F.col("no_cat") == 1, "year_education")
        .otherwise("category_year")
    )
    return (
        levels.withColumn("grouping", level)
        .filter((F.col("no_edu") == 1) | F.col("education_level").isNotNull())
        .filter((F.col("no_cat") == 1) | F.col("job_category").isNotNull())
        .select("grouping", "experience_years", "education_level", "job_category", "count")
    )


def experience_summary(groups: DataFrame) -> DataFrame:
    """Total, weighted mean, least and most years over counted groups."""
    years, n = F.col("experience_years"), F.col("count")
    return groups.agg(
        F.sum(n).alias("total_candidates"),
        (F.sum(years * n) / F.sum(n)).alias("avg_experience"),
        F.max(years).alias("max_experience"),
        F.min(years).alias("min_experience"),
    )


def ungroup(groups: DataFrame, count: str = "count") -> DataFrame:
    """Every group row repeated as often as it counts."""
    copies = F.explode(F.sequence(F.lit(1), F.col(count)))
    others = [c for c in groups.columns if c != count]
    return groups.filter(F.col(count) > 0).select(*others, copies.alias("copy")).drop("copy")


def five_numbers(groups: DataFrame, by: str, value: str = "experience_years") -> DataFrame:
    """Minimum, quartiles and maximum of a counted integer value per key."""
    counted = known(groups, by, value).groupBy(by, value).agg(F.sum("count").alias("n"))
    spread = F.percentile(value, [0.0, 0.25, 0.5, 0.75, 1.0], F.col("n"))
    names = ["minimum", "q1", "median", "q3", "maximum"]
    return counted.groupBy(by).agg(spread.alias("p")).select(
        by, *[F.col("p")[i].alias(name) for i, name in enumerate(names)]
    )


def distinct_values(column: str) -> Column:
    """How many values a column has, NULL being a value of its own; 0 without rows."""
    return F.count_distinct(column) + F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))


def diversity(groups: DataFrame) -> DataFrame:
    """The numbers that decide whether a detailed view is worth showing."""
    counts = groups.agg(F.count("*").alias("rows"), distinct_values("job_category").alias("categories"))
    return counts.select(
        "rows",
        "categories",
        ((F.col("rows") > 10) & (F.col("categories") > 2)).alias("show_detail"),
        (F.col("categories") > 1).alias("show_progression"),
    )


def guards(skills: DataFrame, candidates: DataFrame) -> DataFrame:
    """Whether skill and country views have enough to show.

    ``skills``: one row per skill. More than five skills, more than one country.
    """
    countries = known(candidates, "country").agg(F.count_distinct("country")).scalar()
    return skills.agg(F.count("*").alias("skills")).select("skills", countries.alias("countries")).select(
        "skills",
        "countries",
        (F.col("skills") > 5).alias("show_skills"),
        (F.col("countries") > 1).alias("show_countries"),
    )


# -- time ------------------------------------------------------------------------


def daily_registrations(candidates: DataFrame) -> DataFrame:
    return (
        known(candidates, "created_at")
        .groupBy(F.to_date("created_at").alias("date"), "job_category")
        .agg(F.count("*").alias("daily_count"))
    )


def daily_totals(daily: DataFrame) -> DataFrame:
    return daily.groupBy("date").agg(F.sum("daily_count").alias("daily_count"))


def running_registrations(daily: DataFrame) -> DataFrame:
    """Daily totals with their running sum; one row per calendar day reaches the window."""
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return daily_totals(daily).withColumn("cumulative", F.sum("daily_count").over(upto))


# -- matches ---------------------------------------------------------------------


def row_counts(**tables: DataFrame) -> DataFrame:
    """Rows of every named table, one row per table, in one job."""
    parts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def _score() -> Column:
    return F.col("similarity_score")


def score_statistics(matches: DataFrame) -> DataFrame:
    return matches.agg(
        F.coalesce(F.avg(_score()), F.lit(0.0)).alias("avg_match_score"),
        F.count_if(_score() > 0.8).alias("excellent_matches"),
    )


def match_summary(matches: DataFrame) -> DataFrame:
    return matches.agg(
        F.avg(_score()).alias("avg_similarity"),
        F.max(_score()).alias("max_similarity"),
        F.count("*").alias("total_matches"),
    )


def offer_status(offers: DataFrame) -> DataFrame:
    return offers.agg(
        F.count("*").alias("total_jobs"),
        F.count_if(F.col("status") == "active").alias("active_jobs"),
        F.count_if(F.col("status").isNull()).alias("null_status_jobs"),
    )


def offer_statistics(offers: DataFrame, matches: DataFrame) -> DataFrame:
    """Candidates, mean and best score per offer; offers without a match stay."""
    totals = matches.groupBy("job_offer_id").agg(
        F.count("candidate_id").alias("candidate_count"),
        F.avg(_score()).alias("avg_score"),
        F.max(_score()).alias("best_score"),
    )
    return offers.select("job_offer_id", "client_id", "job_title").join(
        totals, "job_offer_id", "left"
    ).withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)))


def recruiter_summary(statistics: DataFrame) -> DataFrame:
    """Per client: offers, matches, matches per offer, mean of the offers' means."""
    return statistics.groupBy("client_id").agg(
        F.count("*").alias("total_jobs"),
        F.sum("candidate_count").alias("total_candidates"),
        F.avg("candidate_count").alias("avg_candidates_per_job"),
        F.avg("avg_score").alias("overall_avg_score"),
    )


def candidate_summary(matches: DataFrame) -> DataFrame:
    return matches.groupBy("candidate_id").agg(
        F.count("*").alias("total_matches"),
        F.avg(_score()).alias("avg_match"),
        F.max(_score()).alias("best_match"),
    )


def match_quality(matches: DataFrame) -> DataFrame:
    """Per candidate: all, excellent and good matches (excellent ones are also good)."""
    return matches.groupBy("candidate_id").agg(
        F.count("*").alias("total_matches"),
        F.count_if(_score() > 0.8).alias("excellent_matches"),
        F.count_if(_score() > 0.6).alias("good_matches"),
        F.avg(_score()).alias("avg_match"),
    )


def matches_per_candidate(matches: DataFrame) -> DataFrame:
    return matches.groupBy("candidate_id").agg(F.count("*").alias("count"))


def score_histogram(matches: DataFrame) -> DataFrame:
    """Matches per score band, empty bands included; one pass, five counters."""
    inside = [
        F.count_if((_score() > low) & (_score() <= high)) for low, high, _ in SCORE_BANDS
    ]
    rows = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(label).alias("band"), n.alias("count"))
            for i, ((_, _, label), n) in enumerate(zip(SCORE_BANDS, inside))
        ]
    )
    return matches.agg(rows.alias("rows")).select(F.inline("rows"))


def top_companies(
    matches: DataFrame, offers: DataFrame, n: int = TOP_COMPANIES
) -> DataFrame:
    return most_frequent(
        _matches_by(matches, offers, "company_name"), "company_name", "count", n
    )


def categories_of_matches(matches: DataFrame, offers: DataFrame) -> DataFrame:
    return _matches_by(matches, offers, "job_category")


def _matches_by(matches: DataFrame, offers: DataFrame, column: str) -> DataFrame:
    """Matches per offer attribute: counted per offer before the join."""
    per_offer = matches.groupBy("job_offer_id").agg(F.count("*").alias("n"))
    return (
        per_offer.join(known(offers.select("job_offer_id", column), column), "job_offer_id")
        .groupBy(column)
        .agg(F.sum("n").alias("count"))
    )


def profile_completeness(candidates: DataFrame) -> DataFrame:
    """Number of skills, experiences and certifications, and which parts are filled."""

    def n(column: str) -> Column:
        return F.greatest(F.coalesce(F.size(F.col(column)), F.lit(0)), F.lit(0))

    parts: Sequence[tuple[str, Column]] = [
        ("skills", n("skills.technical_skills") + n("skills.soft_skills")),
        ("experience", n("experience")),
        ("certifications", n("certifications")),
    ]
    return candidates.select(
        "candidate_id",
        *[size.alias(f"{name}_count") for name, size in parts],
        *[(size > 0).alias(f"has_{name}") for name, size in parts],
    )
