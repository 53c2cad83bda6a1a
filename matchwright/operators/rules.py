"""Rule matching (category and experience) without pairing rows with rows.

A rule score depends only on the two categories, the candidate's years and the
required years. So candidates with the same category and years are one class, and so
are offers with the same category and requirement. Classes meet by equi-joins:
equal or contained categories through the offer category's substrings, everything
else through the years alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores
from ..sources.tables import staged


def _candidate_classes(candidates: DataFrame) -> DataFrame:
    return candidates.select(
        "candidate_id",
        F.nullif(F.lower("job_category"), F.lit("")).alias("mine"),
        F.coalesce("experience_years", F.lit(0)).alias("years"),
    )


def _offer_classes(offers: DataFrame) -> DataFrame:
    return offers.select(
        "job_offer_id",
        F.nullif(F.lower("job_category"), F.lit("")).alias("theirs"),
        F.coalesce("experience_required", F.lit(0)).alias("required"),
    )


def _contained_in(theirs: DataFrame, mine: DataFrame) -> DataFrame:
    """Substrings of each distinct offer category, with the base score they earn.

    Only substrings as long as some candidate category are made.
    """
    lengths = (
        mine.filter(F.col("mine").isNotNull()).agg(F.collect_set(F.length("mine"))).scalar()
    )
    return (
        theirs.select("theirs")
        .distinct()
        .filter(F.col("theirs").isNotNull())
        .withColumn("lengths", F.coalesce(lengths, F.array().cast("array<int>")))
        .select(
            "theirs",
            F.explode(F.filter("lengths", lambda n: n <= F.length("theirs"))).alias("size"),
        )
        .select(
            "theirs",
            "size",
            F.explode(
                F.sequence(F.lit(1), F.length("theirs") - F.col("size") + 1)
            ).alias("first"),
        )
        .select("theirs", F.expr("substring(theirs, first, size)").alias("mine"))
        .distinct()
        .withColumn("base", F.when(F.col("mine") == F.col("theirs"), 0.8).otherwise(0.6))
    )


def _bonus() -> F.Column:
    return F.when(F.col("years") >= F.col("required"), F.lit(0.1)).otherwise(F.lit(0.0))


def _to_offers(theirs: DataFrame, per_class: DataFrame) -> DataFrame:
    """Results of an offer class (``goal, required``) handed to each of its offers."""
    r = per_class.withColumnRenamed("required", "goal_required")
    same = F.col("theirs").eqNullSafe(F.col("goal")) & (
        F.col("required") == F.col("goal_required")
    )
    return theirs.join(r, same).drop("theirs", "goal", "goal_required")


def best_by_rule(
    candidates: DataFrame, offers: DataFrame, k: int = scores.MATCHES_PER_OFFER
) -> DataFrame:
    """The ``k`` best rule matches of every offer, ties by candidate id.

    A candidate can only be among an offer's best ``k`` if fewer than ``k`` members of
    its own class have a smaller id. So each class sends its ``k`` smallest ids, and
    for the candidates whose category does not fit, the ``k`` smallest ids with enough
    years are all that can be needed.
    """
    mine, theirs = _candidate_classes(candidates), _offer_classes(offers)
    by_id = Window.partitionBy("mine", "years").orderBy("candidate_id")
    heads = staged(
        mine.withColumn("at", F.row_number().over(by_id)).filter(F.col("at") <= k).drop("at"),
        "class-heads",
    )
    wanted = theirs.select("theirs", "required").distinct()

    fitting = (
        heads.join(_contained_in(theirs, heads), "mine")
        .join(wanted, "theirs")
        .withColumn("score", F.col("base") + _bonus())
        .select(F.col("theirs").alias("goal"), "required", "candidate_id", "score")
    )

    by_years = Window.partitionBy("years").orderBy("candidate_id")
    oldest = (
        heads.withColumn("at", F.row_number().over(by_years)).filter(F.col("at") <= k).drop("at")
    )
    limits = theirs.agg(F.array_sort(F.collect_set("required"))).scalar()
    by_required = Window.partitionBy("required").orderBy("candidate_id")
    other = (
        oldest.withColumn("limits", limits)
        .select(
            "candidate_id",
            F.explode(F.filter("limits", lambda r: r <= F.col("years"))).alias("required"),
        )
        .withColumn("at", F.row_number().over(by_required))
        .filter(F.col("at") <= k)
        .join(wanted, "required")
        .select(
            F.col("theirs").alias("goal"),
            "required",
            "candidate_id",
            F.lit(0.3 + 0.1).alias("score"),
        )
    )

    best = Window.partitionBy("goal", "required").orderBy(F.desc("score"), "candidate_id")
    per_class = (
        fitting.unionByName(other)
        .groupBy("goal", "required", "candidate_id")
        .agg(F.max("score").alias("score"))
        .filter(F.col("score") >= scores.RULE_MINIMUM)
        .withColumn("match_rank", F.row_number().over(best))
        .filter(F.col("match_rank") <= k)
    )
    return _to_offers(theirs, per_class).select(
        "job_offer_id",
        "candidate_id",
        F.least("score", F.lit(0.95)).alias("similarity_score"),
        (F.lit(1.0) - F.col("score")).alias("distance"),
        "match_rank",
    )


def rule_score_counts(candidates: DataFrame, offers: DataFrame) -> DataFrame:
    """How many candidates reach each rule score, for every offer.

    The whole rule matching of the two tables in one row per offer and score: the
    classes are counted, never expanded to pairs.
    """
    mine, theirs = _candidate_classes(candidates), _offer_classes(offers)
    sizes = staged(mine.groupBy("mine", "years").agg(F.count("*").alias("n")), "class-sizes")
    wanted = theirs.select("theirs", "required").distinct()

    fitting = (
        sizes.join(_contained_in(theirs, sizes), "mine")
        .join(wanted, "theirs")
        .groupBy(F.col("theirs").alias("goal"), "required", "base", _bonus().alias("bonus"))
        .agg(F.sum("n").alias("n"))
    )
    # Candidates with at least the required years, whatever their category: a running
    # total over the distinct year values of both sides.
    marks = (
        sizes.groupBy(F.col("years").alias("year"))
        .agg(F.sum("n").alias("n"))
        .unionByName(wanted.select(F.col("required").alias("year"), F.lit(0).alias("n")).distinct())
        .groupBy("year")
        .agg(F.sum("n").alias("n"))
    )
    downwards = Window.orderBy(F.desc("year")).rowsBetween(Window.unboundedPreceding, 0)
    enough = marks.select(F.col("year").alias("required"), F.sum("n").over(downwards).alias("n"))
    fitting_enough = (
        fitting.filter(F.col("bonus") > 0).groupBy("goal", "required").agg(F.sum("n").alias("gone"))
    )
    rest = (
        wanted.select(F.col("theirs").alias("goal"), "required").join(enough, "required").alias("w")
    )
    same = F.col("w.goal").eqNullSafe(F.col("f.goal")) & (
        F.col("w.required") == F.col("f.required")
    )
    other = (
        rest.join(fitting_enough.alias("f"), same, "left")
        .select(
            "w.goal",
            "w.required",
            F.lit(0.3).alias("base"),
            F.lit(0.1).alias("bonus"),
            (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n"),
        )
        .filter(F.col("n") > 0)
    )
    counts = fitting.unionByName(other).select(
        "goal", "required", (F.col("base") + F.col("bonus")).alias("score"), "n"
    )
    return (
        _to_offers(theirs, counts.filter(F.col("score") >= scores.RULE_MINIMUM))
        .groupBy("job_offer_id", F.least("score", F.lit(0.95)).alias("similarity_score"))
        .agg(F.sum("n").alias("candidates"))
    )


def best_offers_by_rule(
    candidates: DataFrame, offers: DataFrame, k: int = scores.MATCHES_PER_OFFER
) -> DataFrame:
    """The ``k`` best rule matches of every candidate, ties by offer id.

    The mirror of ``best_by_rule``: an offer class sends its ``k`` smallest ids, classes
    of candidates meet them, and every candidate takes the result of its class. So the
    output is at most ``k`` rows per candidate, whatever the number of offers.
    """
    mine, theirs = _candidate_classes(candidates), _offer_classes(offers)
    by_id = Window.partitionBy("theirs", "required").orderBy("job_offer_id")
    heads = staged(
        theirs.withColumn("at", F.row_number().over(by_id)).filter(F.col("at") <= k).drop("at"),
        "offer-heads",
    )
    wanted = mine.select("mine", "years").distinct()
    fitting = (
        wanted.join(_contained_in(theirs, mine), "mine")
        .join(heads, "theirs")
        .withColumn("score", F.col("base") + _bonus())
        .select(F.col("mine").alias("goal"), "years", "job_offer_id", "score")
    )
    # Offers whose category does not fit count for the bonus alone.
    by_required = Window.partitionBy("required").orderBy("job_offer_id")
    easiest = (
        heads.withColumn("at", F.row_number().over(by_required)).filter(F.col("at") <= k).drop("at")
    )
    limits = wanted.agg(F.array_sort(F.collect_set("years"))).scalar()
    by_years = Window.partitionBy("years").orderBy("job_offer_id")
    other = (
        easiest.withColumn("limits", limits)
        .select(
            "job_offer_id",
            F.explode(F.filter("limits", lambda y: y >= F.col("required"))).alias("years"),
        )
        .withColumn("at", F.row_number().over(by_years))
        .filter(F.col("at") <= k)
        .join(wanted, "years")
        .select(F.col("mine").alias("goal"), "years", "job_offer_id", F.lit(0.3 + 0.1).alias("score"))
    )
    best = Window.partitionBy("goal", "years").orderBy(F.desc("score"), "job_offer_id")
    per_class = (
        fitting.unionByName(other)
        .groupBy("goal", "years", "job_offer_id")
        .agg(F.max("score").alias("score"))
        .filter(F.col("score") >= scores.RULE_MINIMUM)
        .withColumn("match_rank", F.row_number().over(best))
        .filter(F.col("match_rank") <= k)
        .withColumnRenamed("years", "goal_years")
    )
    same = F.col("mine").eqNullSafe(F.col("goal")) & (F.col("years") == F.col("goal_years"))
    return mine.join(per_class, same).select(
        "candidate_id",
        "job_offer_id",
        F.least("score", F.lit(0.95)).alias("similarity_score"),
        (F.lit(1.0) - F.col("score")).alias("distance"),
        "match_rank",
    )


def demo_matches(
    candidates: DataFrame,
    offers: DataFrame,
    n_candidates: int = 20,
    n_offers: int = 5,
    n_results: int = 100,
) -> DataFrame:
    """Rule matches of the first few candidates with the first few offers."""
    few = offers.orderBy("job_offer_id").limit(n_offers)
    listed = few.agg(
        F.collect_list(F.struct("job_offer_id", "job_category", "experience_required"))
    ).scalar()
    return (
        candidates.orderBy("candidate_id")
        .limit(n_candidates)
        .select("candidate_id", "job_category", "experience_years", F.explode(listed).alias("o"))
        .select(
            "candidate_id",
            "o.job_offer_id",
            scores.rule_score(
                F.col("job_category"),
                F.col("o.job_category"),
                F.col("experience_years"),
                F.col("o.experience_required"),
            ).alias("score"),
        )
        .filter(F.col("score") >= scores.RULE_MINIMUM)
        .orderBy("candidate_id", "job_offer_id")
        .limit(n_results)
        .select(
            "candidate_id",
            "job_offer_id",
            F.least("score", F.lit(0.95)).alias("similarity_score"),
            (F.lit(1.0) - F.col("score")).alias("distance"),
        )
    )


def rescored(matches: DataFrame, candidates: DataFrame, offers: DataFrame) -> DataFrame:
    """Rule score of pairs that already exist, weak ones dropped."""
    c = candidates.select("candidate_id", F.col("job_category").alias("mine"), "experience_years")
    o = offers.select("job_offer_id", F.col("job_category").alias("theirs"), "experience_required")
    score = scores.rule_score(
        F.col("mine"), F.col("theirs"), F.col("experience_years"), F.col("experience_required")
    )
    return (
        matches.join(c, "candidate_id")
        .join(o, "job_offer_id")
        .withColumn("score", score)
        .filter(F.col("score") >= scores.RULE_MINIMUM)
        .withColumn("similarity_score", F.least("score", F.lit(0.95)))
        .withColumn("distance", F.lit(1.0) - F.col("score"))
        .drop("score", "mine", "theirs", "experience_years", "experience_required")
    )
