"""Matching: scores, distances, nearest candidates, overlap, thresholds, tiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchwright.functions import scores, vectors
from matchwright.operators import maintenance, nearest, overlap, quantiles, rules, tiers
from matchwright.plans import matching

from .fixtures import RULE_SCORE, Tables, sql


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _unit_pairs_sql(condition: str) -> str:
    return f"""
SELECT o.vec_id AS job_offer_id, c.vec_id AS candidate_id,
       exp(-power(list_distance(c.u, o.u), 2) / 2.0::DOUBLE) AS s
FROM fx_unit c, fx_unit o WHERE {condition}"""


# -- vectors ------------------------------------------------------------------------


def m18_best_candidates(t: Tables) -> DataFrame:
    found = nearest.best_candidates(t.vectors("candidate_id"), t.vectors("job_offer_id"))
    return _rounded(found, "similarity_score")


def m18_through_cells(t: Tables) -> DataFrame:
    """The same where neither side fits in memory."""
    found = nearest.best_candidates(t.vectors("candidate_id"), t.vectors("job_offer_id"), broadcast_bytes=0)
    return _rounded(found, "similarity_score")


M18 = sql(f"""
SELECT job_offer_id, candidate_id, round(s, 6) AS similarity_score,
       CAST(match_rank AS INT) AS match_rank
FROM (SELECT *, row_number() OVER (PARTITION BY job_offer_id ORDER BY s DESC, candidate_id)
               AS match_rank
      FROM ({_unit_pairs_sql("true")}) WHERE s >= 0.2)
WHERE match_rank <= 15""")


def m19_best_offers(t: Tables) -> DataFrame:
    found = nearest.best_offers(t.vectors("candidate_id"), t.vectors("job_offer_id"))
    return _rounded(found, "similarity_score")


M19 = sql(f"""
SELECT job_offer_id, candidate_id, round(s, 6) AS similarity_score,
       CAST(match_rank AS INT) AS match_rank
FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY s DESC, job_offer_id)
               AS match_rank
      FROM ({_unit_pairs_sql("true")}) WHERE s >= 0.2)
WHERE match_rank <= 15""")


def m19_all_pairs(t: Tables) -> DataFrame:
    """Every pair at M-19's minimum, whatever its rank."""
    found = nearest.similar_pairs(t.vectors("candidate_id"), t.vectors("job_offer_id"), 0.2)
    return _rounded(found, "similarity_score").select("job_offer_id", "candidate_id", "similarity_score")


M19_ALL = sql(f"""
SELECT job_offer_id, candidate_id, round(s, 6) AS similarity_score
FROM ({_unit_pairs_sql("true")}) WHERE s >= 0.2""")


def _label_pairs(t: Tables) -> DataFrame:
    """Every vector with the first vector of its label."""
    e = t.raw("embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("v")
    )
    first = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("w"))
    return e.join(first, "label")


def m06_unit_vectors(t: Tables) -> DataFrame:
    u = vectors.unit(F.col("embedding").cast("array<double>"))
    return t.raw("embeddings").select(
        "vec_id",
        F.round(vectors.norm(u), 6).alias("norm"),
        F.round(F.aggregate(u, F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


M06 = sql("""
SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS norm,
       round(list_sum(u), 6) AS total
FROM fx_unit""")

_LABEL_SQL = """(SELECT a.vec_id, a.label, a.u, b.u AS w FROM fx_unit a JOIN
  (SELECT label, arg_min(u, vec_id) AS u FROM fx_unit GROUP BY label) b USING (label))"""


def m07_distances(t: Tables) -> DataFrame:
    """Euclidean, cosine, Manhattan and weighted distance, and the similarity."""
    weights = [1.0 + i / 64 for i in range(64)]
    v, w = F.col("v"), F.col("w")
    out = {
        "euclidean": vectors.distance(v, w),
        "cosine": vectors.distance(v, w, "cosine"),
        "manhattan": vectors.distance(v, w, "manhattan"),
        "weighted": vectors.weighted_euclidean(v, w, weights),
        "similarity": vectors.vector_similarity(v, w),
    }
    return _label_pairs(t).select(
        "vec_id", "label", *[F.round(c, 6).alias(n) for n, c in out.items()]
    )


M07 = sql(f"""
SELECT vec_id, label,
       round(list_distance(u, w), 6) AS euclidean,
       round(1.0::DOUBLE - list_cosine_similarity(u, w), 6) AS cosine,
       round(list_sum(list_transform(range(1, 65), lambda i: abs(u[i] - w[i]))), 6) AS manhattan,
       round(sqrt(list_sum(list_transform(range(1, 65),
             lambda i: (1.0::DOUBLE + (i - 1)::DOUBLE / 64) * power(u[i] - w[i], 2)))), 6) AS weighted,
       round(exp(-power(list_distance(u, w), 2) / 2.0::DOUBLE), 6) AS similarity
FROM {_LABEL_SQL}""")


def m11_shape_guard(t: Tables) -> DataFrame:
    """Vectors of which a third is cut in half and a third is empty."""
    third = F.col("vec_id") % 3
    cut = F.when(third == 1, F.slice("v", 1, 32)).when(third == 2, F.slice("v", 1, 0)).otherwise(F.col("v"))
    d = vectors.distance(cut, F.col("w"))
    return _label_pairs(t).select(
        "vec_id",
        F.round(F.when(d == float("inf"), F.lit(-1.0)).otherwise(d), 6).alias("distance"),
        F.round(vectors.vector_similarity(cut, F.col("w")), 6).alias("similarity"),
    )


M11 = sql(f"""
SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN round(list_distance(u, w), 6) ELSE -1.0::DOUBLE END AS distance,
       CASE WHEN vec_id % 3 = 0 THEN round(exp(-power(list_distance(u, w), 2) / 2.0::DOUBLE), 6)
            ELSE 0.0::DOUBLE END AS similarity
FROM {_LABEL_SQL}""")


def m13_thresholds(t: Tables) -> DataFrame:
    d = _label_pairs(t).select(vectors.euclidean(F.col("v"), F.col("w")).alias("distance"))
    return _rounded(quantiles.match_thresholds(d), "threshold")


M13 = sql(f"""
, d AS (SELECT list_distance(u, w) AS d FROM {_LABEL_SQL}),
s AS (SELECT avg(d) AS m, stddev_pop(d) AS sd, quantile_cont(d, 0.25) AS q1,
             quantile_cont(d, 0.5) AS q2, quantile_cont(d, 0.75) AS q3 FROM d)
SELECT 'percentile' AS method, round(q3, 6) AS threshold FROM s
UNION ALL SELECT 'std', round(greatest(0, m - 1.5 * sd), 6) FROM s
UNION ALL SELECT 'iqr', round(q1 - 1.5 * (q3 - q1), 6) FROM s
UNION ALL SELECT 'adaptive',
  round(CASE WHEN abs(m - q2) > 0.5 * sd THEN q2 ELSE m END - 0.25 * sd, 6) FROM s
UNION ALL SELECT 'fixed', 3.0::DOUBLE FROM s""")


def m13_score_quantiles(t: Tables) -> DataFrame:
    q = quantiles.exact_quantiles(t.raw("lineitem"), "l_extendedprice", [0.05, 0.25, 0.5, 0.95])
    return _rounded(q, "quantile")


M13_QUANTILES = """
SELECT p AS probability, round(q, 6) AS quantile FROM (
  SELECT unnest([0.05, 0.25, 0.5, 0.95]::DOUBLE[]) AS p,
         unnest(quantile_cont(l_extendedprice, [0.05, 0.25, 0.5, 0.95])) AS q
  FROM lineitem)"""


# -- rules --------------------------------------------------------------------------


def m01_best_by_rule(t: Tables) -> DataFrame:
    active = t.posts().filter("status = 'active'")
    return _rounded(rules.best_by_rule(t.people(), active), "similarity_score", "distance")


_ALL_RULE_PAIRS = f"""(SELECT o.job_offer_id, c.candidate_id, {RULE_SCORE} AS score
  FROM fx_candidates c, fx_offers o WHERE o.status = 'active')"""

M01_BEST = sql(f"""
SELECT job_offer_id, candidate_id, round(least(score, 0.95::DOUBLE), 6) AS similarity_score,
       round(1.0::DOUBLE - score, 6) AS distance, CAST(match_rank AS INT) AS match_rank
FROM (SELECT *, row_number() OVER (PARTITION BY job_offer_id
                                   ORDER BY round(score, 6) DESC, candidate_id) AS match_rank
      FROM {_ALL_RULE_PAIRS} WHERE score >= 0.4)
WHERE match_rank <= 15""")


def m01_rule_score_counts(t: Tables) -> DataFrame:
    active = t.posts().filter("status = 'active'")
    return _rounded(rules.rule_score_counts(t.people(), active), "similarity_score")


M01_COUNTS = sql(f"""
SELECT job_offer_id, round(least(score, 0.95::DOUBLE), 6) AS similarity_score,
       CAST(count(*) AS BIGINT) AS candidates
FROM {_ALL_RULE_PAIRS} WHERE score >= 0.4 GROUP BY 1, 2""")


def m01_rule_rescore(t: Tables) -> DataFrame:
    return _rounded(
        t.matches().select("candidate_id", "job_offer_id", "similarity_score", "distance"),
        "similarity_score",
        "distance",
    )


M01_RESCORE = sql("""
SELECT candidate_id, job_offer_id, round(similarity_score, 6) AS similarity_score,
       round(distance, 6) AS distance FROM fx_matches""")


def j08_best_offers_by_rule(t: Tables) -> DataFrame:
    """Every candidate against every active offer: the best 15 of each candidate."""
    active = t.posts().filter("status = 'active'")
    return _rounded(rules.best_offers_by_rule(t.people(), active), "similarity_score", "distance")


J08 = sql(f"""
SELECT candidate_id, job_offer_id, round(least(score, 0.95::DOUBLE), 6) AS similarity_score,
       round(1.0::DOUBLE - score, 6) AS distance, CAST(match_rank AS INT) AS match_rank
FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id
                                   ORDER BY round(score, 6) DESC, job_offer_id) AS match_rank
      FROM {_ALL_RULE_PAIRS} WHERE score >= 0.4)
WHERE match_rank <= 15""")


def m21_demo_matches(t: Tables) -> DataFrame:
    active = t.posts().filter("status = 'active'")
    return _rounded(rules.demo_matches(t.people(), active), "similarity_score", "distance")


M21 = sql(f"""
SELECT candidate_id, job_offer_id, round(least(score, 0.95::DOUBLE), 6) AS similarity_score,
       round(1.0::DOUBLE - score, 6) AS distance
FROM (SELECT c.candidate_id, o.job_offer_id, {RULE_SCORE} AS score
      FROM (SELECT * FROM fx_candidates ORDER BY candidate_id LIMIT 20) c,
           (SELECT * FROM fx_offers WHERE status = 'active' ORDER BY job_offer_id LIMIT 5) o)
WHERE score >= 0.4 ORDER BY candidate_id, job_offer_id LIMIT 100""")


def _paired(t: Tables) -> DataFrame:
    return (
        t.matches()
        .select("candidate_id", "job_offer_id", "similarity_score")
        .join(
            t.people().select("candidate_id", F.col("job_category").alias("mine")),
            "candidate_id",
        )
        .join(
            t.posts().select("job_offer_id", F.col("job_category").alias("theirs")),
            "job_offer_id",
        )
    )


def m02_flag_scores(t: Tables) -> DataFrame:
    return _paired(t).select(
        "candidate_id",
        "job_offer_id",
        scores.flag_score(F.col("mine"), F.col("theirs")).alias("similarity_score"),
    )


M02 = sql("""
SELECT candidate_id, job_offer_id,
       CASE WHEN c.job_category = o.job_category THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END
         AS similarity_score
FROM fx_matches JOIN fx_candidates c USING (candidate_id) JOIN fx_offers o USING (job_offer_id)""")


def m16_match_records(t: Tables) -> DataFrame:
    return _rounded(
        matching.graded(t.matches()), "similarity_score", "distance", "overall_match_percentage"
    )


M16 = sql("""
SELECT candidate_id, job_offer_id, round(similarity_score, 6) AS similarity_score,
       round(1.0::DOUBLE - similarity_score, 6) AS distance,
       CASE WHEN similarity_score > 0.6 THEN 'good' WHEN similarity_score > 0.3 THEN 'fair'
            ELSE 'poor' END AS status,
       round(similarity_score, 6) AS overall_match_percentage
FROM fx_matches""")


def m17_seeded_jitter(t: Tables) -> DataFrame:
    """The second tier with its tie-breaking bonus."""
    found = tiers.category_tier(t.candidates(), t.offers(), noise=0.3, seed=7)
    return _rounded(found, "similarity_score", "distance")


_JITTER = """(('0x' || substr(md5(c.candidate_id || chr(31) || o.job_offer_id || chr(31) || '7'), 1, 13))::BIGINT
  / 4503599627370496.0::DOUBLE * 0.3::DOUBLE)"""

M17_TEXT = f"""
SELECT candidate_id, job_offer_id, round(s, 6) AS similarity_score, round(1.0::DOUBLE - s, 6) AS distance
FROM (SELECT candidate_id, job_offer_id, least({{tier}} + {_JITTER}, 0.95::DOUBLE) AS s
      FROM fx_candidates c,
           (SELECT * FROM fx_offers WHERE status = 'active' OR status IS NULL
            ORDER BY created_at DESC NULLS LAST, job_offer_id LIMIT 50) o)
WHERE s >= 0.2"""


def m17_jittered_records(t: Tables) -> DataFrame:
    """Match records with the bonus that M-16 allows, which moves status borders."""
    return _rounded(
        matching.graded(t.matches(), noise=0.05, seed=7), "similarity_score", "distance", "overall_match_percentage"
    )


M17_RECORDS = sql(f"""
SELECT candidate_id, job_offer_id, round(s, 6) AS similarity_score, round(1.0::DOUBLE - s, 6) AS distance,
       CASE WHEN s > 0.6 THEN 'good' WHEN s > 0.3 THEN 'fair' ELSE 'poor' END AS status,
       round(s, 6) AS overall_match_percentage
FROM (SELECT c.candidate_id, c.job_offer_id, least(greatest(similarity_score - 0.05::DOUBLE
        + (('0x' || substr(md5(c.candidate_id || chr(31) || c.job_offer_id || chr(31) || '7'), 1, 13))::BIGINT
           / 4503599627370496.0::DOUBLE * 0.1::DOUBLE), 0), 1) AS s FROM fx_matches c)""")


# -- overlap ------------------------------------------------------------------------


def _skill_sides(t: Tables) -> tuple[DataFrame, DataFrame]:
    c = t.skills().select("candidate_id", F.col("skills.technical_skills").alias("s"))
    return (
        overlap.folded_skills(c, "candidate_id", "s"),
        overlap.folded_skills(t.offer_skills(), "job_offer_id", "technical_skills"),
    )


def m14_best_by_overlap(t: Tables) -> DataFrame:
    mine, theirs = _skill_sides(t)
    return _rounded(overlap.best_by_overlap(mine, theirs), "similarity_score")


def m14_through_index(t: Tables) -> DataFrame:
    """The same where the offers do not fit in memory."""
    mine, theirs = _skill_sides(t)
    return _rounded(overlap.best_by_overlap(mine, theirs, few_offers=0), "similarity_score")


M14_BEST = sql("""
SELECT job_offer_id, candidate_id, round(s, 6) AS similarity_score,
       CAST(pos AS INT) AS match_rank
FROM (SELECT *, row_number() OVER (PARTITION BY job_offer_id ORDER BY s DESC, candidate_id) AS pos
      FROM (SELECT o.job_offer_id, c.candidate_id,
                   count(*)::DOUBLE / any_value(n) AS s
            FROM fx_skill c JOIN fx_offer_skill o USING (skill)
            JOIN (SELECT job_offer_id, count(*) AS n FROM fx_offer_skill GROUP BY 1) n
              USING (job_offer_id)
            WHERE c.kind = 'technical' GROUP BY 1, 2)
      WHERE s >= 0.2)
WHERE pos <= 15""")


def m14_overlap_of_matches(t: Tables) -> DataFrame:
    mine, theirs = _skill_sides(t)
    pairs = t.matches().select("candidate_id", "job_offer_id")
    return _rounded(overlap.overlap_scores(pairs, mine, theirs), "similarity_score")


M14_PAIRS = sql("""
SELECT m.candidate_id, m.job_offer_id,
       round(count(c.skill)::DOUBLE / count(o.skill), 6) AS similarity_score
FROM fx_matches m JOIN fx_offer_skill o USING (job_offer_id)
LEFT JOIN fx_skill c ON c.candidate_id = m.candidate_id AND c.kind = 'technical'
                    AND c.skill = o.skill
GROUP BY 1, 2""")


# -- text fallback of the vector match -----------------------------------------------


def m15_vector_or_overlap(t: Tables) -> DataFrame:
    """Best candidates where some vectors are unreadable: those pairs use the label."""
    e = t.raw("embeddings")
    readable = F.when(F.col("vec_id") % 50 != 7, F.col("embedding").cast("array<double>"))
    skills = F.array(F.concat(F.lit("Label "), F.col("label").cast("string")))
    side = e.select("vec_id", readable.alias("skills_vector"), skills.alias("s"))
    folded = overlap.folded_skills(side, "vec_id", "s")
    both = side.drop("s").join(folded, "vec_id")
    mine = both.withColumnRenamed("vec_id", "candidate_id")
    theirs = both.withColumnRenamed("vec_id", "job_offer_id").withColumn("status", F.lit("active"))
    return _rounded(matching.best_matches(mine, theirs), "similarity_score")


M15 = sql("""
SELECT job_offer_id, candidate_id, round(s, 6) AS similarity_score, CAST(pos AS INT) AS match_rank
FROM (SELECT *, row_number() OVER (PARTITION BY job_offer_id ORDER BY s DESC, candidate_id) AS pos
      FROM (SELECT o.vec_id AS job_offer_id, c.vec_id AS candidate_id,
                   CASE WHEN c.vec_id % 50 = 7 OR o.vec_id % 50 = 7
                        THEN (c.label = o.label)::INT::DOUBLE
                        ELSE exp(-power(list_distance(c.u, o.u), 2) / 2.0::DOUBLE) END AS s
            FROM fx_unit c, fx_unit o)
      WHERE s >= 0.2)
WHERE pos <= 15""")


# -- fallback tiers ------------------------------------------------------------------


def m03_category_tier(t: Tables) -> DataFrame:
    return _rounded(tiers.category_tier(t.candidates(), t.offers()), "similarity_score", "distance")


_TIER_SCORE = """CASE
  WHEN coalesce(c.job_category, '') = '' OR coalesce(o.job_category, '') = '' THEN 0.4::DOUBLE
  WHEN lower(c.job_category) = lower(o.job_category) THEN 0.8::DOUBLE
  WHEN instr(lower(o.job_category), lower(c.job_category)) > 0
    OR instr(lower(c.job_category), lower(o.job_category)) > 0 THEN 0.6::DOUBLE
  ELSE 0.4::DOUBLE END"""

M03 = sql(f"""
SELECT candidate_id, job_offer_id, round({_TIER_SCORE}, 6) AS similarity_score,
       round(1.0::DOUBLE - {_TIER_SCORE}, 6) AS distance
FROM fx_candidates c,
     (SELECT * FROM fx_offers WHERE status = 'active' OR status IS NULL
      ORDER BY created_at DESC NULLS LAST, job_offer_id LIMIT 50) o""")


def m04_last_resort(t: Tables) -> DataFrame:
    found = tiers.last_resort_tier(t.candidates(), t.offers(), t.matches())
    return _rounded(found, "similarity_score", "distance")


_LAST = """(SELECT c.candidate_id, o.job_offer_id, 0.6::DOUBLE + 0.05::DOUBLE * o.i AS s
  FROM fx_candidates c, (SELECT job_offer_id, i FROM (
       SELECT job_offer_id, row_number() OVER (ORDER BY created_at DESC NULLS LAST, job_offer_id) - 1
                AS i FROM fx_offers) WHERE i < 10) o
  WHERE NOT EXISTS (SELECT 1 FROM fx_matches m WHERE m.candidate_id = c.candidate_id
                                                 AND m.job_offer_id = o.job_offer_id))"""

M04 = sql(f"""
SELECT candidate_id, job_offer_id, round(s, 6) AS similarity_score,
       round(1.0::DOUBLE - s, 6) AS distance FROM {_LAST}""")


def m05_cascade(t: Tables) -> DataFrame:
    """A second tier that asks for a fitting category leaves some to the third."""
    good = t.matches().filter("similarity_score >= 0.6")
    found = tiers.fallback_cascade(t.candidates(), t.offers(), good, min_category=0.6)
    return _rounded(found, "similarity_score", "distance")


M05 = sql(f"""
, good AS (SELECT * FROM fx_matches WHERE similarity_score >= 0.6),
second AS (
  SELECT candidate_id, job_offer_id, {_TIER_SCORE} AS s
  FROM fx_candidates c,
       (SELECT * FROM fx_offers WHERE status = 'active' OR status IS NULL
        ORDER BY created_at DESC NULLS LAST, job_offer_id LIMIT 50) o
  WHERE c.candidate_id NOT IN (SELECT candidate_id FROM good) AND {_TIER_SCORE} >= 0.6)
SELECT candidate_id, job_offer_id, round(similarity_score, 6) AS similarity_score,
       round(distance, 6) AS distance, 1 AS tier FROM good
UNION ALL
SELECT candidate_id, job_offer_id, round(s, 6), round(1.0::DOUBLE - s, 6), 2 FROM second
UNION ALL
SELECT candidate_id, job_offer_id, round(s, 6), round(1.0::DOUBLE - s, 6), 3
FROM (SELECT c.candidate_id, o.job_offer_id, 0.6::DOUBLE + 0.05::DOUBLE * o.i AS s
      FROM fx_candidates c, (SELECT job_offer_id, i FROM (
           SELECT job_offer_id, row_number() OVER (ORDER BY created_at DESC NULLS LAST, job_offer_id) - 1
                    AS i FROM fx_offers) WHERE i < 10) o
      WHERE NOT EXISTS (SELECT 1 FROM good m WHERE m.candidate_id = c.candidate_id AND m.job_offer_id = o.job_offer_id))
WHERE candidate_id NOT IN (SELECT candidate_id FROM good)
  AND candidate_id NOT IN (SELECT candidate_id FROM second)""")


def m05_cascade_without_open_offers(t: Tables) -> DataFrame:
    closed = t.offers().withColumn("status", F.lit("closed"))
    found = tiers.fallback_cascade(t.candidates(), closed, t.matches())
    return _rounded(found, "similarity_score", "distance")


M05_CLOSED = sql(f"""
SELECT candidate_id, job_offer_id, round(similarity_score, 6) AS similarity_score,
       round(distance, 6) AS distance, 1 AS tier FROM fx_matches
UNION ALL
SELECT candidate_id, job_offer_id, round(s, 6), round(1.0::DOUBLE - s, 6), 3 FROM {_LAST}
WHERE candidate_id NOT IN (SELECT candidate_id FROM fx_matches)""")


def m20_new_offers(t: Tables) -> DataFrame:
    """A match table after every offer has come in as new: the best 15 of each are merged."""
    e = t.raw("embeddings")
    stored = e.groupBy(F.col("label").cast("long").alias("job_offer_id")).agg(F.min("vec_id").alias("candidate_id"))
    stored = maintenance.match_rows(stored.withColumn("similarity_score", F.lit(0.25)), F.lit("2000-01-01").cast("timestamp"))
    skills = F.array().cast("array<string>")
    mine = t.vectors("candidate_id").withColumn("skill_set", skills)
    theirs = t.vectors("job_offer_id").withColumn("skill_set", skills).withColumn("status", F.lit("active"))
    merged = matching.after_new_offers(stored, mine, theirs)
    return merged.select(
        "match_id", "candidate_id", "job_offer_id", F.round("similarity_score", 6).alias("similarity_score"),
        (F.year("created_at") == 2000).alias("stored_before"),
    )


M20 = sql(f"""
, fresh AS (
  SELECT job_offer_id, candidate_id, round(s, 6) AS s
  FROM (SELECT *, row_number() OVER (PARTITION BY job_offer_id ORDER BY s DESC, candidate_id) AS match_rank
        FROM ({_unit_pairs_sql("true")}) WHERE s >= 0.2)
  WHERE match_rank <= 15),
stored AS (SELECT CAST(label AS BIGINT) AS job_offer_id, min(vec_id) AS candidate_id FROM embeddings GROUP BY 1)
SELECT md5(coalesce(f.candidate_id, b.candidate_id) || '-' || coalesce(f.job_offer_id, b.job_offer_id)) AS match_id,
       coalesce(f.candidate_id, b.candidate_id) AS candidate_id, coalesce(f.job_offer_id, b.job_offer_id) AS job_offer_id,
       coalesce(f.s, 0.25::DOUBLE) AS similarity_score, b.candidate_id IS NOT NULL AS stored_before
FROM fresh f FULL JOIN stored b ON f.candidate_id = b.candidate_id AND f.job_offer_id = b.job_offer_id""")

CHECKS = {
    "m01_best_by_rule": (m01_best_by_rule, M01_BEST),
    "m01_rule_score_counts": (m01_rule_score_counts, M01_COUNTS),
    "m01_rule_rescore": (m01_rule_rescore, M01_RESCORE),
    "j08_rule_matches_of_arrivals": (j08_best_offers_by_rule, J08),
    "m02_flag_scores": (m02_flag_scores, M02),
    "m03_category_tier": (m03_category_tier, M03),
    "m04_last_resort": (m04_last_resort, M04),
    "m05_cascade": (m05_cascade, M05),
    "m05_cascade_without_open_offers": (m05_cascade_without_open_offers, M05_CLOSED),
    "m06_unit_vectors": (m06_unit_vectors, M06),
    "m07_distances": (m07_distances, M07),
    "m11_shape_guard": (m11_shape_guard, M11),
    "m13_thresholds": (m13_thresholds, M13),
    "m13_score_quantiles": (m13_score_quantiles, M13_QUANTILES),
    "m14_best_by_overlap": (m14_best_by_overlap, M14_BEST),
    "m14_through_index": (m14_through_index, M14_BEST),
    "m14_overlap_of_matches": (m14_overlap_of_matches, M14_PAIRS),
    "m15_vector_or_overlap": (m15_vector_or_overlap, M15),
    "m16_match_records": (m16_match_records, M16),
    "m17_seeded_jitter": (m17_seeded_jitter, sql(M17_TEXT.format(tier=_TIER_SCORE))),
    "m17_jittered_records": (m17_jittered_records, M17_RECORDS),
    "m18_best_candidates": (m18_best_candidates, M18),
    "m18_through_cells": (m18_through_cells, M18),
    "m19_similar_pairs": (m19_best_offers, M19),
    "m19_all_pairs": (m19_all_pairs, M19_ALL),
    "m20_new_offers": (m20_new_offers, M20),
    "m21_demo_matches": (m21_demo_matches, M21),
}
