"""Counts, distributions, rankings and time series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchwright.operators import analytics as a
from matchwright.plans import dashboards

from .fixtures import Tables, placed, sql


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def g01_technical_skills(t: Tables) -> DataFrame:
    return placed(a.skill_frequency(t.skills(), "technical_skills"))


def g02_soft_skills(t: Tables) -> DataFrame:
    return placed(a.skill_frequency(t.skills(), "soft_skills"))


def _frequency(kind: str) -> str:
    return f"""SELECT skill, frequency, CAST(row_number() OVER (ORDER BY frequency DESC, skill) AS INT) AS place
FROM (SELECT skill, count(*) AS frequency FROM fx_skill WHERE kind = '{kind}' GROUP BY 1)"""


def g03_categories(t: Tables) -> DataFrame:
    return placed(a.candidates_per_category(t.people()))


def g04_experience(t: Tables) -> DataFrame:
    return placed(a.candidates_per_experience(t.people()))


def g05_education(t: Tables) -> DataFrame:
    return placed(a.candidates_per_education(t.people()))


def g06_row_counts(t: Tables) -> DataFrame:
    return a.row_counts(
        candidates=t.people(), offers=t.posts(), matches=t.matches(), clients=t.clients()
    )


def g06_global_statistics(t: Tables) -> DataFrame:
    s = dashboards.global_statistics(t.people(), t.posts(), t.matches(), t.clients())
    return _r(s, "avg_match_score")


def g07_score_statistics(t: Tables) -> DataFrame:
    return _r(a.score_statistics(t.matches()), "avg_match_score")


def g08_match_summary(t: Tables) -> DataFrame:
    return _r(a.match_summary(t.matches()), "avg_similarity", "max_similarity")


def g09_offer_status(t: Tables) -> DataFrame:
    return a.offer_status(t.posts())


def g11_recruiter_summary(t: Tables) -> DataFrame:
    s = a.recruiter_summary(a.offer_statistics(t.posts(), t.matches()))
    return _r(s, "avg_candidates_per_job", "overall_avg_score")


def g12_candidate_summary(t: Tables) -> DataFrame:
    return _r(a.candidate_summary(t.matches()), "avg_match", "best_match")


def g13_match_quality(t: Tables) -> DataFrame:
    return _r(a.match_quality(t.matches()), "avg_match")


def g14_matches_per_candidate(t: Tables) -> DataFrame:
    return a.matches_per_candidate(t.matches())


def g15_score_histogram(t: Tables) -> DataFrame:
    return a.score_histogram(t.matches())


G15 = """SELECT CAST(p AS INT) AS position, band, CAST(count(m.s) AS BIGINT) AS count
FROM (VALUES (0, 0.0, 0.2, 'Very Low'), (1, 0.2, 0.4, 'Low'), (2, 0.4, 0.6, 'Medium'),
             (3, 0.6, 0.8, 'High'), (4, 0.8, 1.0, 'Excellent')) b(p, lo, hi, band)
LEFT JOIN (SELECT similarity_score AS s FROM fx_matches) m
  ON m.s > b.lo::DOUBLE AND m.s <= b.hi::DOUBLE
GROUP BY 1, 2"""


def g16_top_companies(t: Tables) -> DataFrame:
    return a.top_companies(t.matches(), t.posts())


def g17_match_categories(t: Tables) -> DataFrame:
    return a.categories_of_matches(t.matches(), t.posts())


def g18_mention_totals(t: Tables) -> DataFrame:
    return a.mention_totals(t.skills())


def g19_places(t: Tables) -> DataFrame:
    return a.by_place(t.people())


def g21_experience_bubbles(t: Tables) -> DataFrame:
    return a.experience_bubbles(t.people())


def g22_experience_groups(t: Tables) -> DataFrame:
    return a.experience_groups(t.people())


def g23_experience_rollups(t: Tables) -> DataFrame:
    return a.experience_rollups(a.experience_groups(t.people()))


def g24_experience_summary(t: Tables) -> DataFrame:
    return _r(a.experience_summary(a.experience_groups(t.people())), "avg_experience")


def g25_ungroup(t: Tables) -> DataFrame:
    return a.ungroup(a.experience_groups(t.people()))


def g26_by_education(t: Tables) -> DataFrame:
    return a.five_numbers(a.experience_groups(t.people()), "education_level")


def g26_by_category(t: Tables) -> DataFrame:
    return a.five_numbers(a.experience_groups(t.people()), "job_category")


def _five(by: str) -> str:
    x = "experience_years"
    return f"""SELECT {by}, min({x})::DOUBLE AS minimum, quantile_cont({x}, 0.25)::DOUBLE AS q1,
       quantile_cont({x}, 0.5)::DOUBLE AS median, quantile_cont({x}, 0.75)::DOUBLE AS q3,
       max({x})::DOUBLE AS maximum
FROM fx_candidates WHERE {x} IS NOT NULL AND {by} IS NOT NULL GROUP BY 1"""


def g27_daily(t: Tables) -> DataFrame:
    return a.daily_registrations(t.candidates())


def g28_daily_totals(t: Tables) -> DataFrame:
    return a.daily_totals(a.daily_registrations(t.candidates()))


def n01_running(t: Tables) -> DataFrame:
    return a.running_registrations(a.daily_registrations(t.candidates()))


def n05_skill_ranks(t: Tables) -> DataFrame:
    return a.skill_ranks(t.skills())


def l01_top_skills(t: Tables) -> DataFrame:
    return a.most_frequent(a.skill_frequency(t.skills()), "skill", "frequency", 30)


def g29_co_occurrence(t: Tables) -> DataFrame:
    return a.co_occurrence(t.skills())


G29 = """, top AS (SELECT skill FROM fx_skill WHERE kind = 'technical' GROUP BY 1
                 ORDER BY count(*) DESC, skill LIMIT 15),
 held AS (SELECT candidate_id, skill FROM fx_skill SEMI JOIN top USING (skill) WHERE kind = 'technical')
SELECT x.skill AS skill_1, y.skill AS skill_2, CAST(count(h.candidate_id) AS BIGINT) AS candidates
FROM top x CROSS JOIN top y
LEFT JOIN (SELECT h1.candidate_id, h1.skill AS s1, h2.skill AS s2
           FROM held h1 JOIN held h2 USING (candidate_id)) h
  ON h.s1 = x.skill AND h.s2 = y.skill
GROUP BY 1, 2"""


def g31_completeness(t: Tables) -> DataFrame:
    """Skills from the lines; orders stand for experience, none for certifications."""
    jobs = (
        t.raw("orders")
        .groupBy(F.col("o_custkey").alias("candidate_id"))
        .agg(F.array_sort(F.collect_set("o_orderpriority")).alias("experience"))
    )
    nothing = F.lit(None).cast("array<string>")
    return a.profile_completeness(
        t.skilled().join(jobs, "candidate_id", "left").withColumn("certifications", nothing)
    )


G31 = """SELECT c.candidate_id, coalesce(s.n, 0)::INT AS skills_count,
  coalesce(e.n, 0)::INT AS experience_count, 0::INT AS certifications_count,
  coalesce(s.n, 0) > 0 AS has_skills, coalesce(e.n, 0) > 0 AS has_experience,
  false AS has_certifications
FROM fx_candidates c
LEFT JOIN (SELECT candidate_id, count(*) AS n FROM fx_skill GROUP BY 1) s USING (candidate_id)
LEFT JOIN (SELECT o_custkey AS candidate_id, count(DISTINCT o_orderpriority) AS n
           FROM orders GROUP BY 1) e USING (candidate_id)"""

_COUNT = """SELECT {c}, count, CAST(row_number() OVER (ORDER BY {o}) AS INT) AS place
FROM (SELECT {c}, count(*) AS count FROM fx_candidates {w} GROUP BY 1)"""
_GROUPS = """SELECT experience_years, job_category, education_level, count(*) AS count
FROM fx_candidates WHERE experience_years IS NOT NULL GROUP BY 1, 2, 3"""
_DAILY = """SELECT CAST(created_at AS DATE) AS date, job_category, count(*) AS daily_count
FROM fx_candidates WHERE created_at IS NOT NULL GROUP BY 1, 2"""

CHECKS = {
    "g01_technical_skills": (g01_technical_skills, sql(_frequency("technical"))),
    "g02_soft_skills": (g02_soft_skills, sql(_frequency("soft"))),
    "g03_categories": (
        g03_categories,
        sql(_COUNT.format(c="job_category", w="WHERE job_category <> ''", o="count DESC, job_category")),
    ),
    "g04_experience": (g04_experience, sql(_COUNT.format(c="experience_years", w="", o="experience_years NULLS LAST"))),
    "g05_education": (
        g05_education,
        sql(_COUNT.format(c="education_level", w="WHERE education_level <> ''", o="count DESC, education_level")),
    ),
    "g06_row_counts": (
        g06_row_counts,
        sql("""SELECT 'candidates' AS "table", count(*) AS rows FROM fx_candidates
               UNION ALL SELECT 'offers', count(*) FROM fx_offers
               UNION ALL SELECT 'matches', count(*) FROM fx_matches
               UNION ALL SELECT 'clients', count(*) FROM nation"""),
    ),
    "g06_global_statistics": (
        g06_global_statistics,
        sql("""SELECT (SELECT count(*) FROM fx_candidates) AS nb_candidates,
                      (SELECT count(*) FROM fx_offers) AS nb_offers, count(*) AS nb_matches,
                      (SELECT count(*) FROM nation) AS nb_clients,
                      round(coalesce(avg(similarity_score), 0), 9) AS avg_match_score,
                      count(*) FILTER (similarity_score > 0.8) AS excellent_matches
               FROM fx_matches"""),
    ),
    "g07_score_statistics": (
        g07_score_statistics,
        sql("""SELECT round(coalesce(avg(similarity_score), 0), 9) AS avg_match_score,
                      count(*) FILTER (similarity_score > 0.8) AS excellent_matches FROM fx_matches"""),
    ),
    "g08_match_summary": (
        g08_match_summary,
        sql("""SELECT round(avg(similarity_score), 9) AS avg_similarity,
                      round(max(similarity_score), 9) AS max_similarity, count(*) AS total_matches
               FROM fx_matches"""),
    ),
    "g09_offer_status": (
        g09_offer_status,
        sql("""SELECT count(*) AS total_jobs, count(*) FILTER (status = 'active') AS active_jobs,
                      count(*) FILTER (status IS NULL) AS null_status_jobs FROM fx_offers"""),
    ),
    "g11_recruiter_summary": (
        g11_recruiter_summary,
        sql("""SELECT client_id, count(*) AS total_jobs, CAST(sum(n) AS BIGINT) AS total_candidates,
                      round(avg(n), 9) AS avg_candidates_per_job, round(avg(s), 9) AS overall_avg_score
               FROM (SELECT o.client_id, o.job_offer_id, count(m.candidate_id) AS n,
                            avg(m.similarity_score) AS s
                     FROM fx_offers o LEFT JOIN fx_matches m USING (job_offer_id) GROUP BY 1, 2)
               GROUP BY 1"""),
    ),
    "g12_candidate_summary": (
        g12_candidate_summary,
        sql("""SELECT candidate_id, count(*) AS total_matches, round(avg(similarity_score), 9) AS avg_match,
                      round(max(similarity_score), 9) AS best_match FROM fx_matches GROUP BY 1"""),
    ),
    "g13_match_quality": (
        g13_match_quality,
        sql("""SELECT candidate_id, count(*) AS total_matches,
                      count(*) FILTER (similarity_score > 0.8) AS excellent_matches,
                      count(*) FILTER (similarity_score > 0.6) AS good_matches,
                      round(avg(similarity_score), 9) AS avg_match FROM fx_matches GROUP BY 1"""),
    ),
    "g14_matches_per_candidate": (
        g14_matches_per_candidate,
        sql("SELECT candidate_id, count(*) AS count FROM fx_matches GROUP BY 1"),
    ),
    "g15_score_histogram": (g15_score_histogram, sql(G15)),
    "g16_top_companies": (
        g16_top_companies,
        sql("""SELECT company_name, count(*) AS count FROM fx_matches JOIN fx_offers USING (job_offer_id)
               GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""),
    ),
    "g17_match_categories": (
        g17_match_categories,
        sql("""SELECT job_category, count(*) AS count FROM fx_matches JOIN fx_offers USING (job_offer_id)
               GROUP BY 1"""),
    ),
    "g18_mention_totals": (
        g18_mention_totals,
        sql("""SELECT CASE kind WHEN 'technical' THEN 'Technical Skills' ELSE 'Soft Skills' END
                        AS skill_type, count(*) AS total_mentions FROM fx_skill GROUP BY 1"""),
    ),
    "g19_places": (
        g19_places,
        sql("""SELECT 'city' AS level, country, city, count(*) AS candidate_count FROM fx_candidates
               WHERE country <> '' GROUP BY 2, 3
               UNION ALL SELECT 'country', country, NULL, count(*) FROM fx_candidates
               WHERE country <> '' GROUP BY 2"""),
    ),
    "g21_experience_bubbles": (
        g21_experience_bubbles,
        sql("""SELECT experience_years, education_level, job_category, count(*) AS count
               FROM (SELECT DISTINCT experience_years, education_level, job_category,
                                     first_name, last_name FROM fx_candidates
                     WHERE experience_years IS NOT NULL AND education_level IS NOT NULL
                       AND job_category IS NOT NULL)
               GROUP BY 1, 2, 3"""),
    ),
    "g22_experience_groups": (g22_experience_groups, sql(_GROUPS)),
    "g23_experience_rollups": (
        g23_experience_rollups,
        sql("""SELECT 'year' AS grouping, experience_years, NULL AS education_level,
                      NULL AS job_category, count(*) AS count
               FROM fx_candidates WHERE experience_years IS NOT NULL GROUP BY 2
               UNION ALL SELECT 'year_education', experience_years, education_level, NULL, count(*)
               FROM fx_candidates WHERE experience_years IS NOT NULL AND education_level IS NOT NULL
               GROUP BY 2, 3
               UNION ALL SELECT 'category_year', experience_years, NULL, job_category, count(*)
               FROM fx_candidates WHERE experience_years IS NOT NULL AND job_category IS NOT NULL
               GROUP BY 2, 4"""),
    ),
    "g24_experience_summary": (
        g24_experience_summary,
        sql("""SELECT count(*) AS total_candidates, round(avg(experience_years), 9) AS avg_experience,
                      max(experience_years) AS max_experience, min(experience_years) AS min_experience
               FROM fx_candidates WHERE experience_years IS NOT NULL"""),
    ),
    "g25_ungroup": (
        g25_ungroup,
        sql("""SELECT experience_years, job_category, education_level FROM fx_candidates
               WHERE experience_years IS NOT NULL"""),
    ),
    "g26_by_education": (g26_by_education, sql(_five("education_level"))),
    "g26_by_category": (g26_by_category, sql(_five("job_category"))),
    "g27_daily": (g27_daily, sql(_DAILY)),
    "g28_daily_totals": (
        g28_daily_totals,
        sql(f"SELECT date, CAST(sum(daily_count) AS BIGINT) AS daily_count FROM ({_DAILY}) GROUP BY 1"),
    ),
    "n01_running": (
        n01_running,
        sql(f"""SELECT date, CAST(n AS BIGINT) AS daily_count,
                       CAST(sum(n) OVER (ORDER BY date) AS BIGINT) AS cumulative
                FROM (SELECT date, sum(daily_count) AS n FROM ({_DAILY}) GROUP BY 1)"""),
    ),
    "n05_skill_ranks": (
        n05_skill_ranks,
        sql(f"""SELECT skill, frequency, CAST(p AS INT) AS position, '#' || p AS label
                FROM (SELECT *, row_number() OVER (ORDER BY frequency DESC, skill) AS p
                      FROM ({_frequency("technical")})) WHERE p <= 5"""),
    ),
    "l01_top_skills": (
        l01_top_skills,
        sql(f"SELECT skill, frequency FROM ({_frequency('technical')}) ORDER BY frequency DESC, skill LIMIT 30"),
    ),
    "g29_co_occurrence": (g29_co_occurrence, sql(G29)),
    "g31_completeness": (g31_completeness, sql(G31)),
}
