"""Filters, joins, searches, sorts and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchwright.operators import analytics, views
from matchwright.operators.tiers import newest_offers
from matchwright.sources.tables import candidate_export, export_csv, new_folder

from .fixtures import Tables, placed, placed_in_runs, sql


def p01_projection(t: Tables) -> DataFrame:
    return t.matches().select(
        "match_id",
        F.col("created_at").alias("match_created"),
        F.col("updated_at").alias("match_updated"),
    )


def p02_open_strict(t: Tables) -> DataFrame:
    return views.open_offers(t.offers())


def p03_open_lenient(t: Tables) -> DataFrame:
    return views.open_offers(t.offers(), lenient=True)


def p04_filled(t: Tables) -> DataFrame:
    return views.filled(t.candidates(), "job_category").select("candidate_id", "job_category")


def p05_known(t: Tables) -> DataFrame:
    return views.known(t.candidates(), "experience_years", "education_level").select(
        "candidate_id", "experience_years", "education_level"
    )


def p06_point_lookup(t: Tables) -> DataFrame:
    return views.by_key(t.candidates(), "candidate_id", 42)


def p07_client_offers(t: Tables) -> DataFrame:
    listed = placed(views.client_offers(t.offers()), "client_id")
    return listed.select("client_id", "job_offer_id", "job_title", "place")


def _with_type(t: Tables) -> DataFrame:
    return t.matches().join(t.posts().select("job_offer_id", "job_type", "company_name"), "job_offer_id")


def p08_browse(t: Tables) -> DataFrame:
    kept = views.browse_matches(_with_type(t), 0.5, "Contract", "Company Name")
    return placed(kept).select(
        "company_name", "candidate_id", "job_offer_id", F.round("similarity_score", 6).alias("score"), "place"
    )


def p09_choices(t: Tables) -> DataFrame:
    return views.choices(t.posts(), "job_type")


def p10_search(t: Tables) -> DataFrame:
    found = t.skilled()
    for condition in views.search_filter(10, "Master", "asia", ["GIZMO", "hot ring"]):
        found = found.filter(condition)
    return found.select("candidate_id", "city", "experience_years")


_SEARCH = """SELECT c.* FROM fx_candidates c
WHERE c.experience_years >= 10 AND c.education_level = 'Master'
  AND (contains(lower(c.city), 'asia') OR contains(lower(c.country), 'asia'))
  AND c.candidate_id IN (SELECT candidate_id FROM fx_skill
        WHERE contains(lower(skill), 'gizmo') OR contains(lower(skill), 'hot ring'))"""


def p12_view_guards(t: Tables) -> DataFrame:
    return analytics.diversity(analytics.experience_groups(t.people()))


def p12_skill_and_place_guards(t: Tables) -> DataFrame:
    return analytics.guards(analytics.skill_frequency(t.skills()), t.people())


def j01_candidate_matches(t: Tables) -> DataFrame:
    return placed_in_runs(views.candidate_matches(t.matches(), t.posts()), "candidate_id").select(
        "place",
        "candidate_id",
        "job_offer_id",
        F.round("similarity_score", 6).alias("similarity_score"),
        "job_title",
        "company_name",
        "job_category",
    )


def j02_job_candidates(t: Tables) -> DataFrame:
    return placed_in_runs(views.job_candidates(t.people(), t.matches()), "job_offer_id").select(
        "place",
        "job_offer_id",
        "candidate_id",
        "first_name",
        "email",
        F.round("similarity_score", 6).alias("similarity_score"),
        "match_created_at",
    )


def j03_offer_statistics(t: Tables) -> DataFrame:
    s = analytics.offer_statistics(t.posts(), t.matches())
    return s.withColumns({c: F.round(c, 9) for c in ("avg_score", "best_score")})


J03 = """SELECT o.job_offer_id, o.client_id, o.job_title,
       CAST(count(m.candidate_id) AS BIGINT) AS candidate_count,
       avg(m.similarity_score) AS avg_score, max(m.similarity_score) AS best_score
FROM fx_offers o LEFT JOIN fx_matches m USING (job_offer_id) GROUP BY 1, 2, 3"""


def g30_search_ranking(t: Tables) -> DataFrame:
    found = views.search_candidates(
        t.skilled(), t.matches(), 50, min_experience=5, location="america", skills=["ring"]
    )
    return found.select(
        "candidate_id", F.round("avg_match_score", 9).alias("avg_match_score"), "total_matches"
    )


G30 = """SELECT candidate_id, round(a, 9) AS avg_match_score, n AS total_matches FROM (
  SELECT c.candidate_id, coalesce(avg(m.similarity_score), 0) AS a,
         CAST(count(m.match_id) AS BIGINT) AS n
  FROM fx_candidates c LEFT JOIN fx_matches m USING (candidate_id)
  WHERE c.experience_years >= 5
    AND (contains(lower(c.city), 'america') OR contains(lower(c.country), 'america'))
    AND c.candidate_id IN (SELECT candidate_id FROM fx_skill WHERE contains(lower(skill), 'ring'))
  GROUP BY 1)
ORDER BY round(a, 9) DESC, n DESC, candidate_id LIMIT 50"""


def j04_candidate_match_totals(t: Tables) -> DataFrame:
    every = views.search_candidates(t.skilled(), t.matches(), None)
    return every.select(
        "candidate_id", F.round("avg_match_score", 9).alias("avg_match_score"), "total_matches"
    )


J04 = """SELECT c.candidate_id, round(coalesce(avg(m.similarity_score), 0), 9) AS avg_match_score,
       CAST(count(m.match_id) AS BIGINT) AS total_matches
FROM fx_candidates c LEFT JOIN fx_matches m USING (candidate_id) GROUP BY 1"""


def j05_match_sample(t: Tables) -> DataFrame:
    """The best five matches with their offer, where it is still active."""
    sample = views.match_sample(t.matches(), views.open_offers(t.posts()), 5)
    return sample.withColumn("similarity_score", F.round("similarity_score", 6))


J05 = """SELECT job_offer_id, candidate_id, round(similarity_score, 6) AS similarity_score,
       created_at, job_title, company_name
FROM (SELECT *, row_number() OVER (PARTITION BY candidate_id
                                   ORDER BY similarity_score DESC, job_offer_id) AS pos
      FROM fx_matches) m
LEFT JOIN (SELECT job_offer_id, job_title, company_name FROM fx_offers WHERE status = 'active') o
  USING (job_offer_id)
WHERE pos <= 5"""


def _all_lines(t: Tables) -> DataFrame:
    return t.bought().select(
        F.col("o_custkey").alias("candidate_id"), F.col("l_suppkey").alias("job_offer_id")
    )


def j09_unmatched_pairs(t: Tables) -> DataFrame:
    """Pairs that met on a line but have no stored match."""
    return views.unmatched_pairs(_all_lines(t).distinct(), t.matches())


def j10_existing_emails(t: Tables) -> DataFrame:
    """Customers named in an order, by e-mail."""
    seen = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email")
    )
    return views.existing(t.candidates(), seen, ["email"]).select("candidate_id", "email")


def n03_ranked_candidates(t: Tables) -> DataFrame:
    return views.ranked_candidates(t.matches(), t.people())


N03 = """SELECT job_offer_id, candidate_id, first_name, last_name, CAST(pos AS INT) AS position,
  CASE pos WHEN 1 THEN '🥇' WHEN 2 THEN '🥈' WHEN 3 THEN '🥉' ELSE '#' || pos END AS label,
  CASE WHEN similarity_score > 0.8 THEN 'excellent-match'
       WHEN similarity_score > 0.6 THEN 'good-match' ELSE 'average-match' END AS match_class,
  printf('%.1f%%', similarity_score * 100) AS match_text
FROM (SELECT *, row_number() OVER (PARTITION BY job_offer_id
                                   ORDER BY similarity_score DESC, candidate_id) AS pos
      FROM fx_matches) JOIN fx_candidates USING (candidate_id)
WHERE pos <= 10"""


def l01_top_parts(t: Tables) -> DataFrame:
    counts = t.raw("part").groupBy("p_brand").agg(F.count("*").alias("parts"))
    return analytics.most_frequent(counts, "p_brand", "parts", 10)


def l02_first_candidates(t: Tables) -> DataFrame:
    return t.candidates().orderBy("candidate_id").limit(100).select("candidate_id", "email")


def l03_newest_offers(t: Tables) -> DataFrame:
    return newest_offers(t.offers(), 10).select("job_offer_id", "created_at")


def l05_sorted_by_date(t: Tables) -> DataFrame:
    return placed(views.browse_matches(_with_type(t), 0.8, "All", "Date")).select(
        "candidate_id", "job_offer_id", "updated_at", "place"
    )


def io10_filtered_export(t: Tables) -> DataFrame:
    """Matches of the browser written as CSV and read back."""
    kept = views.browse_matches(_with_type(t), 0.5).select(
        "match_id", "candidate_id", "job_offer_id", "job_type", "company_name"
    )
    path = new_folder(t.spark, "exported")
    export_csv(kept, path)
    return t.spark.read.option("header", True).schema(kept.schema).csv(path)


def io11_candidate_export(t: Tables) -> DataFrame:
    listed = views.job_candidates(t.people(), t.matches()).withColumns(
        {"phone": F.lit(None).cast("string")}
    )
    return candidate_export(listed)


CHECKS = {
    "p01_projection": (
        p01_projection,
        sql("SELECT match_id, created_at AS match_created, updated_at AS match_updated FROM fx_matches"),
    ),
    "p02_open_strict": (p02_open_strict, sql("SELECT * FROM fx_offers WHERE status = 'active'")),
    "p03_open_lenient": (
        p03_open_lenient,
        sql("SELECT * FROM fx_offers WHERE status = 'active' OR status IS NULL"),
    ),
    "p04_filled": (
        p04_filled,
        sql("SELECT candidate_id, job_category FROM fx_candidates WHERE job_category <> ''"),
    ),
    "p05_known": (
        p05_known,
        sql("""SELECT candidate_id, experience_years, education_level FROM fx_candidates
               WHERE experience_years IS NOT NULL AND education_level IS NOT NULL"""),
    ),
    "p06_point_lookup": (p06_point_lookup, sql("SELECT * FROM fx_candidates WHERE candidate_id = 42")),
    "p07_client_offers": (
        p07_client_offers,
        sql("""SELECT client_id, job_offer_id, job_title, CAST(row_number() OVER (PARTITION BY client_id
                 ORDER BY created_at DESC NULLS LAST, job_offer_id) AS INT) AS place FROM fx_offers"""),
    ),
    "p08_browse": (
        p08_browse,
        sql("""SELECT company_name, candidate_id, job_offer_id, round(similarity_score, 6) AS score,
                      CAST(row_number() OVER (ORDER BY company_name, candidate_id, job_offer_id) AS INT) AS place
               FROM fx_matches JOIN fx_offers USING (job_offer_id)
               WHERE similarity_score >= 0.5 AND job_type = 'Contract'"""),
    ),
    "p09_choices": (p09_choices, sql("SELECT DISTINCT job_type FROM fx_offers")),
    "p10_search": (
        p10_search,
        sql(f"SELECT candidate_id, city, experience_years FROM ({_SEARCH})"),
    ),
    "p12_view_guards": (
        p12_view_guards,
        sql("""SELECT count(*) AS rows, count(DISTINCT coalesce(job_category, '\x01')) AS categories,
                      count(*) > 10 AND count(DISTINCT coalesce(job_category, '\x01')) > 2 AS show_detail,
                      count(DISTINCT coalesce(job_category, '\x01')) > 1 AS show_progression
               FROM (SELECT DISTINCT experience_years, job_category, education_level
                     FROM fx_candidates WHERE experience_years IS NOT NULL)"""),
    ),
    "p12_skill_and_place_guards": (
        p12_skill_and_place_guards,
        sql("""SELECT *, skills > 5 AS show_skills, countries > 1 AS show_countries FROM (
                 SELECT (SELECT count(DISTINCT skill) FROM fx_skill WHERE kind = 'technical') AS skills,
                        (SELECT count(DISTINCT country) FROM fx_candidates) AS countries)"""),
    ),
    "j01_candidate_matches": (
        j01_candidate_matches,
        sql("""SELECT candidate_id, job_offer_id, round(similarity_score, 6) AS similarity_score,
                      job_title, company_name, job_category,
                      CAST(row_number() OVER (PARTITION BY candidate_id ORDER BY similarity_score DESC,
                        m.created_at DESC NULLS LAST, job_offer_id) AS INT) AS place
               FROM fx_matches m JOIN fx_offers USING (job_offer_id)"""),
    ),
    "j02_job_candidates": (
        j02_job_candidates,
        sql("""SELECT job_offer_id, candidate_id, first_name, email,
                      round(similarity_score, 6) AS similarity_score, m.created_at AS match_created_at,
                      CAST(row_number() OVER (PARTITION BY job_offer_id
                        ORDER BY similarity_score DESC, candidate_id) AS INT) AS place
               FROM fx_candidates c JOIN fx_matches m USING (candidate_id)"""),
    ),
    "j03_offer_statistics": (
        j03_offer_statistics,
        sql(f"""SELECT job_offer_id, client_id, job_title, candidate_count,
                       round(avg_score, 9) AS avg_score, round(best_score, 9) AS best_score
                FROM ({J03})"""),
    ),
    "j04_candidate_match_totals": (j04_candidate_match_totals, sql(J04)),
    "j05_match_sample": (j05_match_sample, sql(J05)),
    "j09_unmatched_pairs": (
        j09_unmatched_pairs,
        sql("""SELECT DISTINCT o_custkey AS candidate_id, l_suppkey AS job_offer_id FROM fx_bought
               EXCEPT SELECT candidate_id, job_offer_id FROM fx_matches"""),
    ),
    "j10_existing_emails": (
        j10_existing_emails,
        sql("""SELECT candidate_id, email FROM fx_candidates
               WHERE candidate_id IN (SELECT o_custkey FROM orders)"""),
    ),
    "g30_search_ranking": (g30_search_ranking, sql(G30)),
    "n03_ranked_candidates": (n03_ranked_candidates, sql(N03)),
    "l01_top_parts": (
        l01_top_parts,
        "SELECT p_brand, count(*) AS parts FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    ),
    "l02_first_candidates": (
        l02_first_candidates,
        sql("SELECT candidate_id, email FROM fx_candidates ORDER BY 1 LIMIT 100"),
    ),
    "l03_newest_offers": (
        l03_newest_offers,
        sql("""SELECT job_offer_id, created_at FROM fx_offers
               ORDER BY created_at DESC NULLS LAST, job_offer_id LIMIT 10"""),
    ),
    "l05_sorted_by_date": (
        l05_sorted_by_date,
        sql("""SELECT candidate_id, job_offer_id, updated_at, CAST(row_number() OVER (
                 ORDER BY updated_at DESC, candidate_id, job_offer_id) AS INT) AS place
               FROM fx_matches WHERE similarity_score >= 0.8"""),
    ),
    "io10_filtered_export": (
        io10_filtered_export,
        sql("""SELECT match_id, candidate_id, job_offer_id, job_type, company_name
               FROM fx_matches JOIN fx_offers USING (job_offer_id) WHERE similarity_score >= 0.5"""),
    ),
    "io11_candidate_export": (
        io11_candidate_export,
        sql("""SELECT first_name, last_name, email, CAST(NULL AS VARCHAR) AS phone, city, country,
                      education_level, experience_years,
                      round(similarity_score * 100, 1) AS match_percentage
               FROM fx_candidates JOIN fx_matches USING (candidate_id)"""),
    ),
}
