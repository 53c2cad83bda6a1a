"""Reading, writing and merging tables; streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchwright.functions.text import pair_id
from matchwright.operators import maintenance as m
from matchwright.plans import candidate_table, matching
from matchwright.sources import tables as src
from matchwright.streaming import arrivals

from .fixtures import Tables, sql
from .match_checks import M18, M19


def _scores(df: DataFrame) -> DataFrame:
    return df.select(
        "match_id", "candidate_id", "job_offer_id", F.round("similarity_score", 6).alias("similarity_score")
    )


_MATCHES = """SELECT match_id, candidate_id, job_offer_id, round(similarity_score, 6) AS similarity_score
FROM fx_matches"""


def io01_read_table(t: Tables) -> DataFrame:
    return src.read_table(t.spark, f"{t.folder}/customer.parquet").select("c_custkey", "c_name")


def io03_append(t: Tables) -> DataFrame:
    """Good and fair matches appended one after the other, read back."""
    path = src.new_folder(t.spark, "appended")
    matches = t.matches()
    src.append_rows(matches.filter("similarity_score > 0.6"), path)
    src.append_rows(matches.filter("similarity_score <= 0.6"), path)
    return _scores(src.read_table(t.spark, path))


def _line_scores(t: Tables) -> DataFrame:
    """One new score per line: several per pair, the last shipped one counts."""
    c, o = F.col("o_custkey"), F.col("l_suppkey")
    lines = t.raw("orders").join(t.raw("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return lines.select(
        pair_id(c, o).alias("match_id"),
        c.alias("candidate_id"),
        o.alias("job_offer_id"),
        (F.lit(1.0) - F.col("l_discount")).alias("similarity_score"),
        F.col("l_discount").alias("distance"),
        (F.lit(1.0) - F.col("l_discount")).alias("overall_evaluation"),
        F.col("l_shipdate").alias("created_at"),
        F.col("l_shipdate").alias("updated_at"),
    )


def io04_upsert_matches(t: Tables) -> DataFrame:
    merged = m.upsert_matches(t.matches(), _line_scores(t))
    return merged.withColumns(
        {c: F.round(c, 6) for c in ("similarity_score", "distance", "overall_evaluation")}
    )


def io04_merge_into_stored_table(t: Tables) -> DataFrame:
    """The same upsert into a stored table, partition by partition."""
    path = src.new_folder(t.spark, "match-table")
    matching.create_match_table(t.matches(), path, 16)
    matching.merge_into_match_table(_line_scores(t), path)
    merged = src.read_table(t.spark, path).drop(matching.BUCKET)
    return merged.withColumns(
        {c: F.round(c, 6) for c in ("similarity_score", "distance", "overall_evaluation")}
    )


IO04 = """, u AS (SELECT candidate_id, job_offer_id, score, shipped FROM (
    SELECT o_custkey AS candidate_id, l_suppkey AS job_offer_id, 1.0::DOUBLE - l_discount AS score,
           l_shipdate AS shipped, row_number() OVER (PARTITION BY o_custkey, l_suppkey
             ORDER BY l_shipdate DESC, l_discount) AS rn
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey) WHERE rn = 1)
SELECT md5(candidate_id || '-' || job_offer_id) AS match_id, candidate_id, job_offer_id,
       round(coalesce(u.score, b.similarity_score), 6) AS similarity_score,
       round(coalesce(1 - u.score, b.distance), 6) AS distance,
       round(coalesce(u.score, b.overall_evaluation), 6) AS overall_evaluation,
       coalesce(b.created_at, u.shipped) AS created_at, coalesce(u.shipped, b.updated_at) AS updated_at
FROM fx_matches b FULL JOIN u USING (candidate_id, job_offer_id)"""


def io05_replace(t: Tables) -> DataFrame:
    """A table replaced by a part of itself."""
    path = src.new_folder(t.spark, "replaced")
    src.append_rows(t.matches(), path)
    stored = src.read_table(t.spark, path)
    return _scores(src.replace_table(stored.filter("similarity_score > 0.6"), path))


def io06_delete(t: Tables) -> DataFrame:
    in_debt = t.raw("customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("candidate_id"))
    return m.delete_by_key(t.candidates(), in_debt, ["candidate_id"]).select("candidate_id", "email")


def _profiles(t: Tables) -> DataFrame:
    """Customers with orders arrive again, once per order; suppliers arrive as new."""
    again = t.raw("orders").join(t.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
    known = again.select(
        F.concat(F.lit(" "), F.lower("c_name"), F.lit("@example.org ")).alias("email"),
        F.col("o_orderpriority").alias("job_category"),
        F.col("o_orderstatus").alias("first_name"),
        F.substring("o_orderpriority", 1, 1).alias("experience_years"),
        F.lit(None).cast("string").alias("education_level"),
        F.col("o_orderkey").alias("arrival"),
    )
    fresh = t.raw("supplier").select(
        F.concat(F.lower("s_name"), F.lit("@example.org")).alias("email"),
        F.lit(None).cast("string").alias("job_category"),
        F.col("s_name").alias("first_name"),
        F.lit("many").alias("experience_years"),
        F.lit("Master").alias("education_level"),
        F.col("s_suppkey").alias("arrival"),
    )
    broken = t.raw("nation").select(
        F.col("n_name").alias("email"),
        *[F.lit(None).cast("string").alias(c) for c in ("job_category", "first_name", "experience_years", "education_level")],
        F.lit(0).cast("bigint").alias("arrival"),
    )
    return known.unionByName(fresh).unionByName(broken)


def io07_upsert_candidates(t: Tables) -> DataFrame:
    merged = m.upsert_candidates(t.candidates(), _profiles(t), ["arrival"])
    return merged.select(
        "candidate_id", "email", "first_name", "last_name", "job_category", "experience_years", "education_level", "city"
    )


IO07 = """, k AS (SELECT lower(c_name) || '@example.org' AS email, arg_max(o_orderpriority, o_orderkey) AS p,
                   arg_max(o_orderstatus, o_orderkey) AS f
            FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT candidate_id, email, coalesce(k.f, first_name) AS first_name, last_name,
       coalesce(k.p, job_category) AS job_category,
       CASE WHEN k.email IS NULL THEN experience_years ELSE CAST(substr(k.p, 1, 1) AS INT) END
         AS experience_years,
       CASE WHEN k.email IS NULL THEN education_level ELSE 'Unknown' END AS education_level, city
FROM fx_candidates LEFT JOIN k USING (email)
UNION ALL
SELECT (SELECT max(candidate_id) FROM fx_candidates) + row_number() OVER (ORDER BY md5(email)),
       email, s_name, NULL, '', 0, 'Master', NULL
FROM (SELECT lower(s_name) || '@example.org' AS email, s_name FROM supplier)"""


def _region(t: Tables) -> DataFrame:
    """Places of the suppliers, as if stored earlier."""
    return (
        t.raw("supplier")
        .join(t.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            (F.col("n_nationkey") + 1).cast("bigint").alias("location_id"),
            F.col("n_name").alias("city"),
            F.col("r_name").alias("country"),
        )
        .distinct()
    )


def _places(t: Tables) -> DataFrame:
    c = F.col("candidate_id")
    return t.candidates().select(
        "candidate_id",
        F.concat(F.lit(" "), "city", F.lit("\t")).alias("city"),
        F.when(c % 7 == 0, F.lit("")).when(c % 11 == 0, None).otherwise(F.col("country")).alias("country"),
    )


def io08_locations(t: Tables) -> DataFrame:
    return m.add_locations(_region(t), _places(t))


def io08_continents(t: Tables) -> DataFrame:
    """Continents come with the places, and are Unknown where none is given."""
    region = _region(t).withColumn("continent", F.lit("Old"))
    places = _places(t).withColumn("continent", F.when(F.col("country") != "", F.concat(F.lit(" of "), "country")))
    return m.add_locations(region, places)


def io08_location_keys(t: Tables) -> DataFrame:
    grown = m.add_locations(_region(t), _places(t))
    return m.with_location_id(_places(t), grown).select("candidate_id", "location_id")


_GROWN = """, base AS (SELECT DISTINCT CAST(n_nationkey + 1 AS BIGINT) AS location_id, n_name AS city,
                    r_name AS country
             FROM supplier JOIN nation ON s_nationkey = n_nationkey
                           JOIN region ON n_regionkey = r_regionkey),
places AS (SELECT candidate_id, city, CASE WHEN candidate_id % 7 = 0 OR candidate_id % 11 = 0
                                           THEN 'Unknown' ELSE country END AS country
           FROM fx_candidates),
grown AS (SELECT * FROM base UNION ALL
  SELECT (SELECT max(location_id) FROM base) + row_number() OVER (ORDER BY md5(city || chr(31) || country)),
         city, country
  FROM (SELECT DISTINCT city, country FROM places EXCEPT SELECT city, country FROM base))"""


def io09_skills(t: Tables) -> DataFrame:
    base = t.raw("part").select(F.lower("p_type").alias("name")).distinct().select(
        F.ascii("name").cast("bigint").alias("skill_id"), "name", F.lit("soft").alias("skill_type")
    )
    parts = t.raw("part")
    wanted = parts.select(F.concat(F.lit(" "), "p_name").alias("name"), F.lit("Technical").alias("skill_type"))
    again = parts.select(F.upper("p_type").alias("name"), F.lit("SOFT").alias("skill_type"))
    return m.add_skills(base, wanted.unionByName(again))


IO09 = """WITH base AS (SELECT DISTINCT CAST(ascii(lower(p_type)) AS BIGINT) AS skill_id, lower(p_type) AS name,
                   'soft' AS skill_type FROM part)
SELECT * FROM base UNION ALL
SELECT (SELECT max(skill_id) FROM base)
         + row_number() OVER (ORDER BY md5(lower(name) || chr(31) || 'technical')), name, 'technical'
FROM (SELECT DISTINCT p_name AS name FROM part)"""


# -- streams ------------------------------------------------------------------------


def _arriving(t: Tables, key: str) -> DataFrame:
    source = t.raw("embeddings")
    rows = arrivals.file_arrivals(t.spark, f"{t.folder}/embeddings*.parquet", source.schema)
    return rows.select(
        F.col("vec_id").alias(key),
        F.col("embedding").cast("array<double>").alias("skills_vector"),
        F.array(F.col("label").cast("string")).alias("skill_set"),
        F.lit(None).cast("string").alias("job_category"),
        F.lit("active").alias("status"),
        F.lit(None).cast("timestamp").alias("created_at"),
    )


def _standing(t: Tables, key: str) -> DataFrame:
    return t.vectors(key).withColumns(
        {
            "skill_set": F.array().cast("array<string>"),
            "job_category": F.lit(None).cast("string"),
            "status": F.lit("active"),
            "created_at": F.lit(None).cast("timestamp"),
        }
    )


def _run(t: Tables, rows: DataFrame, match: arrivals.Matcher) -> DataFrame:
    path, checkpoint = src.new_folder(t.spark, "stream-matches"), src.new_folder(t.spark, "stream")
    arrivals.start_matching(rows, match, path, checkpoint).awaitTermination()
    now = arrivals.current_matches(arrivals.stored_matches(t.spark, path))
    return now.select(
        "candidate_id", "job_offer_id", F.round("similarity_score", 6).alias("similarity_score")
    )


def s01_new_profiles(t: Tables) -> DataFrame:
    match = arrivals.on_new_profiles(lambda: _standing(t, "job_offer_id"))
    return _run(t, _arriving(t, "candidate_id"), match)


def io07_upsert_stored_table(t: Tables) -> DataFrame:
    """The same upsert on a stored table, of which it rewrites the partitions it touches."""
    path = src.new_folder(t.spark, "candidate-table")
    candidate_table.create(t.candidates(), path)
    candidate_table.upsert(_profiles(t), path, ["arrival"])
    return candidate_table.read(t.spark, path).select(
        "candidate_id", "email", "first_name", "last_name", "job_category", "experience_years", "education_level", "city"
    )


def _intake(t: Tables, rows: DataFrame) -> tuple[str, str]:
    """Candidate table and match folder after ``rows`` have arrived as profiles."""
    people, places, out, checkpoint = (
        src.new_folder(t.spark, label) for label in ("people", "places", "intake-matches", "intake")
    )
    _region(t).write.parquet(places)
    standing = t.candidates().withColumns({"skills": _no_skills(), "skills_vector": F.lit(None).cast("array<double>")})
    candidate_table.create(m.with_location_id(standing, _region(t)), people)
    arrivals.start_intake(
        rows, people, places, lambda: _standing(t, "job_offer_id"), out, checkpoint, ["arrival"]
    ).awaitTermination()
    return people, out


def _no_skills() -> Column:
    return F.struct(*[F.array().cast("array<string>").alias(c) for c in ("technical_skills", "soft_skills")])


def s01_stored_profiles(t: Tables) -> DataFrame:
    """The candidate table after suppliers have arrived as profiles, with their places."""
    source = t.raw("supplier")
    rows = arrivals.file_arrivals(t.spark, f"{t.folder}/supplier*.parquet", source.schema).select(
        F.concat(F.lower("s_name"), F.lit("@example.org")).alias("email"),
        F.col("s_name").alias("first_name"),
        F.concat(F.lit("Town "), F.col("s_nationkey").cast("string")).alias("city"),
        F.lit("Somewhere").alias("country"),
        F.col("s_suppkey").alias("arrival"),
        _no_skills().alias("skills"),
        F.lit(None).cast("array<double>").alias("skills_vector"),
        F.lit(None).cast("string").alias("job_category"),
    )
    people, _ = _intake(t, rows)
    return candidate_table.read(t.spark, people).select("candidate_id", "email", "first_name", "city", "location_id")


def s01_intake_matches(t: Tables) -> DataFrame:
    """Vectors arrive as profiles, are stored, and are matched with all standing offers."""
    source = t.raw("embeddings")
    rows = arrivals.file_arrivals(t.spark, f"{t.folder}/embeddings*.parquet", source.schema).select(
        F.concat(F.lit("v"), F.col("vec_id"), F.lit("@example.org")).alias("email"),
        F.col("label").cast("string").alias("first_name"),
        F.lit(None).cast("string").alias("city"),
        F.lit(None).cast("string").alias("country"),
        F.col("vec_id").alias("arrival"),
        _no_skills().alias("skills"),
        F.col("embedding").cast("array<double>").alias("skills_vector"),
        F.lit(None).cast("string").alias("job_category"),
    )
    people, out = _intake(t, rows)
    stored = candidate_table.read(t.spark, people).select("candidate_id", "email")
    now = arrivals.current_matches(arrivals.stored_matches(t.spark, out))
    return now.join(stored, "candidate_id").select("email", "job_offer_id", F.round("similarity_score", 6).alias("similarity_score"))


S01_STORED = """, base AS (SELECT DISTINCT CAST(n_nationkey + 1 AS BIGINT) AS location_id, n_name AS city,
                    r_name AS country
             FROM supplier JOIN nation ON s_nationkey = n_nationkey
                           JOIN region ON n_regionkey = r_regionkey),
grown AS (SELECT * FROM base UNION ALL
  SELECT (SELECT max(location_id) FROM base) + row_number() OVER (ORDER BY md5(city || chr(31) || country)), city, country
  FROM (SELECT DISTINCT 'Town ' || s_nationkey AS city, 'Somewhere' AS country FROM supplier)),
everyone AS (
  SELECT candidate_id, email, first_name, city, country FROM fx_candidates
  UNION ALL
  SELECT (SELECT max(candidate_id) FROM fx_candidates) + row_number() OVER (ORDER BY md5(lower(s_name) || '@example.org')),
         lower(s_name) || '@example.org', s_name, 'Town ' || s_nationkey, 'Somewhere' FROM supplier)
SELECT candidate_id, email, first_name, city, location_id FROM everyone LEFT JOIN grown USING (city, country)"""


def s02_new_offers(t: Tables) -> DataFrame:
    match = arrivals.on_new_offers(lambda: _standing(t, "candidate_id"))
    return _run(t, _arriving(t, "job_offer_id"), match)


CHECKS = {
    "io01_read_table": (io01_read_table, "SELECT c_custkey, c_name FROM customer"),
    "io03_append": (io03_append, sql(_MATCHES)),
    "io04_upsert_matches": (io04_upsert_matches, sql(IO04)),
    "io04_merge_into_stored_table": (io04_merge_into_stored_table, sql(IO04)),
    "io05_replace": (io05_replace, sql(_MATCHES + " WHERE similarity_score > 0.6")),
    "io06_delete": (
        io06_delete,
        sql("""SELECT candidate_id, email FROM fx_candidates
               WHERE candidate_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"""),
    ),
    "io07_upsert_candidates": (io07_upsert_candidates, sql(IO07)),
    "io07_upsert_stored_table": (io07_upsert_stored_table, sql(IO07)),
    "io08_locations": (io08_locations, sql(_GROWN + " SELECT * FROM grown")),
    "io08_continents": (
        io08_continents,
        sql(_GROWN + """ SELECT g.*, CASE WHEN b.location_id IS NOT NULL THEN 'Old'
              WHEN g.country = 'Unknown' THEN 'Unknown' ELSE 'of ' || g.country END AS continent
            FROM grown g LEFT JOIN base b USING (location_id)"""),
    ),
    "io08_location_keys": (
        io08_location_keys,
        sql(_GROWN + " SELECT candidate_id, location_id FROM places JOIN grown USING (city, country)"),
    ),
    "io09_skills": (io09_skills, IO09),
    "s01_new_profiles": (
        s01_new_profiles,
        f"SELECT candidate_id, job_offer_id, similarity_score FROM ({M19})",
    ),
    "s01_stored_profiles": (s01_stored_profiles, sql(S01_STORED)),
    "s01_intake_matches": (
        s01_intake_matches,
        f"SELECT 'v' || candidate_id || '@example.org' AS email, job_offer_id, similarity_score FROM ({M19})",
    ),
    "s02_new_offers": (
        s02_new_offers,
        f"SELECT candidate_id, job_offer_id, similarity_score FROM ({M18})",
    ),
}
