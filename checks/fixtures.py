"""The star-schema test tables as candidates, offers and matches.

The same recipes twice: as DataFrames for Spark, and as common table expressions for
the comparison SQL. All tables are used whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchwright import ship
from matchwright.functions import text
from matchwright.operators import rules


class Tables:
    """Test tables of one folder and the entities derived from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        ship(spark)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def candidates(self) -> DataFrame:
        """Candidates, created when they first ordered."""
        first = (
            self.raw("orders")
            .groupBy(F.col("o_custkey").alias("candidate_id"))
            .agg(F.min("o_orderdate").alias("created_at"))
        )
        return self.people().join(first, "candidate_id", "left")

    def people(self) -> DataFrame:
        c = F.col("c_custkey")
        level = F.element_at(
            F.array(*[F.lit(x) for x in ("High School", "Bachelor", "Master", "PhD", "Other")]),
            (c % 6 + 1).cast("int"),
        )
        return (
            self.raw("customer")
            .join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(
                c.alias("candidate_id"),
                F.concat(F.lit("Name"), (c % 97).cast("string")).alias("first_name"),
                F.col("c_mktsegment").alias("last_name"),
                F.concat(F.lower("c_name"), F.lit("@example.org")).alias("email"),
                F.when(c % 17 == 0, None)
                .when(c % 19 == 0, "")
                .otherwise(F.col("c_mktsegment"))
                .alias("job_category"),
                F.col("n_name").alias("city"),
                F.col("r_name").alias("country"),
                F.when(c % 23 != 0, ((c * 7) % 31).cast("int")).alias("experience_years"),
                F.when(c % 6 < 5, level).alias("education_level"),
            )
        )

    def bought(self) -> DataFrame:
        """Customer, supplier and part of every line."""
        return (
            self.raw("orders")
            .join(self.raw("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
            .select("o_custkey", "l_suppkey", "l_partkey", "l_shipdate")
        )

    def skills(self) -> DataFrame:
        """``candidate_id, skills``: part names are technical, part types soft skills."""
        return (
            self.bought()
            .join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("o_custkey").alias("candidate_id"))
            .agg(
                F.struct(
                    F.array_sort(F.collect_set("p_name")).alias("technical_skills"),
                    F.array_sort(F.collect_set("p_type")).alias("soft_skills"),
                ).alias("skills")
            )
        )

    def skilled(self) -> DataFrame:
        return self.people().join(self.skills(), "candidate_id", "left")

    def offers(self) -> DataFrame:
        """Offers, created when their supplier last shipped."""
        dated = (
            self.raw("lineitem")
            .groupBy(F.col("l_suppkey").alias("job_offer_id"))
            .agg(F.max("l_shipdate").alias("created_at"))
        )
        return self.posts().join(dated, "job_offer_id", "left")

    def posts(self) -> DataFrame:
        s = F.col("s_suppkey")
        names = ("building", "MACHINERY", "HOUSEHOLD GOODS", "AUTOMOBILE", "FURNITURE")
        category = [F.lit(x) for x in names]
        kind = [F.lit(x) for x in ("Full-time", "Part-time", "Contract", "Internship")]
        return (
            self.raw("supplier")
            .select(
                s.alias("job_offer_id"),
                F.col("s_nationkey").cast("bigint").alias("client_id"),
                F.col("s_name").alias("job_title"),
                F.concat(F.lit("Company "), F.col("s_nationkey").cast("string")).alias(
                    "company_name"
                ),
                F.element_at(F.array(*category), (s % 5 + 1).cast("int")).alias("job_category"),
                (s % 12).cast("int").alias("experience_required"),
                F.when(s % 10 == 9, "closed").when(s % 10 != 8, "active").alias("status"),
                F.element_at(F.array(*kind), (s % 4 + 1).cast("int")).alias("job_type"),
            )
        )

    def offer_skills(self) -> DataFrame:
        """``job_offer_id, technical_skills``: all names a supplier ships, most shipped first."""
        counted = (
            self.raw("lineitem")
            .join(self.raw("part"), F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("l_suppkey").alias("job_offer_id"), F.col("p_name").alias("skill"))
            .agg(F.count("*").alias("n"))
        )
        entry = F.struct((-F.col("n")).alias("n"), "skill")
        return counted.groupBy("job_offer_id").agg(
            F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["skill"]).alias(
                "technical_skills"
            )
        )

    def matches(self) -> DataFrame:
        """Stored matches: a candidate and an active offer that met on some line."""
        active = self.posts().filter(F.col("status") == "active")
        met = (
            self.bought()
            .groupBy(F.col("o_custkey").alias("candidate_id"), F.col("l_suppkey").alias("job_offer_id"))
            .agg(F.min("l_shipdate").alias("created_at"), F.max("l_shipdate").alias("updated_at"))
        )
        scored = rules.rescored(met, self.people(), active)
        return scored.select(
            text.pair_id(F.col("candidate_id"), F.col("job_offer_id")).alias("match_id"),
            "candidate_id",
            "job_offer_id",
            "similarity_score",
            "distance",
            F.col("similarity_score").alias("overall_evaluation"),
            "created_at",
            "updated_at",
        )

    def clients(self) -> DataFrame:
        return self.raw("nation").select(
            F.col("n_nationkey").cast("bigint").alias("client_id"),
            F.col("n_name").alias("company_name"),
        )

    def vectors(self, key: str) -> DataFrame:
        """Every embedding under the id name of one side."""
        return self.raw("embeddings").select(
            F.col("vec_id").alias(key), F.col("embedding").cast("array<double>").alias("skills_vector")
        )


RULE_SCORE = """(
  CASE WHEN coalesce(c.job_category, '') <> '' AND coalesce(o.job_category, '') <> '' THEN
         CASE WHEN lower(c.job_category) = lower(o.job_category) THEN 0.8::DOUBLE
              WHEN instr(lower(o.job_category), lower(c.job_category)) > 0 THEN 0.6::DOUBLE
              ELSE 0.3::DOUBLE END
       ELSE 0.3::DOUBLE END
  + CASE WHEN coalesce(c.experience_years, 0) >= coalesce(o.experience_required, 0)
         THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)"""

CTES = {
    "fx_candidates": """
  SELECT c_custkey AS candidate_id,
         'Name' || (c_custkey % 97) AS first_name, c_mktsegment AS last_name,
         lower(c_name) || '@example.org' AS email,
         CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN ''
              ELSE c_mktsegment END AS job_category,
         n_name AS city, r_name AS country,
         CASE WHEN c_custkey % 23 = 0 THEN NULL
              ELSE CAST((c_custkey * 7) % 31 AS INT) END AS experience_years,
         CASE c_custkey % 6 WHEN 0 THEN 'High School' WHEN 1 THEN 'Bachelor'
              WHEN 2 THEN 'Master' WHEN 3 THEN 'PhD' WHEN 4 THEN 'Other' END AS education_level,
         d.created_at
  FROM customer JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey
       LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created_at FROM orders GROUP BY 1) d
         ON o_custkey = c_custkey""",
    "fx_bought": """
  SELECT o_custkey, l_suppkey, l_partkey, l_shipdate
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey""",
    "fx_skill": """
  SELECT DISTINCT o_custkey AS candidate_id, 'technical' AS kind, p_name AS skill
  FROM fx_bought JOIN part ON l_partkey = p_partkey
  UNION ALL
  SELECT DISTINCT o_custkey, 'soft', p_type FROM fx_bought JOIN part ON l_partkey = p_partkey""",
    "fx_offers": """
  SELECT s_suppkey AS job_offer_id, CAST(s_nationkey AS BIGINT) AS client_id,
         s_name AS job_title, 'Company ' || s_nationkey AS company_name,
         CASE s_suppkey % 5 WHEN 0 THEN 'building' WHEN 1 THEN 'MACHINERY'
              WHEN 2 THEN 'HOUSEHOLD GOODS' WHEN 3 THEN 'AUTOMOBILE' ELSE 'FURNITURE' END
           AS job_category,
         CAST(s_suppkey % 12 AS INT) AS experience_required,
         CASE s_suppkey % 10 WHEN 9 THEN 'closed' WHEN 8 THEN NULL ELSE 'active' END AS status,
         CASE s_suppkey % 4 WHEN 0 THEN 'Full-time' WHEN 1 THEN 'Part-time'
              WHEN 2 THEN 'Contract' ELSE 'Internship' END AS job_type,
         d.created_at
  FROM supplier LEFT JOIN
       (SELECT l_suppkey, max(l_shipdate) AS created_at FROM lineitem GROUP BY 1) d
       ON l_suppkey = s_suppkey""",
    "fx_offer_skill": """
  SELECT DISTINCT l_suppkey AS job_offer_id, p_name AS skill
  FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "fx_matches": f"""
  SELECT md5(candidate_id || '-' || job_offer_id) AS match_id, candidate_id, job_offer_id,
         least(score, 0.95::DOUBLE) AS similarity_score, 1.0::DOUBLE - score AS distance,
         least(score, 0.95::DOUBLE) AS overall_evaluation, created_at, updated_at
  FROM (SELECT m.*, {RULE_SCORE} AS score
        FROM (SELECT o_custkey AS candidate_id, l_suppkey AS job_offer_id,
                     min(l_shipdate) AS created_at, max(l_shipdate) AS updated_at
              FROM fx_bought GROUP BY 1, 2) m
        JOIN fx_candidates c USING (candidate_id)
        JOIN fx_offers o USING (job_offer_id)
        WHERE o.status = 'active')
  WHERE score >= 0.4""",
    "fx_unit": """
  SELECT vec_id, label, list_transform(v, lambda x: x / (n + 1e-8::DOUBLE)) AS u
  FROM (SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda y: y * y))) AS n
        FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings))""",
}


def placed(df: DataFrame, *keys: str) -> DataFrame:
    """The place of each row in the order it came in, inside its key if one is given."""
    window = Window.partitionBy(*keys).orderBy("_at") if keys else Window.orderBy("_at")
    at = df.withColumn("_at", F.monotonically_increasing_id())
    return at.withColumn("place", F.row_number().over(window)).drop("_at")


def placed_in_runs(df: DataFrame, key: str) -> DataFrame:
    """The place of each row inside its key, where a key's rows come side by side.

    Numbers inside a partition have no gaps, so a place is the way from the key's first
    number; the window needs rows sorted by the key only, as they are, and not once more.
    """
    at = df.withColumn("_at", F.monotonically_increasing_id())
    first = F.min("_at").over(Window.partitionBy(key))
    return at.withColumn("place", (F.col("_at") - first + 1).cast("int")).drop("_at")


def sql(body: str) -> str:
    """The comparison SQL with the shared recipes in front of it."""
    recipes = ",\n".join(f"{name} AS ({text_})" for name, text_ in CTES.items())
    return f"WITH {recipes}\n{body}"
