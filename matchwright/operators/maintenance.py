"""Merging new rows into tables: upserts, deletes and key assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.vectors import fit
from ..sources.tables import staged

MATCH_KEYS = ["candidate_id", "job_offer_id"]
MATCH_SCORES = ["similarity_score", "distance", "overall_evaluation"]
UNKNOWN = "Unknown"


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the one with the largest ``order`` columns.

    An aggregate, so a key that repeats very often is reduced before the shuffle. The row
    is its own rank, ``order`` first, so that no value travels twice; rows that agree in
    ``order`` are told apart by the other columns where Spark can order them.
    """
    others = [c for c in df.columns if c not in keys]
    ordered = [c for c in order if c in others]
    rest = [c for c in others if c not in ordered]
    if "map<" in df.select(*rest).schema.simpleString() or "variant" in df.select(*rest).schema.simpleString():
        largest = F.max_by(F.struct(*others), F.struct(*(order or others)))
    else:
        largest = F.max(F.struct(*ordered, *rest))
    return (
        df.groupBy(*keys)
        .agg(largest.alias("row"))
        .select(*keys, *[F.col("row")[c].alias(c) for c in others])
        .select(*df.columns)
    )


def merge_by_key(
    base: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    update_columns: Sequence[str],
) -> DataFrame:
    """Insert new keys, and replace ``update_columns`` of the known ones.

    ``updates`` holds a key at most once (see ``latest_per_key``). A column it lacks is
    NULL on insert. NULL in an update column replaces like any other value.
    """
    has = set(updates.columns)
    old = base.withColumn("_old", F.lit(True)).alias("b")
    new = updates.withColumn("_new", F.lit(True)).alias("u")
    same = [F.col(f"b.{k}") == F.col(f"u.{k}") for k in keys]
    joined = old.join(new, same, "full_outer")

    def merged(name: str) -> Column:
        before = F.col(f"b.{name}")
        after = F.col(f"u.{name}") if name in has else F.lit(None)
        if name in keys:
            return F.coalesce(before, after)
        if name in update_columns:
            return F.when(F.col("_new"), after).otherwise(before)
        return F.when(F.col("_old"), before).otherwise(after)

    return joined.select(*[merged(c).alias(c) for c in base.columns])


def match_rows(scored: DataFrame, now: Column | None = None) -> DataFrame:
    """Scored pairs as rows of the match table, distance being ``1 - score``."""
    at = F.current_timestamp() if now is None else now
    return scored.select(
        text.pair_id(F.col("candidate_id"), F.col("job_offer_id")).alias("match_id"),
        "candidate_id",
        "job_offer_id",
        "similarity_score",
        (F.lit(1.0) - F.col("similarity_score")).alias("distance"),
        F.col("similarity_score").alias("overall_evaluation"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


def upsert_matches(
    matches: DataFrame,
    updates: DataFrame,
    update_columns: Sequence[str] = (*MATCH_SCORES, "updated_at"),
) -> DataFrame:
    """New pairs are added; known pairs get the new scores and keep id and creation."""
    once = latest_per_key(updates, MATCH_KEYS, ["updated_at", "similarity_score", "match_id"])
    return merge_by_key(matches, once, MATCH_KEYS, update_columns)


def delete_by_key(df: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(keys_df.select(*keys).distinct(), list(keys), "left_anti")


def assign_ids(
    new_rows: DataFrame, id_column: str, key: Sequence[str], after: Column
) -> DataFrame:
    """Dense ids after ``after`` in the order of the key's MD5, without a global sort.

    The keys are spread over 4096 buckets by their digest; bucket totals give each
    bucket its first id, and rows are numbered inside their bucket only.
    """
    digest = F.md5(F.concat_ws("\u001f", *key).cast("binary"))
    spread = new_rows.withColumn("_digest", digest).withColumn(
        "_bucket", F.substring("_digest", 1, 3)
    )
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        spread.groupBy("_bucket")
        .agg(F.count("*").alias("_size"))
        .withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .drop("_size")
    )
    inside = Window.partitionBy("_bucket").orderBy("_digest", *key)
    number = F.coalesce(after, F.lit(0)) + F.col("_start") + F.row_number().over(inside)
    return (
        spread.join(starts, "_bucket")
        .withColumn(id_column, number.cast("bigint"))
        .drop("_digest", "_bucket", "_start")
    )


def known_or_new(
    dimension: DataFrame,
    wanted: DataFrame,
    id_column: str,
    match: Sequence[Column],
    keys: Sequence[str],
) -> DataFrame:
    """``dimension`` plus a row with a new id for every key it lacks.

    ``match`` are the expressions two rows agree on when they are the same entry.
    """
    names = [f"_k{i}" for i in range(len(match))]
    keyed = wanted.select(*keys, *[m.alias(n) for m, n in zip(match, names)])
    # Of several spellings of a new key the smallest is stored.
    fresh = keyed.groupBy(*names).agg(F.min(F.struct(*keys)).alias("s")).select("s.*", *names)
    have = dimension.select(*[m.alias(n) for m, n in zip(match, names)]).distinct()
    missing = fresh.join(have, names, "left_anti")
    top = dimension.agg(F.max(id_column)).scalar()
    numbered = assign_ids(missing, id_column, names, top).drop(*names)
    return dimension.unionByName(numbered, allowMissingColumns=True)


def locations(places: DataFrame) -> DataFrame:
    """City, country and, where given, continent as stored: trimmed, Unknown where empty."""
    names = [c for c in ("city", "country", "continent") if c in places.columns]
    return places.select(*[text.text_or(text.strip(F.col(c)), UNKNOWN).alias(c) for c in names])


def add_locations(region: DataFrame, places: DataFrame, now: Column | None = None) -> DataFrame:
    """The location table with every place of ``places`` in it."""
    wanted = locations(places)
    if "continent" not in region.columns:
        wanted = wanted.drop("continent")
    grown = known_or_new(
        region, wanted, "location_id", [F.col("city"), F.col("country")], wanted.columns
    )
    at = F.current_timestamp() if now is None else now
    filled = {"continent": F.lit(UNKNOWN), "created_at": at, "updated_at": at}
    present = {c: F.coalesce(c, v) for c, v in filled.items() if c in region.columns}
    return grown.withColumns(present)


def with_location_id(candidates: DataFrame, region: DataFrame) -> DataFrame:
    """Foreign key of each candidate's place; NULL where city and country are empty."""
    given = F.coalesce(F.col("city") != "", F.lit(False)) | F.coalesce(
        F.col("country") != "", F.lit(False)
    )
    keyed = candidates.withColumns(
        {
            "_city": F.when(given, text.text_or(text.strip(F.col("city")), UNKNOWN)),
            "_country": F.when(given, text.text_or(text.strip(F.col("country")), UNKNOWN)),
        }
    )
    places = region.groupBy(F.col("city").alias("_city"), F.col("country").alias("_country")).agg(
        F.min("location_id").alias("location_id")
    )
    return keyed.drop("location_id").join(places, ["_city", "_country"], "left").drop(
        "_city", "_country"
    )


def add_skills(skills: DataFrame, wanted: DataFrame, now: Column | None = None) -> DataFrame:
    """The skill table with every (name, type) in it, names compared without case."""
    clean = wanted.select(text.strip(F.col("name")).alias("name"), F.lower("skill_type").alias("skill_type"))
    grown = known_or_new(
        skills,
        clean,
        "skill_id",
        [F.lower("name"), F.lower("skill_type")],
        ["name", "skill_type"],
    )
    if "updated_at" not in skills.columns:
        return grown
    at = F.current_timestamp() if now is None else now
    return grown.withColumn("updated_at", F.coalesce("updated_at", at))


# -- candidates ------------------------------------------------------------------

TEXT_FIELDS = [
    "first_name",
    "last_name",
    "phone",
    "linkedin",
    "job_category",
    "current_job",
    "country",
    "city",
    "filename",
    "url",
    "document_extension",
]


def clean_profiles(profiles: DataFrame, dimension: int | None = None) -> DataFrame:
    """Defaults of an incoming profile: texts, years, level, language, vector."""
    have = set(profiles.columns)
    out = {c: text.text_or(F.col(c)) for c in TEXT_FIELDS if c in have}
    out["email"] = text.strip(F.col("email"))
    if "experience_years" in have:
        out["experience_years"] = text.int_or_zero(F.col("experience_years").cast("string"))
    if "education_level" in have:
        out["education_level"] = text.text_or(F.col("education_level"), "Unknown")
    if "document_language" in have:
        out["document_language"] = text.text_or(F.col("document_language"), "unknown")
    if "skills_vector" in have and dimension is not None:
        out["skills_vector"] = fit(F.col("skills_vector"), dimension)
    return profiles.withColumns(out)


def split_valid(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles with a usable e-mail address, and the rejected others."""
    valid = text.is_email(F.col("email"))
    rejected = profiles.filter(~valid).withColumn("reason", F.lit("invalid e-mail"))
    return profiles.filter(valid), rejected


def upsert_candidates(
    candidates: DataFrame,
    profiles: DataFrame,
    arrival: Sequence[str],
    now: Column | None = None,
    after: Column | None = None,
) -> DataFrame:
    """Known e-mail: update in place, keep the id; new e-mail: insert with a new id.

    ``arrival`` orders profiles of one e-mail within the batch; the last one wins. New
    ids follow ``after``, by default the largest of ``candidates``.
    """
    at = F.current_timestamp() if now is None else now
    good, _ = split_valid(profiles)
    once = staged(latest_per_key(clean_profiles(good), ["email"], arrival), "profiles")
    once = once.drop(*[c for c in arrival if c not in candidates.columns])
    # The smallest id where a stored e-mail repeats: an update then reaches one row.
    ids = candidates.groupBy("email").agg(F.min("candidate_id").alias("candidate_id"))
    seen = once.drop("candidate_id").join(ids, "email")
    unseen = once.drop("candidate_id").join(ids, "email", "left_anti")
    top = candidates.agg(F.max("candidate_id")).scalar() if after is None else after
    added = assign_ids(unseen, "candidate_id", ["email"], top)
    stamps = {c: at for c in ("updated_at", "processed_at") if c in candidates.columns}
    defaults = {
        "created_at": at,
        "visibility_setting": F.lit(True),
        "blocked": F.lit(False),
    }
    fresh = added.withColumns(
        {c: v for c, v in defaults.items() if c in candidates.columns and c not in added.columns}
    )
    updates = seen.unionByName(fresh, allowMissingColumns=True).withColumns(stamps)
    kept = {"candidate_id", "email", "created_at", "visibility_setting", "blocked"}
    replaced = [c for c in candidates.columns if c in updates.columns and c not in kept]
    return merge_by_key(candidates, updates, ["candidate_id"], replaced)
