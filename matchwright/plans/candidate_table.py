"""The stored candidate table, in partitions by e-mail, that batches of profiles update.

A candidate lies in the partition that the hash of the e-mail address names. A batch reads
and rewrites only the partitions of its own addresses, and the e-mail and id columns of
those partitions say which addresses are known, so no index beside the table can disagree
with it. New candidates get the ids after the largest one given out so far, which an empty
file beside the table is named after; ids are reserved before anything is written. If a batch
fails in between and is repeated, known addresses keep their ids and some reserved ids are
never used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators import maintenance
from ..sources.tables import append_rows, largest_mark, put_mark, read_table, replace_partitions, staged

BUCKET = "email_bucket"
BUCKETS = 256


def bucketed(candidates: DataFrame, buckets: int) -> DataFrame:
    return candidates.withColumn(BUCKET, F.pmod(F.xxhash64("email"), F.lit(buckets)).cast("int"))


def _layout(path: str) -> str:
    return f"{path}/_layout"  # readers pass over names with an underscore


def _ids(path: str) -> str:
    return f"{path}/_ids"


def _schema(path: str) -> str:
    return f"{path}/_schema"


def create(candidates: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Store candidates in ``buckets`` partitions; number and schema are kept beside them."""
    spark = candidates.sparkSession
    rows = bucketed(candidates, buckets).hint("rebalance", BUCKET)
    rows.write.partitionBy(BUCKET).parquet(path)
    candidates.limit(0).coalesce(1).write.parquet(_schema(path))
    put_mark(spark, _layout(path), buckets)
    put_mark(spark, _ids(path), candidates.agg(F.max("candidate_id")).first()[0] or 0)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All candidates, without the partition column."""
    return _stored(spark, path).drop(BUCKET)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(_schema(path)).schema.add(BUCKET, T.IntegerType())).parquet(path)


def partitions_of(spark: SparkSession, path: str, buckets: list[int]) -> DataFrame:
    """The candidates of some partitions; no other is listed."""
    return _stored(spark, path).filter(F.col(BUCKET).isin(buckets))


def upsert(
    profiles: DataFrame,
    path: str,
    arrival: list[str],
    region: DataFrame | None = None,
    now: Column | None = None,
) -> DataFrame:
    """Store a batch of profiles by e-mail; the candidates inserted or updated by it.

    The same rule as ``maintenance.upsert_candidates``, on the partitions that the batch
    touches. With a location table the batch's candidates get their ``location_id``.
    The new partitions are complete in the shared folder before the stored ones go.
    """
    spark = profiles.sparkSession
    buckets = largest_mark(spark, _layout(path))
    if buckets is None:
        raise ValueError(f"{path} is no candidate table in partitions by e-mail: use candidate_table.create")
    good, _ = maintenance.split_valid(profiles)
    emails = staged(bucketed(good.select(text.strip(F.col("email")).alias("email")).distinct(), buckets), "emails")
    # At most ``buckets`` numbers: the scans then list only these partitions.
    touched = [r[BUCKET] for r in emails.select(BUCKET).distinct().collect()]
    if not touched:
        return read(spark, path).limit(0)
    stored = partitions_of(spark, path, touched)
    new = emails.join(stored.select("email"), "email", "left_anti").count()
    top = largest_mark(spark, _ids(path)) or 0
    if new:
        put_mark(spark, _ids(path), top + new)
    merged = maintenance.upsert_candidates(stored.drop(BUCKET), profiles, arrival, now, after=F.lit(top))
    if region is not None:
        merged = staged(merged, "merged-candidates")
        placed = maintenance.with_location_id(merged.join(emails.select("email"), "email", "left_semi"), region)
        others = merged.join(emails.select("email"), "email", "left_anti")
        merged = others.select(*merged.columns).unionByName(placed.select(*merged.columns))
    fresh = staged(bucketed(merged, buckets).hint("rebalance", BUCKET), "candidate-partitions")
    replace_partitions(fresh, path, [BUCKET])
    return fresh.join(emails.select("email"), "email", "left_semi").select(*merged.columns)


def add_places(region_path: str, places: DataFrame) -> DataFrame:
    """The location table at ``region_path``, grown by the new places of ``places`` only."""
    spark = places.sparkSession
    region = read_table(spark, region_path)
    wanted = staged(maintenance.locations(places).distinct(), "places")
    grown = maintenance.add_locations(region, wanted)
    fresh = staged(grown.join(region.select("location_id"), "location_id", "left_anti"), "new-places")
    if not fresh.isEmpty():
        append_rows(fresh.select(*region.columns), region_path)
    return read_table(spark, region_path)
