"""Arrival-triggered matching as Structured Streaming jobs.

Every micro-batch writes its matches to a partition of its own, named by the batch, so
a repeated batch replaces what it wrote before. Readers see the newest version of each
pair; writing costs as much as the batch, whatever the size of the match table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.maintenance import MATCH_KEYS, MATCH_SCORES, match_rows
from ..plans import candidate_table, matching
from ..schema import JOB_MATCHES
from ..sources.tables import job_folder

Matcher = Callable[[DataFrame], DataFrame]
BATCH = "batch_id"


def file_arrivals(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """Rows of Parquet files as they appear under ``path``."""
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def start_matching(
    arrivals: DataFrame,
    match: Matcher,
    matches_path: str,
    checkpoint: str,
    every: str | None = None,
) -> StreamingQuery:
    """Match each batch with ``match`` and store the result.

    Runs until stopped, looking for arrivals at the interval ``every``; without one it
    stops when all that has arrived is read.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # matchers read it several times
        try:
            with job_folder(batch.sparkSession):
                rows = match_rows(match(batch))
                # Its own folder is replaced as a whole, also by a result without rows.
                rows.write.mode("overwrite").parquet(f"{matches_path}/{BATCH}={batch_id}")
        finally:
            batch.unpersist()

    writer = arrivals.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    timing = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**timing).start()


def start_intake(
    arrivals: DataFrame,
    candidates_path: str,
    region_path: str,
    read_offers: Callable[[], DataFrame],
    matches_path: str,
    checkpoint: str,
    arrival: list[str],
    every: str | None = None,
    **options,
) -> StreamingQuery:
    """Store each batch of profiles by e-mail, with its place, and match it.

    ``candidates_path`` is a table in partitions by e-mail (``plans.candidate_table``): a
    batch rewrites the partitions of its own addresses, and appends places that are new.
    A repeated batch finds its e-mails and places known and writes the same rows again.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            with job_folder(spark):
                region = candidate_table.add_places(region_path, batch)
                touched = candidate_table.upsert(batch, candidates_path, arrival, region)
                found = matching.match_profiles(matching.with_skill_set(touched), read_offers(), **options)
                match_rows(found).write.mode("overwrite").parquet(f"{matches_path}/{BATCH}={batch_id}")
        finally:
            batch.unpersist()

    writer = arrivals.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    timing = {"availableNow": True} if every is None else {"processingTime": every}
    return writer.trigger(**timing).start()


def fold_batches(spark: SparkSession, matches_path: str, table_path: str) -> None:
    """Merge the newest version of each pair into the bucketed match table.

    Batches that are folded can be deleted; run it while the stream rests.
    """
    matching.merge_into_match_table(current_matches(stored_matches(spark, matches_path)), table_path)


def on_new_profiles(read_offers: Callable[[], DataFrame], **options) -> Matcher:
    """Arriving candidates against the open offers of that moment, with fallback tiers."""
    return lambda batch: matching.match_profiles(batch, read_offers(), **options)


def on_new_offers(read_candidates: Callable[[], DataFrame], **options) -> Matcher:
    """Arriving offers against all candidates of that moment."""
    return lambda batch: matching.best_matches(read_candidates(), batch, **options)


def stored_matches(spark: SparkSession, matches_path: str) -> DataFrame:
    """All versions of all matches the stream has written."""
    schema = T.StructType([*JOB_MATCHES.fields, T.StructField(BATCH, T.LongType())])
    return spark.read.schema(schema).parquet(matches_path)


def current_matches(versions: DataFrame) -> DataFrame:
    """One row per pair: newest scores, first creation."""
    newest = F.struct(*MATCH_SCORES, "updated_at")
    return (
        versions.groupBy(*MATCH_KEYS)
        .agg(
            F.min_by("match_id", BATCH).alias("match_id"),
            F.min_by("created_at", BATCH).alias("created_at"),
            F.max_by(newest, BATCH).alias("n"),
        )
        .select(
            "match_id",
            *MATCH_KEYS,
            *[F.col("n")[c].alias(c) for c in MATCH_SCORES],
            "created_at",
            F.col("n")["updated_at"].alias("updated_at"),
        )
    )
