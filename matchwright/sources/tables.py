"""Tables in and out: Parquet by default, JDBC and CSV where asked."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scores
from ..schema import missing_or_mistyped

CHECKPOINT_SETTING = "spark.checkpoint.dir"
RELEASE_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_jobs: list[str] = []  # folders of the running jobs, innermost last


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    Where the setting is absent, as in a local trial, the session gets a folder of its
    own; a cluster has to name one.
    """
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="matchwright-")
        spark.conf.set(CHECKPOINT_SETTING, named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A name nothing has used yet, inside the running job's folder if there is one."""
    return f"{_jobs[-1] if _jobs else shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def put_mark(spark: SparkSession, folder: str, number: int) -> None:
    """Keep a number as the name of an empty file; smaller marks of the folder go."""
    system, place = file_system(spark, folder)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system.mkdirs(place)
    system.create(path(place, str(number)), True).close()
    for found in system.listStatus(place):
        name = found.getPath().getName()
        if name.isdigit() and int(name) < number:
            system.delete(found.getPath(), False)


def largest_mark(spark: SparkSession, folder: str) -> int | None:
    """The largest number kept in ``folder``, or None."""
    system, place = file_system(spark, folder)
    if not system.exists(place):
        return None
    names = [found.getPath().getName() for found in system.listStatus(place)]
    return max((int(n) for n in names if n.isdigit()), default=None)


def file_system(spark: SparkSession, folder: str) -> tuple:
    """Hadoop's file system of a path, and the path, as objects of the JVM."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


@contextmanager
def job_folder(spark: SparkSession) -> Iterator[str]:
    """What is staged inside goes to one folder, deleted when the job is over.

    Results have to be written or collected inside.
    """
    path = new_folder(spark, "job")
    _jobs.append(path)
    try:
        yield path
    finally:
        _jobs.remove(path)
        delete_folder(spark, path)


@contextmanager
def released_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries run inside go when the query ends.

    Otherwise they stay until the driver happens to collect its garbage.
    """
    before = spark.conf.get(RELEASE_SETTING, None)
    spark.conf.set(RELEASE_SETTING, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(RELEASE_SETTING)
        else:
            spark.conf.set(RELEASE_SETTING, before)


def staged(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    Cuts the lineage, so a lost executor does not repeat the work before it, and
    lets later steps read only the columns they need.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table; with a declared schema its columns, checked before use."""
    found = spark.read.parquet(path)
    if schema is None:
        return found
    wrong = missing_or_mistyped(found, schema)
    if wrong:
        raise ValueError(f"{path}: columns missing or of another type: {', '.join(wrong)}")
    return found.select(*schema.fieldNames())


def from_rows(
    spark: SparkSession, rows: Sequence[Mapping[str, Any]], schema: T.StructType
) -> DataFrame:
    """Rows the driver already holds (fixtures, form input) as a DataFrame."""
    names = schema.fieldNames()
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def jdbc_options(
    url: str,
    table: str,
    driver: str,
    user: str | None = None,
    password: str | None = None,
    partition_column: str | None = None,
    lower_bound: int | None = None,
    upper_bound: int | None = None,
    partitions: int | None = None,
    rows_per_trip: int = 10_000,
) -> dict[str, str]:
    """Options of a JDBC read or write; with a partition column the read is parallel."""
    options = {
        "url": url,
        "dbtable": table,
        "driver": driver,
        "fetchsize": str(rows_per_trip),
        "batchsize": str(rows_per_trip),
    }
    if user is not None:
        options["user"] = user
    if password is not None:
        options["password"] = password
    if partition_column is not None:
        if None in (lower_bound, upper_bound, partitions):
            raise ValueError("a partition column needs both bounds and a partition count")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(lower_bound),
            "upperBound": str(upper_bound),
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, **arguments: Any) -> DataFrame:
    """A whole table over JDBC; filters and columns used later are pushed down."""
    return spark.read.format("jdbc").options(**jdbc_options(**arguments)).load()


def append_jdbc(df: DataFrame, **arguments: Any) -> None:
    df.write.format("jdbc").options(**jdbc_options(**arguments)).mode("append").save()


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Put ``df`` in place of the table at ``path``, which ``df`` may read from.

    The new content is complete in the shared folder before the old one goes. The
    replacement itself is not atomic: Parquet folders have no transactions, so readers
    must wait, and after a failure while writing the staged copy is what holds the rows.
    """
    fresh = staged(df, "replacement")
    writer = fresh.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    delete_folder(df.sparkSession, fresh.inputFiles()[0].rpartition("/")[0])
    return read_table(df.sparkSession, path, None if partition_by else df.schema)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Overwrite only the partitions that ``df`` holds rows for."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, one file per task."""
    df.write.mode("overwrite").option("header", True).csv(path)


def candidate_export(job_candidates: DataFrame) -> DataFrame:
    """The columns of an offer's candidate list as exported, score as percent."""
    return job_candidates.select(
        "first_name",
        "last_name",
        "email",
        "phone",
        "city",
        "country",
        "education_level",
        "experience_years",
        scores.percent_1(F.col("similarity_score")).alias("match_percentage"),
    )
