"""What the operators of this folder share: words, row keys, shared folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.tables import new_folder, staged

__all__ = ["WORD", "documents", "embeddings", "keep_first", "new_folder", "release", "row_key", "ship", "staged", "word_count", "words", "written"]

#: A word: a run of anything but blank, tab, line ends, vertical tab and form feed.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for NULL."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(*columns: str) -> Column:
    """A number that tells rows of one doc_id with different content apart."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns])


def keep_first(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """``docs`` with the first row of each group of ``grouped`` (doc_id, key, root).

    ``key`` is the ``row_key`` of the text. First is the row of smallest doc_id, NULL
    last, then of smallest key; of rows equal in both one stays.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = grouped.groupBy("root").agg(F.min(place).alias("k")).select(F.col("k.doc_id").alias("k_doc"), F.col("k.key").alias("k_key"))
    columns = docs.columns
    numbers = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]
    at = columns.index("doc_id"), columns.index("text")
    rows = docs.select(*numbers).withColumn("k_row", row_key(f"c{at[1]}"))
    met = rows.join(first, F.col(f"c{at[0]}").eqNullSafe(F.col("k_doc")) & (F.col("k_row") == F.col("k_key")), "left_semi")
    number = F.row_number().over(Window.partitionBy(f"c{at[0]}", "k_row").orderBy(f"c{at[1]}"))
    met = met.withColumn("k_place", number).filter("k_place = 1")
    return met.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/embeddings.parquet")


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, and where; see ``release``."""
    path = new_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, *paths: str) -> None:
    """Delete written tables that nothing reads any more.

    The JVM is asked to collect garbage, upon which Spark removes the shuffle files of
    steps that are over, too.
    """
    jvm = spark.sparkContext._jvm
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    jvm.System.gc()
