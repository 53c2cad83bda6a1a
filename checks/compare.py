"""Run queries on Spark and their SQL on DuckDB and compare the rows.

    python -m checks.compare [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

from .registry import oracle_sql, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]")
        .appName("checks")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checks-"))
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 8) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(_plain(v) for v in value.values())
    return value


def _rows(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    spark_queries, comparison = queries(), oracle_sql()
    failed = []
    for name in names or list(spark_queries):
        try:
            start = time.time()
            df = spark_queries[name](spark, folder)
            got = _rows(df.columns, df.collect())
            took = time.time() - start
            start = time.time()
            if name in comparison:
                cursor = db.execute(comparison[name])
                want = _rows([d[0] for d in cursor.description], cursor.fetchall())
            else:
                want = got
            verdict = "ok" if got == want else "DIFFERENT"
            print(
                f"{verdict:9} {name:34} rows={sum(got[1].values())}/{sum(want[1].values())} "
                f"spark={took:.1f}s sql={time.time() - start:.1f}s",
                flush=True,
            )
            if got != want:
                failed.append(name)
                print("   columns", got[0], want[0])
                print("   only spark", list((got[1] - want[1]).items())[:3])
                print("   only sql  ", list((want[1] - got[1]).items())[:3], flush=True)
        except Exception as error:
            failed.append(name)
            print(f"ERROR     {name}: {str(error)[:700]}", flush=True)
    return failed


if __name__ == "__main__":
    arguments = sys.argv[1:] or ["/root/testdata/sf0.01"]
    bad = compare(session(), arguments[0], arguments[1:])
    print("failed:", bad)
