"""Exact quantiles and match thresholds by radix selection.

A double is taken as a 64-bit key whose unsigned order is the order of the values. A pass
counts the values of each wanted range by the next 16 bits of their keys, all ranks
together; the bin that holds a rank is its range in the next pass. After four passes at
most a range is one value. Once the ranges hold few values these are counted one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.tables import staged

DIGIT = 16
BINS = 1 << DIGIT


def keys_of(values: np.ndarray) -> np.ndarray:
    """64-bit numbers in the order of the values; -0.0 counts as 0.0, NaN comes last."""
    values = np.where(np.isnan(values), np.nan, values + 0.0)
    bits = values.view(np.uint64)
    negative = bits >> np.uint64(63) == 1
    return np.where(negative, ~bits, bits | np.uint64(1 << 63))


def value_of(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else ~key & ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _counted(values: DataFrame, prefixes: Sequence[int], shift: int) -> DataFrame:
    """How many values have each key, cut to the bits above ``shift``, among those whose
    next higher bits are one of ``prefixes``: ``key, n``."""
    wanted = np.array(sorted(prefixes), np.uint64)
    above = shift + DIGIT

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((wanted.size, BINS), np.int64)
        for batch in batches:
            keys = keys_of(batch.column(0).to_numpy(zero_copy_only=False))
            for i, prefix in enumerate(wanted):
                own = keys if above == 64 else keys[keys >> np.uint64(above) == prefix]
                tables[i] += np.bincount((own >> np.uint64(shift) & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
        for i, prefix in enumerate(wanted):
            held = np.flatnonzero(tables[i])
            key = held.astype(np.uint64) if above == 64 else (prefix << np.uint64(DIGIT)) | held.astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(tables[i][held])], names=["key", "n"])

    return values.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _single(values: DataFrame, prefixes: Sequence[int], shift: int) -> DataFrame:
    """How often each value occurs whose bits above ``shift`` are one of ``prefixes``."""
    wanted = np.array(sorted(prefixes), np.uint64)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = keys_of(batch.column(0).to_numpy(zero_copy_only=False))
            held, n = np.unique(keys[np.isin(keys >> np.uint64(shift), wanted)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(n)], names=["key", "n"])

    return values.mapInArrow(pick, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _collected(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = counts.toArrow()
    keys = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], table.column("n").to_numpy()[order]


def exact_quantiles(
    df: DataFrame, value: str, probabilities: Sequence[float], few: int = BINS
) -> DataFrame:
    """Linear-interpolated quantiles of a numeric column: ``probability, quantile``.

    The column is written once, as doubles, and read once per pass: four passes at most,
    whatever the values, and two where the first leaves ranges of up to ``few`` values.
    65,536 counts per wanted range reach the driver, of at most two ranges per
    probability. NULL is left out, NaN is larger than any number.
    """
    spark = df.sparkSession
    ship(spark)
    values = staged(df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull()), "quantile-values")
    # Per rank: its range (the bits above shift) and its place in it.
    keys, counts = _collected(_counted(values, [0], 64 - DIGIT))
    size = int(counts.sum())
    if not size:
        return spark.createDataFrame([], "probability double, quantile double")
    places = {float(p): p * (size - 1) for p in probabilities}
    ranks = sorted({r for place in places.values() for r in (math.floor(place), math.ceil(place))})
    inside = {r: r for r in ranks}
    prefix = dict.fromkeys(ranks, 0)
    for shift in (48, 32, 16, 0):
        if shift < 48:
            single = sum({prefix[r]: held[r] for r in ranks}.values()) <= few
            count = _single if single else _counted
            keys, counts = _collected(count(values, set(prefix.values()), shift + DIGIT if single else shift))
            cut = shift + DIGIT if single else DIGIT
        held = {}
        for r in ranks:
            own = slice(None) if shift == 48 else keys >> np.uint64(cut) == np.uint64(prefix[r])
            upto = np.cumsum(counts[own])
            at = int(np.searchsorted(upto, inside[r], "right"))
            prefix[r], held[r] = int(keys[own][at]), int(counts[own][at])
            inside[r] -= int(upto[at]) - held[r]
        if shift < 48 and single:
            break
    found = {r: value_of(prefix[r]) for r in ranks}
    quantiles = []
    for p, place in places.items():
        below, above = found[math.floor(place)], found[math.ceil(place)]
        # Equal ends give themselves, also where they are infinite.
        between = below if below == above else below + (above - below) * (place - math.floor(place))
        quantiles.append((p, between))
    return spark.createDataFrame(quantiles, "probability double, quantile double")


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def match_thresholds(
    distances: DataFrame,
    column: str = "distance",
    percentile: float = 75.0,
    n_std: float = 1.5,
    fixed: float = 3.0,
    fixed_if_empty: float = 2.0,
) -> DataFrame:
    """Distance thresholds by every method: ``method, threshold``, one row each."""
    finite = distances.select(F.col(column).cast("double").alias("d")).filter(_finite(F.col("d")))
    finite = staged(finite, "distances")
    points = sorted({0.25, 0.5, 0.75, percentile / 100.0})
    q = exact_quantiles(finite, "d", points)

    def at(p: float) -> Column:
        return F.max(F.when(F.abs(F.col("probability") - p) < 1e-12, F.col("quantile")))

    quartiles = q.agg(
        at(percentile / 100.0).alias("pct"),
        at(0.25).alias("q1"),
        at(0.5).alias("median"),
        at(0.75).alias("q3"),
        F.lit(1).alias("one"),
    )
    moments = finite.agg(
        F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"), F.lit(1).alias("one")
    )
    skewed = F.abs(F.col("mean") - F.col("median")) > 0.5 * F.col("std")
    middle = F.when(skewed, F.col("median")).otherwise(F.col("mean"))
    by_method = {
        "percentile": F.col("pct"),
        "std": F.greatest(F.lit(0.0), F.col("mean") - n_std * F.col("std")),
        "iqr": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")),
        "adaptive": middle - 0.25 * F.col("std"),
        "fixed": F.lit(fixed),
    }
    listed = F.array(
        *[F.struct(F.lit(m).alias("method"), t.alias("t")) for m, t in by_method.items()]
    )
    empty = F.col("mean").isNull()
    return (
        moments.join(quartiles, "one")
        .select(F.explode(listed).alias("m"), empty.alias("empty"))
        .select(
            "m.method",
            F.when(F.col("empty"), F.lit(fixed_if_empty)).otherwise(F.col("m.t")).alias(
                "threshold"
            ),
        )
    )


def match_threshold(distances: DataFrame, method: str = "percentile", **arguments) -> DataFrame:
    """The threshold of one method; an unknown method counts as ``fixed``."""
    known = {"percentile", "std", "iqr", "adaptive"}
    return match_thresholds(distances, **arguments).filter(
        F.col("method") == (method if method in known else "fixed")
    )
