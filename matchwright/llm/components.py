"""Connected components of an edge table by alternating large and small stars.

Each round every node hands its larger neighbours (large star), then its smaller ones
(small star), to the smallest node it knows, until no edge changes. Minima are plain
aggregates and meet the edges in an equi-join with one row per node on the other side,
so a node with a large part of all edges can be split. Each step is written to the
shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of comparable nodes -> (node, root): the smallest node reachable.

    Nodes without an edge to another node are not listed. Repeated edges and edges of a
    node to itself are allowed; the direction of edges does not matter.
    """
    now = staged(
        edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    state = _state(now)
    while state[0]:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, F.col("a") == F.col("n")).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = staged(large.filter("a != b").distinct(), "large-star")
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("low"))
        small = large.join(low, F.col("a") == F.col("n"))
        hung = small.filter("b != low").select(F.greatest("b", "low").alias("a"), F.least("b", "low").alias("b"))
        now = staged(hung.unionAll(low.select(F.col("n").alias("a"), F.col("low").alias("b"))).distinct(), "small-star")
        before, state = state, _state(now)
        if state == before:
            break
    # Every remaining edge leads to a root, and roots lead nowhere.
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
