"""Approximate nearest neighbours by cross-polytope hashing.

Each of ``tables`` rotates a vector by a fast pseudo-rotation (three rounds of random
signs and a Hadamard transform) and files it under the signed axis it comes nearest to.
A query looks into the nearest tenth of the axes (``probe_share``) of each table. What it meets there is
scored on the original vectors in double precision, and the best of every place are
merged to the best ``k``. Queries that met fewer than ``k`` candidates, though there are
more, look into all axes of one table, that is at everything.

Inner products are searched by direction. Where norms differ by more than a percent,
indexed vectors get one more component that makes them equally long, and queries a zero
there: the order of inner products becomes an order of angles. These angles are wide, so
twice the share of axes is probed then.

The places of an axis are counted first. An axis with more than ``place_rows`` vectors
or ``place_queries`` queries is cut into places of that size, by a digest of the id, and
every part of its queries meets every part of its vectors. So no task holds more than
one place, whatever a third of all vectors look like. The count has one row per table
and axis. Nothing is dropped; a place hands on ``k`` rows per query.

Measured against brute force (20 nearest, 12 tables): recall 0.996 on 10,256 vectors of
64 components, 0.98 on 2,000, 0.96 on 500; see tests/llm/test_neighbours.py.

Rows. Vectors that are NULL, zero, of another length than most, or hold NULL or
non-finite components take no part, nor do rows without id. Of rows that repeat an id
the one with the smallest vector counts. Equal scores go by the smaller id. Only the id
and the vector are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, staged


def rotate(rows: np.ndarray, seed: int) -> np.ndarray:
    """Rows of a power of two components after three signed Hadamard transforms."""
    n = rows.shape[1]
    signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(3, n))
    for s in signs:
        rows = rows * s
        step = 1
        while step < n:
            pairs = rows.reshape(rows.shape[0], -1, 2, step)
            rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows.shape[0], n)
            step *= 2
        rows = rows / np.sqrt(n)
    return rows


def axes(rows: np.ndarray, seed: int, probes: int) -> np.ndarray:
    """The signed axes nearest to each row, nearest first: 2 i for +i, 2 i + 1 for -i."""
    turned = rotate(rows, seed)
    both = np.empty((turned.shape[0], 2 * turned.shape[1]))
    both[:, 0::2], both[:, 1::2] = turned, -turned
    if probes >= both.shape[1]:
        return np.tile(np.arange(both.shape[1]), (both.shape[0], 1))
    if probes == 1:
        return both.argmax(axis=1)[:, None]
    near = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(both, near, axis=1), axis=1, kind="stable"), axis=1)


def valid_vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``id`` and ``v`` (doubles) of the rows that take part."""
    v = F.col(vector_column)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != float("inf")))
    own = rows.select(F.col(id_column).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double")).alias("v"), good.alias("good"))
    own = own.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.col("good") & F.exists("v", lambda x: x != 0))
    sizes = own.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    size = sizes[0]["n"] if sizes else 1
    return own.filter(F.size("v") == size).groupBy("id").agg(F.min("v").alias("v"))


class _Hashing:
    """Turns ids and vectors into places; a value that tasks carry along."""

    def __init__(self, length: int, longest: float, level: bool) -> None:
        self.longest, self.level = longest, level
        self.size = 1 << max(1, (length + (0 if level else 1) - 1).bit_length())

    def padded(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((vectors.shape[0], self.size))
        out[:, : vectors.shape[1]] = vectors
        if not self.level and not query:
            out[:, vectors.shape[1]] = np.sqrt(np.maximum(self.longest**2 - (vectors**2).sum(axis=1), 0.0))
        return out / np.linalg.norm(out, axis=1, keepdims=True)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(1)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _digest(ids: np.ndarray) -> np.ndarray:
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed >> np.uint64(33)


def _meet(indexed: DataFrame, queries: DataFrame, hashing: _Hashing, seeds: list[int], probes: int, k: int, place_rows: int, place_queries: int) -> DataFrame:
    """query_id, vec_id, score of the best ``k`` of each place, for each of its queries."""

    def counts(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(seeds), 2 * hashing.size), np.int64)
            for batch in batches:
                if batch.num_rows:
                    rows = hashing.padded(_matrix(batch), query)
                    for t, seed in enumerate(seeds):
                        total[t] += np.bincount(axes(rows, seed, probes if query else 1).reshape(-1), minlength=2 * hashing.size)
            t, axis = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(axis), pa.array(total[t, axis])], names=["t", "axis", "n"])

        return run

    def parts(rows: DataFrame, query: bool, most: int) -> np.ndarray:
        found = rows.mapInArrow(counts(query), "t long, axis long, n long").groupBy("t", "axis").agg(F.sum("n").alias("n")).collect()
        out = np.ones((len(seeds), 2 * hashing.size), np.int64)
        for row in found:  # one row per table and axis
            out[row["t"], row["axis"]] = ceil(row["n"] / most)
        return out

    v_parts, q_parts = parts(indexed, False, place_rows), parts(queries, True, place_queries)

    def placed(query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    ids = batch.column(0).to_numpy()
                    rows = hashing.padded(_matrix(batch), query)
                    for t, seed in enumerate(seeds):
                        near = axes(rows, seed, probes if query else 1)
                        row, axis = np.repeat(np.arange(len(ids)), near.shape[1]), near.reshape(-1)
                        own, other = (q_parts, v_parts) if query else (v_parts, q_parts)
                        part = (_digest(ids[row]) % own[t, axis].astype(np.uint64)).astype(np.int64)
                        copies = other[t, axis]
                        row, axis, part = (np.repeat(x, copies) for x in (row, axis, part))
                        against = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                        v_part, q_part = (against, part) if query else (part, against)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(row), t)), pa.array(axis), pa.array(v_part), pa.array(q_part), *[batch.column(c).take(pa.array(row)) for c in (0, 1)]],
                            names=["t", "axis", "v_part", "q_part", "id", "v"],
                        )

        return run

    schema = "t long, axis long, v_part long, q_part long, id long, v array<double>"
    keys = ["t", "axis", "v_part", "q_part"]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        queries_, vectors_ = left.select(["id", "v"]).combine_chunks(), right.select(["id", "v"]).combine_chunks()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            q_ids, v_ids = queries_["id"].to_numpy(), vectors_["id"].to_numpy()
            q, v = (_matrix(x.to_batches()[0]) for x in (queries_, vectors_))
            rough = q @ v.T
            rough[q_ids[:, None] == v_ids[None, :]] = -np.inf
            kth = min(k, v.shape[0]) - 1
            least = -np.partition(-rough, kth, axis=1)[:, kth]
            slack = 1e-9 * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max()
            for i in range(len(q_ids)):
                own = np.flatnonzero((rough[i] >= least[i] - slack[i]) & (rough[i] > -np.inf))
                score = (q[i] * v[own]).sum(axis=1)  # the same sum wherever the pair meets
                order = np.lexsort((v_ids[own], -score))[:k]
                out.append((np.full(len(order), q_ids[i]), v_ids[own][order], score[order]))
        columns = [np.concatenate([o[c] for o in out]) if out else np.empty(0, kind) for c, kind in enumerate((np.int64, np.int64, np.float64))]
        return pa.table({"query_id": columns[0], "vec_id": columns[1], "score": columns[2]})

    asked, filed = queries.mapInArrow(placed(True), schema), indexed.mapInArrow(placed(False), schema)
    return asked.groupBy(*keys).cogroup(filed.groupBy(*keys)).applyInArrow(best, "query_id long, vec_id long, score double")


def nearest(
    rows: DataFrame,
    is_query: Column,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    k: int = 20,
    tables: int = 12,
    probe_share: float = 0.1,
    place_rows: int = 4096,
    place_queries: int = 1024,
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` found nearest by inner product.

    ``is_query`` is a condition on the column ``id``.
    """
    ship(rows.sparkSession)
    valid = staged(valid_vectors(rows, id_column, vector_column), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda t, x: t + x * x))
    n, low, high, length = valid.agg(F.count(F.lit(1)), F.min(norm), F.max(norm), F.max(F.size("v"))).first()
    hashing = _Hashing(length or 1, high or 1.0, (low or 0.0) >= 0.99 * (high or 0.0))
    queries = valid.filter(is_query)
    probes = ceil(probe_share * (1 if hashing.level else 2) * 2 * hashing.size)
    seeds = list(range(1, tables + 1))
    found = staged(_meet(valid, queries, hashing, seeds, probes, k, place_rows, place_queries).distinct(), "neighbours")
    needed = min(k, n - 1)
    counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    short = queries.join(counts, F.col("id") == F.col("query_id"), "left").filter(F.coalesce("n", F.lit(0)) < needed).select("id", "v")
    short = staged(short, "short-queries")
    if not short.isEmpty():
        rest = _meet(valid, short, hashing, seeds[:1], 2 * hashing.size, k, place_rows, place_queries)
        found = found.unionAll(rest).distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
