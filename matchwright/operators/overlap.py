"""Skill-overlap matching, exact and without pair lists.

An offer's score is the share of its skills the candidate has. Few offers are broadcast.
Otherwise both sides hold their skills as numbers, as far as an offer asks for them, and
are packed into blocks that are written once and meet as a Cartesian product: no copies of
sets are shuffled, however many blocks a block meets. Each block's own index of skills
finds what its rows share with another's. Candidates with more skills come first, and a
block is left out where none of its candidates has as many skills as an offer needs, by
the minimum or by the ``k`` it has found already. A task keeps the best ``k`` of its offers
(or candidates) while the other side passes by, in a fixed number of partitions at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores, text
from ..sources.tables import staged
from . import blocks
from .blocks import PAIR_SCHEMA
from .maintenance import assign_ids
from .nearest import FEWEST_ROWS, FILE_BLOCKS, TASKS_PER_CORE, top_per_offer

FEW_OFFERS = 4096  # most offers that are broadcast
SKILL_BYTES = 4096  # most bytes of skills of an offer that is broadcast
SLICE = 1024  # candidates held against them at a time
PAIRS = 1 << 20  # pairs a task holds where all are asked for
BLOCK_SKILLS = 1 << 20  # most skills of a block, 8 MB
NO_ID = -(1 << 63)  # stands for a NULL id, and comes first as Spark sorts it


def folded_skills(df: DataFrame, key: str, *skill_columns: str) -> DataFrame:
    """One folded skill set per row from one or more skill array columns."""
    empty = F.array().cast("array<string>")
    both = F.concat(*[F.coalesce(F.col(c), empty) for c in skill_columns])
    return df.select(key, text.fold(both).alias("skill_set"))


ANYONE = ""  # stands for "no skill asked": every candidate has it


def _met(k: int | None, minimum: float, per_candidate: bool):
    """Scores pairs of blocks; with ``k``, the best of every waiting row leave at the end."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, blocks.Pairs]] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = {n: batch.column(n)[at] for n in batch.schema.names}
                block = row["to_block"].as_py()
                ids, flat, sizes = (np.frombuffer(row[c].as_buffer(), t) for c, t in blocks.SET_COLUMNS.items())
                own = blocks.Sets(ids, flat, sizes)
                ids, flat, sizes = (np.frombuffer(row[f"to_{c}"].as_buffer(), t) for c, t in blocks.SET_COLUMNS.items())
                waiting = blocks.Sets(ids, flat, sizes)
                asked = np.frombuffer(row["to_asked" if not per_candidate else "asked"].as_buffer(), np.int32)
                if k is None:
                    yield _pairs(waiting.ids, blocks.set_pairs(own, waiting, asked, None, minimum, per_candidate))
                    continue
                held = best[block][1] if block in best else blocks.no_pairs()
                found = blocks.set_pairs(own, waiting, asked, k, minimum, per_candidate, held)
                if found[0].size:
                    best[block] = waiting.ids.copy(), blocks.keep_best(blocks.join_pairs([held, found]), k)
        for names, pairs in best.values():
            yield _pairs(names, pairs)

    def _pairs(names: np.ndarray, pairs: blocks.Pairs) -> pa.RecordBatch:
        keys, others, score = names[pairs[0]], *pairs[1:]
        ids = [pa.array(x, pa.int64(), mask=x == NO_ID) for x in ((others, keys) if per_candidate else (keys, others))]
        return pa.RecordBatch.from_arrays([*ids, pa.array(score, pa.float64())], names=blocks.PAIR_COLUMNS)

    return met


def _asked_skills(asked: DataFrame, limit: int) -> tuple[list[np.ndarray], np.ndarray] | None:
    """All offers' skills where they are few and short, counted while reading; else None.

    Skills of more than ``SKILL_BYTES`` an offer are not fetched.
    """
    size = F.aggregate(
        "wanted", F.lit(0), lambda n, s: n + F.coalesce(F.octet_length(s), F.lit(0))
    )
    head = asked.select(
        "job_offer_id", F.when(size <= SKILL_BYTES, F.col("wanted")).alias("wanted")
    ).take(limit + 1)
    if len(head) > limit or any(r.wanted is None for r in head):
        return None
    if sum(len(r.wanted) for r in head) > 16 * limit:
        return None
    return [np.array(r.wanted, dtype=object) for r in head], np.array(
        [r.job_offer_id for r in head], dtype=np.int64
    )


def _with_few_offers(
    candidates: DataFrame,
    few: tuple[list[np.ndarray], np.ndarray],
    k: int | None,
    minimum: float,
    per_candidate: bool = False,
) -> DataFrame:
    """Pairs of broadcast offers and candidates read in place: no skill is shuffled.

    All offers are at hand, so a candidate's best ``k`` are final and leave at once.
    """
    shared = candidates.sparkSession.sparkContext.broadcast(few)

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, offers = shared.value
        askers, sizes = blocks.askers_of(wanted), np.array([len(w) for w in wanted])
        at_a_time = SLICE if k is not None else max(1, min(SLICE, PAIRS // max(len(offers), 1)))
        best = blocks.no_pairs()
        for batch in batches:
            for start in range(0, len(batch), at_a_time):
                part = batch.iloc[start : start + at_a_time]
                found = blocks.overlap_pairs(
                    list(part["skill_set"]),
                    part["candidate_id"].to_numpy(),
                    askers,
                    sizes,
                    offers,
                    k,
                    minimum,
                    per_candidate,
                )
                if k is None or per_candidate:
                    yield blocks.as_frame(found)
                else:
                    best = blocks.keep_best(blocks.join_pairs([best, found]), k)
        yield blocks.as_frame(best)

    return candidates.select("candidate_id", "skill_set").mapInPandas(match, PAIR_SCHEMA)


def _check(min_similarity: float) -> None:
    if min_similarity <= 0:
        raise ValueError("min_similarity must be positive: 0 would ask for every pair")


def _numbered(candidates: DataFrame, asked: DataFrame) -> DataFrame:
    """Every skill an offer asks for: ``skill, number, holders``."""
    vocabulary = asked.select(F.explode("wanted").alias("skill")).distinct()
    holders = (
        candidates.select(F.explode("skill_set").alias("skill"))
        .join(vocabulary, "skill", "left_semi")
        .groupBy("skill")
        .agg(F.count("*").alias("holders"))
    )
    known = vocabulary.join(holders, "skill", "left").withColumn(
        "holders", F.coalesce("holders", F.lit(0).cast("long"))
    )
    return staged(assign_ids(known, "number", ["skill"], F.lit(0)), "skill-numbers")


def _by_rarity(rows: DataFrame, keys: list[str], column: str, numbered: DataFrame) -> DataFrame:
    """``keys`` and the numbers of a row's skills, rarest first, as far as they are asked for."""
    return (
        rows.select(*keys, F.explode(column).alias("skill"))
        .join(numbered, "skill")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_set(F.struct("holders", "number"))).alias("found"))
        .select(*keys, F.col("found.number").alias("numbers"))
    )


def _held(candidates: DataFrame, numbered: DataFrame) -> DataFrame:
    return _by_rarity(candidates, ["candidate_id"], "skill_set", numbered).withColumnRenamed(
        "numbers", "held"
    )


def _wanted(asked: DataFrame, numbered: DataFrame) -> DataFrame:
    sized = asked.select("job_offer_id", F.size("wanted").alias("asked"), "wanted")
    return _by_rarity(sized, ["job_offer_id", "asked"], "wanted", numbered).withColumnRenamed(
        "numbers", "wanted"
    )


def _first_of_equals(rows: DataFrame, key: str, same: list[str], k: int) -> DataFrame:
    """The ``k`` smallest keys of rows that tie everywhere: no other can be among the best."""
    copies = Window.partitionBy(*same).orderBy(key)
    return rows.withColumn("at", F.row_number().over(copies)).filter(F.col("at") <= k).drop("at")


def _packed(rows: DataFrame, files: int, block_rows: int) -> DataFrame:
    """``id, asked, numbers`` in blocks, rows with most skills first."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, done = TaskContext.get().partitionId() << 33, 0
        ids, asked, sets, held = [], [], [], 0

        def block() -> pa.RecordBatch:
            numbers = np.concatenate(sets)
            sizes = np.array([x.size for x in sets], np.int32)
            wants = np.array(asked, np.int32)
            flat = [np.array(ids, np.int64), numbers, sizes, wants]
            columns = [pa.array([first + done]), pa.array([int(sizes.max())], pa.int32()), pa.array([int(wants.min())], pa.int32())]
            columns += [pa.array([x.tobytes()], pa.binary()) for x in flat]
            return pa.RecordBatch.from_arrays(columns, names=["block", "most", "fewest_asked", "ids", "numbers", "sizes", "asked"])

        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)
            for own, n, numbers in rows:
                numbers = numbers.values.to_numpy()
                if ids and (len(ids) >= block_rows or held + numbers.size > BLOCK_SKILLS):
                    yield block()
                    ids, asked, sets, held, done = [], [], [], 0, done + 1
                ids.append(own)
                asked.append(n)
                sets.append(numbers)
                held += numbers.size
        if ids:
            yield block()

    order = [F.size("numbers").desc(), F.xxhash64("id")]
    near = rows.repartitionByRange(files, *order).sortWithinPartitions(*order)
    schema = "block long, most int, fewest_asked int, ids binary, numbers binary, sizes binary, asked binary"
    return near.select("id", "asked", "numbers").mapInArrow(pack, schema)


def _meeting(
    heads: DataFrame,
    asking: DataFrame,
    k: int | None,
    min_similarity: float,
    block_rows: int,
    per_candidate: bool = False,
) -> DataFrame:
    """Scored pairs of ``candidate_id, held`` and ``job_offer_id, asked, wanted``.

    An offer id with sets of several sizes has the better score.
    """

    def rows_of(side: DataFrame, key: str, asked: Column, numbers: str) -> DataFrame:
        own = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID))
        return side.select(own.alias("id"), asked.alias("asked"), F.col(numbers).alias("numbers"))

    sides = [rows_of(heads, "candidate_id", F.lit(0), "held"), rows_of(asking, "job_offer_id", F.col("asked"), "wanted")]
    # Those whose best are kept wait, the others pass by.
    passing, waiting = reversed(sides) if per_candidate else sides

    def sized(side: DataFrame) -> tuple[int, int]:
        n, skills = side.agg(F.count("*"), F.sum(F.size("numbers"))).first()
        return n, max(-(-n // block_rows), -(-(skills or 0) // BLOCK_SKILLS))

    tasks = TASKS_PER_CORE * heads.sparkSession.sparkContext.defaultParallelism
    (_, n_left), (n, n_right) = sized(passing), sized(waiting)
    goals = max(min(tasks, n // FEWEST_ROWS), -(-n_right // FILE_BLOCKS), 1)
    # Each partition of those that pass hands on ``k`` rows of a key: one is enough beside many of the others.
    parts = -(-tasks // goals)
    files = max(parts, -(-n_left // FILE_BLOCKS))
    left = staged(_packed(passing, files, block_rows), "passing-sets").drop("block").coalesce(parts)
    right = staged(_packed(waiting, goals, block_rows), "waiting-sets")
    right = right.select(*[F.col(c).alias(f"to_{c}") for c in right.columns])
    most, least = ("to_most", "fewest_asked") if per_candidate else ("most", "to_fewest_asked")
    needed = F.greatest(F.ceil(F.col(least) * F.lit(min_similarity) - F.lit(1e-9)), F.lit(1))
    met = left.hint("shuffle_replicate_nl").join(right, F.col(most) >= needed)
    pairs = met.drop("most", "fewest_asked", "to_most", "to_fewest_asked").mapInArrow(
        _met(k, min_similarity, per_candidate), PAIR_SCHEMA
    )
    return pairs.groupBy("job_offer_id", "candidate_id").agg(F.max("similarity_score").alias("similarity_score"))


def best_by_overlap(
    candidates: DataFrame,
    offers: DataFrame,
    k: int = scores.MATCHES_PER_OFFER,
    min_similarity: float = scores.MIN_SIMILARITY,
    block_rows: int = 2048,
    few_offers: int = FEW_OFFERS,
) -> DataFrame:
    """The ``k`` candidates with the largest overlap for every offer, ties by id.

    Both sides have an id and ``skill_set``. An offer without skills scores 1 with
    everyone, so it takes the ``k`` smallest candidate ids.
    """
    _check(min_similarity)
    asked = offers.filter(F.size("skill_set") > 0).select(
        "job_offer_id", F.col("skill_set").alias("wanted")
    )
    few = _asked_skills(asked, few_offers)
    if few is not None:
        found = _with_few_offers(candidates, few, k, min_similarity)
    else:
        numbered = _numbered(candidates, asked)
        heads = staged(
            _first_of_equals(_held(candidates, numbered), "candidate_id", ["held"], k),
            "skill-holders",
        )
        asking = staged(_wanted(asked, numbered), "skill-askers")
        found = _meeting(heads, asking, k, min_similarity, block_rows)
    first = (
        candidates.select("candidate_id")
        .orderBy("candidate_id")
        .limit(k)
        .agg(F.collect_list("candidate_id"))
        .scalar()
    )
    open_to_all = (
        offers.filter(F.size("skill_set") == 0)
        .select("job_offer_id", F.explode(first).alias("candidate_id"))
        .withColumn("similarity_score", F.lit(1.0))
    )
    return top_per_offer(found.unionByName(open_to_all), k)


def best_offers_by_overlap(
    candidates: DataFrame,
    offers: DataFrame,
    k: int = scores.MATCHES_PER_OFFER,
    min_similarity: float = scores.MIN_SIMILARITY,
    block_rows: int = 2048,
    few_offers: int = FEW_OFFERS,
) -> DataFrame:
    """The ``k`` offers whose skills each candidate covers best, ties by offer id.

    An offer without skills scores 1 with everyone: the ``k`` smallest such ids are
    found once and handed to every candidate. No more than ``k`` rows of a candidate
    leave a block.
    """
    _check(min_similarity)
    asked = offers.filter(F.size("skill_set") > 0).select(
        "job_offer_id", F.col("skill_set").alias("wanted")
    )
    few = _asked_skills(asked, few_offers)
    if few is not None:
        found = _with_few_offers(candidates, few, k, min_similarity, per_candidate=True)
    else:
        numbered = _numbered(candidates, asked)
        heads = staged(_held(candidates, numbered), "skill-holders")
        asking = staged(
            _first_of_equals(_wanted(asked, numbered), "job_offer_id", ["wanted", "asked"], k),
            "skill-askers",
        )
        found = _meeting(heads, asking, k, min_similarity, block_rows, per_candidate=True)
    empty = offers.filter(F.size("skill_set") == 0).select("job_offer_id")
    first = empty.orderBy("job_offer_id").limit(k).agg(F.collect_list("job_offer_id")).scalar()
    open_to_all = candidates.select(
        F.explode(first).alias("job_offer_id"), "candidate_id"
    ).withColumn("similarity_score", F.lit(1.0))
    best = Window.partitionBy("candidate_id").orderBy(F.desc("similarity_score"), "job_offer_id")
    return (
        found.unionByName(open_to_all)
        .withColumn("match_rank", F.row_number().over(best))
        .filter(F.col("match_rank") <= k)
    )


def overlapping_pairs(
    candidates: DataFrame,
    offers: DataFrame,
    min_similarity: float = scores.MIN_SIMILARITY,
    block_rows: int = 1024,
    few_offers: int = FEW_OFFERS,
) -> DataFrame:
    """All pairs with at least ``min_similarity`` overlap: a set-similarity join.

    An offer without skills pairs with everyone, as its score of 1 demands. A task
    holds at most ``block_rows`` squared pairs, or ``PAIRS`` where offers are broadcast.
    """
    _check(min_similarity)
    anyone = F.array(F.lit(ANYONE))
    asked = offers.select(
        "job_offer_id",
        F.when(F.size("skill_set") > 0, F.col("skill_set")).otherwise(anyone).alias("wanted"),
    )
    everyone = candidates.select(
        "candidate_id", F.concat(F.col("skill_set"), anyone).alias("skill_set")
    )
    few = _asked_skills(asked, few_offers)
    if few is not None:
        return _with_few_offers(everyone, few, None, min_similarity)
    numbered = _numbered(everyone, asked)
    heads = staged(_held(everyone, numbered), "skill-holders")
    asking = staged(_wanted(asked, numbered), "skill-askers")
    return _meeting(heads, asking, None, min_similarity, block_rows)


def overlap_scores(pairs: DataFrame, candidates: DataFrame, offers: DataFrame) -> DataFrame:
    """Skill overlap of pairs that already exist."""
    c = candidates.select("candidate_id", F.col("skill_set").alias("held"))
    o = offers.select("job_offer_id", F.col("skill_set").alias("wanted"))
    return (
        pairs.join(c, "candidate_id")
        .join(o, "job_offer_id")
        .withColumn("similarity_score", scores.overlap(F.col("held"), F.col("wanted")))
        .drop("held", "wanted")
    )
