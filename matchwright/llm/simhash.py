"""SimHash near-dedup with the generalised pigeonhole principle.

A document's fingerprint has 64 bits; a bit is set if it is set in more than half of the
hashes of the document's word shingles. Fingerprints link at ``radius`` or fewer
differing bits, documents are grouped by reachability.

Search works on distinct fingerprints. Their bits are dealt into ``m`` partitions, with
correlated bits side by side, and partition ``i`` gets a threshold ``t_i`` such that the
``t_i + 1`` add up to ``radius + 1``: of two fingerprints within ``radius`` at least one
partition differs in at most ``t_i`` bits. The bits' counts and co-occurrences over all
fingerprints give the expected candidates of a partition at each threshold, dynamic
programming picks thresholds (0 to radius, or none at all), and the cheapest ``m`` wins;
so keys get longer as the data grows. Each fingerprint is entered under its key in every
partition with a threshold, probes the keys within ``t_i`` bits, and what meets is
verified on all 64 bits inside the join.

Dense groups would verify all pairs of near copies. So a first pass links every
fingerprint to the smallest one in its bucket of two neighbouring partitions, verified,
and pairs under one leader, which are thereby connected, are left out of the join's
result. The components are those of the leaders' links and the join's links together.

Rows. NULL and empty texts have fingerprint zero and are linked like any other. Repeated
rows and copies share a fingerprint. A component is named by its smallest doc_id; NULL
doc_ids name none unless nothing else is there. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_first, row_key, ship, staged
from .components import components

BITS = 64
SEED = 42
#: What a probe row costs, in verified pairs.
ROW_COST = 20


def fingerprint(text: str | None, words: int = 4) -> int:
    """The SimHash of a text's word shingles, ASCII letters in lower case."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(found)
    if len(found) <= words:
        return digest(joined, SEED)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(found) - words + 1].tolist()
    lasts = ends[words - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), 65536):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 65536], lasts[at : at + 65536], strict=True)]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > len(starts)))


def fingerprints(docs: DataFrame, words: int = 4, *others: str) -> DataFrame:
    """doc_id, the named other columns and ``fp``, the fingerprint as a signed 64-bit number."""
    ship(docs.sparkSession)
    names = ["doc_id", *others]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                values = np.array([fingerprint(t, words) for t in some.column(len(names)).to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([*some.columns[: len(names)], pa.array(values.view(np.int64))], names=[*names, "fp"])

    kinds = "".join(f"{n} {docs.schema[n].dataType.simpleString()}, " for n in names)
    return docs.select(*names, "text").mapInArrow(compute, f"{kinds}fp long")


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how often each two bits are set together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, together = 0, np.zeros((BITS, BITS))
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy()).astype("<i8")
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            together += bits.T @ bits
            total += len(values)
        flat = np.concatenate([together.reshape(-1), [total]]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(flat.size)), pa.array(flat)], names=["cell", "n"])

    rows = distinct.select("fp").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1)
    for row in rows:
        flat[row["cell"]] = row["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """All bits in ``parts`` groups of nearly equal size, correlated bits together."""
    p = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(p, p)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs(cov / np.outer(dev, dev))
    np.fill_diagonal(near, 0)
    free, groups = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        group = [max(free, key=lambda b: (near[b, free].max(initial=0), -b))]
        free.remove(group[0])
        while len(group) < size:
            group.append(max(free, key=lambda b: (near[b, group].sum(), -b)))
            free.remove(group[-1])
        groups.append(sorted(group))
    return groups


def plan(n: int, together: np.ndarray, radius: int) -> list[tuple[list[int], int]]:
    """Groups of bits with their thresholds, at the least expected cost."""
    p = np.diag(together) / max(n, 1)
    differ = 2 * p * (1 - p)
    best: tuple[float, list[tuple[list[int], int]]] | None = None
    for parts in range(2, radius + 2):
        groups = group_bits(n, together, parts)
        costs = []
        for group in groups:
            within = np.zeros(radius + 1)  # probability that so many bits differ
            within[0] = 1
            for b in group:
                within[1:] = within[1:] * (1 - differ[b]) + within[:-1] * differ[b]
                within[0] *= 1 - differ[b]
            pairs = n * n / 2 * np.cumsum(within)
            probes = np.cumsum([comb(len(group), j) for j in range(radius + 1)])
            costs.append(n * ROW_COST * (1 + probes / 2) + pairs)
        # state: radius + 1 left to hand out; a group takes t + 1 of it, or nothing
        table: dict[int, tuple[float, list[int]]] = {radius + 1: (0.0, [])}
        for cost in costs:
            new: dict[int, tuple[float, list[int]]] = {}
            for left, (spent, taken) in table.items():
                for t in range(-1, left):
                    total = spent + (cost[t] if t >= 0 else 0.0)
                    if left - t - 1 not in new or total < new[left - t - 1][0]:
                        new[left - t - 1] = (total, [*taken, t])
            table = new
        spent, taken = table[0]
        if best is None or spent < best[0]:
            best = spent, list(zip(groups, taken, strict=True))
    return best[1]


def _key(fp: Column, bits: list[int]) -> Column:
    taken = [F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1)), j) for j, b in enumerate(bits)]
    out = taken[0]
    for x in taken[1:]:
        out = out.bitwiseOR(x)
    return out


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def linked(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Distinct fingerprints -> (fp, root) of those linked to another one."""
    ship(distinct.sparkSession)
    n, together = bit_statistics(distinct)
    chosen = plan(n, together, radius)

    # Leaders: the smallest fingerprint with the same bits in two neighbouring groups.
    groups = [bits for bits, _ in chosen]
    wide = [groups[i] + groups[(i + 1) % len(groups)] for i in range(len(groups) if len(groups) > 2 else 1)]
    buckets = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), _key(F.col("fp"), bits[: BITS // 2]).alias("key")) for i, bits in enumerate(wide)])).alias("x")).select("fp", "x.part", "x.key")
    leaders = buckets.groupBy("part", "key").agg(F.min("fp").alias("leader"))
    led = staged(
        buckets.join(leaders, ["part", "key"])
        .filter((F.col("fp") != F.col("leader")) & (_distance("fp", "leader") <= radius))
        .select("fp", "leader")
        .distinct(),
        "simhash-leaders",
    )
    # A fingerprint goes under its smallest leader; all under one leader are connected.
    under = led.groupBy("fp").agg(F.min("leader").alias("under"))
    named = staged(distinct.join(under, "fp", "left").select("fp", F.coalesce("under", "fp").alias("known")), "simhash-known")
    above = named.select(F.col("fp").alias("leader"), F.col("known").alias("b"))
    ties = led.join(named, "fp").join(above, "leader").select(F.col("known").alias("a"), "b")

    used = [(i, bits, t) for i, (bits, t) in enumerate(chosen) if t >= 0]
    entered = named.select(
        F.col("fp").alias("o_fp"),
        F.col("known").alias("o_known"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("part"), _key(F.col("fp"), bits).alias("key")) for i, bits, _ in used])).alias("x"),
    ).select("o_fp", "o_known", "x.part", "x.key")
    probes = None
    for i, bits, t in used:
        masks = [sum(1 << j for j in c) for size in range(t + 1) for c in combinations(range(len(bits)), size)]
        own = named.withColumn("key", _key(F.col("fp"), bits)).withColumn("mask", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])))
        probe = F.col("key").bitwiseXOR(F.col("mask"))
        # Of two keys the larger probes the smaller; equal keys are told apart by value.
        own = own.withColumn("probe", probe).filter((F.col("mask") == 0) | (F.col("probe") < F.col("key")))
        own = own.select("fp", "known", F.lit(i).alias("part"), F.col("probe").alias("key"), (F.col("mask") == 0).alias("same"))
        probes = own if probes is None else probes.unionAll(own)
    p, e = probes.alias("p"), entered.alias("e")
    meets = (
        (F.col("p.part") == F.col("e.part"))
        & (F.col("p.key") == F.col("e.key"))
        & (~F.col("same") | (F.col("fp") < F.col("o_fp")))
        & (F.col("known") != F.col("o_known"))
        & (_distance("fp", "o_fp") <= radius)
    )
    links = p.join(e, meets).select(F.col("known").alias("a"), F.col("o_known").alias("b"))
    last = components(links.unionAll(ties))
    joined = named.join(last.withColumnRenamed("node", "known"), "known", "left")
    return joined.select("fp", F.coalesce("root", "known").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = staged(fingerprints(docs, words), "simhash")
    by_print = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = linked(by_print.select("fp"), radius)
    named = by_print.join(roots, "fp")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(smallest, "root").select("fp", "component_id")
    return prints.join(by_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one row of each component; see ``common.keep_first``."""
    keyed = docs.select("doc_id", "text", row_key("text").alias("key"))
    prints = staged(fingerprints(keyed, words, "key"), "simhash")
    roots = linked(staged(prints.select("fp").distinct(), "simhash-distinct"), radius)
    return keep_first(docs, prints.join(roots, "fp").select("doc_id", "key", "root"))
