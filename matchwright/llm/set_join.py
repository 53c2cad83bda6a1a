"""Documents whose sets of word shingles are alike, joined by PartEnum signatures.

Two sets are alike if their Jaccard similarity is ``PART / WHOLE`` (0.8) or more; every such
pair meets, and every pair that meets is verified on the whole sets.

Signatures. Sizes fall into bands whose largest size is 1.25 times the smallest, so alike
sets are in the same or in neighbouring bands. Instance j of the method serves bands j - 1
and j: alike sets of sizes a and b differ in at most (a + b) / 9 shingles, so in k = 2 r / 9
at most, r being the largest size of band j. All shingles are dealt by hash into ``n1``
parts and each part into ``n2`` cells. With n1 (k2 + 1) > k some part has at most ``k2``
differing shingles, so some n2 - k2 of its cells are equal in both sets: the contents of
each part's choices of n2 - k2 cells are the signatures. More cells make signatures more
telling and more numerous; ``plan`` chooses by expected cost for each band.

Empty cells are equal in unrelated sets, too, which would meet by the square of their number.
So there may be ``spare`` parts more than the pigeonhole needs: then ``spare`` + 1 parts at
least have ``k2`` differing shingles or fewer, and a set with at most ``spare`` parts in which
a choice of cells is empty leaves its empty signatures out: one that holds shingles is left.
Where sets are so large that parities (below) do not keep unrelated ones apart, a pair that
meets costs as much as a row, so spare parts are worth it for few sets already.

Before that, sets without a partner are left out: at least 80 % of a set's shingles are in
any set alike to it, so a set of which more than a fifth occurs in no other set is alike to
none. It is enough to look at a part of all shingles, one of ``LOOK`` by hash.

Dense groups would verify all their pairs. So a first pass verifies every set against the
smallest set of each of its signatures; pairs that are thereby connected are left out of
the second pass, which takes the pairs of signatures that still hold more than one
component. The parities of shingles per hash cell give a lower bound of the number of
differing shingles. Pairs too far by size or by the parities of 512 cells are dropped inside
the joins, what is left by those of as many cells as the sets have shingles, and only then
whole sets meet. Sets that nearly are alike share many signatures, but need to meet once: the
smallest ``FIRST`` signatures of a set travel with it, and a pair is left out wherever both
hold a smaller one that is the same, under which they meet as well.

Rows. NULL, empty and blank texts have the empty set and are alike to nothing, not even to
each other. A text shorter than a shingle is one shingle. Copies share a set and count
once. A component is named by its smallest doc_id; NULL only where it has no other. Only
``doc_id`` and ``text`` are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb, erfc, exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import bitmap, may_hold
from .byte_words import chunks, extended, mixed, word_hashes
from .common import release, row_key, ship, staged, written
from .components import components

BLANKS = b" \t\n\x0b\x0c\r"
SEED = 42
PART, WHOLE = 4, 5
#: One of so many shingles is looked at to find sets without a partner.
LOOK = 3
LOG_BITS = 23
#: Cells of the parity sketch, as longs of 64.
SKETCH = 8
#: What a signature row costs, in compared pairs.
ROW_COST = 100
#: So many signatures of a set travel with it in the second pass.
FIRST = 8
CHOICES = ((1, 0), (3, 1), (4, 1), (5, 2), (6, 2), (7, 3), (8, 3))
SIGNED = "s0 long, s1 long, s2 long, s3 long, s4 long, s5 long, s6 long, s7 long"


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, as hashes in order."""
    for at, stop, text, row_starts in chunks(column):
        starts, _, hashes = word_hashes(BLANKS, SEED).words(text)
        keys = hashes
        for j in range(1, words):
            keys = extended(keys[: max(0, hashes.size - j)], hashes[j:])
        bounds = np.searchsorted(starts, np.concatenate((row_starts, [text.size])))
        for i in range(stop - at):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= words:
                yield np.unique(keys[a : b - words + 1])
            else:
                own = hashes[a : a + 1]
                for j in range(a + 1, b):
                    own = extended(own, hashes[j : j + 1])
                yield own[: b - a]


def _set_id(own: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum([x.size for x in arrays], dtype=np.int64))).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def measured(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, place (of the row), sid (of its set) and n."""
    ship(docs.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, sizes = [], []
            for own in shingle_sets(batch.column(2), words):
                sids.append(_set_id(own))
                sizes.append(own.size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "place", "sid", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", row_key("doc_id", "text").alias("place"), "text")
    return rows.mapInArrow(compute, f"doc_id {kind}, place long, sid long, n long")


def _flat(names: list[str], pieces: Iterator[tuple[np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
    """Batches of (hash, sid) from hashes and the sid they all have."""
    hashes, sids, held = [], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(sids))], names=names)

    for own, sid in pieces:
        hashes.append(own)
        sids.append(np.full(own.size, sid, np.int64))
        held += own.size
        if held >= 1 << 17:
            yield batch()
            hashes, sids, held = [], [], 0
    if hashes:
        yield batch()


def looked_at(docs: DataFrame, words: int) -> DataFrame:
    """(h, sid) of the shingles looked at. They are many, so they are not staged."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owns = (own for batch in batches for own in shingle_sets(batch.column(0), words))
        yield from _flat(["h", "sid"], ((own[own % np.uint64(LOOK) == 0], _set_id(own)) for own in owns))

    return docs.select("text").mapInArrow(compute, "h long, sid long")


def with_partners(rows: DataFrame, looked: DataFrame) -> DataFrame:
    """(sid, place) of the sets that may have one: ``measured`` rows without the others."""
    alone = looked.groupBy("h").agg(F.min("sid").alias("sid"), F.max("sid").alias("other")).filter("sid = other")
    alone = alone.groupBy("sid").agg(F.count(F.lit(1)).alias("alone"))
    sets = rows.filter("n > 0").groupBy("sid").agg(F.min("place").alias("place"), F.first("n").alias("n"))
    left = sets.join(alone, "sid", "left").filter((F.coalesce("alone", F.lit(0)) * WHOLE <= F.col("n") * (WHOLE - PART)))
    return left.select("sid", "place")


def parities(own: np.ndarray, cells: int) -> np.ndarray:
    """For each of ``cells`` (a power of two) if it holds an odd number of shingles, as bits
    of longs. Half as many cells have the exclusive or of both halves."""
    odd = np.bincount((own & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def whole_sets(docs: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """sid, n, shingles and parity sketch of the ``chosen`` (sid, place)."""
    places = docs.sparkSession.sparkContext.broadcast(bitmap(chosen, "place", LOG_BITS))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = places.value
        for batch in batches:
            key = as_keys(batch.column(0))
            batch = batch.filter(pa.array(may_hold(bits, key)))
            owns = list(shingle_sets(batch.column(1), words)) if batch.num_rows else []
            sketches, odds = np.zeros((len(owns), SKETCH), np.int64), []
            for i, own in enumerate(owns):
                odds.append(parities(own, max(64 * SKETCH, 1 << int(own.size).bit_length())))
                sketches[i] = np.bitwise_xor.reduce(odds[-1].reshape(-1, SKETCH), axis=0)
            columns = [pa.array(np.ascontiguousarray(sketches[:, j])) for j in range(SKETCH)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_set_id(x) for x in owns], pa.int64()), pa.array([x.size for x in owns], pa.int64()), _lists(owns), _lists(odds), *columns],
                names=["place", "sid", "n", "own", "odds", *[f"s{j}" for j in range(SKETCH)]],
            )

    rows = docs.select(row_key("doc_id", "text").alias("place"), "text")
    found = rows.mapInArrow(compute, f"place long, sid long, n long, own array<long>, odds array<long>, {SIGNED}")
    # One place for each set; rows that repeat wholly share it.
    return found.join(chosen, ["sid", "place"], "left_semi").dropDuplicates(["sid", "place"]).drop("place")


def _asked(sets: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """sid and shingles of the sets on one side of the pairs, and a few others."""
    bits = sets.sparkSession.sparkContext.broadcast(bitmap(pairs, side, LOG_BITS))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(bits.value, as_keys(batch.column(0)))))

    return sets.select("sid", "own").mapInArrow(pick, "sid long, own array<long>")


def as_keys(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


@lru_cache(maxsize=1)
def bands() -> np.ndarray:
    """The largest size of each band."""
    ends, low = [], 1
    while low < 1 << 40:
        ends.append(low * WHOLE // PART)
        low = ends[-1] + 1
    return np.array(ends, np.int64)


def most_differing(instance: int) -> int:
    """By how many shingles alike sets of the instance's bands can differ."""
    return int(bands()[instance]) * 2 * (WHOLE - PART) // (WHOLE + PART)


def plan(sets: int, instance: int) -> tuple[int, int, int]:
    """n1, n2 and k2 of least expected cost for so many sets, if sets are unrelated."""
    k, size = most_differing(instance), float(bands()[instance]) * PART / WHOLE
    best = None
    for n2, k2 in CHOICES:
        n1 = -(-(k + 1) // (k2 + 1))
        many = n1 * comb(n2, k2)
        held = size / n1 * (n2 - k2) / n2
        cost = sets * many * ROW_COST + sets * sets / 2 * many * exp(-2 * held)
        if best is None or cost < best[0]:
            best = cost, (n1, n2, k2)
    n1, n2, k2 = best[1]
    return n1 + spare(sets, int(bands()[instance - 1]) * PART / WHOLE, pair_cost(instance), n1, n2, k2), n2, k2


def pair_cost(instance: int) -> int:
    """What a pair of unrelated sets costs: ``ROW_COST`` if parities may not drop it in the join."""
    cells = 64 * SKETCH  # about half of them differ, with a deviation of half the root
    return ROW_COST if most_differing(instance) > cells / 2 - 3 * sqrt(cells) / 2 else 1


def spare(sets: int, size: float, pair: int, n1: int, n2: int, k2: int) -> int:
    """How many parts more are of least expected cost for unrelated sets of ``size``."""
    best, e = None, 0
    while e <= n1:
        parts, many = n1 + e, (n1 + e) * comb(n2, k2)
        empty = exp(-size / parts / n2)
        light = parts * sum(comb(n2, c) * empty**c * (1 - empty) ** (n2 - c) for c in range(n2 - k2, n2 + 1))
        keep = erfc((e + 0.5 - light) / sqrt(2 * light)) / 2 if light else 0.0
        cost = sets * many * ROW_COST + pair * (sets * keep) ** 2 / 2 * many * empty ** (2 * (n2 - k2))
        if best is None or cost < best[0]:
            best = cost, e
        e += 1 + e // 8
    return best[1]


def signatures(own: np.ndarray, instance: int, n1: int, n2: int, k2: int) -> np.ndarray:
    """The signatures of one set in one instance; without empty ones where they can be spared."""
    own = mixed(own + np.uint64(instance + 1))
    cell = (own % np.uint64(n1)) * np.uint64(n2) + (own >> np.uint64(40)) % np.uint64(n2)
    sums = np.zeros(n1 * n2, np.uint64)
    np.add.at(sums, cell.astype(np.int64), mixed(own))
    sums = sums.reshape(n1, n2)
    filled = np.bincount(cell.astype(np.int64), minlength=n1 * n2).reshape(n1, n2) > 0
    spared = n1 - 1 - most_differing(instance) // (k2 + 1)
    light = int((filled.sum(axis=1) <= k2).sum())
    out = np.empty((n1, comb(n2, k2)), np.uint64)
    holds = np.empty(out.shape, bool)
    parts = np.arange(n1, dtype=np.uint64)
    for i, chosen in enumerate(combinations(range(n2), n2 - k2)):
        h = parts * np.uint64(1000003) + np.uint64(instance * 4099 + i + 1)
        for c in chosen:
            h = extended(h, sums[:, c])
        out[:, i] = h
        holds[:, i] = filled[:, chosen].any(axis=1)
    return out[holds] if light <= spared else out.reshape(-1)


def signature_rows(sets: DataFrame) -> DataFrame:
    """(sig, sid) of all ``sets`` (sid, n, own)."""
    ends = bands()
    by_size = sets.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    banded = by_size.groupBy(F.expr(f"aggregate(array({', '.join(f'{e}L' for e in ends.tolist())}), 0, (i, e) -> i + cast(n > e AS int))").alias("band")).agg(F.sum("c").alias("c"))
    counts = {r["band"]: r["c"] for r in banded.collect()}
    plans = {}
    for band in counts:
        for j in (band, band + 1):
            if most_differing(j):
                plans[j] = plan(counts.get(j, 0) + counts.get(j - 1, 0), j)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
        for batch in batches:
            for sid, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = own.values.to_numpy().view(np.uint64)
                band = int(np.searchsorted(ends, own.size))
                for j in (band, band + 1):
                    if j in plans:
                        yield signatures(own, j, *plans[j]), sid

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _flat(["sig", "sid"], signed(batches))

    return sets.select("sid", "own").mapInArrow(compute, "sig long, sid long")


def _near() -> Column:
    """Neither size nor parity says that the sets of a row are too far."""
    a, b = F.col("n"), F.col("o_n")
    differ = sum((F.bit_count(F.col(f"s{j}").bitwiseXOR(F.col(f"o_s{j}"))) for j in range(SKETCH)), F.lit(0))
    return (F.least(a, b) * WHOLE >= F.greatest(a, b) * PART) & (differ * (WHOLE + PART) <= (a + b) * (WHOLE - PART))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are alike."""
    first = sets.select(F.col("sid").alias("a"), F.col("n").alias("a_n"), F.col("odds").alias("x"))
    second = sets.select(F.col("sid").alias("b"), F.col("n").alias("b_n"), F.col("odds").alias("y"))
    # Sizes differ by a quarter at most, so one side may have twice the cells of the other.
    half = "zip_with(slice({0}, 1, size({0}) div 2), slice({0}, size({0}) div 2 + 1, size({0}) div 2), (p, q) -> p ^ q)"
    even = [f"CASE WHEN size({c}) > size({o}) THEN {half.format(c)} ELSE {c} END" for c, o in ("xy", "yx")]
    differ = F.expr(f"aggregate(zip_with({even[0]}, {even[1]}, (p, q) -> bit_count(p ^ q)), 0, (t, d) -> t + d)")
    bound = differ * (WHOLE + PART) <= (F.col("a_n") + F.col("b_n")) * (WHOLE - PART)
    pairs = staged(pairs.join(first, "a").join(second, "b").filter(bound).select("a", "b"), "set-close")
    release(sets.sparkSession)
    left = _asked(sets, pairs, "a").select(F.col("sid").alias("a"), F.col("own").alias("x"))
    right = _asked(sets, pairs, "b").select(F.col("sid").alias("b"), F.col("own").alias("y"))
    both = F.size(F.array_intersect("x", "y")) * (PART + WHOLE) >= (F.size("x") + F.size("y")) * PART
    found = staged(pairs.join(left, "a").join(right, "b").filter(both).select("a", "b"), "set-alike")
    release(sets.sparkSession)
    return found


def with_first(rows: DataFrame) -> DataFrame:
    """``rows`` (sig, sid, ...) with the smallest ``FIRST`` signatures of their sets."""
    first = rows.groupBy("sid").agg(F.slice(F.sort_array(F.collect_list("sig")), 1, FIRST).alias("first"))
    return rows.join(first, "sid")


def meeting(left: DataFrame) -> DataFrame:
    """The pairs (a, b) of near sets that share a signature and are not known to be connected.

    ``left`` has (sig, sid, first, known, n and the sketch), one row for each signature of a set.
    """
    right = left.select("sig", *[F.col(c).alias(f"o_{c}") for c in left.columns if c != "sig"])
    p, o = left.alias("p"), right.alias("o")
    meets = (F.col("p.sig") == F.col("o.sig")) & (F.col("sid") < F.col("o_sid")) & (F.col("known") != F.col("o_known")) & _near()
    # Of the shared signatures, the smallest is first for both sets if any shared one is.
    before = F.coalesce(F.array_min(F.array_intersect("first", "o_first")) < F.col("p.sig"), F.lit(False))
    return p.join(o, meets & ~before).select(F.col("sid").alias("a"), F.col("o_sid").alias("b"))


def linked(sets: DataFrame) -> DataFrame:
    """(sid, root) of the sets that are alike to another one, directly or through others."""
    spark = sets.sparkSession
    names = ["sid", "n", *[f"s{j}" for j in range(SKETCH)]]
    small = sets.select(*names)
    other = small.select(*[F.col(c).alias(f"o_{c}") for c in names])
    rows, place = written(signature_rows(sets), "set-signatures")
    shared = rows.groupBy("sig").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).filter("low < high").select("sig", "low")
    shared = staged(shared, "set-leaders")
    release(spark)
    held = staged(rows.join(shared, "sig").distinct(), "set-shared")
    release(spark, place)
    first = held.filter("sid != low").select("sid", "low").distinct()
    first = first.join(small, "sid").join(other, F.col("low") == F.col("o_sid")).filter(_near())
    led = _verified(staged(first.select(F.col("sid").alias("a"), F.col("low").alias("b")), "set-first"), sets)
    known = components(led).select(F.col("node").alias("sid"), F.col("root").alias("known"))
    known = staged(small.join(known, "sid", "left").withColumn("known", F.coalesce("known", "sid")), "set-known")
    # The smallest set of a signature has been compared with all its others.
    rest = held.filter("sid != low").select("sig", "sid")
    named = rest.join(known.select("sid", "known"), "sid")
    open_ = named.groupBy("sig").agg(F.min("known").alias("low"), F.max("known").alias("high")).filter("low < high").select("sig")
    asked = staged(staged(open_, "set-open").join(rest, "sig"), "set-asked")
    left = staged(with_first(asked).join(known, "sid"), "set-left")
    release(spark)
    second = staged(meeting(left).distinct(), "set-second")
    links = _verified(second, sets)
    roots = known.select("sid", "known")
    ends = [roots.select(F.col("sid").alias(c), F.col("known").alias(f"{c}_known")) for c in "ab"]
    links = links.join(ends[0], "a").join(ends[1], "b").select(F.col("a_known").alias("a"), F.col("b_known").alias("b"))
    last = components(links).select(F.col("node").alias("known"), F.col("root").alias("last"))
    return roots.join(last, "known", "left").select("sid", F.coalesce("last", "known").alias("root"))


def alike(docs: DataFrame, words: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    rows = staged(measured(docs, words), "set-rows")
    chosen = staged(with_partners(rows, looked_at(docs, words)), "set-chosen")
    release(docs.sparkSession)
    sets = staged(whole_sets(docs, chosen, words), "set-whole")
    release(docs.sparkSession)
    named = rows.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    named = staged(named.join(linked(sets), "sid", "left").withColumn("root", F.coalesce("root", "sid")), "set-named")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_set = named.join(smallest, "root").select("sid", "component_id")
    joined = rows.select("doc_id", "sid", "n").join(by_set, "sid", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
