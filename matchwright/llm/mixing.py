"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks.

The words of a source, its documents in a fixed order, are cut into blocks of equal
size. The order is by a digest of doc_id and text, then doc_id (NULL last) and size. The seats of the mix, one block each, go to the sources by the highest quotients
``target / (2 k + 1)``. The sequence of seats is the same whatever their number, so the
first ``n_s`` seats belong to the shards up to ``s``, and a source's quota in a shard is
the difference of two apportionments. A seeded permutation of a source's blocks then
fills its seats: whole passes first, each block once per pass, and a part of the blocks
in the last pass. Which seats a block holds follows from arithmetic on its number; no
list of blocks or seats is ever sorted.

The apportionment needs no loop over seats. With divisors ``T / (n + S/2)`` and
``T / (n - S/2)`` (S sources) rounding gives at least and at most ``n`` seats, so only
some 4 S quotients in between have to be ranked for each shard.

Rows. NULL and empty texts have size 0 and are returned with ``taken`` 0. A NULL source
is a source of its own, the last. A row is known by doc_id, source and text, not by doc_id
alone; rows equal in all three are numbered and dealt their words by number. Only
``doc_id``, ``text`` and ``source`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, row_key, staged, word_count

#: Multipliers of the block permutation, all prime; the first that does not divide the
#: number of blocks is taken. Below 2**20, so products stay in 64 bits up to 8e12 blocks.
PRIMES = (1048573, 1048571, 1048559)
PASSES = 3
#: A source has so many blocks at least, unless they have ``SMALL`` words or fewer.
FINE, SMALL = 64, 4


def _spot(doc_id: str, text: str) -> Column:
    """A number of 32 bits from id and text, by which rows are ordered and put in buckets."""
    known = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(known.cast("binary")), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """One row per source: its place by code point, size and target.

    Targets share the sum of all sizes by weight and stop at three times the source's
    size; what is above is shared again until none is above. In closed form: sources are
    ordered by cap per weight, and the level is the first ``rest / weights left`` that
    does not exceed the cap per weight of its own source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    chosen = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("place", place).withColumn("weight", chosen)
    ranked = ranked.withColumn("cap", F.col("source_size").cast("double") * PASSES)
    ranked = ranked.withColumn("bound", F.col("cap") / F.col("weight"))
    order = Window.orderBy("bound", "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level).withColumn("step", F.row_number().over(order))
    final = F.min_by("level", F.when(F.col("level") <= F.col("bound"), F.col("step"))).over(whole)
    return (
        leveled.withColumn("final", final)
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("sources", F.count(F.lit(1)).over(whole))
        .withColumn("target", F.coalesce(F.least(F.col("cap"), F.col("final") * F.col("weight")), F.col("cap")))
        .select("source", "place", "source_size", "target", "total", "sources")
    )


def shard_quotas(targets: DataFrame, block_words: int = 1024, shards: int = 16) -> DataFrame:
    """``targets`` with the block size and the seats up to each shard (``seats``).

    ``seats[s]`` is the number of blocks the source has in shards 0 to s, so its quota
    in shard s is ``seats[s] - seats[s - 1]``. A block has ``block_words`` words, or
    fewer where the sources would have less than 1,024 blocks on average.

    A source of fewer than ``FINE`` blocks would be far from its target by whole blocks,
    so it has blocks of its own, a ``FINE``-th of its size, and as many of them as its
    target says. Blocks of up to ``SMALL`` words are fine enough for any source.
    """
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("total") / (F.col("sources") * 1024))))
    sized = targets.withColumn("block", block.cast("long"))
    coarse = (F.col("block") > SMALL) & (F.col("source_size") < FINE * F.col("block")) & (F.col("source_size") > 0)
    all_seats = F.floor(F.col("total") / F.col("block"))
    one = sized.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    one = one.withColumn("n", F.floor(all_seats * (F.col("shard") + 1) / F.lit(shards)).cast("long"))
    share, half = F.col("target") / F.col("total"), F.col("sources") / 2
    least = F.greatest(F.lit(0), F.floor(share * F.greatest(F.lit(0.0), F.col("n") - half) + 0.5) - 1)
    most = F.floor(share * (F.col("n") + half) + 0.5) + 1
    one = one.withColumn("least", F.when(F.col("target") > 0, least).otherwise(0).cast("long"))
    one = one.withColumn("most", F.when(F.col("target") > 0, most).otherwise(0).cast("long"))
    by_shard = Window.partitionBy("shard")
    one = one.withColumn("open", F.col("n") - F.sum("least").over(by_shard))
    seats = one.filter(F.col("most") > F.col("least")).withColumn("k", F.explode(F.sequence(F.col("least"), F.col("most") - 1)))
    seats = seats.withColumn("quotient", F.col("target") / (2 * F.col("k") + 1))
    rank = F.row_number().over(by_shard.orderBy(F.desc("quotient"), "place", "k"))
    won = seats.withColumn("rank", rank).filter(F.col("rank") <= F.col("open")).groupBy("shard", "place").agg(F.count(F.lit(1)).alias("won"))
    own_block = F.when(coarse, F.greatest(F.lit(1), F.floor(F.col("source_size") / FINE))).otherwise(F.col("block")).cast("long")
    blocks = F.ceil(F.col("source_size") / own_block).cast("long")
    own_seats = F.floor(F.col("target") / F.col("source_size") * blocks * (F.col("shard") + 1) / F.lit(shards) + 0.5).cast("long")
    seats_held = F.when(coarse, own_seats).otherwise(F.col("least") + F.coalesce(F.col("won"), F.lit(0)))
    per_shard = one.join(won, ["shard", "place"], "left").withColumn("held", F.least(seats_held, PASSES * blocks))
    held = per_shard.groupBy("place").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", "held"))), lambda x: x["held"]).alias("seats"))
    return sized.join(held, "place").withColumn("blocks", blocks).withColumn("block", own_block)


def mix(docs: DataFrame, block_words: int = 1024, shards: int = 16, seed: int = 1) -> DataFrame:
    """One row per document: its size, its source's size and target, and what is taken.

    ``spans`` lists what the mix takes of the document: shard, pass (0 to 2), first word
    and number of words; ``taken`` is their sum. ``source``, ``key`` (of the text) and
    ``copy`` (from 0, of rows equal in all) say which row it is. As many digest buckets as
    the square root of the rows keep both the buckets and the list of bucket sums small,
    also for a source with a third of all rows. Equal rows are counted before they move and
    placed side by side, so they are one row of their bucket.
    """
    rows = docs.select("doc_id", "source", row_key("text").alias("key"), _spot("doc_id", "text").alias("spot"), word_count(F.col("text")).alias("size"))
    rows = staged(rows.groupBy("doc_id", "source", "key", "spot", "size").agg(F.count(F.lit(1)).alias("copies")), "mix-sizes")
    buckets = max(1, math.isqrt(rows.agg(F.sum("copies")).first()[0] or 0))
    rows = rows.withColumn("bucket", F.col("spot") % buckets).withColumn("words", F.col("size") * F.col("copies"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("words").alias("bucket_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("s_source"),
        F.col("bucket").alias("s_bucket"),
        F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_start"),
    )
    order = F.col("doc_id").asc_nulls_last(), "size", "key"
    inside = Window.partitionBy("source", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        rows.withColumn("upto", F.sum("words").over(inside))
        .join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("bucket") == F.col("s_bucket")))
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("start", F.col("bucket_start") + F.col("upto") - F.col("words") + F.col("copy") * F.col("size"))
        .drop("s_source", "s_bucket")
    )
    sizes = rows.select("source", F.col("words").alias("size"))
    quotas = shard_quotas(source_targets(sizes), block_words, shards).withColumnRenamed("source", "q_source")
    quotas = staged(quotas, "mix-quotas")
    joined = placed.join(quotas, F.col("source").eqNullSafe(F.col("q_source")))
    a, b, c = PRIMES
    joined = joined.withColumn("step", F.when(F.col("blocks") % a != 0, a).when(F.col("blocks") % b != 0, b).otherwise(c).cast("long"))
    joined = joined.withColumn("quota", F.element_at("seats", -1))
    spans = F.expr(f"""
        filter(flatten(transform(
            sequence(start div block, (start + size - 1) div block),
            j -> transform(sequence(0, {PASSES - 1}), p -> named_struct(
                'seat', p * blocks + (j * step + {seed}) % blocks,
                'pass', p,
                'first', greatest(j * block, start) - start,
                'words', least((j + 1) * block, start + size) - greatest(j * block, start))))),
            x -> x.seat < quota)""")
    with_shard = F.expr("""
        transform(spans, x -> named_struct(
            'shard', size(filter(seats, s -> s <= x.seat)), 'pass', x.pass, 'first', x.first, 'words', x.words))""")
    none = F.expr("filter(array(named_struct('seat', 0L, 'pass', 0, 'first', 0L, 'words', 0L)), x -> false)")
    return (
        joined.withColumn("spans", F.when(F.col("size") > 0, spans).otherwise(none))
        .withColumn("spans", with_shard)
        .withColumn("taken", F.expr("aggregate(spans, 0L, (t, x) -> t + x.words)"))
        .select("doc_id", "size", "source_size", "target", "taken", "spans", "source", "key", "copy")
    )


def _numbered(rows: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` with ``copy``, their number (from 0) among those equal in ``group``.

    Rows are numbered inside the parts they were written from, and parts know how many
    rows came before them, so a large group is not one task's.
    """
    rows = staged(rows.withColumn("part", F.spark_partition_id()), "mix-rows")
    counts = rows.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("earlier", F.coalesce(F.sum("c").over(before), F.lit(0)))
    counts = counts.select(*[F.col(c).alias(f"o_{c}") for c in (*group, "part")], "earlier")
    same = F.col("part") == F.col("o_part")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"o_{c}"))
    inside = Window.partitionBy(*group, "part").orderBy(F.lit(1))
    numbered = rows.withColumn("number", F.row_number().over(inside) - 1).join(counts, same)
    return numbered.withColumn("copy", F.col("number") + F.col("earlier"))


def taken_texts(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """``docs`` with the text that the mix takes of each; documents without any go.

    A pass that takes all words gives the text as it is; of other passes the taken
    stretches are cut from the first word's start to the last word's end. The parts are
    joined by a line end, in the order of passes. ``n_chars`` is set anew. ``mixed`` is the
    ``mix`` of ``docs``: rows are met by doc_id, source and text, equal rows by number.
    """
    columns, schema = docs.columns, docs.schema
    spans = mixed.select(F.col("doc_id").alias("m_doc"), F.col("source").alias("m_source"), F.col("key").alias("m_key"), F.col("copy").alias("m_copy"), "size", "taken", "spans")
    spans = staged(spans, "mix-spans")
    names = {c: f"c{i}" for i, c in enumerate(columns)}
    doc, source, text = (names[c] for c in ("doc_id", "source", "text"))
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).withColumn("key", row_key(text))
    met = F.col(doc).eqNullSafe(F.col("m_doc")) & F.col(source).eqNullSafe(F.col("m_source")) & (F.col("key") == F.col("m_key"))
    if not spans.filter("m_copy > 0").isEmpty():
        rows = _numbered(rows, [doc, source, "key"])
        met &= F.col("copy") == F.col("m_copy")
    joined = rows.join(spans.filter("taken > 0"), met).select(*[F.col(n).alias(n) for n in names.values()], "size", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index("text")
        for batch in batches:
            texts = []
            for text, size, spans in zip(*[batch.column(c).to_pylist() for c in (at, len(columns), len(columns) + 1)], strict=True):
                parts: list[str] = []
                places = None
                for p in range(PASSES):
                    own = sorted((x["first"], x["first"] + x["words"]) for x in spans if x["pass"] == p)
                    if sum(b - a for a, b in own) == size:
                        parts.append(text)
                        continue
                    runs: list[list[int]] = []
                    for a, b in own:
                        if runs and runs[-1][1] == a:
                            runs[-1][1] = b
                        else:
                            runs.append([a, b])
                    if runs and places is None:
                        places = [m.span() for m in re.finditer(WORD, text)]
                    parts += [text[places[a][0] : places[b - 1][1]] for a, b in runs]
                texts.append("\n".join(parts))
            arrays = batch.columns[: len(columns)]
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    out = joined.mapInArrow(cut, schema)
    if "n_chars" in columns:
        out = out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return out


QUERY_COLUMNS = ("doc_id", "size", "source_size", "target", "taken")

ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS digest FROM documents),
n AS (SELECT greatest(1, floor(sqrt(count(*)))::BIGINT) AS buckets FROM sizes),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1)::BIGINT AS place FROM by_source),
weighed AS (
  SELECT *, (place % 3 + 1)::DOUBLE AS weight, source_size::DOUBLE * 3 AS cap, source_size::DOUBLE * 3 / (place % 3 + 1) AS bound FROM ranked),
leveled AS (
  SELECT *, (sum(source_size) OVER ()
    - coalesce(sum(cap) OVER (ORDER BY bound, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))::DOUBLE
    / sum(weight) OVER (ORDER BY bound, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY bound, place) AS step,
    (sum(source_size) OVER ())::BIGINT AS total, count(*) OVER () AS sources FROM weighed),
final AS (SELECT arg_min(level, step) AS final FROM leveled WHERE level <= bound),
targets AS (
  SELECT source, place, source_size, coalesce(least(cap, final * weight), cap) AS target, total, sources,
    greatest(1, least(1024, floor(total / (sources * 1024))))::BIGINT AS block FROM leveled, final),
one AS (
  SELECT *, floor(floor(total / block) * 1.0::DOUBLE)::BIGINT AS n, target / total AS share FROM targets),
bounds AS (
  SELECT *, CASE WHEN target > 0 THEN greatest(0, floor(share * greatest(0, n - sources / 2) + 0.5) - 1)::BIGINT ELSE 0 END AS lo,
    CASE WHEN target > 0 THEN (floor(share * (n + sources / 2) + 0.5) + 1)::BIGINT ELSE 0 END AS hi FROM one),
seats AS (
  SELECT place, target / (2 * k + 1) AS quotient, k, open FROM (
    SELECT place, target, n - sum(lo) OVER () AS open, unnest(range(lo, hi)) AS k FROM bounds)),
won AS (
  SELECT place, count(*) AS won FROM (
    SELECT place, open, row_number() OVER (ORDER BY quotient DESC, place, k) AS rank FROM seats) WHERE rank <= open GROUP BY place),
shared AS (
  SELECT *, block > 4 AND source_size < 64 * block AND source_size > 0 AS coarse FROM bounds),
cut AS (
  SELECT * REPLACE (CASE WHEN coarse THEN greatest(1, source_size // 64) ELSE block END AS block) FROM shared),
quotas AS (
  SELECT b.source, b.source_size, b.target, b.block, ceil(b.source_size / b.block)::BIGINT AS blocks,
    least(CASE WHEN coarse THEN floor(b.target / b.source_size * ceil(b.source_size / b.block) + 0.5) ELSE lo + coalesce(won, 0) END,
      3 * ceil(b.source_size / b.block))::BIGINT AS quota
  FROM cut b LEFT JOIN won USING (place)),
placed AS (
  SELECT s.doc_id, s.source, s.size,
    (sum(s.size) OVER (PARTITION BY s.source ORDER BY ('0x' || substr(s.digest, 1, 8))::BIGINT % n.buckets, s.doc_id NULLS LAST, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - s.size)::BIGINT AS start FROM sizes s, n),
joined AS (
  SELECT p.*, q.source_size, q.target, q.block, q.blocks, q.quota,
    CASE WHEN blocks % 1048573 != 0 THEN 1048573 WHEN blocks % 1048571 != 0 THEN 1048571 ELSE 1048559 END AS step
  FROM placed p JOIN quotas q ON p.source IS NOT DISTINCT FROM q.source),
spans AS (
  SELECT *, unnest(range(start // block, (start + size - 1) // block + 1)) AS j FROM joined WHERE size > 0),
copies AS (
  SELECT doc_id, source, size, start, sum((least((j + 1) * block, start + size) - greatest(j * block, start))
    * len(list_filter([0, 1, 2], lambda p: p * blocks + (j * step + 1) % blocks < quota)))::BIGINT AS taken
  FROM spans GROUP BY doc_id, source, size, start)
SELECT j.doc_id, j.size, j.source_size, j.target, coalesce(c.taken, 0)::BIGINT AS taken
FROM joined j LEFT JOIN copies c ON j.doc_id IS NOT DISTINCT FROM c.doc_id AND j.source IS NOT DISTINCT FROM c.source AND j.start = c.start AND j.size = c.size AND j.size > 0
"""
