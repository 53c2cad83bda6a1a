"""Phrases that occur often and hold together, by Toivonen's sampling method.

A phrase is a run of words inside a piece of text. A phrase is frequent only if the phrases
without its first and without its last word are, so frequent phrases of a sample, at a
lowered limit and level by level, propose the set S. Its negative border are the phrases
outside S whose two shorter parts are in S. One pass over all texts counts S, the border
and all single words exactly. A border phrase that turns out frequent is a failure of the
sample: the phrases that its discovery opens are counted by a further pass, until a pass
finds nothing new. The result is exact whatever the sample was; the sample decides the
number of passes, five at most.

Tasks ask whether a shorter part belongs to S by a bitmap of fixed size. It may say yes
wrongly, the same for every occurrence of a phrase, and then a phrase is counted in vain.
Counts are keyed by 64-bit hashes of language and words; of F frequent phrases and N
different ones, F N / 2 ** 64 share a hash with another by chance (0.00001 in 135 million
words). The words of frequent phrases are read in a last pass from one of ``THIN``
occurrences, and from all for those not met so. Should one hash show two phrases there, all
is done again with other hashes.

Rows. A NULL language is ``und``; a NULL text is empty. Repeated rows and ids count as they
come. ASCII letters are compared in lower case. Only ``doc_id``, ``lang`` and ``text`` are
read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bitmap import bitmap, may_hold
from .byte_words import chunks, extended, mixed, word_hashes
from .common import release, ship, staged

BREAKS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"
LONGEST = 5
#: Bits of the map of known phrases: 2 MB.
LOG_BITS = 24
_TOGETHER = 1 << 21
_SEEN = 1 << 20
#: One of so many occurrences of a phrase is asked for its words at first, a power of two.
THIN = 32
_IS_BREAK = np.zeros(256, np.int32)
_IS_BREAK[list(BREAKS)] = 1


def _word_keys(batch: pa.RecordBatch, seed: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Text, starts and ends of its words, keys of word and language, pieces, rows."""
    import xxhash

    hashes = word_hashes(BREAKS + BLANKS, seed)
    langs = pc.fill_null(batch.column(0), "und").dictionary_encode()
    values = np.array([xxhash.xxh64_intdigest(x, seed) for x in langs.dictionary.to_pylist()], np.uint64)
    codes = langs.indices.to_numpy(zero_copy_only=False)
    for at, _, text, row_starts in chunks(batch.column(1)):
        starts, ends, words = hashes.words(text)
        piece = np.cumsum(_IS_BREAK[text], dtype=np.int32)[starts]
        row = np.searchsorted(row_starts, starts, "right") - 1 + at
        yield text, starts, ends, mixed(words + values[codes[row]]), piece, row


def _levels(words: np.ndarray, piece: np.ndarray, known: np.ndarray, upto: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For 2 to ``upto`` words: where phrases start whose shorter parts are known, and their keys."""
    inside = may_hold(known, words)
    keys = words
    for k in range(2, upto + 1):
        pair = inside[:-1] & inside[1:]
        if k == 2:
            pair &= piece[:-1] == piece[1:]
        at = np.flatnonzero(pair)
        own = extended(keys[at], words[at + k - 1])
        yield at, own
        inside = np.zeros(words.size, bool)
        inside[at[may_hold(known, own)]] = True
        keys = np.zeros(words.size, np.uint64)
        keys[at] = own


def _counts(texts: DataFrame, orders: Sequence[int], known: np.ndarray | None, counted: list[np.ndarray], least: int, seed: int) -> DataFrame:
    """``h`` and ``f``, ``least`` or more: how often each phrase of so many words occurs, if
    its shorter parts are known and an earlier pass, with the maps ``counted``, did not count it."""
    context = texts.sparkSession.sparkContext
    maps = context.broadcast((known, counted))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counted = maps.value
        waiting: list[np.ndarray] = []
        size = 0

        def combined() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["h", "f"])

        for batch in batches:
            for _, _, _, words, piece, _ in _word_keys(batch, seed):
                if 1 in orders:
                    waiting.append(words)
                    size += words.size
                if max(orders) > 1 and words.size:
                    before = [_levels(words, piece, b, max(orders)) for b in counted]
                    for k, (at, own) in enumerate(_levels(words, piece, known, max(orders)), 2):
                        fresh = np.ones(words.size, bool)
                        for b in before:
                            fresh[next(b)[0]] = False
                        if k in orders:
                            waiting.append(own[fresh[at]])
                            size += waiting[-1].size
                if size >= _TOGETHER:
                    yield combined()
                    waiting, size = [], 0
        if size:
            yield combined()

    counts = texts.mapInArrow(count, "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))
    found = staged(counts.filter(F.col("f") >= least), "phrase-counts")
    maps.destroy()
    return found


def _named(texts: DataFrame, known: np.ndarray, wanted: np.ndarray, thin: int, seed: int) -> DataFrame:
    """``h``, lang and words of the phrases in the map ``wanted``, from one of ``thin``
    occurrences; and, with a NULL phrase, the number of words of a language in ``h``."""
    context = texts.sparkSession.sparkContext
    maps = context.broadcast((known, wanted))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (known, wanted), seen = maps.value, np.zeros(_SEEN, np.uint64)
        kind = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("phrase", pa.string())])
        for batch in batches:
            langs = pc.fill_null(batch.column(0), "und").to_pylist()
            totals: dict[str, int] = {}
            for text, starts, ends, words, piece, row in _word_keys(batch, seed):
                for r, n in zip(*np.unique(row, return_counts=True), strict=True):
                    totals[langs[r]] = totals.get(langs[r], 0) + int(n)
                if not words.size:
                    continue
                # Other hashes of the same words: a key of two phrases is thereby seen.
                other = word_hashes(BREAKS + BLANKS, seed + 1).words(text)[2]
                found: tuple[list, list, list] = ([], [], [])
                every = np.arange(words.size)
                for k, (at, own) in enumerate([(every, words), *_levels(words, piece, known, LONGEST)], 1):
                    held = np.flatnonzero((mixed(own + at.astype(np.uint64)) & np.uint64(thin - 1)) == 0)
                    held = held[may_hold(wanted, own[held])]
                    at, own = at[held], own[held]
                    check = other[at]
                    for j in range(1, k):
                        check = extended(check, other[at + j])
                    keys, first, back = np.unique(own, return_index=True, return_inverse=True)
                    odd = np.flatnonzero(check[first][back] != check)
                    slot = (keys & np.uint64(_SEEN - 1)).astype(np.int64)
                    new = seen[slot] != keys
                    seen[slot[new]] = keys[new]
                    for i in np.concatenate((first[new], odd)).tolist():
                        w = at[i]
                        parts = [text[a:b].tobytes().lower() for a, b in zip(starts[w : w + k], ends[w : w + k], strict=True)]
                        found[0].append(own[i])
                        found[1].append(langs[row[w]])
                        found[2].append(b" ".join(parts).decode())
                if found[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(found[0], np.uint64).view(np.int64)), pa.array(found[1]), pa.array(found[2])], schema=kind)
            if totals:
                yield pa.RecordBatch.from_arrays([pa.array(list(totals.values()), pa.int64()), pa.array(list(totals)), pa.nulls(len(totals), pa.string())], schema=kind)

    named = staged(texts.mapInArrow(name, "h long, lang string, phrase string"), "phrase-names")
    maps.destroy()
    return named


def sampled(texts: DataFrame, part: int, seed: int) -> DataFrame:
    """One of ``part`` texts, chosen by a hash of id and text."""
    return texts.filter(F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(part)) == 0)


def frequent_phrases(docs: DataFrame, least: int = 100, part: int = 8, low: int | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to 5 words that occur ``least`` times or more in their language:
    (lang, phrase, size, f); and the number of words (lang, n).

    The sample is one of ``part`` texts and its limit ``low``, or half of what ``least``
    gives on average there.
    """
    ship(docs.sparkSession)
    low = max(2, least // (2 * part)) if low is None else low
    texts = docs.select("doc_id", "lang", "text")
    while True:
        sample = staged(sampled(texts, part, seed).select("lang", "text"), "phrase-sample")
        proposed, known = None, None
        for k in range(1, LONGEST + 1):
            level = _counts(sample, [k], known, [], low, seed).select("h")
            bits = bitmap(level, "h", LOG_BITS)
            if not bits.any():
                break
            proposed = level if proposed is None else proposed.unionAll(level)
            known = bits if known is None else known | bits
        whole = texts.select("lang", "text")
        if known is None:
            known = np.zeros(1 << (LOG_BITS - 3), np.uint8)
        found = _counts(whole, range(1, LONGEST + 1), known, [], least, seed)
        failed = found.select("h") if proposed is None else found.select("h").join(proposed, "h", "left_anti")
        counted = [known]
        while not failed.isEmpty():
            now = bitmap(found, "h", LOG_BITS)
            more = _counts(whole, range(2, LONGEST + 1), now, counted, least, seed)
            counted.append(now)
            found, failed = found.unionAll(more), more
            release(docs.sparkSession)
        known = bitmap(found, "h", LOG_BITS)
        names = _named(whole, known, known, THIN, seed)
        totals = names.filter("phrase IS NULL").groupBy("lang").agg(F.sum("h").alias("n"))
        names = names.filter("phrase IS NOT NULL")
        rest = staged(found.select("h").join(names.select("h").distinct(), "h", "left_anti"), "phrase-rest")
        if not rest.isEmpty():
            names = names.unionAll(_named(whole, known, bitmap(rest, "h", LOG_BITS), 1, seed).filter("phrase IS NOT NULL"))
        spelled = names.groupBy("h").agg(F.min(F.struct("lang", "phrase")).alias("s"), F.max(F.struct("lang", "phrase")).alias("t"))
        spelled = staged(spelled.join(found, "h").select("h", "s", "t", "f"), "phrase-spelled")
        if spelled.filter("s != t").isEmpty():
            size = F.size(F.split("s.phrase", " "))
            return spelled.select("s.lang", "s.phrase", size.alias("size"), "f"), totals
        seed += 2


def collocations(docs: DataFrame, least: int = 100, most: int = 2000, **sampling) -> DataFrame:
    """The first ``most`` phrases of each language by how well they hold together.

    A phrase of 2 to 5 words with a = f >= ``least``, cut after k words into parts of
    frequency l and r, scores floor(1000 a n / (l r)); its lowest cut counts, of equal ones
    the first. A phrase inside a longer one that is as frequent is dropped.
    """
    every, totals = frequent_phrases(docs, least, **sampling)
    long = every.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cut = long.withColumn("k", F.explode(F.expr("sequence(1, size - 1)")))
    cut = cut.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("first"), F.expr("array_join(slice(words, k + 1, size - k), ' ')").alias("rest"))
    left = every.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = every.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    parts = cut.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in "alrn"}
    parts = parts.withColumns({f"{c}_": v for c, v in wide.items()})
    # Whole numbers of up to 38 digits; div drops the rest.
    parts = parts.withColumn("score", F.expr("cast(1000 AS decimal(4,0)) * a_ * cast(n_ AS decimal(15,0)) div (l_ * r_)"))
    lowest = parts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.*")
    spans = "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(words, i, m), ' '))))"
    within = long.filter("size > 2").select("lang", F.col("a").alias("longer"), F.explode(F.expr(spans)).alias("phrase"))
    within = within.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left_over = lowest.join(within, ["lang", "phrase"], "left").filter("longer IS NULL OR 100 * longer < 100 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left_over.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
starts AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM worded),
runs AS (SELECT lang, words, i, unnest(range(1, least(5, len(words) - i + 1) + 1)) AS size FROM starts),
f AS (
  SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase, count(*) AS f FROM runs GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS words, f AS a FROM f WHERE size > 1 AND f >= 100),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, l.f AS l, r.f AS r, n.n,
    ((1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN n USING (lang)
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.words[1:c.k], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.words[c.k + 1:], ' ')),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT q.lang, array_to_string(q.words[i:i + m - 1], ' ') AS phrase, max(q.a) AS a
  FROM (SELECT *, unnest(range(2, size)) AS m FROM candidates) q, unnest(range(1, q.size - q.m + 2)) AS u(i) GROUP BY ALL)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank,
  s.phrase, s.a, s.l, s.r, s.n, s.score
FROM lowest s LEFT JOIN longer q ON q.lang = s.lang AND q.phrase = s.phrase
WHERE q.a IS NULL OR 100 * q.a < 100 * s.a
QUALIFY rank <= 2000
"""
