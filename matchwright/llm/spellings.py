"""Spelling variants: words one edit apart, found by pivotal grams.

Bigrams of a word are ordered by how many words hold them, rarest first. A word's prefix
are its three first bigrams, and all that equal the last of them. Its pivots are two
disjoint bigrams of the prefix, chosen by dynamic programming so that together they are in
the fewest words. One edit destroys at most one of two disjoint bigrams, so of two near
words, the one whose prefix ends first in the order has a pivot that stands in the other's
prefix: every near pair meets in the index of pivots against prefixes.

Position limits. Where the one edit is, relative to a word's pivots p < q, says what stays:
the word from p on (edit before p), up to q (edit after q), from q on and before p (edit in
p), or up to p and after q (edit in q or between them). So a pivot meets only prefix
bigrams at the same place from the front with the same letters up to it, or at the same
place from the back with the same letters after it; in the last two cases words have to
agree in their first or last two letters or in two letters beside the bigram, too, where
these are known to stay. Lengths differ by one at most. What meets is verified by edit distance.

A word's form is its near word of largest count (ties: the smallest word), if that count
is ``ratio`` times its own or more. Counts grow along a chain of forms, so chains end; roots
are found by doubling.

Rows. NULL and empty texts have no words. A NULL doc_id stands as an empty text before the
colon. Repeated rows count as they come. Only ``doc_id`` and ``text`` are read, so other
columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, staged

#: Letters of a word. At most 26 + 64 of them are left in lower case, so 8,100 bigrams.
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def noisy_words(docs: DataFrame, shortest: int = 7, every: int = 31) -> DataFrame:
    """The words of all texts, one row each, of ``shortest`` letters or more.

    A run of letters loses the one at place crc32 modulo its length if ``every`` divides
    the crc32 of its id and itself, so that the table holds misspellings.
    """
    # Shorter runs cannot give a word that is long enough, so the pattern leaves them out.
    runs = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    rows = rows.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    digest = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    rows = rows.select("run", digest.alias("h"))
    cut = F.expr("concat(substring(run, 1, cast(h % length(run) AS int)), substring(run, cast(h % length(run) AS int) + 2))")
    return rows.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= shortest)


def gram_counts(words: DataFrame) -> dict[str, int]:
    """In how many places of distinct words each bigram stands; bounded by the letters."""
    grams = words.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("gram"))
    return {r["gram"]: r["c"] for r in grams.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).collect()}


def prefix_and_pivots(word: str, order: dict[str, tuple[int, int]]) -> tuple[int, list[int], tuple[int, int]]:
    """Rank of the prefix's last bigram, places of the prefix, and the two pivots.

    ``order`` gives each bigram's rank and count.
    """
    grams = [order[word[i : i + 2]] for i in range(len(word) - 1)]
    last = sorted(grams)[2][0]
    places = [i for i, (rank, _) in enumerate(grams) if rank <= last]
    # lightest: the cheapest first pivot among the places left of the second by two or more.
    best: tuple[int, int, int] | None = None
    lightest: tuple[int, int] | None = None
    behind = 0
    for j in places:
        while places[behind] <= j - 2:
            own = grams[places[behind]][1], places[behind]
            lightest = own if lightest is None or own < lightest else lightest
            behind += 1
        if lightest is not None:
            total = lightest[0] + grams[j][1], lightest[1], j
            best = total if best is None or total < best else best
    return last, places, best[1:]


def pivot_keys(word: str, p: int, q: int) -> list[tuple[str, ...]]:
    """What another word has to share with this one, by the place of the edit."""
    out = [(">", word[p:]), ("<", word[: q + 2])]
    # In p: what is before p and behind it stays.
    if p >= 2:
        out.append((">2", word[q:], word[:2]))
    else:
        out.append((">-", word[q - 2 :]) if q >= p + 4 else (">", word[q:]))
    # In q or between p and q: what is behind q stays; in q, all before q as well.
    if len(word) - (q + 2) >= 2:
        out.append(("<2", word[: p + 2], word[-2:]))
    elif q >= p + 4:
        out += [("<+", word[: p + 4]), (">2", word[q:], word[:2])]
    else:
        out.append(("<", word[: p + 2]))
    return out


def prefix_keys(word: str, p: int) -> list[tuple[str, ...]]:
    """What a bigram of a word's prefix offers: ``pivot_keys`` of all words one edit away."""
    out: list[tuple[str, ...]] = [(">", word[p:]), ("<", word[: p + 2])]
    if p >= 3:
        out += [(">2", word[p:], word[:2]), (">-", word[p - 2 :])]
    if len(word) - (p + 2) >= 3:
        out += [("<2", word[: p + 2], word[-2:]), ("<+", word[: p + 4])]
    return out


def _entries(words: DataFrame, order: dict[str, tuple[int, int]]) -> DataFrame:
    """word, n, rank of its prefix's end, and keys of its pivots and of its prefix."""
    ship(words.sparkSession)
    sent = words.sparkSession.sparkContext.broadcast(order)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        order = sent.value

        def keys(shared: list[tuple[str, ...]]) -> list[int]:
            return [xxhash.xxh64_intdigest("|".join(x)) - (1 << 63) for x in shared]

        for batch in batches:
            lasts, pivots, prefixes = [], [], []
            for word in batch.column(0).to_pylist():
                last, places, (p, q) = prefix_and_pivots(word, order)
                lasts.append(last)
                pivots.append(keys(pivot_keys(word, p, q)))
                prefixes.append(keys([x for at in places for x in prefix_keys(word, at)]))
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lasts, pa.int32()), pa.array(pivots, many), pa.array(prefixes, many)],
                names=["word", "n", "last", "pivots", "prefix"],
            )

    return words.select("word", "n").mapInArrow(compute, "word string, n long, last int, pivots array<long>, prefix array<long>")


def near_pairs(words: DataFrame) -> DataFrame:
    """All pairs (a, a_n, b, b_n), a < b, of words (word, n) that are one edit apart."""
    counts = gram_counts(words)
    order = {g: (i, c) for i, (g, c) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0])))}
    entries = staged(_entries(words, order), "spelling-entries")
    pivots = entries.select("word", "n", "last", F.explode("pivots").alias("key"))
    prefix = entries.select(F.col("word").alias("o_word"), F.col("n").alias("o_n"), F.col("last").alias("o_last"), F.explode("prefix").alias("o_key"))
    meets = (
        (F.col("key") == F.col("o_key"))
        & (F.col("last") <= F.col("o_last"))
        & (F.abs(F.length("word") - F.length("o_word")) <= 1)
        & (F.col("word") != F.col("o_word"))
        & (F.levenshtein("word", "o_word", 1) == 1)
    )
    a, b = F.struct("word", "n"), F.struct(F.col("o_word").alias("word"), F.col("o_n").alias("n"))
    pairs = pivots.join(prefix, meets).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return pairs.select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n")).distinct()


def with_roots(words: DataFrame) -> DataFrame:
    """``words`` (word, form, ...) with ``root``: from the word along the forms to the last."""
    at = staged(words.filter("form IS NOT NULL").select("word", F.col("form").alias("to")), "spelling-forms")
    while True:
        then = at.select(F.col("word").alias("via"), F.col("to").alias("next"))
        joined = staged(at.join(then, F.col("to") == F.col("via"), "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        at = joined.select("word", "to")
        if joined.filter("moved").isEmpty():
            break
    return words.join(at, "word", "left").withColumn("root", F.coalesce("to", "word")).drop("to")


def variants(docs: DataFrame, shortest: int = 7, least: int = 2, ratio: int = 10, every: int = 31) -> DataFrame:
    """One row per distinct word: word, form, root, n, n_near, form_n."""
    counted = noisy_words(docs, shortest, every).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    words = staged(counted, "spelling-words")
    pairs = staged(near_pairs(words), "spelling-pairs")
    one = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    both = one.unionAll(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    # Smallest of (-n, word): the largest count, then the smallest word.
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(near, "word", "left")
    largest: Column = -F.col("best.less")
    named = joined.select(
        "word",
        F.when(largest >= ratio * F.col("n"), F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(largest >= ratio * F.col("n"), largest).alias("form_n"),
    )
    return with_roots(staged(named, "spelling-named")).select("word", "form", "root", "n", "n_near", "form_n")
