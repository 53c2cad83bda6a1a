"""Quality rules: word counts, repetition, and lines that many documents of a host share.

A line is normalised (lower case, blanks collapsed and trimmed) and hashed. Per host
(``source``) the distinct documents of each line are counted; exact copies of a text are
one document, so copying a page does not turn its lines into boilerplate. A line in more
documents than both ``min_documents`` and ``max_share`` of the host's documents is
removed. A document is depleted, and rejected, if fewer than ``min_words`` words or less
than ``min_left`` of its words remain.

Only functions of DataFrames are used. Repeated word windows are found in the row: window
hashes are sorted with their places, equal neighbours are marked, and the words under
the marked places are counted. So a document costs n log n and no shuffle.

Rows. NULL and empty texts have no words and fail the base rules. A NULL source is a host
of its own. Repeated rows are returned as often as they come; they are one document in
the counts. Lines without a word are neither counted nor removed. Only ``doc_id``,
``text`` and ``source`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, staged, word_count, words


def _repeat_words(tokens: Column, window: int = 3) -> Column:
    """Words of ``tokens`` in windows that occur twice or more."""

    def marked(ws: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(ws) - window),
            lambda i: F.struct(F.xxhash64(*[F.get(ws, i + j) for j in range(window)]).alias("h"), i.alias("i")),
        )
        return F.transform(
            F.array(F.sort_array(hashes)),
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        # places in s, from 0
                        lambda x, n: (F.get(s, n - 1)["h"] == x["h"]) & (n > 0) | F.coalesce(F.get(s, n + 1)["h"] == x["h"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
        )[0]

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, n: F.least(F.lit(window), F.coalesce(F.get(places, n + 1) - p, F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda t, x: t + x)

    count = F.transform(F.transform(F.array(tokens), marked), covered)[0]
    return F.when(F.size(tokens) >= window + 1, count).otherwise(0).cast("long")


def normalised_lines(text: Column) -> Column:
    """Normalised lines that hold a word, in order."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    lines = F.transform(F.split(lower, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")))
    return F.filter(lines, lambda x: x != "")


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, a key of the row's content, and the counts of the base rules."""
    has_word = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    tokens = docs.select("doc_id", row_key("text", "source").alias("key"), "text", has_word.alias("lines"), words(F.col("text")).alias("tokens"))
    return tokens.select(
        "doc_id",
        "key",
        F.size("tokens").cast("long").alias("n_words"),
        F.aggregate("tokens", F.lit(0).cast("long"), lambda t, w: t + F.length(w)).alias("word_chars"),
        F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("tokens")).alias("n_repeat_words"),
    )


def host_lines(docs: DataFrame) -> DataFrame:
    """One row per line that holds a word: document, host, place, hash and words."""
    return docs.select(
        "doc_id",
        row_key("text", "source").alias("key"),
        "source",
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"),
        F.posexplode(normalised_lines(F.col("text"))).alias("place", "line"),
    ).select("doc_id", "key", "source", "content", "place", F.xxhash64("line").alias("hash"), word_count(F.col("line")).alias("words"))


def frequent_lines(docs: DataFrame, lines: DataFrame, min_documents: int, max_share: float) -> DataFrame:
    """Host and hash of the lines in too many distinct documents of the host."""
    hosts = docs.groupBy(F.col("source").alias("host")).agg(
        F.countDistinct(F.xxhash64(F.coalesce("text", F.lit("")))).alias("host_documents")
    )
    counts = lines.groupBy("source", "hash").agg(F.countDistinct("content").alias("documents"))
    limit = F.greatest(F.lit(float(min_documents)), F.col("host_documents") * F.lit(max_share))
    return (
        counts.filter(F.col("documents") > min_documents)
        .join(hosts, F.col("source").eqNullSafe(F.col("host")))
        .filter(F.col("documents") > limit)
        .select("host", F.col("hash").alias("f_hash"))
    )


def quality(
    docs: DataFrame,
    min_words: int = 50,
    max_repeat_percent: int = 50,
    min_documents: int = 20,
    max_share: float = 0.02,
    min_left: float = 0.5,
) -> DataFrame:
    """One row per document: base counts and their verdict, lines and words that stay
    away as boilerplate, and whether the document is kept."""
    lines = staged(host_lines(docs), "host-lines")
    frequent = frequent_lines(docs, lines, min_documents, max_share)
    hit = lines.join(frequent, F.col("source").eqNullSafe(F.col("host")) & (F.col("hash") == F.col("f_hash")))
    removed = (
        hit.groupBy(F.col("doc_id").alias("r_doc"), F.col("key").alias("r_key"))
        .agg(F.collect_set(F.struct("place", "words")).alias("gone"))  # repeated rows count once
        .select(
            "r_doc",
            "r_key",
            F.size("gone").cast("long").alias("gone_lines"),
            F.aggregate("gone", F.lit(0).cast("long"), lambda t, x: t + x["words"]).alias("gone_words"),
        )
    )
    joined = base_counts(docs).join(removed, F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("key") == F.col("r_key")), "left")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("gone_words", F.lit(0))
    return joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (left >= min_words) & (left >= F.col("n_words") * F.lit(min_left))).alias("kept"),
        F.coalesce("gone_lines", F.lit(0)).cast("long").alias("n_boilerplate_lines"),
        left.cast("long").alias("n_words_left"),
    )


ORACLE = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
tokens AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM docs),
windows AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM tokens)),
repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM repeated) GROUP BY r),
raw AS (SELECT r, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS line FROM docs),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM raw GROUP BY r),
normal AS (
  SELECT r, source, text, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM (SELECT r, source, text, unnest(string_split(lower(text), chr(10))) AS line FROM docs)),
lines AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM normal WHERE line != ''),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM docs GROUP BY source),
frequent AS (
  SELECT l.source, l.line FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, l.line, h.n HAVING count(DISTINCT text) > greatest(20.0, h.n * 0.02)),
gone AS (
  SELECT r, count(*) AS gone_lines, sum(words) AS gone_words FROM lines l
  JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.line = f.line GROUP BY r),
counts AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(gone_lines, 0)::BIGINT AS n_boilerplate_lines,
    (len(ws) - coalesce(gone_words, 0))::BIGINT AS n_words_left
  FROM tokens LEFT JOIN covered USING (r) LEFT JOIN dups USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words_left >= 50 AND n_words_left >= n_words * 0.5 AS kept,
  n_boilerplate_lines, n_words_left
FROM counts
"""
