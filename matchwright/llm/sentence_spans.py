"""Substring dedup by sliding sentence spans.

A text is cut into sentences and their clauses (up to a full stop, question or
exclamation mark, comma, colon, semicolon or line end, with the white space behind it),
every run of ``sentences`` consecutive ones with ``min_words`` words or more is hashed,
and equal runs are joined over the whole corpus. Clauses count like sentences, since a
passage that was pasted into a sentence shares neither its first nor its last one whole,
and long sentences would leave nothing in between. The first place of a run, the smallest (doc_id, sentence number), stays; every
sentence that a later place covers is removed. Places are judged on the input.

Sentences are compared in lower case and with white space collapsed. A run is named by
two independent 64-bit hashes. Counting is a plain aggregate that combines before the
shuffle, and places meet the repeated runs in an equi-join whose other side has one row
per run, so a run that a third of all documents share can be split.

Rows. NULL texts stay NULL, empty ones empty. Rows that repeat doc_id and text count as
one document and stay alike. Texts with fewer sentences than a run stay. Only ``doc_id``
and ``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, staged, word_count

SENTENCE = r"[^.!?,;:\n]*[.!?,;:\n]+[\x20\x09-\x0D]*|[^.!?,;:\n]+"


def split_sentences(text: Column) -> Column:
    """The sentences of a text; joined they are the text."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0))


def _normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), r"[\x20\x09-\x0D]+", " "))


def runs(text: Column, sentences: int, min_words: int) -> Column:
    """Runs of a text: first sentence and two hashes."""

    def of(own: Column) -> Column:
        places = F.when(F.size(own) >= sentences, F.sequence(F.lit(0), F.size(own) - sentences)).otherwise(F.array().cast("array<int>"))

        def one(i: Column) -> Column:
            part = [F.get(own, i + j) for j in range(sentences)]
            return F.struct(
                i.alias("first"),
                F.xxhash64(*[p["s"] for p in part]).alias("h1"),
                F.xxhash64(F.lit(7), *[p["s"] for p in part]).alias("h2"),
                sum([p["n"] for p in part[1:]], part[0]["n"]).alias("n"),
            )

        return F.filter(F.transform(places, one), lambda x: x["n"] >= min_words)

    normal = F.transform(split_sentences(text), lambda s: F.struct(_normal(s).alias("s"), word_count(s).alias("n")))
    return F.flatten(F.transform(F.array(normal), of))


def dedup_sentences(docs: DataFrame, sentences: int = 3, min_words: int = 12) -> DataFrame:
    """One row per document: doc_id, n_sentences, n_removed, the text that is left."""
    texts = docs.select("doc_id", "text", row_key("text").alias("key"))
    places = staged(
        texts.select("doc_id", "key", F.explode(runs(F.col("text"), sentences, min_words)).alias("x")).select(
            "doc_id", "key", "x.first", "x.h1", "x.h2"
        ),
        "sentence-runs",
    )
    hashes = ["h1", "h2"]
    repeated = places.groupBy(*hashes).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    # Written first, so that the join has two plain shuffles and a hot run can be split.
    repeated = staged(repeated.filter("n > 1").drop("n"), "sentence-repeated")
    met = staged(places.join(repeated, hashes), "sentence-repeats")
    at_first = met.filter(F.col("doc_id").eqNullSafe(F.col("first_doc")))
    firsts = at_first.groupBy(*hashes).agg(F.min(F.struct("key", "first")).alias("keep"))
    later = met.filter(~F.col("doc_id").eqNullSafe(F.col("first_doc"))).select("doc_id", "key", "first")
    own = at_first.join(firsts, hashes).filter(F.struct("key", "first") != F.col("keep")).select("doc_id", "key", "first")
    covered = (
        later.unionAll(own)
        .groupBy(F.col("doc_id").alias("c_doc"), F.col("key").alias("c_key"))
        .agg(F.array_distinct(F.flatten(F.transform(F.collect_set("first"), lambda i: F.sequence(i, i + sentences - 1)))).alias("covered"))
    )
    joined = texts.join(covered, F.col("doc_id").eqNullSafe(F.col("c_doc")) & (F.col("key") == F.col("c_key")), "left")

    def rest(all: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(all) - 1), F.col("covered"))
        return F.array_join(F.transform(left, lambda i: F.get(all, i)), "")

    kept = F.transform(F.array(split_sentences(F.col("text"))), rest)[0]
    return joined.select(
        "doc_id",
        F.size(split_sentences(F.col("text"))).cast("long").alias("n_sentences"),
        F.coalesce(F.when(F.col("covered").isNotNull(), F.size("covered")), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("covered").isNull(), F.col("text")).otherwise(kept).alias("text"),
    )


ORACLE = r"""
WITH cut AS (
  SELECT DISTINCT doc_id, text, regexp_extract_all(text, '[^.!?,;:\n]*[.!?,;:\n]+[\x20\x09-\x0D]*|[^.!?,;:\n]+') AS own FROM documents WHERE text IS NOT NULL),
runs AS (
  SELECT doc_id, text, i,
    trim(regexp_replace(lower(own[i + 1]), '[\x20\x09-\x0D]+', ' ', 'g')) AS a, trim(regexp_replace(lower(own[i + 2]), '[\x20\x09-\x0D]+', ' ', 'g')) AS b,
    trim(regexp_replace(lower(own[i + 3]), '[\x20\x09-\x0D]+', ' ', 'g')) AS c,
    len(regexp_extract_all(own[i + 1], '[^\x20\x09-\x0D]+')) + len(regexp_extract_all(own[i + 2], '[^\x20\x09-\x0D]+'))
      + len(regexp_extract_all(own[i + 3], '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT *, unnest(range(len(own) - 2)) AS i FROM cut)),
later AS (
  SELECT doc_id, text, i FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS place FROM runs WHERE n >= 12) WHERE place > 1),
covered AS (SELECT doc_id, text, list(DISTINCT p) AS covered FROM (SELECT doc_id, text, unnest([i, i + 1, i + 2]) AS p FROM later) GROUP BY doc_id, text)
SELECT d.doc_id, coalesce(len(c.own), 0)::BIGINT AS n_sentences, coalesce(len(covered), 0)::BIGINT AS n_removed,
  CASE WHEN covered IS NULL THEN d.text ELSE array_to_string(list_filter(c.own, lambda x, j: NOT list_contains(covered, j - 1)), '') END AS text
FROM documents d LEFT JOIN cut c ON d.doc_id = c.doc_id AND d.text = c.text LEFT JOIN covered v ON d.doc_id = v.doc_id AND d.text = v.text
"""
