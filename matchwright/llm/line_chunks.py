"""Line dedup by content-defined chunks of lines.

A document's lines are hashed, a rolling hash over ``window`` line hashes runs along
them, and a chunk ends after each line whose rolling hash is divisible by ``divisor``.
Boundaries depend on the lines next to them only, so an insertion elsewhere shifts none
of them. A chunk of two or more lines that hold a word and that occurs more than once in
the corpus is removed everywhere but at its first place, the smallest
(doc_id, chunk number). Chunk hashes only nominate: bytes are compared with those of the
first place, and chunks of equal hash but other bytes are settled by grouping on the
bytes themselves.

Only functions of DataFrames are used. Places, hashes and the bytes of nominated chunks
are written to the shared folder; texts are shuffled twice, by document: to read the
nominated bytes and to write what is left.

Rows. NULL texts stay NULL, empty ones empty. Rows that repeat doc_id and text count as
one document, so they keep their chunks, all of them. A last line without line end is a
line; other white space than the line end belongs to the line. Only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, staged

#: A Mersenne prime as modulus and a multiplier below it: products fit in 64 bits.
MODULUS = 2147483647
BASE = 1000003


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long") % MODULUS


def chunks(text: Column, window: int = 2, divisor: int = 4) -> Column:
    """The chunks of a text in order, each an array of lines; joined they are the text."""
    powers = [pow(BASE, j, MODULUS) for j in range(window)]

    def rolling(hashes: Column, i: Column) -> Column:
        terms = [
            F.when(i >= j, F.get(hashes, i - j) * F.lit(p) % MODULUS).otherwise(F.lit(0)) for j, p in enumerate(powers)
        ]
        return sum(terms[1:], terms[0]) % MODULUS

    def cut(lines: Column) -> Column:
        hashes = F.array(F.transform(lines, _line_hash))
        last = F.size(lines) - 1
        ends = F.flatten(
            F.transform(hashes, lambda h: F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (rolling(h, i) % divisor == 0)))
        )
        return F.flatten(
            F.transform(
                F.array(ends),
                lambda e: F.transform(
                    e,
                    lambda end, n: F.slice(
                        lines,
                        F.when(n == 0, F.lit(1)).otherwise(F.get(e, n - 1) + 2),
                        end - F.when(n == 0, F.lit(-1)).otherwise(F.get(e, n - 1)),
                    ),
                ),
            )
        )

    # The array of one binds its element to a name, so nothing is computed per line.
    return F.flatten(F.transform(F.array(F.split(text, "\n", -1)), cut))


def _worth(chunk: Column) -> Column:
    """Two or more lines that hold a word."""
    return F.size(F.filter(chunk, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))) >= 2


def removed_chunks(docs: DataFrame, window: int = 2, divisor: int = 4) -> DataFrame:
    """n_doc, n_key and the numbers of the chunks to remove, for documents that have any."""
    texts = docs.select("doc_id", "text", row_key("text").alias("key"))
    spread = (
        texts.filter("text IS NOT NULL")
        .select("doc_id", "key", F.posexplode(chunks(F.col("text"), window, divisor)).alias("chunk", "lines"))
        .filter(_worth(F.col("lines")))
        .select("doc_id", "key", "chunk", F.xxhash64(F.array_join("lines", "\n")).alias("hash"))
    )
    spread = staged(spread, "line-chunks")
    place = F.struct("doc_id", "key", "chunk")
    groups = spread.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # Written first, so that the join has two plain shuffles and a hot chunk can be split.
    groups = staged(groups.filter(F.col("first") != F.col("last")).select("hash", "first"), "line-groups")
    named = spread.join(groups, "hash").groupBy("doc_id", "key").agg(F.collect_set(F.struct("chunk", "hash", "first")).alias("named"))
    named = named.select(F.col("doc_id").alias("n_doc"), F.col("key").alias("n_key"), "named")
    same = F.col("doc_id").eqNullSafe(F.col("n_doc")) & F.col("key").eqNullSafe(F.col("n_key"))

    # Bytes of the chunks that were named, from a shuffle of the texts by document.
    found = (
        texts.join(named, same, "left")
        .filter("named IS NOT NULL")
        .withColumn("all", chunks(F.col("text"), window, divisor))
        .select("doc_id", "key", F.explode(F.transform("named", lambda x: F.struct(x["chunk"].alias("chunk"), x["hash"].alias("hash"), x["first"].alias("first"), F.array_join(F.get(F.col("all"), x["chunk"]), "\n").alias("bytes")))).alias("x"))
        .select("doc_id", "key", "x.*")
    )
    found = staged(found, "line-found")
    is_first = place == F.col("first")
    firsts = staged(found.filter(is_first).groupBy("hash").agg(F.first("bytes").alias("first_bytes")), "line-firsts")
    compared = found.filter(~is_first).join(firsts, "hash")
    equal = compared.filter(F.col("bytes") == F.col("first_bytes")).select("doc_id", "key", "chunk")
    # Equal hash, other bytes: these form groups of their own.
    other = compared.filter(F.col("bytes") != F.col("first_bytes"))
    own = other.groupBy("hash", "bytes").agg(F.min(place).alias("own_first"))
    rest = other.join(own, ["hash", "bytes"]).filter(place != F.col("own_first")).select("doc_id", "key", "chunk")
    removed = equal.unionAll(rest).groupBy("doc_id", "key").agg(F.collect_set("chunk").alias("removed"))
    return removed.select(F.col("doc_id").alias("n_doc"), F.col("key").alias("n_key"), "removed")


def dedup_lines(docs: DataFrame, window: int = 2, divisor: int = 4) -> DataFrame:
    """``row_`` (the other columns), doc_id, n_lines, n_removed_lines, the text that is left."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    texts = docs.select("doc_id", "text", row_key("text").alias("key"), F.struct(*others).alias("row_"))
    removed = removed_chunks(docs, window, divisor)
    same = F.col("doc_id").eqNullSafe(F.col("n_doc")) & F.col("key").eqNullSafe(F.col("n_key"))

    def part(all: Column) -> Column:
        # Set operations on chunk numbers, so that long documents stay linear.
        numbers = F.array_except(F.sequence(F.lit(0), F.size(all) - 1), F.col("removed"))
        left = F.transform(numbers, lambda i: F.get(all, i))
        return F.struct(F.array_join(F.flatten(left), "\n").alias("text"), F.size(F.flatten(left)).alias("lines"))

    kept = F.when(F.col("removed").isNotNull(), F.transform(F.array(chunks(F.col("text"), window, divisor)), part)[0])
    n_lines = F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long")
    return (
        texts.join(removed, same, "left")
        .withColumn("kept", kept)
        .select(
            "row_",
            "doc_id",
            n_lines.alias("n_lines"),
            F.when(F.col("removed").isNull(), F.lit(0)).otherwise(n_lines - F.col("kept.lines")).cast("long").alias("n_removed_lines"),
            F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.col("kept.text")).alias("text"),
        )
    )


def keep_lines(docs: DataFrame, window: int = 2, divisor: int = 4) -> DataFrame:
    """``docs`` with what is left of each text and ``n_chars`` set anew.

    Documents of which no word is left go; those that had no word before stay.
    """
    found = dedup_lines(docs, window, divisor)
    left = found.filter((F.col("n_removed_lines") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    own = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed_lines") == 0, F.col("row_.n_chars")).otherwise(F.length("text"))} if "n_chars" in docs.columns else {"text": F.col("text")}
    return left.select(*[own.get(c, F.col(f"row_.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


ORACLE = r"""
WITH texts AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
hashed AS (SELECT *, list_transform(lines, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT % 2147483647) AS hs FROM texts),
ended AS (
  SELECT *, list_filter(range(len(lines)), lambda i: i = len(lines) - 1 OR
    ((hs[i + 1] * 1 % 2147483647 + CASE WHEN i >= 1 THEN hs[i] * 1000003 % 2147483647 ELSE 0 END) % 2147483647) % 4 = 0) AS ends FROM hashed),
parts AS (
  SELECT doc_id, text, lines, ends, unnest(range(len(ends))) AS chunk FROM ended),
cut AS (
  SELECT doc_id, text, chunk,
    lines[(CASE WHEN chunk = 0 THEN 1 ELSE ends[chunk] + 2 END) : ends[chunk + 1] + 1] AS own FROM parts),
marked AS (
  SELECT *, len(list_filter(own, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) >= 2 AS worth, array_to_string(own, chr(10)) AS bytes FROM cut),
numbered AS (
  SELECT *, worth AND row_number() OVER (PARTITION BY worth, bytes ORDER BY doc_id, chunk) > 1 AS gone FROM marked),
kept AS (
  SELECT doc_id, text, coalesce(sum(CASE WHEN gone THEN len(own) END), 0)::BIGINT AS n_removed_lines,
    coalesce(string_agg(bytes, chr(10) ORDER BY chunk) FILTER (WHERE NOT gone), '') AS kept FROM numbered GROUP BY doc_id, text)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n_removed_lines, 0)::BIGINT AS n_removed_lines,
  CASE WHEN coalesce(n_removed_lines, 0) = 0 THEN d.text ELSE kept END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id AND d.text = k.text
"""
