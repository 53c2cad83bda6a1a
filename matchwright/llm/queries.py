"""The operators of this folder as registered queries, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    language,
    line_chunks,
    mixing,
    neighbours,
    phrases,
    pieces,
    quality,
    sentence_spans,
    set_join,
    simhash,
    spellings,
    suffixes,
    token_files,
)
from .common import documents, embeddings


def op1_sentence_spans(spark: SparkSession, folder: str) -> DataFrame:
    return sentence_spans.dedup_sentences(documents(spark, folder))


def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.token_table(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(embeddings(spark, folder), is_query=F.col("id") % 20 == 0, k=20)


def op4_line_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return line_chunks.dedup_lines(documents(spark, folder)).select("doc_id", "n_lines", "n_removed_lines", "text")


def op5_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(documents(spark, folder)).select(*mixing.QUERY_COLUMNS)


def op6_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixes.remove_repeats(documents(spark, folder), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return language.identify(docs, language.fit(docs))


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(documents(spark, folder))


def op9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.piece_table(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder), words=4, radius=4)


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(documents(spark, folder), least=100, most=2000)


def op12_spellings(spark: SparkSession, folder: str) -> DataFrame:
    return spellings.variants(documents(spark, folder), shortest=7, least=2, ratio=10, every=31)


def op13_set_join(spark: SparkSession, folder: str) -> DataFrame:
    return set_join.alike(documents(spark, folder), words=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentence_spans": op1_sentence_spans,
    "op2_token_files": op2_token_files,
    "op3_neighbours": op3_neighbours,
    "op4_line_chunks": op4_line_chunks,
    "op5_source_mixing": op5_source_mixing,
    "op6_suffixes": op6_suffixes,
    "op7_language": op7_language,
    "op8_quality_rules": op8_quality_rules,
    "op9_pieces": op9_pieces,
    "op10_simhash": op10_simhash,
    "op11_phrases": op11_phrases,
    "op12_spellings": op12_spellings,
    "op13_set_join": op13_set_join,
}

SQL: dict[str, str] = {
    "op1_sentence_spans": sentence_spans.ORACLE,
    "op4_line_chunks": line_chunks.ORACLE,
    "op5_source_mixing": mixing.ORACLE,
    "op8_quality_rules": quality.ORACLE,
    "op11_phrases": phrases.ORACLE,
}
