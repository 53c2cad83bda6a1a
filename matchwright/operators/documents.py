"""Documents as tables: reading files, decoding, rejecting, tagging the language."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import chain, groupby
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.tables import file_system, staged

# Accepted upload types; only plain text is read here.
READABLE = ["txt"]
NEEDS_A_PARSER = ["pdf", "docx", "doc"]
FOLDER, FOLDERS = "folder", 256
TASKS_PER_CORE = 4
REPEATED_KEYS = 1 << 16  # most keys of several texts that are broadcast
NO_KEY = "__HIVE_DEFAULT_PARTITION__"  # as Spark names the partition of NULL


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder with name, extension and bytes; Spark skips files of length 0.

    Spark counts 4 MB for each file it opens, which gives a task to every few small files:
    they are read by a number of tasks that does not grow with them.
    """
    tasks = max(FOLDERS, TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .coalesce(tasks)
        .withColumn("filename", F.regexp_extract("path", r"([^/]*)$", 1))
        .withColumn("extension", text.file_extension(F.col("filename")))
        .select("path", "filename", "extension", "length", "content")
    )


def write_files(texts: DataFrame, path: str, key: str) -> None:
    """One text file for each key, in ``FOLDERS`` folders named by ``FOLDER``.

    Tasks put their own files in place, and folders are listed side by side when they are
    read by a pattern; one folder of all files would leave both to the driver. A file is
    named ``key=value.txt``, or lies in a folder ``key=value`` where Spark writes it: the
    path holds the key in both, as Spark spells partitions. Texts of one key share a file;
    those of other keys are written where they are read, if few keys repeat.
    """
    spark = texts.sparkSession
    tasks = TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    folder = F.pmod(F.xxhash64(key), F.lit(FOLDERS)).alias(FOLDER)
    rows = texts.select(folder, key, "text")
    root = _mounted(spark, path)
    if root is None:
        writer = rows.repartition(tasks, key).write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        writer.partitionBy(FOLDER, key).text(path)
        return
    if os.path.exists(root):
        raise FileExistsError(f"{path} exists already")
    sent = rows.select(FOLDER, F.col(key).cast("string").alias("key"), F.col("text").cast("binary").alias("text"))
    # NULL and "" have one name, and so one file.
    sent = sent.withColumn("key", F.coalesce("key", F.lit("")))
    twice = sent.groupBy("key").count().filter("count > 1").select("key")
    few = twice.limit(REPEATED_KEYS + 1).toPandas()["key"]
    if len(few) > REPEATED_KEYS:
        dealt = sent.repartition(tasks, "key").sortWithinPartitions("key")
    else:
        known = F.broadcast(spark.createDataFrame([(k,) for k in few], "key string"))
        again = sent.join(known, "key", "left_semi").repartition(tasks, "key").sortWithinPartitions("key")
        dealt = again.unionByName(sent.join(known, "key", "left_anti"))
    files = dealt.select(FOLDER, "key", "text").mapInArrow(_put(root, key), "files long")
    files.agg(F.sum("files")).collect()


def _mounted(spark: SparkSession, path: str) -> str | None:
    """The name under which tasks can open ``path`` themselves, None if it is in another store.

    Hadoop's local file system starts a process for each permission it sets, five for a
    small file in a folder of its own, and that is most of the time there.
    """
    system, place = file_system(spark, path)
    found = system.makeQualified(place).toUri()
    return found.getPath() if found.getScheme() == "file" else None


def _put(root: str, name: str):
    """Writes the texts of each key, which come one after the other, as one file."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, files, made = f".{uuid.uuid4().hex}", 0, set()
        for key, found in groupby(rows(batches), lambda row: row[1]):
            first = next(found)
            place = os.path.join(root, f"{FOLDER}={first[0]}")
            if place not in made:
                os.makedirs(place, exist_ok=True)
                made.add(place)
            spelled = quote(key, safe=" ") if key else NO_KEY
            # Whole before it has its name, so a task that runs twice leaves the same file.
            with open(os.path.join(place, own), "wb") as file:
                for _, _, body in chain([first], found):
                    file.write(body.as_py() or b"")
                    file.write(b"\n")
            os.replace(os.path.join(place, own), os.path.join(place, f"{name}={spelled}.txt"))
            files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    return put


def sort_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable documents with their text, and the rejected files with a reason.

    Names and lengths are judged first, so the bytes of a file that these reject are not
    read.
    """
    length = F.col("length") if "length" in files.columns else F.octet_length("content")
    reason = (
        F.when(F.col("extension").isin(NEEDS_A_PARSER), "needs a document parser")
        .when(~F.col("extension").isin(READABLE), "unsupported file format")
        .when(length == 0, "empty file")
    )
    refused = files.drop("content") if "length" in files.columns else files
    refused = refused.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("content")
    read = files.filter(reason.isNull()).withColumn("text", F.when(F.col("extension").isin(READABLE), text.decode_bytes(F.col("content"))))
    has = F.coalesce(F.col("text").rlike(r"\S"), F.lit(True))
    silent = read.filter(~has).drop("text", "content").withColumn("reason", F.lit("no text in file"))
    return read.filter(has).drop("content"), refused.unionByName(silent)


def has_text(df: DataFrame, column: str = "text") -> DataFrame:
    return df.filter(F.col(column).rlike(r"\S"))


# -- language ----------------------------------------------------------------------

CHARACTERS_AT_A_TIME = 1 << 20
PROFILE_ROWS = 1 << 20  # largest profile that is broadcast
PART_BYTES = 32 << 20
PART_CHARACTERS = 8 << 20  # texts that share the trigrams fetched for them


def _flat() -> Column:
    """The whole text in lower case, blanks run together."""
    return F.regexp_replace(F.lower(text.strip(F.col("text"))), r"\s+", " ")


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about ``CHARACTERS_AT_A_TIME`` characters each."""
    start, size = 0, 0
    for at, body in enumerate(texts):
        size += len(body)
        if size >= CHARACTERS_AT_A_TIME:
            yield start, at + 1
            start, size = at + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Every character trigram of the texts as a number, and the text it is from."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    if points.size < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    wide = points.astype(np.int64)
    codes = (wide[:-2] << 42) | (wide[1:-1] << 21) | wide[2:]
    inside = owner[:-2] == owner[2:]
    return codes[inside], owner[:-2][inside]


def _spelled(code: int) -> str:
    return "".join(chr(code >> shift & 0x1FFFFF) for shift in (42, 21, 0))


def _number(gram: str) -> int:
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c


def _trigram_counts(documents: DataFrame) -> DataFrame:
    """``lang, gram, n``: counted inside each batch, then added up."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                texts = list(part["flat"])
                for start, end in _slices(texts):
                    codes, n = np.unique(_trigrams(texts[start:end])[0], return_counts=True)
                    grams = [_spelled(c) for c in codes.tolist()]
                    if grams:
                        yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})

    flat = documents.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    return (
        flat.select("lang", _flat().alias("flat"))
        .mapInPandas(count, "lang string, gram string, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )


def language_profile(documents: DataFrame) -> DataFrame:
    """Log-probability of every trigram of the texts, in every language.

    Read from whole texts of known language. Weights are whole millionths, so adding
    them gives the same sum in any order and equal sums are true ties.
    """
    counts = staged(_trigram_counts(documents), "trigram-counts")
    vocabulary = counts.select("gram").distinct()
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    size = vocabulary.agg(F.count("*")).scalar()
    languages = totals.agg(F.collect_list(F.struct("lang", "total"))).scalar()
    every = vocabulary.select("gram", F.explode(languages).alias("l")).select("gram", "l.*")
    chance = F.log((F.coalesce("n", F.lit(0)) + 1.0) / (F.col("total") + size))
    return every.join(counts, ["gram", "lang"], "left").select(
        "gram", "lang", F.round(chance * 1e6).cast("long").alias("weight")
    )


def _spread(documents: DataFrame) -> DataFrame:
    """Parts of ``PART_BYTES`` of text on average, or one per core where that is more."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cores = documents.sparkSession.sparkContext.defaultParallelism
    return documents.repartition(max(cores, -(-size // PART_BYTES)))


def tag_language(
    documents: DataFrame, profile: DataFrame, key: str = "doc_id", broadcast_rows: int = PROFILE_ROWS
) -> DataFrame:
    """``key, language``: the likeliest language of each whole text, else ``unknown``.

    Equal weights go to the first language by name. A profile of checked size is
    broadcast and texts are weighed where they are read; of a larger one each part of the
    texts gets the trigrams it holds by a join. Both give the same result.
    """
    few = profile.select("gram", "lang", "weight").limit(broadcast_rows + 1).toPandas()
    if len(few) > broadcast_rows:
        return _tag_by_join(documents, profile, key)
    known = _weights(few["lang"].to_numpy(dtype=object), np.array([_number(g) for g in few["gram"]], dtype=np.int64), few["weight"].to_numpy())
    shared = documents.sparkSession.sparkContext.broadcast(known)

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "language": _likeliest(list(batch["flat"]), *shared.value)})

    kind = documents.schema[key].dataType.simpleString()
    flat = _spread(documents).select(key, F.coalesce(_flat(), F.lit("")).alias("flat"))
    return flat.mapInPandas(tag, f"{key} {kind}, language string")


def _tag_by_join(documents: DataFrame, profile: DataFrame, key: str) -> DataFrame:
    """Texts are dealt into parts of bounded size; a part's trigrams travel, each once."""
    kind = documents.schema[key].dataType.simpleString()
    flat = _spread(documents).select(key, F.coalesce(_flat(), F.lit("")).alias("flat"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, size = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            sizes = batch["flat"].str.len().to_numpy()
            parts = part + (size + np.cumsum(sizes) - sizes) // PART_CHARACTERS
            size += int(sizes.sum())
            yield pd.DataFrame({key: batch[key], "flat": list(batch["flat"]), "part": parts})

    dealt = staged(flat.mapInPandas(deal, f"{key} {kind}, flat string, part long"), "language-parts")

    def held(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, texts in batch.groupby("part")["flat"]:
                texts = list(texts)
                found = [np.unique(_trigrams(texts[a:b])[0]) for a, b in _slices(texts)]
                grams = [_spelled(c) for c in np.unique(np.concatenate(found)).tolist()]
                if grams:
                    yield pd.DataFrame({"part": part, "gram": grams})

    grams = dealt.select("part", "flat").mapInPandas(held, "part long, gram string").distinct()
    row = F.struct("lang", "weight")
    by_gram = profile.groupBy("gram").agg(F.collect_list(row).alias("weights"))
    wanted = grams.join(by_gram, "gram")

    def weigh(texts: pd.DataFrame, weights: pd.DataFrame) -> pd.DataFrame:
        each = weights["weights"].str.len().to_numpy(dtype=np.int64)
        rows = [(w["lang"], w["weight"]) for of in weights["weights"] for w in of]
        numbers = np.repeat(np.array([_number(g) for g in weights["gram"]], dtype=np.int64), each)
        known = _weights(np.array([r[0] for r in rows], dtype=object), numbers, np.array([r[1] for r in rows], dtype=np.int64))
        codes, weight, names = known
        held = np.zeros(weight.shape, dtype=np.int64)
        held[np.searchsorted(codes, numbers), np.searchsorted(names[:-1].astype(str), [r[0] for r in rows])] = 1
        found = []
        for text, sums in _summed(list(texts["flat"]), codes, np.hstack([weight, held])):
            at, lang = np.nonzero(sums[:, weight.shape[1] :])
            found.append((text[at], names[lang], sums[at, lang]))
        if not found:
            return pd.DataFrame({key: texts[key].iloc[:0], "lang": pd.Series([], dtype=object), "weight": np.empty(0, np.int64)})
        text, lang, weight = map(np.concatenate, zip(*found))
        return pd.DataFrame({key: texts[key].to_numpy()[text], "lang": list(lang), "weight": weight})

    weighed = dealt.groupBy("part").cogroup(wanted.groupBy("part")).applyInPandas(weigh, f"{key} {kind}, lang string, weight long")
    best = weighed.groupBy(key, "lang").agg(F.sum("weight").alias("weight"))
    best = best.groupBy(key).agg(F.min_by("lang", F.struct(-F.col("weight"), "lang")).alias("found"))
    return documents.select(key).join(best, key, "left").select(key, F.coalesce("found", F.lit("unknown")).alias("language"))


def _weights(lang: np.ndarray, numbers: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram numbers in order, their weights by language, and the languages' names."""
    languages, column = np.unique(lang, return_inverse=True)
    codes, row = np.unique(numbers, return_inverse=True)
    weights = np.zeros((len(codes), len(languages)), dtype=np.int64)
    weights[row, column] = weight
    return codes, weights, np.array([*languages, "unknown"], dtype=object)


def _likeliest(texts: list[str], known: np.ndarray, weight: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The language of each text."""
    found = np.full(len(texts), len(names) - 1)
    for at, sums in _summed(texts, known, weight):
        found[at] = sums.argmax(1)
    return names[found]


def _summed(texts: list[str], known: np.ndarray, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts that hold a known trigram, and the sums of the weights of theirs."""
    for start, end in _slices(texts):
        grams, owner = _trigrams(texts[start:end])
        if not grams.size or not known.size:
            continue
        at = np.minimum(np.searchsorted(known, grams), known.size - 1)
        hit = known[at] == grams
        at, owner = at[hit], owner[hit]
        if not at.size:
            continue
        # Rows of one text follow each other: add up each run.
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        yield start + owner[starts], np.add.reduceat(weight[at], starts)
