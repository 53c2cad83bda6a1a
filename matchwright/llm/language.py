"""Language identification by the nearest of several centroids per language.

A text is lower-cased, what is not a letter becomes a blank, and its byte trigrams are
counted in ``DIMENSIONS`` hashed cells. Counts are damped by logarithm, weighed by
inverse document frequency and normalised. Document frequencies are counted over all
documents one may learn from. Centroids come from a sample of at most
``per_language`` distinct texts of each language (those with the smallest hash), split
by spherical k-means into ``clusters``. A text gets the language of the nearest centroid
by cosine; it is rejected if it is farther from it than the language's farthest sampled
member plus a margin, and than ``least_limit``: short texts are far from every centroid.

The sample is a bound on the fit only: each language is fitted in one task on at most
``per_language`` rows. The model has languages x clusters x dimensions numbers.

Rows. NULL texts and texts without a letter are ``und`` with score 0 and rejected. Rows
with NULL lang are predicted, not learned from. With nothing to learn from everything is
``und``. Repeated rows count in the document frequencies and once in the sample. Only ``doc_id`` (to tell which rows
one may learn from), ``text`` and ``lang`` are read; a prediction sees the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

DIMENSIONS = 4096
#: ASCII that is no letter becomes a blank.
_BLANKED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_WEIGHTS = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint32)


def trigrams(text: str) -> np.ndarray:
    """Counts of the hashed byte trigrams of a text, words framed by blanks."""
    data = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANKED).split()) + b" "
    codes = np.frombuffer(data, np.uint8).astype(np.uint32)
    if codes.size < 3:
        return np.zeros(DIMENSIONS, np.float32)
    with np.errstate(over="ignore"):
        mixed = codes[:-2] * _WEIGHTS[0] + codes[1:-1] * _WEIGHTS[1] + codes[2:] * _WEIGHTS[2]
        mixed = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(2246822519)
    return np.bincount((mixed >> np.uint32(20)).astype(np.int64), minlength=DIMENSIONS).astype(np.float32)


def vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    counts = np.stack([trigrams(t) for t in texts]) if texts else np.zeros((0, DIMENSIONS), np.float32)
    weighed = np.log1p(counts) * idf
    return weighed / np.maximum(np.linalg.norm(weighed, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """Centroids in the order of their languages, and the distance each one rejects at."""

    langs: list[str]
    centroids: np.ndarray
    limits: np.ndarray
    idf: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        cosine = vectors(texts, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(best)), best], 0.0, 1.0).astype(np.float64)
        return [self.langs[i] for i in best], score, 1.0 - score > self.limits[best]


def may_learn(doc_id: Column) -> Column:
    """Documents whose crc32 of the id is not 2 modulo 4; NULL ids are not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(False))


def cluster(own: np.ndarray, clusters: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: centroids, and the members' cosines to them.

    Starts are the members at evenly spaced ranks of nearness to the mean.
    """
    ranked = np.argsort(-(own @ own.mean(axis=0)), kind="stable")
    k = min(clusters, len(own))
    centroids = own[ranked[((np.arange(k) + 0.5) * len(own) / k).astype(int)]]
    for _ in range(rounds):
        member = (own @ centroids.T).argmax(axis=1)
        sums = np.stack([own[member == j].sum(axis=0) if (member == j).any() else centroids[j] for j in range(k)])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids, own @ centroids.T


def fit(
    docs: DataFrame, per_language: int = 500, clusters: int = 4, margin: float = 0.05, least_limit: float = 0.9
) -> Model | None:
    """Learn from the rows one may learn from; None if there is none."""
    spark = docs.sparkSession
    ship(spark)
    learned = docs.filter(may_learn(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                seen += trigrams(text.as_py()) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1)), pa.array(np.append(seen, n))], names=["cell", "n"])

    counted = learned.select("text").mapInArrow(frequencies, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    flat = np.zeros(DIMENSIONS + 1)
    for row in counted.collect():
        flat[row["cell"]] = row["n"]
    if not flat[-1]:
        return None
    idf = (np.log((1 + flat[-1]) / (1 + flat[:-1])) + 1).astype(np.float32)

    def one_language(rows: pd.DataFrame) -> pd.DataFrame:
        texts = sorted(rows["text"])  # the same start whatever order rows arrive in
        centroids, cosine = cluster(vectors(texts, idf), clusters)
        limit = max(least_limit, 1.0 - float(cosine.max(axis=1).min()) + margin)
        return pd.DataFrame({"lang": rows["lang"].iloc[0], "k": range(len(centroids)), "limit": limit, "centroid": [c.tolist() for c in centroids]})

    # The largest sampled hash of each language is found on hashes alone; texts follow.
    hashed = learned.withColumn("hash", F.xxhash64("text"))
    order = Window.partitionBy("lang").orderBy("hash")
    first = hashed.select("lang", "hash").distinct().withColumn("place", F.row_number().over(order))
    limits = first.filter(F.col("place") <= per_language).groupBy("lang").agg(F.max("hash").alias("last"))
    limits = spark.createDataFrame(limits.collect(), "lang string, last long")  # one row per language
    chosen = hashed.join(F.broadcast(limits), "lang").filter(F.col("hash") <= F.col("last"))
    sample = chosen.dropDuplicates(["lang", "hash"]).select("lang", "text")
    fitted = sample.groupBy("lang").applyInPandas(one_language, "lang string, k int, limit double, centroid array<float>")
    rows = sorted(fitted.collect(), key=lambda r: (r["lang"], r["k"]))
    return Model([r["lang"] for r in rows], np.array([r["centroid"] for r in rows], np.float32), np.array([r["limit"] for r in rows]), idf)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` and ``rejected`` of every row."""
    held_out = F.coalesce(~may_learn(F.col("c0_")) & F.col("c0_").isNotNull(), F.lit(False))
    return tagged(docs, model, ["doc_id"]).select(F.col("c0_").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score", "rejected")


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` without rejected rows; a NULL lang becomes the predicted one."""
    columns = docs.columns
    kept = tagged(docs, model, columns).filter(~F.col("rejected"))
    lang = F.coalesce(F.col(f"c{columns.index('lang')}_"), "lang_pred")
    return kept.select(*[(lang if c == "lang" else F.col(f"c{i}_")).alias(c) for i, c in enumerate(columns)])


def tagged(docs: DataFrame, model: Model | None, carry: list[str]) -> DataFrame:
    """The columns ``carry`` as c0_, c1_, ... with the prediction beside them.

    Columns are carried by place, so no name of theirs can clash with the result's.
    """
    spark = docs.sparkSession
    places = [f"c{i}_" for i in range(len(carry))]
    carried = [F.col(f"`{c}`").alias(p) for c, p in zip(carry, places, strict=True)]
    if model is None:
        return docs.select(*carried, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = some.column(len(places)).to_pylist()
                known = [i for i, x in enumerate(some.column(len(places) + 1).to_pylist()) if x]
                langs, scores, rejected = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
                if known:
                    for i, lang, score, out in zip(known, *own.predict([texts[i] for i in known]), strict=True):
                        langs[i], scores[i], rejected[i] = lang, float(score), bool(out)
                yield pa.RecordBatch.from_arrays(
                    [*[some.column(i) for i in range(len(places))], pa.array(langs), pa.array(scores), pa.array(rejected)],
                    names=[*places, "lang_pred", "score", "rejected"],
                )

    source = docs.select(*carried, F.col("text").alias("t_"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("l_"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema[: len(places)])
    return source.mapInArrow(predict, f"{kinds}, lang_pred string, score double, rejected boolean")
