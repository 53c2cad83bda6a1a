"""Phrases against SQL: odd texts, failing samples, and hashes on long and odd bytes."""

import random

import numpy as np
import pyarrow as pa
from helpers import by_sql, clashing, docs, odd_texts, rows
from pyspark.sql import functions as F

from matchwright.llm import bitmap, byte_words, phrases

SQL_10 = phrases.ORACLE.replace("f >= 100", "f >= 10")


def talk(seed, n=400):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(30)]
    out = []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randrange(40))]
        if i % 3 == 0:
            words += "As Soon as possible".split()
        if i % 7 == 0:
            words += "very rarely seen together now".split()
        if i % 11 == 0:
            words.insert(rng.randrange(len(words) + 1), "stop.Go;")
        out.append((i if i % 10 else None, " ".join(words), "a"))
    return out


def langs(df):
    return df.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "en").when(F.col("doc_id") % 3 == 0, "und"))


def test_equals_sql(spark):
    for seed in (1, 2):
        df = langs(docs(spark, talk(seed)))
        got = rows(phrases.collocations(df, least=10, part=4))
        assert got == by_sql(df, SQL_10) and len(got) > 20


def test_any_sample_gives_the_same(spark):
    """Samples that propose nothing, a part, and far too much: only the passes differ."""
    df = langs(docs(spark, talk(3)))
    want = by_sql(df, SQL_10)
    for part, low in ((1000, 2), (8, 40), (50, 3), (1, 2)):
        assert rows(phrases.collocations(df, least=10, part=part, low=low)) == want


def test_small_bitmap_counts_more_but_right(spark, monkeypatch):
    monkeypatch.setattr(phrases, "LOG_BITS", 8)
    df = langs(docs(spark, talk(4)))
    assert rows(phrases.collocations(df, least=10, part=4)) == by_sql(df, SQL_10)


def test_repeated_words_and_large_products(spark):
    """Overlapping occurrences, and products beyond 64 bits."""
    df = docs(spark, ["x " * 3000, "a\tb. a b\rA  B"])
    got = {r.phrase: r for r in phrases.collocations(df, least=2).collect()}
    assert got["x x x x x"].a == 2996 and "x x" in got and got["a b"].a == 3
    big = spark.createDataFrame([(4 * 10**12, 9 * 10**14, 5 * 10**12, 7 * 10**12)], "a_ long, n_ long, l_ long, r_ long")
    big = big.select(*[F.col(c).cast("decimal(19,0)") for c in big.columns])
    exact = "cast(1000 AS decimal(4,0)) * a_ * cast(n_ AS decimal(15,0)) div (l_ * r_)"
    assert big.selectExpr(f"{exact} AS s").first().s == 1000 * 4 * 10**12 * 9 * 10**14 // (5 * 10**12 * 7 * 10**12)


def test_odd_tables(spark):
    df = clashing(docs(spark, odd_texts() * 3))
    assert rows(phrases.collocations(df, least=10)) == by_sql(df, SQL_10)
    assert phrases.collocations(docs(spark, [])).count() == 0
    assert phrases.collocations(docs(spark, [None, "", " . "])).count() == 0


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    monkeypatch.setattr(byte_words, "_WINDOW", 64)
    own = byte_words.WordHashes(b" .", 7)
    texts = ["abc Abc é" + "z" * 200 + " abc.", None, "", "x abc é" + "Z" * 200]
    (at, stop, text, starts), = byte_words.chunks(pa.array(texts))
    assert (at, stop) == (0, 4) and starts.tolist() == [0, 216, 217, 218]
    first, last, hashes = byte_words.WordHashes(b" .\n", 7).words(text)
    seen = {}
    for a, b, h in zip(first, last, hashes, strict=True):
        seen.setdefault(text[a:b].tobytes().lower(), set()).add(int(h))
    assert all(len(x) == 1 for x in seen.values()) and len(set.union(*seen.values())) == len(seen) == 3
    assert own.words(np.empty(0, np.uint8))[0].size == 0


def test_bitmap_never_misses(spark):
    keys = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 1000)
    bits = bitmap.bitmap(spark.createDataFrame([(int(k),) for k in keys], "h long"), "h", 16)
    assert bits.size == 1 << 13 and bitmap.may_hold(bits, keys.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert bitmap.may_hold(bits, others).mean() < 0.05
