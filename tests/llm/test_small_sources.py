"""Small sources beside a hot one come near their targets."""

from collections import Counter

from helpers import by_sql, docs, odd_texts, rows
from pyspark.sql import functions as F

from matchwright.llm import mixing


def test_small_sources_beside_millions_of_words(spark):
    texts = [(i, "w " * 100_000, "hot") for i in range(45)]
    texts += [(100 + i, "w " * 10, "tiny") for i in range(10)] + [(200 + i, "w " * 103, "uneven") for i in range(10)]
    texts += [(300, "w " * 7, None), (301, "w", "one"), (302, "", "none")]
    df = docs(spark, texts)
    mixed = mixing.mix(df)
    got = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    found = {r.source: r for r in got}
    assert {s: round(found[s].target) for s in ("tiny", "uneven", None, "one", "none")} == {"tiny": 300, "uneven": 3090, None: 21, "one": 3, "none": 0}
    for r in got:
        assert abs(r.taken - r.target) <= max(1, 0.02 * r.target)
    assert mixed.filter("taken > 3 * size").count() == 0
    assert mixed.filter("taken != aggregate(spans, 0L, (t, x) -> t + x.words)").count() == 0
    assert mixed.filter("exists(spans, x -> x.shard > 15)").count() == 0
    assert rows(mixed.select(*mixing.QUERY_COLUMNS)) == by_sql(df, mixing.ORACLE)


def words_by_row(df):
    """Rows of mix and of taken_texts by id, source and number of words."""
    mixed = mixing.mix(df)
    want = Counter((r.doc_id, r.source, r.taken) for r in mixed.collect() if r.taken)
    assert mixed.count() == df.count()
    return want, Counter((r.doc_id, r.source, len(r.text.split())) for r in mixing.taken_texts(df, mixed).collect())


def test_repeated_and_missing_ids(spark):
    texts = [f"{c} " * n for c, n in zip("abcdefgh", (3, 300, 40, 40, 5, 900, 1, 7), strict=True)]
    for ids in ((1, 1, 2, 3, 3, 3, 4, 5), (None,) * 8, (1, None, 1, None, 1, None, 1, None)):
        df = docs(spark, [(i, t, s) for i, t, s in zip(ids, texts, "aabbacab", strict=True)])
        want, got = words_by_row(df)
        assert got == want
        assert rows(mixing.mix(df).select(*mixing.QUERY_COLUMNS)) == by_sql(df, mixing.ORACLE)
        for r in mixing.taken_texts(df, mixing.mix(df)).collect():  # no row has words of another
            assert len(set(r.text.split())) == 1 and r.n_chars == len(r.text)
    want, got = words_by_row(docs(spark, odd_texts() * 2))
    assert got == want


def test_thousands_of_rows_under_one_id(spark):
    """Equal rows and different ones, over many parts: each row gets its own words once."""
    hot = [(7, "the same text of every row", "a")] * 4000 + [(None, f"t{i} " * (1 + i % 9), "a") for i in range(3000)]
    df = docs(spark, [*hot, *[(i, f"u{i} " * 20, "b") for i in range(100)]]).repartition(7)
    want, got = words_by_row(df)
    assert got == want
