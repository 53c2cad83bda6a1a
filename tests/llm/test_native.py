"""Sentence spans, line chunks, mixing and quality rules against SQL on odd tables."""

import pytest
from helpers import by_sql, clashing, docs, odd_texts, rows
from pyspark.sql import functions as F

from matchwright.llm import line_chunks, mixing, quality, sentence_spans

CASES = {
    "sentences": (sentence_spans.dedup_sentences, sentence_spans.ORACLE, None),
    "lines": (line_chunks.dedup_lines, line_chunks.ORACLE, ["doc_id", "n_lines", "n_removed_lines", "text"]),
    "mixing": (mixing.mix, mixing.ORACLE, list(mixing.QUERY_COLUMNS)),
    "quality": (quality.quality, quality.ORACLE, None),
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CASES)
def test_odd_tables_equal_sql(spark, name):
    operator, sql, columns = CASES[name]
    df = docs(spark, [t for t in odd_texts() if not (isinstance(t, tuple) and t[0] is None)])
    got = operator(clashing(df))
    assert rows(got.select(*columns) if columns else got) == by_sql(df, sql)


@pytest.mark.parametrize("name", CASES)
def test_empty_table(spark, name):
    assert CASES[name][0](docs(spark, [])).count() == 0


@pytest.mark.parametrize("name", CASES)
def test_all_null(spark, name):
    df = docs(spark, [(None, None, None), (None, None, None), (1, None, "a")])
    assert CASES[name][0](df).count() == 3


def test_native_plans_hold_no_python(spark):
    df = docs(spark, odd_texts())
    for found in (line_chunks.dedup_lines(df), quality.quality(df)):
        p = plan(found)
        assert "Python" not in p and "Arrow" not in p and "CartesianProduct" not in p


def test_sentences_of_a_passage_stay_once(spark):
    passage = "The first sentence of it has quite a few words. The second one is about as long as that. A third ends it."
    df = docs(spark, ["Own start here. " + passage, passage + " Own end of this.", "Nothing in common with it at all. Really nothing."])
    left = {r.doc_id: r.text for r in sentence_spans.dedup_sentences(df).collect()}
    assert left[0].endswith(passage) and left[1] == "Own end of this." and left[2].startswith("Nothing")


def test_line_chunks_survive_a_shift(spark):
    body = "\n".join(f"line number {i} of the shared part with words" for i in range(60))
    df = docs(spark, [body, "an own line\n" + body, "another\nand one more\n" + body + "\nend"])
    left = {r.doc_id: r for r in line_chunks.dedup_lines(df).collect()}
    assert left[0].n_removed_lines == 0
    for i in (1, 2):  # all but the chunks at the seams
        assert left[i].n_removed_lines >= 45
    # Every line is somewhere once, and nothing else has gone.
    kept = set("\n".join(r.text for r in left.values()).split("\n"))
    assert kept >= set(body.split("\n"))


def test_equal_hashes_of_other_bytes_are_told_apart(spark, monkeypatch):
    """With a hash that knows two values every group mixes different chunks."""
    monkeypatch.setattr(line_chunks.F, "xxhash64", lambda *c: F.length(c[-1]).cast("long") % 2 if len(c) == 1 else F.hash(*c).cast("long"))
    body = "\n".join(f"line {i} of the shared part" for i in range(30))
    df = docs(spark, [body, body + "\nx", "own\n" + body])
    got = line_chunks.dedup_lines(df).select("doc_id", "n_lines", "n_removed_lines", "text")
    assert rows(got) == by_sql(df, line_chunks.ORACLE)


def test_kept_lines_keep_the_columns(spark):
    df = clashing(docs(spark, odd_texts()))
    assert line_chunks.keep_lines(df).columns == df.columns


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_mix_meets_its_targets(spark, block):
    texts = [(i, "w " * (i % 50), f"s{i % 7}") for i in range(700)]
    mixed = mixing.mix(docs(spark, texts), block_words=block)
    total = mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert abs(sum(r.target for r in total) - sum(i % 50 for i in range(700))) < 1e-6
    for r in total:
        assert abs(r.taken - r.target) <= max(6, 0.02 * r.target)
    assert mixed.filter("taken > 3 * size").count() == 0


def test_mix_caps_small_sources(spark):
    texts = [(0, "w " * 900, "a"), (1, "w " * 10, "b"), (2, "w " * 20, "c"), (3, None, "d"), (4, "w " * 5, None)]
    got = {r.doc_id: r for r in mixing.mix(docs(spark, texts)).collect()}
    # Weights 1, 2, 3, 1, 2 (NULL last); b, c and NULL stop at three times their size.
    assert [round(got[i].target) for i in range(5)] == [830, 30, 60, 0, 15]
    assert [got[i].taken for i in range(1, 5)] == [30, 60, 0, 15]


def test_seats_go_by_highest_quotients(spark):
    targets = spark.createDataFrame(
        [(f"s{i}", i, 10_000 * (i + 1), t, 150_000, 5) for i, t in enumerate([53_000.0, 24_000.0, 23_000.0, 49_900.0, 100.0])],
        "source string, place int, source_size long, target double, total long, sources long",
    )
    got = {r.place: r for r in mixing.shard_quotas(targets, block_words=1000, shards=4).collect()}
    block = next(iter(got.values())).block
    seats, order = {i: 0 for i in range(5)}, []
    goal = {i: t for i, t in enumerate([53_000.0, 24_000.0, 23_000.0, 49_900.0, 100.0])}
    for _ in range(150_000 // block):
        best = min(goal, key=lambda i: (-goal[i] / (2 * seats[i] + 1), i))
        seats[best] += 1
        order.append(best)
    for shard in range(4):
        upto = order[: len(order) * (shard + 1) // 4]
        assert [got[i].seats[shard] for i in range(5)] == [min(upto.count(i), 3 * -(-got[i].source_size // block)) for i in range(5)]


def test_taken_texts_hold_the_taken_words(spark):
    df = clashing(docs(spark, [(i, f"alpha{i}  beta\ngamma " * (i + 1), f"s{i % 3}") for i in range(60)]))
    mixed = mixing.mix(df, block_words=8)
    texts = mixing.taken_texts(df, mixed)
    assert texts.columns == df.columns
    want = {r.doc_id: r.taken for r in mixed.collect() if r.taken}
    assert {r.doc_id: len(r.text.split()) for r in texts.collect()} == want


def test_copies_do_not_make_boilerplate(spark):
    copy = "\n".join(" ".join(f"copied{i}x{j}" for j in range(12)) for i in range(6))
    footer = "subscribe to the newsletter of this host and read all about it"
    own = [" ".join(f"word{i}x{j}" for j in range(60)) + "\n" + footer for i in range(40)]
    df = docs(spark, [copy] * 40 + own + ["\n".join([footer] * 6)])
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    assert all(got[i].kept for i in range(80))
    assert all(got[i].n_boilerplate_lines == 1 for i in range(40, 80))
    assert not got[80].kept
