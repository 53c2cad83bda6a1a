"""The pipeline against its stages done by brute force, and the registered queries."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from helpers import clashing, docs, odd_texts, rows

from matchwright.llm import language, line_chunks, mixing, queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    cursor = db.execute(queries.SQL[name])
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    want = Counter(tuple(round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order) for r in cursor.fetchall())
    assert rows(queries.QUERIES[name](spark, SF)) == want


def test_all_thirteen_are_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)


def brute_language(spark, table):
    """Rows with a letter whose nearest centroid is near enough, one text at a time."""
    model = language.fit(table)
    out = []
    for r in table.collect():
        if r.text is None or not any(c.isalpha() for c in r.text):
            continue
        counts = language.trigrams(r.text)
        v = np.log1p(counts) * model.idf
        cosine = [float(v @ c) / float(np.linalg.norm(v)) for c in model.centroids]
        best = int(np.argmax(cosine))
        if 1 - min(1.0, max(0.0, cosine[best])) <= model.limits[best]:
            out.append(tuple(r[:2]) + (r.lang or model.langs[best],) + tuple(r[3:]))
    return Counter(out)


def brute_near(table):
    """The first row of each component of fingerprints at up to 4 bits, as op10 has them."""
    import xxhash

    found = table.collect()
    prints = []
    for r in found:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().lower())
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    root = list(range(len(found)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(found)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                keep, go = (x, y) if found[x].doc_id < found[y].doc_id else (y, x)
                root[go] = keep
    return Counter(tuple(r) for i, r in enumerate(found) if find(i) == i)


def brute_mix(spark, table):
    """Words from SQL's quotas: the number of words taken of each document."""
    taken = {r[0]: r[1] for r in duckdb_rows(table, f"SELECT doc_id, taken FROM ({mixing.ORACLE})") if r[1]}
    return taken


def duckdb_rows(table, sql):
    db = duckdb.connect()
    db.register("documents", table.toArrow())
    return db.execute(sql).fetchall()


def test_stages_by_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    columns = table.columns
    stage = dict(corpus_pipeline.STAGES)
    one = spark.createDataFrame(stage["language"](spark, table, SF).collect(), table.schema)
    assert Counter(tuple(r) for r in one.collect()) == brute_language(spark, table)

    two = spark.createDataFrame(stage["line_dedup"](spark, one, SF).collect(), table.schema)
    left = {r[0]: r for r in duckdb_rows(one, line_chunks.ORACLE)}
    want = Counter()
    for r in one.collect():
        _, _, gone, text = left[r.doc_id]
        if gone == 0 or re.search(r"[^\x20\x09-\x0D]", text):
            want[r.doc_id, text, r.lang, r.source, len(text) if gone else r.n_chars] += 1
    assert Counter(tuple(r) for r in two.collect()) == want

    three = spark.createDataFrame(stage["near_dedup"](spark, two, SF).collect(), table.schema)
    assert Counter(tuple(r) for r in three.collect()) == brute_near(two)

    four = spark.createDataFrame(stage["mixing"](spark, three, SF).collect(), table.schema)
    assert {r.doc_id: len(r.text.split()) for r in four.collect()} == brute_mix(spark, three)
    assert four.columns == columns

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    five = {r.doc_id: r for r in stage["pieces"](spark, four, SF).collect()}
    for r in four.collect():
        ids = library.encode(r.text, add_bos=True, add_eos=True)
        assert five[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert len(five) == four.count()


def test_pipeline_runs_over_the_documents(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 100
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "line_dedup", "near_dedup", "mixing", "pieces"]


def test_stages_take_odd_tables(spark):
    for texts in (odd_texts(), []):
        table = clashing(docs(spark, texts))
        for name, stage in corpus_pipeline.STAGES:
            table_out = stage(spark, table, SF)
            if name != "pieces":
                assert table_out.columns == table.columns
            table = spark.createDataFrame(table_out.collect(), table_out.schema)
