"""Neighbours, language, suffixes and near copies against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import clashing, docs, odd_texts
from pyspark.sql import functions as F

from matchwright.llm import components, language, neighbours, simhash, suffixes

SF = "/root/testdata/sf0.001"

# -- neighbours -------------------------------------------------------------------------


def vectors(spark, matrix, ids=None):
    ids = range(len(matrix)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, matrix, strict=True)], "vec_id long, embedding array<float>")


def exact(ids, matrix, k):
    matrix = np.asarray(matrix, dtype=np.float32).astype(np.float64)
    out = {}
    for i in np.flatnonzero(np.asarray(ids) % 20 == 0):
        score = matrix @ matrix[i]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), score[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    hits = sum(len({v for v, _ in got.get(q, [])} & {v for v, _ in w}) for q, w in want.items())
    return hits / max(1, sum(map(len, want.values())))


@pytest.mark.parametrize("scaled", [False, True])
def test_recall(spark, scaled):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(10, 48))
    m = centres[rng.integers(0, 10, 900)] + rng.normal(size=(900, 48)) * 1.5
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    if scaled:
        m *= rng.uniform(0.5, 3, size=(900, 1))
    ids = np.arange(900)
    got = found(neighbours.nearest(vectors(spark, m), F.col("id") % 20 == 0))
    want = exact(ids, m, 20)
    assert recall(got, want) >= 0.9
    for q, rows in got.items():
        assert len(rows) == 20 and q not in {v for v, _ in rows}
        assert rows == sorted(rows, key=lambda x: (-x[1], x[0]))


def test_places_of_a_hot_axis_are_split(spark):
    rng = np.random.default_rng(4)
    m = np.concatenate([np.tile(rng.normal(size=16), (150, 1)), rng.normal(size=(150, 16))])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    whole = found(neighbours.nearest(vectors(spark, m), F.col("id") % 20 == 0, k=5))
    split = found(neighbours.nearest(vectors(spark, m), F.col("id") % 20 == 0, k=5, place_rows=16, place_queries=3))
    assert whole == split
    assert [v for v, _ in whole[0]] == [1, 2, 3, 4, 5] and [v for v, _ in whole[20]] == [0, 1, 2, 3, 4]


def test_odd_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (6, [0.5, 0.5]), (7, [1.0, 0.0, 0.0]), (8, [-1.0, 0.0]), (None, [1.0, 1.0]), (20, [0.0, 1.0]), (6, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({n: F.lit(0) for n in ("id", "v", "t", "axis")})
    got = found(neighbours.nearest(df, F.col("id") % 20 == 0))
    assert {q: [v for v, _ in r] for q, r in got.items()} == {0: [6, 20, 8], 20: [6, 0, 8]}
    assert neighbours.nearest(df.filter("false"), F.col("id") % 20 == 0).count() == 0
    assert neighbours.nearest(df.filter("vec_id = 0"), F.col("id") % 20 == 0).count() == 0


# -- language ---------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(table, language.fit(table)).join(table.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got.lang == got.lang_pred)[got.held_out].mean() >= 0.98
    assert got.score.between(0, 1).all() and got.rejected.mean() < 0.01
    assert set(got.held_out[got.doc_id.map(lambda i: __import__("zlib").crc32(str(i).encode()) % 4 == 2)]) == {True}


def test_noise_is_rejected_and_nothing_else_decides(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(table)
    rng = random.Random(5)
    noise = ["".join(rng.choice("qxzjkvw") for _ in range(3)) + " " + "".join(rng.choice("ĦŊŦŽĐ") for _ in range(300)) for _ in range(5)]
    odd = clashing(docs(spark, odd_texts() + noise))
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in language.identify(odd, model).collect()]
    assert [x[1:] for x in got[:3]] == [("und", True)] * 3 and not got[7][2]
    assert all(x[2] for x in got[-5:])
    moved = odd.withColumns({"doc_id": F.col("doc_id") + 1000, "lang": F.lit("xx"), "source": F.lit("q")})
    again = [(r.doc_id - 1000 if r.doc_id is not None else None, r.lang_pred, r.rejected) for r in language.identify(moved, model).collect()]
    assert again == got
    kept = language.keep_identified(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(not x[2] for x in got)


def test_nothing_to_learn_from(spark):
    empty = docs(spark, [])
    assert language.identify(empty, language.fit(empty)).count() == 0
    unknown = docs(spark, ["some text", None]).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language.identify(unknown, language.fit(unknown)).collect()} == {("und", 0.0)}


# -- components and near copies ---------------------------------------------------------


def union_find(nodes, edges):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 340)] + [(400, i) for i in range(401, 440)] + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: r for n, r in union_find(linked, edges).items()}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def by_definition(text):
    import re

    import xxhash

    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in odd_texts():
        text = text[1] if isinstance(text, tuple) else text
        assert simhash.fingerprint(text) == by_definition(text)


def clusters(seed, n=300):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)] + [0, 1, 2**64 - 1]
    for base in out[:20]:
        for _ in range(30):
            v = base
            for _ in range(rng.randrange(1, 7)):
                v ^= 1 << rng.randrange(64)
            out.append(v)
    return sorted(set(out))


@pytest.mark.parametrize("radius", [1, 4])
def test_all_links_are_found(spark, radius):
    values = np.array(clusters(radius), dtype=np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    signed = values.view(np.int64)
    edges = [(int(signed[a]), int(signed[b])) for a, b in zip(*np.nonzero(near), strict=True) if a < b]
    want = Counter(union_find([int(x) for x in signed], edges).values())
    df = spark.createDataFrame([(int(x),) for x in signed], "fp long")
    got = {r.fp: r.root for r in simhash.linked(df, radius).collect()}
    groups = {}
    for fp, root in got.items():
        groups.setdefault(root, set()).add(fp)
    assert Counter({min(g): len(g) for g in groups.values()}) == want


@pytest.mark.parametrize("n", [10, 10**5, 10**9])
def test_plans_keep_the_pigeonhole(n):
    rng = np.random.default_rng(1)
    p = rng.uniform(0.2, 0.8, 64)
    together = np.outer(p, p) * n
    np.fill_diagonal(together, p * n)
    chosen = simhash.plan(n, together, 4)
    assert sum(t + 1 for _, t in chosen) == 5
    assert sorted(b for bits, _ in chosen for b in bits) == list(range(64))
    if n == 10**9:  # larger data get longer keys
        assert len(chosen) < 5


def test_near_duplicates_of_odd_tables(spark):
    df = docs(spark, odd_texts() * 2)
    got = simhash.near_duplicates(clashing(df)).collect()
    rows = df.collect()
    assert len(got) == len(rows)
    prints = [by_definition(r.text) for r in rows]
    root = union_find(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= 4])
    names = {}
    for i, r in enumerate(rows):
        names.setdefault(root[i], []).append(r.doc_id)
    want = Counter((r.doc_id, format(prints[i], "016x"), min((d for d in names[root[i]] if d is not None), default=None)) for i, r in enumerate(rows))
    assert Counter(map(tuple, got)) == want
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


def test_keep_one(spark):
    df = clashing(docs(spark, ["same text over and over again here"] * 5 + ["another text that has nothing in common"] + [None, ""]))
    kept = simhash.keep_one(df, words=5)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 5, 6]


# -- suffixes -----------------------------------------------------------------------------


def brute(rows, length):
    seen = Counter()
    for _, text in rows:
        data = (text or "").encode()
        seen.update(data[i : i + length] for i in range(len(data) - length + 1))
    out = Counter()
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if seen[data[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def shared_texts(seed):
    rng = random.Random(seed)
    base = "".join(rng.choice("abcdé ") for _ in range(1500))
    out = []
    for i in range(60):
        a, b = rng.randrange(1200), rng.randrange(1200)
        out.append((i, base[a : a + rng.randrange(500)] + "".join(rng.choice("ab") for _ in range(rng.randrange(200))) + base[b : b + rng.randrange(300)]))
    return out + [(100, None), (101, ""), (102, "a" * 700), (103, "ab" * 200), (104, base), (104, base), (105, "x" * 49), (None, "y" * 60), (106, "y" * 60)]


@pytest.mark.parametrize("shard_bytes", [400, 2 << 20])
def test_repeated_strings_equal_brute_force(spark, shard_bytes):
    rows = shared_texts(1)
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = suffixes.remove_repeats(df, 50, gram=16, shard_bytes=shard_bytes)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == brute(rows, 50)


def test_long_texts_are_cut_into_pieces(spark, monkeypatch):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdef") for _ in range(9000))
    rows = [(0, long), (1, long[4000:4300]), (2, long[2:9] + long[8000:])]
    import matchwright.llm.suffixes as own

    monkeypatch.setattr(own, "PIECE", 1000)
    got = own.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 50, gram=16)
    assert Counter(tuple(r)[:5] for r in got.collect()) == brute(rows, 50)


def test_no_long_string_at_all(spark):
    for rows in ([], [(1, "short"), (2, None)]):
        got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
        assert Counter(tuple(r)[:5] for r in got.collect()) == brute(rows, 200)
