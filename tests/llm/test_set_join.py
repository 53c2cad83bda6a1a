"""The shingle set join against the similarity of all pairs."""

import random
import re

import numpy as np
import pytest
from helpers import clashing, docs, odd_texts
from pyspark.sql import functions as F

from matchwright.llm import set_join

SF = "/root/testdata/sf0.001"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def brute(table):
    sets = []
    for r in table:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().translate(LOWER))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(table)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(table)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for i, r in enumerate(table):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return sorted((str(r.doc_id), len(sets[i]), str(least.get(find(i)))) for i, r in enumerate(table))


def found(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in set_join.alike(df).collect())


def varied(seed):
    """Texts of 1 to 200 words; copies with words replaced around the limit, and chains of them."""
    rng = random.Random(seed)
    out = []
    for _ in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice((1, 4, 5, 6, 9, 14, 30, 60, 120, 200)))]
        out.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            copy = list(base)
            at = rng.randrange(len(copy))
            for i in range(rng.randrange(1, 2 + len(copy) // 10)):
                copy[(at + i) % len(copy)] = f"x{rng.randrange(3000)}"
            out.append(" ".join(copy))
            if rng.random() < 0.4:
                base = copy
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_all_pairs(spark, seed):
    df = docs(spark, varied(seed))
    assert found(df) == brute(df.collect())


def test_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(table) == brute(table.collect())


def test_every_cell_choice_finds_all(spark, monkeypatch):
    df = docs(spark, varied(4))
    want = brute(df.collect())
    for choice in set_join.CHOICES:
        monkeypatch.setattr(set_join, "CHOICES", (choice,))
        assert found(df) == want


def test_alike_sets_share_a_signature():
    rng = np.random.default_rng(1)
    ends = set_join.bands()
    for n in (3, 9, 25, 80, 300, 1500):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for _ in range(8):
            gone = int(rng.integers(0, n // 9 + 1))
            other = np.concatenate((base[gone:], rng.integers(0, 1 << 63, gone, dtype=np.uint64)))
            if 9 * np.intersect1d(base, other).size < 4 * (base.size + other.size):
                continue
            bands = {int(np.searchsorted(ends, x.size)) for x in (base, other)}
            j = max(bands)
            for choice in set_join.CHOICES:
                k = set_join.most_differing(j)
                n1 = -(-(k + 1) // (choice[1] + 1))
                a, b = (set_join.signatures(x, j, n1, *choice) for x in (base, other))
                assert np.intersect1d(a, b).size


def test_unrelated_sets_do_not_share_empty_cells():
    """Empty signatures are spared by nearly all sets of many, and alike sets still meet."""
    rng = np.random.default_rng(2)
    ends = set_join.bands()
    for n, many in ((300, 20000), (1200, 500000), (3000, 20000)):
        j = int(np.searchsorted(ends, n))
        n1, n2, k2 = set_join.plan(many, j)
        assert n1 - 1 > set_join.most_differing(j) // (k2 + 1)
        sets = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for _ in range(100)]
        signed = [np.unique(set_join.signatures(x, j, n1, n2, k2)) for x in sets]
        assert sum(np.intersect1d(a, b).size for i, a in enumerate(signed) for b in signed[:i]) <= 5
        for x, own in zip(sets[:10], signed, strict=False):
            gone = n // 9
            other = np.concatenate((x[gone:], rng.integers(0, 1 << 63, gone, dtype=np.uint64)))
            assert np.intersect1d(own, set_join.signatures(other, j, n1, n2, k2)).size


def test_few_large_sets_do_not_share_empty_cells():
    """Parities do not keep sets of so many shingles apart, so not many may meet."""
    rng = np.random.default_rng(3)
    for n, many in ((1100, 2000), (1400, 1800), (2200, 800), (4300, 500)):
        j = int(np.searchsorted(set_join.bands(), n)) + 1
        chosen = set_join.plan(many, j)
        signed = [np.unique(set_join.signatures(rng.integers(0, 1 << 63, n, dtype=np.uint64), j, *chosen)) for _ in range(60)]
        met = sum(bool(np.intersect1d(a, b).size) for i, a in enumerate(signed) for b in signed[:i])
        assert met <= 60 * 59 / 2 * 0.05


def test_sets_that_share_many_signatures_meet_once(spark):
    rng = np.random.default_rng(4)
    sigs = rng.integers(-(1 << 62), 1 << 62, 100).tolist()
    # Of 100 signatures each set has 60; the last two sets share one, the largest of both.
    held = [sorted(rng.choice(sigs, 60, replace=False).tolist()) for _ in range(40)]
    held += [[*range(-(1 << 63), 100 - (1 << 63)), 1 << 62], [*range(200 - (1 << 63), 300 - (1 << 63)), 1 << 62]]
    flat = [(s, i, i, 100, *[0] * set_join.SKETCH) for i, own in enumerate(held) for s in own]
    rows = spark.createDataFrame(flat, "sig long, sid long, known long, n long, " + set_join.SIGNED)
    met = [(r.a, r.b) for r in set_join.meeting(set_join.with_first(rows)).collect()]
    assert set(met) == {(i, j) for j in range(42) for i in range(j) if set(held[i]) & set(held[j])}
    assert len(met) <= 2 * len(set(met)) and (40, 41) in met


@pytest.mark.parametrize("more", [1, 3])
def test_spare_parts_lose_no_link(spark, monkeypatch, more):
    monkeypatch.setattr(set_join, "spare", lambda *_: more)
    df = docs(spark, varied(5))
    assert found(df) == brute(df.collect())


def test_a_large_group_of_near_copies_and_of_copies(spark):
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join([*base[:i], "other", *base[i + 1 :]]) for i in range(80)] * 5 + [" ".join(base)] * 300
    got = set_join.alike(docs(spark, texts)).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 700


def test_odd_tables(spark):
    df = clashing(docs(spark, odd_texts() + odd_texts()))
    assert found(df) == brute(df.collect())
    assert set_join.alike(docs(spark, [])).count() == 0
    named = df.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r.component_id for r in set_join.alike(named).filter("n_shingles > 0").collect()} <= {r.doc_id for r in named.collect()}
