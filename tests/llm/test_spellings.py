"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

from helpers import clashing, docs, odd_texts

from matchwright.llm import spellings

SF = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(table, shortest=7, least=2, ratio=10):
    counts = Counter()
    for r in table.collect():
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", r.text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if r.doc_id is None else r.doc_id}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    near = {w: [] for w in counts}
    for a, b in combinations(counts, 2):
        if abs(len(a) - len(b)) <= 1 and one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


def found(df):
    got = [tuple(r) for r in spellings.variants(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    got = found(table)
    assert got == brute(table) and sum(x[1] is not None for x in got) > 5


def test_every_edit_of_dense_words(spark):
    """Few letters, so that bigrams repeat and tie, and edits at every place."""
    rng = random.Random(5)
    words = set()
    for _ in range(60):
        base = "".join(rng.choice("abé") for _ in range(rng.randrange(7, 11)))
        words.add(base)
        for i in range(len(base)):
            words |= {base[:i] + base[i + 1 :], base[:i] + "b" + base[i:], base[:i] + "a" + base[i + 1 :]}
    df = docs(spark, [" ".join(sorted(words)), " ".join(sorted(words, reverse=True)), "aaaaaaa " * 40, "aaaaaaaa " * 900])
    assert found(df) == brute(df)


def test_chains_of_forms(spark):
    texts = ["abcdefgh " * 2, "abcdefghi " * 40, "abcdefghij " * 700, "abcdefghijk " * 9000]
    got = {x[0]: x for x in found(docs(spark, texts))}
    assert got["abcdefgh"][2] == got["abcdefghij"][2] == "abcdefghijk" and got["abcdefgh"][1] == "abcdefghi"


def test_pivots_are_disjoint_and_in_the_prefix():
    rng = random.Random(1)
    for _ in range(300):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(7, 15)))
        grams = [word[i : i + 2] for i in range(len(word) - 1)]
        weigh = {g: rng.randrange(1, 9) for g in sorted(set(grams))}
        order = {g: (i, c) for i, (g, c) in enumerate(sorted(weigh.items(), key=lambda x: (x[1], x[0])))}
        last, places, (p, q) = spellings.prefix_and_pivots(word, order)
        assert q - p >= 2 and {p, q} <= set(places) and len(places) >= 3
        assert weigh[grams[p]] + weigh[grams[q]] == min(weigh[grams[a]] + weigh[grams[b]] for a, b in combinations(places, 2) if b - a >= 2)
        assert all(order[grams[i]][0] <= last for i in places)


def test_odd_tables(spark):
    df = clashing(docs(spark, odd_texts() * 2 + [(None, "Ünsinnige Wörterei", "x"), "Ünsinnige wörtereI" * 2, "ab×cdefgh ab×cdefgh"]))
    assert found(df) == brute(df)
    assert spellings.variants(docs(spark, [])).count() == 0
    assert spellings.variants(docs(spark, [None, "short words only"])).count() == 0
