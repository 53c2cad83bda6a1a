"""Text, vector and score functions on hand-made edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchwright.functions import scores, text, vectors


def column(spark, values, kind, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()]


def pairs(spark, rows, build, kind="array<double>"):
    df = spark.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(rows)], f"i int, a {kind}, b {kind}"
    )
    out = df.select("i", build(F.col("a"), F.col("b")).alias("y")).orderBy("i").collect()
    return [r.y for r in out]


def test_skill_set(spark):
    raw = [
        '{"technical_skills": [" Python ", "SQL", null], "soft_skills": ["Team"]}',
        '{"technical_skills": "Python, sql ,", "soft_skills": "team"}',
        "Python, SQL",
        '["Go", "go", ""]',
        "{broken",
        None,
        "",
        '"a, b"',
        "12",
        '{"soft_skills": ["x"]}',
    ]
    got = column(spark, raw, "string", text.skill_set)
    assert [sorted(g) for g in got] == [
        ["python", "sql", "team"],
        ["python", "sql", "team"],
        ["python", "sql"],
        ["go"],
        ["{broken"],
        [],
        [],
        ["a", "b"],
        [],
        ["x"],
    ]


def test_skills_document(spark):
    raw = [
        '{"technical_skills": [" Python "], "soft_skills": "Team, Talk"}',
        "A, B",
        '["C"]',
        '{"soft_skills": ["x"]}',
        None,
    ]
    got = column(spark, raw, "string", text.skills_document)
    assert [(r.technical_skills, r.soft_skills) for r in got] == [
        (["Python"], ["Team", "Talk"]),
        (["A", "B"], []),
        (["C"], []),
        ([], []),
        ([], []),
    ]


def test_vector_text(spark):
    raw = ["[1,2]", "1, 2.5", "[]", "null", "", "abc", None, "[1, 2"]
    assert column(spark, raw, "string", text.vector_or_null) == [
        [1.0, 2.0],
        [1.0, 2.5],
        [],
        [],
        [],
        None,
        None,
        [1.0, 2.0],
    ]
    assert column(spark, ["abc"], "string", text.vector_or_empty) == [[]]


def test_fit(spark):
    got = column(spark, [[1.0], [1.0, 2.0, 3.0], None], "array<double>", lambda v: vectors.fit(v, 2))
    assert got == [[1.0, 0.0], [1.0, 2.0], [0.0, 0.0]]


def test_names_and_texts(spark):
    names = ["My CV (1).PDF", "a/b/notes.v2.txt", ".hidden", "plain", "x."]
    assert column(spark, names, "string", text.file_extension) == ["pdf", "txt", "", "", ""]
    stems = column(spark, names[:2], "string", text.clean_stem)
    assert stems == ["My CV 1", "notesv2"]
    types = column(spark, [".PDF", "txt", "odt", None], "string", text.content_type)
    assert types == ["application/pdf", "text/plain"] + ["application/octet-stream"] * 2
    levels = ["Ph.D", "unknown", "Bachelors", "master's", "Nothing", None]
    assert column(spark, levels, "string", text.canonical_education) == [
        "PhD",
        "Other",
        "Bachelor",
        "Master",
        "Other",
        "Other",
    ]
    assert column(spark, [" A@b.C "], "string", text.email_hash_id) == [6119637]
    assert column(spark, ["a@b", " ", None, "ab"], "string", text.is_email) == [
        True,
        False,
        False,
        False,
    ]
    assert column(spark, ["7", " 5 ", "x", None, "3.7"], "string", text.int_or_zero) == [7, 5, 0, 0, 0]
    assert column(spark, ["a;b, c\n\n d"], "string", text.text_lines) == [["a", "b", "c", "d"]]
    skills = [["a"] * 5, ["a"] * 6]
    assert column(spark, skills, "array<string>", text.skill_preview) == [
        "a, a, a, a, a",
        "a, a, a, a, a...",
    ]
    assert [len(x) for x in column(spark, ["x" * 2000, "x" * 2001], "string", text.text_preview)] == [
        2000,
        2003,
    ]


def test_job_entries(spark):
    raw = ['[{"position": "Dev", "employer": "X", "period": "2y"}, {"title": "T"}]', "junk", None]
    got = column(spark, raw, "string", text.job_entries)
    assert [tuple(e) for e in got[0]] == [("Dev", "X", "2y"), ("T", "Company", "")]
    one = column(spark, ['{"title": "T", "job_title": "J"}'], "string", text.job_entry)
    assert tuple(one[0]) == ("J", "Company", "")


def test_complete_profile(spark):
    got = column(spark, ['{"email": "a@b", "schools": ["s"]}', "{}"], "string", text.complete_profile)
    assert (got[0].email, got[0].schools, got[0].city) == ("a@b", ["s"], "")
    assert (got[1].experience, got[1].first_name) == ([], "")


def test_decoding(spark):
    raw = [bytearray("é".encode()), bytearray("é".encode("latin-1")), bytearray()]
    assert column(spark, raw, "binary", text.decode_bytes) == ["é", "é", ""]


ROWS = [
    ([1.0, 2.0, 3.0], [2.0, 0.5, 1.0]),
    ([0.0, 0.0], [0.0, 0.0]),
    ([0.0, 0.0], [3.0, 4.0]),
    ([1.0, 0.0], [-1.0, 0.0]),
    ([1.0], [1.0, 2.0]),
    ([], []),
    (None, [1.0]),
]


def _unit(v):
    v = np.array(v)
    return v / (np.linalg.norm(v) + 1e-8)


def test_distances(spark):
    e = pairs(spark, ROWS, vectors.euclidean)
    c = pairs(spark, ROWS, vectors.cosine)
    m = pairs(spark, ROWS, vectors.manhattan)
    a, b = _unit(ROWS[0][0]), _unit(ROWS[0][1])
    assert e[0] == pytest.approx(np.linalg.norm(a - b))
    assert c[0] == pytest.approx(1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    assert m[0] == pytest.approx(np.abs(a - b).sum())
    assert e[1] == 0 and c[1] == math.inf
    assert e[3] == pytest.approx(2)
    assert e[4:] == [math.inf] * 3 and m[4:] == [math.inf] * 3
    w = pairs(spark, ROWS[:1], lambda x, y: vectors.weighted_euclidean(x, y, [1, 2, 3]))
    assert w[0] == pytest.approx(math.sqrt((np.array([1, 2, 3]) * (a - b) ** 2).sum()))
    short = pairs(spark, ROWS[:1], lambda x, y: vectors.weighted_euclidean(x, y, [1, 2]))
    assert short == [math.inf]
    with pytest.raises(ValueError):
        vectors.distance(F.col("a"), F.col("b"), "hamming")


def test_similarity(spark):
    s = pairs(spark, ROWS, vectors.vector_similarity)
    assert s[1] == 1.0
    assert s[2] == pytest.approx(math.exp(-0.5), abs=1e-6)
    assert s[3] == pytest.approx(math.exp(-2), abs=1e-6)
    assert s[4:] == [0.0] * 3
    d = [0.0, 1.0, 30.0, math.inf, math.nan, None]
    got = column(spark, d, "double", vectors.gaussian_similarity)
    assert got == pytest.approx([1.0, math.exp(-0.5), math.exp(-50), 0.0, 0.0, 0.0])


def test_rule_scores(spark):
    rows = [
        ("Sales", "sales", 5, 3, 0.9, 0.8, 0.5),
        ("sale", "Sales", 1, 3, 0.6, 0.6, 0.5),
        ("Sales", "sale", None, 0, 0.4, 0.6, 0.5),
        (None, "sale", 1, None, 0.4, 0.4, 0.5),
        ("", "sale", None, 1, 0.3, 0.4, 0.5),
        ("a", "a", 0, 1, 0.8, 0.8, 0.8),
    ]
    df = spark.createDataFrame(
        [(i, *r[:4]) for i, r in enumerate(rows)], "i int, a string, b string, y int, q int"
    )
    got = df.select(
        "i",
        scores.rule_score(F.col("a"), F.col("b"), F.col("y"), F.col("q")).alias("r"),
        scores.tier_score(F.col("a"), F.col("b")).alias("t"),
        scores.flag_score(F.col("a"), F.col("b")).alias("f"),
    ).orderBy("i")
    for row, want in zip(got.collect(), rows):
        assert (row.r, row.t, row.f) == pytest.approx(want[4:])


def test_overlap_and_grades(spark):
    rows = [(["a", "b"], ["a", "c"]), ([], ["a"]), (["a"], []), (None, ["a"]), (["a"], None)]
    assert pairs(spark, rows, scores.overlap, "array<string>") == [0.5, 0.0, 1.0, 0.0, 1.0]
    values = [0.3, 0.31, 0.6, 0.61, 0.8, 0.81, None]
    assert column(spark, values, "double", scores.status) == [
        "poor",
        "fair",
        "fair",
        "good",
        "good",
        "good",
        "poor",
    ]
    assert column(spark, values[2:], "double", scores.match_class) == [
        "average-match",
        "good-match",
        "good-match",
        "excellent-match",
        "average-match",
    ]
    assert column(spark, [0.5, None], "double", scores.percent_text) == ["50.0%", "N/A"]
    assert column(spark, [0.4125, 0.1], "double", scores.percent_1) == [41.2, 10.0]


def test_jitter(spark):
    df = spark.range(2000).select(
        scores.jitter([F.col("id")], -0.1, 0.1, 1).alias("a"),
        scores.jitter([F.col("id")], -0.1, 0.1, 1).alias("b"),
        scores.jitter([F.col("id")], -0.1, 0.1, 2).alias("c"),
    )
    rows = df.collect()
    a = np.array([r.a for r in rows])
    assert all(r.a == r.b for r in rows) and any(r.a != r.c for r in rows)
    assert a.min() >= -0.1 and a.max() < 0.1 and abs(a.mean()) < 0.01
