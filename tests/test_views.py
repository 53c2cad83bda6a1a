"""Views, analytics and documents on hand-made rows, and the plans of key operators."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from checks import view_checks
from matchwright.operators import analytics as a
from matchwright.operators import documents as docs
from matchwright.operators import nearest, quantiles, rules, views
from matchwright.plans import dashboards

DAY = datetime(2024, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def people(spark):
    skills = "struct<technical_skills:array<string>,soft_skills:array<string>>"
    data = [
        (1, "Ann", "A", "IT", "Tunis", "Tunisia", 3, "Master", (["py", "sql", "py"], ["team"]), DAY),
        (2, "Bob", "B", "IT", "Paris", "France", 10, "PhD", (["py"], []), DAY),
        (3, "Cid", "C", "", "Lyon", "France", None, "", (["go", "sql"], ["talk", "team"]), datetime(2024, 1, 3)),
        (4, "Dan", "D", None, "", "", 3, None, None, None),
        (5, "Ann", "A", "IT", "Tunis", "Tunisia", 3, "Master", ([], None), DAY),
    ]
    return spark.createDataFrame(
        data,
        "candidate_id long, first_name string, last_name string, job_category string, city string, "
        f"country string, experience_years int, education_level string, skills {skills}, created_at timestamp",
    )


@pytest.fixture(scope="module")
def offers(spark):
    data = [
        (1, 7, "Dev", "X", "IT", "Contract", "active", datetime(2024, 1, 1)),
        (2, 7, "Ops", "Y", "IT", "Contract", None, datetime(2024, 1, 2)),
        (3, 8, "Rep", "X", None, "Full-time", "closed", None),
    ]
    return spark.createDataFrame(
        data,
        "job_offer_id long, client_id long, job_title string, company_name string, job_category string, job_type string, status string, created_at timestamp",
    )


@pytest.fixture(scope="module")
def matches(spark):
    data = [(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.61), (2, 2, 0.2), (2, 9, 1.05), (3, 1, 0.0)]
    return spark.createDataFrame(
        [(f"{c}-{o}", c, o, s, 1 - s, s, DAY, DAY) for c, o, s in data],
        "match_id string, candidate_id long, job_offer_id long, similarity_score double, distance double, overall_evaluation double, created_at timestamp, updated_at timestamp",
    )


def test_filters(people, offers):
    assert [r.job_offer_id for r in views.open_offers(offers).collect()] == [1]
    assert sorted(r.job_offer_id for r in views.open_offers(offers, True).collect()) == [1, 2]
    assert views.filled(people, "job_category").count() == 3
    assert views.known(people, "experience_years").count() == 4
    assert [r.job_offer_id for r in views.client_offers(offers, 7).collect()] == [2, 1]


@pytest.mark.parametrize(
    "criteria,found",
    [
        ({}, [1, 2, 3, 4, 5]),
        ({"min_experience": 4}, [2]),
        ({"education": "Master"}, [1, 5]),
        ({"location": "FRAN"}, [2, 3]),
        ({"location": "%"}, []),
        ({"skills": ["SQ", " "]}, [1, 3]),
        ({"skills": ["talk", "zzz"], "location": "lyon"}, [3]),
        ({"skills": ["technical"]}, []),
    ],
)
def test_search(people, matches, criteria, found):
    got = views.search_candidates(people, matches, **criteria).collect()
    assert sorted(r.candidate_id for r in got) == found


def test_search_ranking(people, matches):
    got = views.search_candidates(people, matches, limit=3).collect()
    assert [(r.candidate_id, r.total_matches) for r in got] == [(1, 2), (2, 3), (3, 1)]


def test_browse_and_lists(matches, offers, people):
    full = views.candidate_matches(matches, offers, 1)
    assert [r.job_title for r in full.collect()] == ["Dev", "Ops"]
    kept = views.browse_matches(full, 0.85, "Contract")
    assert [r.job_offer_id for r in kept.collect()] == [1]
    assert views.browse_matches(full, 0.5, "All", "Company Name").count() == 2
    listed = views.job_candidates(people, matches, 1).collect()
    assert [r.candidate_id for r in listed] == [1, 2, 3]
    sample = views.match_sample(matches, offers, 1).collect()
    assert {(r.candidate_id, r.job_title) for r in sample} == {(1, "Dev"), (2, None), (3, "Dev")}
    ranked = views.ranked_candidates(matches, people, 2).filter("job_offer_id = 1")
    assert [(r.position, r.label, r.match_class) for r in ranked.orderBy("position").collect()] == [
        (1, "\U0001f947", "excellent-match"),
        (2, "\U0001f948", "good-match"),
    ]


def test_skill_counts(people):
    assert [tuple(r) for r in a.skill_frequency(people).collect()] == [("py", 3), ("sql", 2), ("go", 1)]
    assert rows(a.mention_totals(people)) == [("Soft Skills", 3), ("Technical Skills", 6)]
    cells = {(r.skill_1, r.skill_2): r.candidates for r in a.co_occurrence(people, 3).collect()}
    assert len(cells) == 9
    assert cells[("py", "py")] == 2 and cells[("py", "sql")] == 1 and cells[("go", "py")] == 0
    two = {r.skill_1 for r in a.co_occurrence(people, 2).collect()}
    assert two == {"py", "sql"}
    assert [r.label for r in a.skill_ranks(people, n=2).collect()] == ["#1", "#2"]


def test_groups(people):
    assert rows(a.candidates_per_category(people)) == [("IT", 3)]
    assert rows(a.candidates_per_education(people)) == [("Master", 2), ("PhD", 1)]
    assert [tuple(r) for r in a.candidates_per_experience(people).collect()] == [(3, 3), (10, 1), (None, 1)]
    places = {(r.level, r.country, r.city): r.candidate_count for r in a.by_place(people).collect()}
    assert places[("country", "France", None)] == 2 and places[("city", "Tunisia", "Tunis")] == 2
    assert rows(a.experience_bubbles(people)) == [(3, "Master", "IT", 1), (10, "PhD", "IT", 1)]
    groups = a.experience_groups(people)
    assert groups.count() == 3
    s = a.experience_summary(groups).collect()[0]
    assert (s.total_candidates, s.avg_experience, s.min_experience) == (4, 19 / 4, 3)
    assert a.ungroup(groups).count() == 4
    five = a.five_numbers(groups, "job_category").collect()[0]
    assert tuple(five) == ("IT", 3.0, 3.0, 3.0, 6.5, 10.0)
    levels = {r.grouping for r in a.experience_rollups(groups).collect()}
    assert levels == {"year", "year_education", "category_year"}
    d = a.diversity(groups).collect()[0]
    assert (d["rows"], d.categories, d.show_detail, d.show_progression) == (3, 2, False, True)


def test_time(people):
    running = a.running_registrations(a.daily_registrations(people)).orderBy("date").collect()
    assert [(r.daily_count, r.cumulative) for r in running] == [(3, 3), (1, 4)]


def test_match_numbers(matches, offers, people, spark):
    bands = {r.band: r["count"] for r in a.score_histogram(matches).collect()}
    assert bands == {"Very Low": 1, "Low": 0, "Medium": 0, "High": 2, "Excellent": 1}
    borders = spark.createDataFrame([(x,) for x in (0.0, 0.2, 0.4, 0.6, 0.8, 1.0, 1.05)], "similarity_score double")
    assert {r["count"] for r in a.score_histogram(borders).collect()} == {1}
    s = {r.job_offer_id: r for r in a.offer_statistics(offers, matches).collect()}
    assert s[1].candidate_count == 3 and s[3].candidate_count == 0 and s[3].avg_score is None
    assert rows(a.top_companies(matches, offers)) == [("X", 3), ("Y", 2)]
    assert rows(a.categories_of_matches(matches, offers)) == [("IT", 5)]
    assert tuple(a.offer_status(offers).collect()[0]) == (3, 1, 1)
    q = {r.candidate_id: r for r in a.match_quality(matches).collect()}
    assert (q[1].excellent_matches, q[1].good_matches) == (1, 2)
    nothing = matches.limit(0)
    assert tuple(a.score_statistics(nothing).collect()[0]) == (0.0, 0)
    g = dashboards.global_statistics(people, offers, matches, offers).collect()[0]
    assert (g.nb_candidates, g.nb_offers, g.nb_matches, g.excellent_matches) == (5, 3, 6, 2)
    summary = {r.client_id: r for r in a.recruiter_summary(a.offer_statistics(offers, matches)).collect()}
    assert summary[7].total_candidates == 5 and summary[8].overall_avg_score is None


def test_completeness(people):
    extra = people.withColumn("experience", F.array(F.lit("x"))).withColumn(
        "certifications", F.lit(None).cast("array<string>")
    )
    got = {r.candidate_id: r for r in a.profile_completeness(extra).collect()}
    assert (got[1].skills_count, got[1].has_experience, got[1].has_certifications) == (4, True, False)
    assert (got[4].skills_count, got[4].has_skills) == (0, False)


def test_dashboards(people, offers, matches):
    with dashboards.cached(people):
        assert all(df.count() >= 0 for df in dashboards.skills_analytics(people).values())
    assert all(df.count() >= 0 for df in dashboards.experience_dashboard(people).values())
    assert all(df.count() >= 0 for df in dashboards.timeline_dashboard(people).values())
    assert dashboards.candidate_dashboard(matches, offers, 1)["matches"].count() == 2
    assert dashboards.recruiter_dashboard(matches, offers, 7)["statistics"].count() == 2


def test_a_third_of_the_matches_on_one_offer(spark):
    """Hot offer and hot score: results stay whole in every grouping."""
    n = 30_000
    offer = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500)
    score = F.when(F.col("id") % 3 == 0, F.lit(0.9)).otherwise((F.col("id") % 1000) / 1000.0)
    hot = spark.range(n, numPartitions=12).select(
        F.col("id").cast("string").alias("match_id"),
        F.col("id").alias("candidate_id"),
        offer.alias("job_offer_id"),
        score.alias("similarity_score"),
    )
    pdf = hot.toPandas()
    per_offer = pdf.groupby("job_offer_id").similarity_score.agg(["count", "mean", "max"])
    cards = spark.range(500).select(
        F.col("id").alias("job_offer_id"), F.lit(1).alias("client_id"), F.lit("t").alias("job_title")
    )
    got = {r.job_offer_id: r for r in a.offer_statistics(cards, hot).collect()}
    assert len(got) == 500 and got[0].candidate_count == per_offer.loc[0, "count"]
    assert got[0].avg_score == pytest.approx(per_offer.loc[0, "mean"])
    best = nearest.top_per_offer(hot, 15).collect()
    ranked = pdf.sort_values(["similarity_score", "candidate_id"], ascending=[False, True])
    want = ranked.groupby("job_offer_id").head(15)
    assert {(r.job_offer_id, r.candidate_id) for r in best} == set(
        zip(want.job_offer_id, want.candidate_id)
    )
    assert "WindowGroupLimit" in plan(nearest.top_per_offer(hot, 15))
    assert sum(r["count"] for r in a.score_histogram(hot).collect()) == (pdf.similarity_score > 0).sum()
    q = quantiles.exact_quantiles(hot, "similarity_score", [0.5, 0.9]).orderBy("probability")
    assert [r["quantile"] for r in q.collect()] == pytest.approx(
        list(pdf.similarity_score.quantile([0.5, 0.9]))
    )


# -- documents ----------------------------------------------------------------------


def test_files(spark, tmp_path):
    for name, content in {
        "a.txt": "café".encode(),
        "b.TXT": "café".encode("latin-1"),
        "d.txt": b" \n ",
        "e.pdf": b"%PDF",
        "f.odt": b"x",
        "g": b"x",
    }.items():
        (tmp_path / name).write_bytes(content)
    kept, rejected = docs.sort_files(docs.read_files(spark, str(tmp_path)))
    assert {r.filename: r.text for r in kept.collect()} == {"a.txt": "café", "b.TXT": "café"}
    assert {r.filename: r.reason for r in rejected.collect()} == {
        "d.txt": "no text in file",
        "e.pdf": "needs a document parser",
        "f.odt": "unsupported file format",
        "g": "unsupported file format",
    }


def test_empty_content_is_rejected(spark):
    # Spark's file reader skips files of length 0, so this shows only on other sources.
    files = spark.createDataFrame(
        [("p", "c.txt", "txt", 0, bytearray())],
        "path string, filename string, extension string, length long, content binary",
    )
    kept, rejected = docs.sort_files(files)
    assert kept.count() == 0 and rejected.collect()[0].reason == "empty file"


def test_language_of_unseen_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train, rest = d.filter("doc_id % 5 <> 0"), d.filter("doc_id % 5 = 0 AND n_chars > 50")
    tagged = docs.tag_language(rest, docs.language_profile(train)).join(rest, "doc_id")
    right, whole = tagged.filter("language = lang").count(), rest.count()
    assert right >= 0.95 * whole
    joined = docs.tag_language(rest, docs.language_profile(train), broadcast_rows=0)
    assert rows(joined) == rows(tagged.select("doc_id", "language"))
    blank = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert {r.language for r in docs.tag_language(blank, docs.language_profile(train)).collect()} == {"unknown"}


@pytest.mark.parametrize("broadcast_rows", [0, 1 << 20])
def test_language_ties_and_wide_characters(spark, broadcast_rows):
    known = spark.createDataFrame([("zz", "abc"), ("aa", "abc"), ("em", "x\U0001f600yz")], "lang string, text string")
    seen = spark.createDataFrame([(1, "abc"), (2, "\U0001f600yz"), (3, "qqq")], "doc_id long, text string")
    found = docs.tag_language(seen, docs.language_profile(known), broadcast_rows=broadcast_rows)
    assert {r.doc_id: r.language for r in found.collect()} == {1: "aa", 2: "em", 3: "unknown"}


def test_diversity_of_nothing(spark):
    none = spark.createDataFrame([], "experience_years int, job_category string, education_level string")
    assert [tuple(r) for r in a.diversity(none).collect()] == [(0, 0, False, False)]


def test_one_client_and_found_candidates_are_joined_before_aggregation(spark, people):
    matches = spark.createDataFrame([(1, 1, "m", 0.5)], "candidate_id long, job_offer_id long, match_id string, similarity_score double")
    p = plan(views.search_candidates(people, matches, 50, min_experience=3))
    assert "LeftSemi" in p


# -- plans --------------------------------------------------------------------------


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark, offers, tmp_path):
    offers.write.parquet(str(tmp_path / "o"))
    stored = spark.read.parquet(str(tmp_path / "o"))
    p = plan(views.open_offers(stored).select("job_offer_id"))
    assert "EqualTo(status,active)" in p and "ReadSchema: struct<job_offer_id:bigint,status:string>" in p


def test_no_cross_join_and_limits_before_the_shuffle(spark, people):
    wanted = spark.createDataFrame(
        [(1, "IT", 2)], "job_offer_id long, job_category string, experience_required int"
    )
    p = plan(rules.best_by_rule(people, wanted))
    assert "WindowGroupLimit" in p
    assert "CartesianProduct" not in p and "NestedLoop" not in p
    assert "Python" not in p and "InArrow" not in p
    vectors = spark.createDataFrame([(1, [1.0])], "candidate_id long, skills_vector array<double>")
    near = plan(
        nearest.best_candidates(vectors, vectors.withColumnRenamed("candidate_id", "job_offer_id"))
    )
    assert "WindowGroupLimit" in near and "CartesianProduct" not in near and "NestedLoop" not in near


def test_analytics_stay_in_the_jvm(people):
    for df in (a.skill_frequency(people), a.co_occurrence(people), a.by_place(people)):
        p = plan(df)
        assert "Python" not in p and "CartesianProduct" not in p and "NestedLoop" not in p


def test_lists_of_all_keys_are_sorted_once(spark):
    match = "candidate_id long, job_offer_id long, similarity_score double, created_at timestamp, distance double, overall_evaluation double"
    met = [(c, o, round((c * o) % 7 / 10, 1), DAY if o % 3 else None, 0.5, 0.5) for c in range(40) for o in range(1, 30)]
    matches = spark.createDataFrame(met + met[:50], match).repartition(7)
    posts = spark.createDataFrame([(o, f"Job {o}", f"Company {o % 4}", "IT") for o in range(1, 25)], "job_offer_id long, job_title string, company_name string, job_category string")
    names = spark.createDataFrame([(c, f"N{c}", f"{c}@x") for c in range(35)], "candidate_id long, first_name string, email string")

    class Made:
        def __getattr__(self, name):
            return lambda: {"matches": matches, "posts": posts, "people": names}[name]

    for listed, key, order in (
        (view_checks.j01_candidate_matches(Made()), "candidate_id", lambda r: (r[0], -r[2], r[3] is None, r[1])),
        (view_checks.j02_job_candidates(Made()), "job_offer_id", lambda r: (r[1], -r[2], r[0])),
    ):
        kept = [r for r in met + met[:50] if (r[1] < 25 if key == "candidate_id" else r[0] < 35)]
        want, at = [], {}
        for r in sorted(kept, key=order):
            own = r[0] if key == "candidate_id" else r[1]
            at[own] = at.get(own, 0) + 1
            want.append((at[own], *r[:3]))
        assert rows(listed.select("place", "candidate_id", "job_offer_id", "similarity_score")) == sorted(want)
        assert dict(listed.dtypes)["place"] == "int"
        plan = listed._jdf.queryExecution().executedPlan().toString()
        assert "Sort [" in plan and not [x for x in plan.splitlines() if "Sort [" in x and " _at#" in x]
