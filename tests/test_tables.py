"""Merging, writing, reading, streaming."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchwright import schema
from matchwright.operators import documents
from matchwright.operators import maintenance as m
from matchwright.plans import candidate_table, matching
from matchwright.sources import tables as src
from matchwright.streaming import arrivals

T1, T2, T3 = (datetime(2024, 1, d) for d in (1, 2, 3))
MATCH = "match_id string, candidate_id long, job_offer_id long, similarity_score double, distance double, overall_evaluation double, created_at timestamp, updated_at timestamp"


def match(spark, rows):
    full = [(f"{c}-{o}", c, o, s, None if s is None else 1 - s, s, at, at) for c, o, s, at in rows]
    return spark.createDataFrame(full, MATCH)


def seen(df):
    return {
        (r.candidate_id, r.job_offer_id): (r.similarity_score, r.created_at, r.updated_at)
        for r in df.collect()
    }


def test_upsert(spark):
    base = match(spark, [(1, 1, 0.5, T1), (1, 2, 0.6, T1)])
    new = match(spark, [(1, 2, 0.7, T2), (1, 2, 0.9, T3), (2, 1, None, T2)])
    once = m.upsert_matches(base, new)
    want = {(1, 1): (0.5, T1, T1), (1, 2): (0.9, T1, T3), (2, 1): (None, T2, T2)}
    assert seen(once) == want
    assert seen(m.upsert_matches(once, new)) == want
    assert once.columns == base.columns
    scores_only = m.upsert_matches(base, new, ["similarity_score"])
    assert seen(scores_only)[(1, 2)] == (0.9, T1, T1)
    lost = m.upsert_matches(base, match(spark, [(1, 1, None, T2)]))
    assert seen(lost)[(1, 1)] == (None, T1, T2)


def test_delete(spark):
    base = match(spark, [(1, 1, 0.5, T1), (2, 2, 0.6, T1)])
    gone = spark.createDataFrame([(2,), (2,)], "candidate_id long")
    assert set(seen(m.delete_by_key(base, gone, ["candidate_id"]))) == {(1, 1)}


def test_assigned_ids_are_dense_and_repeatable(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("name"))
    ids = [m.assign_ids(rows.repartition(n), "id", ["name"], F.lit(10)) for n in (2, 7)]
    first, second = ({r.name: r.id for r in df.collect()} for df in ids)
    assert first == second
    assert sorted(first.values()) == list(range(11, 5011))
    empty = m.assign_ids(rows.limit(0), "id", ["name"], F.lit(None).cast("bigint"))
    assert empty.count() == 0


def test_locations(spark):
    region = spark.createDataFrame(
        [(4, "Tunis", "Tunisia", "Africa", T1, T1)],
        "location_id long, city string, country string, continent string, created_at timestamp, updated_at timestamp",
    )
    people = spark.createDataFrame(
        [(1, " Tunis ", "Tunisia"), (2, "", "France"), (3, None, None), (4, "Lyon", " "), (5, "Lyon", None)],
        "candidate_id long, city string, country string",
    )
    grown = m.add_locations(region, people)
    places = {(r.city, r.country): (r.location_id, r.continent) for r in grown.collect()}
    assert places[("Tunis", "Tunisia")] == (4, "Africa")
    assert set(places) == {
        ("Tunis", "Tunisia"),
        ("Unknown", "France"),
        ("Unknown", "Unknown"),
        ("Lyon", "Unknown"),
    }
    assert sorted(i for i, _ in places.values()) == [4, 5, 6, 7]
    assert places[("Lyon", "Unknown")][1] == "Unknown"
    keys = {r.candidate_id: r.location_id for r in m.with_location_id(people, grown).collect()}
    assert keys[1] == 4 and keys[3] is None and keys[4] == keys[5] is not None
    again = m.add_locations(grown, people)
    assert again.count() == 4


def test_skills(spark):
    skills = spark.createDataFrame([(7, "Python", "technical", T1)], "skill_id long, name string, skill_type string, updated_at timestamp")
    wanted = spark.createDataFrame(
        [("python ", "Technical"), ("SQL", "technical"), (" sql", "technical"), ("Team", "SOFT")],
        "name string, skill_type string",
    )
    got = {(r.name, r.skill_type): r.skill_id for r in m.add_skills(skills, wanted).collect()}
    assert got[("Python", "technical")] == 7
    assert set(got) == {("Python", "technical"), ("SQL", "technical"), ("Team", "soft")}
    assert sorted(got.values()) == [7, 8, 9]


def test_upsert_candidates(spark):
    base = spark.createDataFrame(
        [(3, "a@x", "Ann", "IT", 4, T1, T1, True)],
        "candidate_id long, email string, first_name string, job_category string, experience_years int, created_at timestamp, updated_at timestamp, visibility_setting boolean",
    )
    profiles = spark.createDataFrame(
        [
            (" a@x ", "Anna", None, "5", 1),
            ("a@x", "Anne", "Sales", "x", 2),
            ("b@x", "Bob", "IT", "2", 1),
            ("nobody", "N", "IT", "1", 1),
            (None, "N", "IT", "1", 1),
        ],
        "email string, first_name string, job_category string, experience_years string, arrival int",
    )
    now = F.lit(T3)
    out = {r.email: r for r in m.upsert_candidates(base, profiles, ["arrival"], now).collect()}
    assert set(out) == {"a@x", "b@x"}
    a, b = out["a@x"], out["b@x"]
    assert (a.candidate_id, a.first_name, a.job_category, a.experience_years) == (3, "Anne", "Sales", 0)
    assert (a.created_at, a.updated_at, a.visibility_setting) == (T1, T3, True)
    assert (b.candidate_id, b.experience_years, b.created_at, b.visibility_setting) == (4, 2, T3, True)
    assert m.split_valid(profiles)[1].count() == 2


# -- sources ------------------------------------------------------------------------


def test_replace_a_table_that_is_read(spark, tmp_path):
    path = str(tmp_path / "t")
    src.append_rows(spark.range(10), path)
    stored = src.read_table(spark, path)
    fresh = src.replace_table(stored.filter("id > 6"), path)
    assert sorted(r.id for r in fresh.collect()) == [7, 8, 9]
    src.append_rows(spark.range(1), path)
    assert src.read_table(spark, path).count() == 4


def test_a_table_of_another_shape_is_refused(spark, tmp_path):
    path = str(tmp_path / "m")
    match(spark, [(1, 1, 0.5, T1)]).withColumn("more", F.lit(1)).write.parquet(path)
    assert src.read_table(spark, path, schema.JOB_MATCHES).columns == schema.JOB_MATCHES.fieldNames()
    with pytest.raises(ValueError, match="location_id"):
        src.read_table(spark, path, schema.REGION)


def test_replace_partitions_only(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.range(4).withColumn("part", F.col("id") % 2)
    src.replace_partitions(df, path, ["part"])
    src.replace_partitions(spark.range(10, 11).withColumn("part", F.lit(1).cast("long")), path, ["part"])
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 2, 10]


def test_csv_export(spark, tmp_path):
    listed = spark.createDataFrame(
        [("A", "B", "a@b", "1", "X", "Y", "Master", 3, 0.8125)],
        "first_name string, last_name string, email string, phone string, city string, country string, education_level string, experience_years int, similarity_score double",
    )
    path = str(tmp_path / "csv")
    src.export_csv(src.candidate_export(listed), path)
    back = spark.read.option("header", True).csv(path).collect()
    assert back[0].match_percentage == "81.2" and "similarity_score" not in back[0].asDict()


def test_jdbc_options():
    o = src.jdbc_options("jdbc:x:y", "candidates", "d.Driver", "u", "p", "id", 0, 100, 8)
    assert (o["dbtable"], o["numPartitions"], o["upperBound"]) == ("candidates", "8", "100")
    with pytest.raises(ValueError):
        src.jdbc_options("u", "t", "d", partition_column="id")


def test_rows_and_schema(spark):
    df = src.from_rows(spark, [{"client_id": 1, "company_name": "A"}, {"client_id": 2}], schema.CLIENTS)
    assert [tuple(r) for r in df.collect()] == [(1, "A"), (2, None)]
    assert schema.missing_or_mistyped(df, schema.CLIENTS) == []
    assert "city" in schema.missing_or_mistyped(df, schema.REGION)
    assert schema.conform(df, schema.REGION).schema == schema.REGION


def test_shared_folder_is_the_sessions(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert src.shared_folder(spark) == named
    path = src.new_folder(spark, "x")
    assert path.startswith(named)
    assert src.staged(spark.range(3), "three").count() == 3
    assert any(f.startswith("three-") for f in os.listdir(named))


def test_merge_rewrites_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "matches")
    matching.create_match_table(match(spark, [(1, o, 0.5, T1) for o in range(40)]), path, 8)
    before = {f: set(os.listdir(os.path.join(path, f))) for f in os.listdir(path) if "=" in f}
    new = match(spark, [(1, 3, 0.9, T2), (2, 3, 0.4, T2), (1, 3, 0.7, T1)])
    matching.merge_into_match_table(new, path, 8)
    after = {f: set(os.listdir(os.path.join(path, f))) for f in before}
    assert sum(before[f] != after[f] for f in before) == 1
    got = seen(spark.read.parquet(path))
    assert len(got) == 41
    assert got[(1, 3)] == (0.9, T1, T2) and got[(2, 3)] == (0.4, T2, T2)


def test_the_table_knows_its_buckets(spark, tmp_path):
    path = str(tmp_path / "matches")
    stored = match(spark, [(1, o, 0.5, T1) for o in range(50)])
    matching.create_match_table(stored, path, 16)
    again = match(spark, [(1, o, 0.9, T2) for o in range(50)])
    with pytest.raises(ValueError):
        matching.merge_into_match_table(again, path, 8)
    matching.merge_into_match_table(again, path)
    got = seen(spark.read.parquet(path))
    assert spark.read.parquet(path).count() == len(got) == 50
    assert {v[0] for v in got.values()} == {0.9}


def test_a_repeated_batch_without_result_leaves_nothing(spark, tmp_path):
    arriving, path = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1,), (2,)], "candidate_id long").write.parquet(arriving)
    rows = arrivals.file_arrivals(spark, arriving, spark.read.parquet(arriving).schema)

    def found(minimum):
        return lambda batch: batch.select(
            "candidate_id", F.lit(7).cast("long").alias("job_offer_id"), F.lit(0.5).alias("similarity_score")
        ).filter(F.col("similarity_score") >= minimum)

    # The same batch number twice, as after a failure: fresh checkpoints replay it.
    for step, minimum, left in (("a", 0.0, 2), ("b", 0.9, 0)):
        arrivals.start_matching(rows, found(minimum), path, str(tmp_path / step)).awaitTermination()
        assert arrivals.stored_matches(spark, path).count() == left


def test_job_folder_is_empty_afterwards(spark):
    with src.job_folder(spark) as folder:
        assert src.staged(spark.range(3), "x").count() == 3
        assert os.listdir(folder)
    assert not os.path.exists(folder)


def test_profiles_are_stored_with_their_place(spark, tmp_path):
    people, places = str(tmp_path / "people"), str(tmp_path / "places")
    arriving, out = str(tmp_path / "in"), str(tmp_path / "out")
    base = spark.createDataFrame(
        [(1, "a@x.org", "Ann", "Tunis", "Tunisia", None, None)],
        "candidate_id long, email string, job_category string, city string, country string, skills_vector array<double>, location_id long",
    ).withColumn("skills", F.struct(F.array(F.lit("s")).alias("technical_skills"), F.array(F.lit("t")).alias("soft_skills")))
    candidate_table.create(base, people, 16)
    spark.createDataFrame([(4, "Tunis", "Tunisia", "Africa", T1, T1)], "location_id long, city string, country string, continent string, created_at timestamp, updated_at timestamp").write.parquet(places)
    spark.createDataFrame(
        [("a@x.org", "Sales", " Lyon", "France", "Europe", [1.0, 0.0], 1), ("b@x.org", "IT", "Tunis", "Tunisia", None, [0.0, 1.0], 2)],
        "email string, job_category string, city string, country string, continent string, skills_vector array<double>, at int",
    ).withColumn("skills", F.struct(F.array(F.lit("s")).alias("technical_skills"), F.array(F.lit("t")).alias("soft_skills"))).write.parquet(arriving)
    offers = spark.createDataFrame(
        [(10, [1.0, 0.0], ["s"], "active", "Sales", T1)],
        "job_offer_id long, skills_vector array<double>, skill_set array<string>, status string, job_category string, created_at timestamp",
    )
    rows = arrivals.file_arrivals(spark, arriving, spark.read.parquet(arriving).schema)
    for step in ("a", "b"):  # the second run repeats the batch
        arrivals.start_intake(rows, people, places, lambda: offers, out, str(tmp_path / step), ["at"]).awaitTermination()
        stored = {r.email: r for r in spark.read.parquet(people).collect()}
        assert {e: (r.candidate_id, r.location_id, r.job_category) for e, r in stored.items()} == {"a@x.org": (1, 5, "Sales"), "b@x.org": (2, 4, "IT")}
        assert {(r.city, r.country): r.continent for r in spark.read.parquet(places).collect()} == {("Tunis", "Tunisia"): "Africa", ("Lyon", "France"): "Europe"}
        found = {(r.candidate_id, r.job_offer_id): round(r.similarity_score, 6) for r in arrivals.stored_matches(spark, out).collect()}
        assert found[(1, 10)] == 1.0


def _stored_people(spark, path, n=60, buckets=16):
    rows = [(i, f"p{i}@x.org", f"P{i}", "IT", 0) for i in range(1, n)] + [(n, None, "nobody", "IT", 0)]
    base = spark.createDataFrame(rows, "candidate_id long, email string, first_name string, job_category string, experience_years int")
    candidate_table.create(base, path, buckets)
    return base


def _files(path):
    return {f"{os.path.basename(d)}/{f}" for d, _, names in os.walk(path) for f in names if f.startswith("part-") and "/_" not in d}


PROFILE = "email string, first_name string, job_category string, experience_years string, at int"


def test_candidate_table_rewrites_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "people")
    _stored_people(spark, path)
    assert len({f.split("/")[0] for f in _files(path)}) == 16
    profiles = [(" p3@x.org", "Three", "Sales", "4", 1), ("p3@x.org ", "Drei", "Sales", "5", 2), ("new@x.org", "New", None, None, 1), ("broken", "No", None, None, 1)]
    batch = spark.createDataFrame(profiles, PROFILE)
    want = {r.email: tuple(r) for r in m.upsert_candidates(candidate_table.read(spark, path), batch, ["at"]).collect()}
    before = _files(path)
    touched = {r.email: tuple(r) for r in candidate_table.upsert(batch, path, ["at"]).collect()}
    assert set(touched) == {"p3@x.org", "new@x.org"} and touched["new@x.org"][0] == 61
    assert {r.email: tuple(r) for r in candidate_table.read(spark, path).collect()} == want
    gone = {f.split("/")[0] for f in before - _files(path)}
    spots = candidate_table.bucketed(spark.createDataFrame([(e,) for e in touched], "email string"), 16)
    assert gone == {f"email_bucket={r.email_bucket}" for r in spots.collect()} and len(gone) <= 2
    # The same batch again, as after a failure: the same ids and rows.
    assert {r.email: tuple(r) for r in candidate_table.upsert(batch, path, ["at"]).collect()} == touched
    assert {r.email: tuple(r) for r in candidate_table.read(spark, path).collect()} == want
    later = spark.createDataFrame([("z@x.org", "Z", "IT", "1", 1)], PROFILE)
    assert [r.candidate_id for r in candidate_table.upsert(later, path, ["at"]).collect()] == [62]


def test_candidate_table_reads_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "people")
    _stored_people(spark, path)
    some = candidate_table.partitions_of(spark, path, [2, 5])
    assert "PartitionFilters" in explained(some) and "email_bucket#" in explained(some).split("PartitionFilters")[1].split("]")[0]


def explained(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_candidate_table_after_a_lost_batch(spark, tmp_path):
    """Ids that a failed batch reserved are not given to another address."""
    path = str(tmp_path / "people")
    _stored_people(spark, path)
    src.put_mark(spark, f"{path}/_ids", 70)
    batch = spark.createDataFrame([("new@x.org", "New", None, None, 1)], PROFILE)
    assert [r.candidate_id for r in candidate_table.upsert(batch, path, ["at"]).collect()] == [71]
    nothing = spark.createDataFrame([("broken", "No", None, None, 1), (None, "No", None, None, 2)], PROFILE)
    assert candidate_table.upsert(nothing, path, ["at"]).count() == 0
    assert candidate_table.read(spark, path).count() == 61
    plain = str(tmp_path / "plain")
    candidate_table.read(spark, path).write.parquet(plain)
    with pytest.raises(ValueError, match="candidate_table.create"):
        candidate_table.upsert(batch, plain, ["at"])


def test_rejected_files_are_not_read(spark, tmp_path):
    for name, body in (("a.txt", b"text"), ("b.pdf", b"%PDF"), ("c.txt", b"  "), ("d.xyz", b"?")):
        (tmp_path / name).write_bytes(body)
    kept, rejected = documents.sort_files(documents.read_files(spark, str(tmp_path)))
    assert [(r.filename, r.text) for r in kept.collect()] == [("a.txt", "text")]
    assert {(r.filename, r.reason) for r in rejected.collect()} == {
        ("b.pdf", "needs a document parser"), ("c.txt", "no text in file"), ("d.xyz", "unsupported file format")
    }
    refused = rejected.filter("reason != 'no text in file'")
    scans = [x for x in explained(refused).split("ReadSchema: ")[1:]]
    assert any("content" not in x.split("\n")[0] for x in scans)


def test_empty_candidate_table(spark, tmp_path):
    path = str(tmp_path / "people")
    base = spark.createDataFrame([], "candidate_id long, email string, first_name string, job_category string, experience_years int")
    candidate_table.create(base, path, 4)
    batch = spark.createDataFrame([(f"n{i}@x.org", "New", None, None, 1) for i in range(9)], PROFILE)
    candidate_table.upsert(batch, path, ["at"])
    assert sorted(r.candidate_id for r in candidate_table.read(spark, path).collect()) == list(range(1, 10))


def test_places_are_appended(spark, tmp_path):
    path = str(tmp_path / "places")
    spark.createDataFrame([(4, "Tunis", "Tunisia", "Africa", T1, T1)], "location_id long, city string, country string, continent string, created_at timestamp, updated_at timestamp").write.parquet(path)
    before = _files(path)
    batch = spark.createDataFrame([(" Lyon", "France", None), ("Tunis", "Tunisia", None), (None, "", None)], "city string, country string, continent string")
    for _ in range(2):
        got = {(r.city, r.country): r.location_id for r in candidate_table.add_places(path, batch).collect()}
        assert got[("Tunis", "Tunisia")] == 4 and len(got) == 3 and before < _files(path)


def test_match_table_jobs(spark):
    people = spark.createDataFrame(
        [(1, [1.0, 0.0], ["a"]), (2, [0.0, 1.0], ["b"])],
        "candidate_id long, skills_vector array<double>, skill_set array<string>",
    )
    offers = spark.createDataFrame(
        [(10, [1.0, 0.0], ["a"], "active"), (11, [0.0, 1.0], ["b"], "closed")],
        "job_offer_id long, skills_vector array<double>, skill_set array<string>, status string",
    )
    whole = matching.refresh_all(people, offers)
    assert {k: round(v[0], 4) for k, v in seen(whole).items()} == {(1, 10): 1.0, (2, 10): 0.3679}
    stored = match(spark, [(1, 10, 0.3, T1), (9, 9, 0.3, T1)])
    renewed = seen(matching.refresh_selected(stored, people.filter("candidate_id = 1"), offers))
    assert set(renewed) == {(1, 10), (9, 9)}
    assert round(renewed[(1, 10)][0], 6) == 1.0 and renewed[(1, 10)][1] == T1
    fresh = offers.filter("job_offer_id = 11").withColumn("status", F.lit("active"))
    grown = matching.after_new_offers(stored, people, fresh, k=1)
    assert set(seen(grown)) == {(1, 10), (9, 9), (2, 11)}


def test_profile_intake(spark):
    kind = "struct<technical_skills:array<string>,soft_skills:array<string>>"
    base = spark.createDataFrame(
        [(3, "a@x", "IT", [1.0, 0.0], (["py"], [])), (4, "z@x", "IT", [1.0, 0.0], (["py"], []))],
        f"candidate_id long, email string, job_category string, skills_vector array<double>, skills {kind}",
    )
    profiles = spark.createDataFrame(
        [("a@x ", "IT", [0.0, 1.0], (["go"], []), 1), ("n@x", "Sales", None, (["Go"], None), 2)],
        f"email string, job_category string, skills_vector array<double>, skills {kind}, arrival int",
    )
    offers = spark.createDataFrame(
        [(10, "IT", "active", [0.0, 1.0], ["go"], T1)],
        "job_offer_id long, job_category string, status string, skills_vector array<double>, skill_set array<string>, created_at timestamp",
    )
    stored, found = matching.profile_intake(base, profiles, offers, ["arrival"])
    ids = {r.email: r.candidate_id for r in stored.collect()}
    assert ids == {"a@x": 3, "z@x": 4, "n@x": 5}
    got = {(r.candidate_id, r.job_offer_id, r.tier): round(r.similarity_score, 6) for r in found.collect()}
    assert got == {(3, 10, 1): 1.0, (5, 10, 1): 1.0}


# -- streams ------------------------------------------------------------------------

PERSON = T.StructType(
    [
        T.StructField("candidate_id", T.LongType()),
        T.StructField("job_category", T.StringType()),
        T.StructField("skills_vector", T.ArrayType(T.DoubleType())),
        T.StructField("skill_set", T.ArrayType(T.StringType())),
    ]
)


def test_stream_equals_batch_and_replays(spark, tmp_path):
    people = [(i, "IT", [float(i % 3), 1.0], ["a"]) for i in range(9)] + [(9, "IT", None, ["z"])]
    inbox = str(tmp_path / "inbox")
    spark.createDataFrame(people, PERSON).repartition(3).write.parquet(inbox)
    offers = spark.createDataFrame(
        [(100, "IT", "active", [1.0, 1.0], ["a"], T1), (101, "IT", "active", [0.0, 1.0], ["b"], T2)],
        "job_offer_id long, job_category string, status string, skills_vector array<double>, skill_set array<string>, created_at timestamp",
    )
    matcher = arrivals.on_new_profiles(lambda: offers, min_similarity=0.9)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    stream = arrivals.file_arrivals(spark, inbox, PERSON, files_per_batch=1)
    arrivals.start_matching(stream, matcher, out, mark).awaitTermination()
    stored = arrivals.stored_matches(spark, out)
    got = {
        (r.candidate_id, r.job_offer_id): round(r.similarity_score, 6)
        for r in arrivals.current_matches(stored).collect()
    }
    batch = matcher(spark.createDataFrame(people, PERSON))
    want = {(r.candidate_id, r.job_offer_id): round(r.similarity_score, 6) for r in batch.collect()}
    assert got == want
    # The candidate without a vector and without a common skill falls to the second tier.
    assert got[(9, 100)] == 0.8
    versions = stored.count()
    # The same batches once more, as after a lost checkpoint: nothing doubles.
    again = arrivals.file_arrivals(spark, inbox, PERSON, files_per_batch=1)
    arrivals.start_matching(again, matcher, out, str(tmp_path / "mark2")).awaitTermination()
    stored = arrivals.stored_matches(spark, out)
    assert stored.count() == versions
    assert arrivals.current_matches(stored).count() == len(want)


def test_newest_version_wins(spark):
    rows = match(spark, [(1, 1, 0.5, T1)]).withColumn("batch_id", F.lit(0).cast("long"))
    later = match(spark, [(1, 1, 0.7, T2)]).withColumn("batch_id", F.lit(1).cast("long"))
    assert seen(arrivals.current_matches(rows.unionByName(later))) == {(1, 1): (0.7, T1, T2)}


def test_language_by_join_sends_trigrams_once_for_a_part(spark, monkeypatch):
    from matchwright.operators import documents as d

    monkeypatch.setattr(d, "PART_CHARACTERS", 40)
    rows = [(i, "the cat and the dog" if i % 2 else "le chat et le chien", "en" if i % 2 else "fr") for i in range(30)]
    rows += [(None, "the cat", "en"), (1, "le chat", "fr"), (99, "", "en"), (98, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = d.tag_language(docs, d.language_profile(docs), broadcast_rows=0)
    assert "FlatMapCoGroupsInPandas" in found._jdf.queryExecution().executedPlan().toString()
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.language) for r in found.collect())
    names = {i: "en" if i % 2 else "fr" for i in range(30)} | {98: "unknown", 99: "unknown"}
    expected = [(True, i, n) for i, n in names.items()] + [(True, 1, "en"), (False, 0, "unknown")]
    assert got == sorted(expected)


def test_latest_per_key_sends_each_value_once(spark):
    from matchwright.operators import maintenance

    rows = spark.createDataFrame([(1, 2.0, "a"), (1, 3.0, "b"), (2, None, "c")], "k long, at double, v string")
    found = maintenance.latest_per_key(rows, ["k"], ["at"])
    assert "max_by" not in found._jdf.queryExecution().analyzed().toString()
    assert sorted((r.k, r.v) for r in found.collect()) == [(1, "b"), (2, "c")]


def test_written_files_are_dealt_over_folders(spark, tmp_path):
    from matchwright.operators import documents as d

    rows = spark.createDataFrame([(i, f"text {i}") for i in range(12)], "doc_id long, text string")
    d.write_files(rows, str(tmp_path / "files"), "doc_id")
    found = d.read_files(spark, f"{tmp_path}/files/{d.FOLDER}=*").collect()
    assert sorted(bytes(r.content).decode() for r in found) == sorted(f"text {i}\n" for i in range(12))
    assert len({r.path.split(f"{d.FOLDER}=")[1].split("/")[0] for r in found}) > 1


def test_tasks_put_files_in_place(spark, tmp_path, monkeypatch):
    """One file a key, also for equal keys, odd names and no text; few tasks read many files."""
    from matchwright.operators import documents as d

    rows = [("a/b", "one"), ("a/b", "one"), ("c d", None), (None, "none"), *[(str(i), f"text {i}") for i in range(600)]]
    texts = spark.createDataFrame(rows, "name string, text string").repartition(7)

    def stored(some, path):
        d.write_files(some, path, "name")
        files = d.read_files(spark, f"{path}/{d.FOLDER}=*")
        assert files.rdd.getNumPartitions() <= d.FOLDERS
        found = files.select(F.regexp_extract("path", r"name=(.*?)(\.txt$|/)", 1), "content").collect()
        assert len({r[0] for r in found}) == len(found)
        return sorted((r[0] if r[0].isdigit() else "", bytes(r.content).decode()) for r in found)

    direct = stored(texts, f"{tmp_path}/direct")
    monkeypatch.setattr(d, "REPEATED_KEYS", 0)
    assert stored(texts, f"{tmp_path}/many") == direct
    odd = [("", "\n"), ("", "none\n"), ("", "one\none\n")]
    assert direct == sorted([*odd, *((str(i), f"text {i}\n") for i in range(600))])
    assert not [f for _, _, names in os.walk(f"{tmp_path}/direct") for f in names if f.startswith(".")]
    with pytest.raises(FileExistsError):
        d.write_files(texts, f"{tmp_path}/direct", "name")
    monkeypatch.setattr(d, "_mounted", lambda *_: None)
    few = texts.filter("name IS NULL OR NOT name RLIKE '[0-9]' OR name = '7'")
    assert stored(few, f"{tmp_path}/by Spark") == [*odd, ("7", "text 7\n")]


def test_buckets_are_merged_a_few_at_a_time(spark, tmp_path, monkeypatch):
    calls, replace = [], matching.replace_partitions
    monkeypatch.setattr(matching, "replace_partitions", lambda df, *rest: (calls.append(1), replace(df, *rest)))
    stored = match(spark, [(c, o, 0.5, T1) for c in range(3) for o in range(60)])
    new = match(spark, [(c, o, 0.9, T2) for c in range(2, 5) for o in range(40)] + [(9, None, 0.8, T2), (9, None, 0.8, T2)])
    found = []
    for most in (1, 100, 1 << 24):
        monkeypatch.setattr(matching, "MERGED_ROWS", most)
        calls.clear()
        path = str(tmp_path / f"at-most-{most}")
        matching.create_match_table(stored, path, 8)
        matching.merge_into_match_table(new, path)
        found.append((len(calls), sorted(map(repr, spark.read.parquet(path).drop(matching.BUCKET).collect()))))
    assert [n for n, _ in found][0] == 8 and 2 <= found[1][0] < 8 and found[2][0] == 1
    assert found[0][1] == found[1][1] == found[2][1]
    assert len(found[0][1]) == 3 * 60 + 2 * 40 + 1
    assert spark.conf.get(src.RELEASE_SETTING) == "false"


def test_few_found_pairs_bound_nothing():
    import numpy as np
    from matchwright.operators import nearest

    rule = nearest._Rule(15, 0.2, 1.0, 9.0)
    for n in range(14):
        held = np.zeros(n, np.int64), np.arange(n), np.full(n, 0.5)
        assert np.isinf(rule.bounds(held, np.arange(4))).all()


@pytest.mark.parametrize("small_is_offers", [True, False])
def test_all_pairs_meet_in_squares(spark, monkeypatch, small_is_offers):
    """Where the small side is long, few rows of the other do not meet all of it at once."""
    from matchwright.operators import blocks, nearest

    class Large:
        def mapInArrow(self, found, _):
            return found

    vectors = spark.createDataFrame([(i, [1.0, i / 9]) for i in range(10)], "job_offer_id long, skills_vector array<double>")
    units = nearest._units(vectors, "job_offer_id", "match")
    shapes, pairs = [], blocks.vector_pairs
    monkeypatch.setattr(nearest, "PAIRS_AT_ONCE", 16)
    monkeypatch.setattr(blocks, "vector_pairs", lambda *a: (shapes.append((len(a[1]), len(a[3]))), pairs(*a))[1])
    rule = nearest._Rule(None, 0.2, 1.0, nearest._farthest(0.2, 1.0))
    batches = units.coalesce(1).toArrow().to_batches()
    found = [b for b in nearest._with_small_side(Large(), units, small_is_offers, rule, 4)(batches)]
    assert set(shapes) == {(4, 4), (4, 2), (2, 4), (2, 2)}
    assert sorted((o, c) for b in found for o, c in zip(*[b.column(i).to_pylist() for i in (0, 1)])) == [
        (o, c) for o in range(10) for c in range(10)
    ]
