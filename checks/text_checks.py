"""Text, JSON, vector and document functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchwright.functions import scores, text, vectors
from matchwright.operators import documents as docs
from matchwright.operators.analytics import offer_statistics
from matchwright.sources.tables import new_folder

from .fixtures import Tables, sql


def _raw_skills(t: Tables) -> DataFrame:
    """Skill documents in the four stored forms, chosen by id."""
    c, s = F.col("candidate_id"), F.col("skills")
    tech, soft = s["technical_skills"], s["soft_skills"]
    loose = F.struct(
        F.concat(F.lit("  "), F.array_join(F.transform(tech, F.upper), " , ")).alias(
            "technical_skills"
        ),
        F.array_join(soft, ",").alias("soft_skills"),
    )
    raw = (
        F.when(c % 4 == 0, F.to_json(s))
        .when(c % 4 == 1, F.array_join(tech, ", "))
        .when(c % 4 == 2, F.to_json(tech))
        .otherwise(F.to_json(loose))
    )
    return t.skills().select("candidate_id", raw.alias("raw"))


def a01_skill_set(t: Tables) -> DataFrame:
    return _raw_skills(t).select(
        "candidate_id", F.explode(text.skill_set(F.col("raw"))).alias("skill")
    )


def a01_skills_document(t: Tables) -> DataFrame:
    doc = _raw_skills(t).select(
        "candidate_id", text.skills_document(F.col("raw")).alias("d")
    )
    return doc.select(
        "candidate_id",
        F.array_join("d.technical_skills", "|").alias("technical"),
        F.array_join("d.soft_skills", "|").alias("soft"),
    )


def a02_vector_text(t: Tables) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    listed = F.array_join(v.cast("array<string>"), ",")
    raw = (
        F.when(F.col("label") % 3 == 0, F.to_json(v))
        .when(F.col("label") % 3 == 1, listed)
        .otherwise(F.concat(F.lit("["), listed, F.lit("]")))
    )
    parsed = t.raw("embeddings").select("vec_id", text.vector_or_empty(raw).alias("v"))
    return parsed.select(
        "vec_id",
        F.size("v").alias("length"),
        F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


def a03_vector_size(t: Tables) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    return t.raw("embeddings").select(
        "vec_id",
        *[
            f.alias(name)
            for n in (32, 100)
            for name, f in (
                (f"size_{n}", F.size(vectors.fit(v, n))),
                (
                    f"total_{n}",
                    F.round(F.aggregate(vectors.fit(v, n), F.lit(0.0), lambda a, x: a + x), 6),
                ),
            )
        ],
    )


def a04_json_field(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return (
        t.raw("events")
        .select("event_id", text.int_or_zero(k).alias("k"), F.size(text.json_strings(F.col("props"), "missing")).alias("missing"))
    )


def a05_json_rows(t: Tables) -> DataFrame:
    doc = t.skills().select("candidate_id", F.to_json("skills").alias("j"))
    return doc.select(
        "candidate_id", F.explode(text.json_strings(F.col("j"), "soft_skills")).alias("skill")
    )


def a06_to_json(t: Tables) -> DataFrame:
    return t.skills().select("candidate_id", text.as_json(F.col("skills")).alias("document"))


def a07_nested_experience(t: Tables) -> DataFrame:
    flat = F.array(
        F.struct(
            F.col("o_orderpriority").alias("title"),
            F.col("o_orderstatus").alias("company"),
            F.year("o_orderdate").cast("string").alias("start_year"),
            F.month("o_orderdate").cast("string").alias("start_month"),
            F.year("o_orderdate").cast("string").alias("end_year"),
            F.lit("12").alias("end_month"),
            (F.col("o_orderstatus") == "O").alias("en_cours"),
            F.lit("").alias("description"),
        )
    )
    nested = t.raw("orders").select("o_orderkey", text.nested_experience(flat)[0].alias("e"))
    return nested.select(
        "o_orderkey",
        "e.title",
        "e.company",
        F.col("e.duration.start.year").alias("start_year"),
        F.col("e.duration.start.month").alias("start_month"),
        F.col("e.duration.end.month").alias("end_month"),
        "e.en_cours",
    )


def a08_field_names(t: Tables) -> DataFrame:
    o = F.col("o_orderkey")
    title, company = F.col("o_orderpriority"), F.col("o_orderstatus")
    entry = (
        F.when(o % 3 == 0, F.to_json(F.struct(title.alias("job_title"), company.alias("employer"))))
        .when(o % 3 == 1, F.to_json(F.struct(title.alias("title"), company.alias("organization"))))
        .otherwise(F.to_json(F.struct(title.alias("position"), F.lit("2 y").alias("period"))))
    )
    listed = F.concat(F.lit("["), entry, F.lit("]"))
    out = t.raw("orders").select("o_orderkey", text.job_entries(listed)[0].alias("e"))
    return out.select("o_orderkey", "e.job_title", "e.company", "e.years")


def a09_text_lines(t: Tables) -> DataFrame:
    lines = text.text_lines(F.col("text"))
    return t.raw("documents").select(
        "doc_id", F.size(lines).alias("lines"), F.md5(F.array_join(lines, "|").cast("binary")).alias("digest")
    )


A09 = r"""SELECT doc_id, CAST(len(l) AS INT) AS lines, md5(array_to_string(l, '|')) AS digest
FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[;,\n]'),
        lambda x: trim(x, E' \t\n\r\x0b\x0c')), lambda x: x <> '') AS l FROM documents)"""


def a10_complete_profile(t: Tables) -> DataFrame:
    c = F.col("c_custkey")
    raw = F.when(
        c % 2 == 0, F.to_json(F.struct(F.col("c_name").alias("first_name"), F.array("c_mktsegment").alias("schools")))
    ).otherwise(F.to_json(F.struct(F.col("c_mktsegment").alias("job_category"))))
    p = t.raw("customer").select("c_custkey", text.complete_profile(raw).alias("p"))
    return p.select(
        "c_custkey",
        "p.first_name",
        "p.email",
        "p.job_category",
        F.size("p.schools").alias("schools"),
        F.size("p.technical_skills").alias("technical_skills"),
    )


def a11_int_or_zero(t: Tables) -> DataFrame:
    return t.raw("orders").select(
        "o_orderkey",
        text.int_or_zero(F.substring("o_orderpriority", 1, 1)).alias("rank"),
        text.int_or_zero(F.col("o_orderpriority")).alias("bad"),
    )


def a12_text_defaults(t: Tables) -> DataFrame:
    return t.candidates().select(
        "candidate_id",
        text.text_or(F.col("job_category")).alias("job_category"),
        text.text_or(F.col("education_level"), "Unknown").alias("education_level"),
    )


def a13_education(t: Tables) -> DataFrame:
    raw = (
        F.when(F.col("education_level") == "Bachelor", "Bachelor's")
        .when(F.col("education_level") == "Master", "MASTERS")
        .when(F.col("education_level") == "PhD", "Ph.D")
        .when(F.col("education_level") == "Other", "Apprentice")
        .otherwise(F.col("education_level"))
    )
    return t.candidates().select("candidate_id", text.canonical_education(raw).alias("level"))


def a14_email_check(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", text.is_email(F.col("text")).alias("is_email"))


def a15_hash_id(t: Tables) -> DataFrame:
    padded = F.concat(F.lit(" "), F.upper("email"), F.lit(" "))
    return t.candidates().select("candidate_id", text.email_hash_id(padded).alias("hash_id"))


def a17_percent_text(t: Tables) -> DataFrame:
    s = offer_statistics(t.offers(), t.matches())
    return s.select(
        "job_offer_id",
        scores.percent_text(F.col("best_score")).alias("best"),
        scores.match_class(F.col("best_score")).alias("match_class"),
    )


A17 = """SELECT o.job_offer_id,
  CASE WHEN max(m.similarity_score) IS NULL THEN 'N/A'
       ELSE printf('%.1f%%', max(m.similarity_score) * 100) END AS best,
  CASE WHEN max(m.similarity_score) > 0.8 THEN 'excellent-match'
       WHEN max(m.similarity_score) > 0.6 THEN 'good-match' ELSE 'average-match' END AS match_class
FROM fx_offers o LEFT JOIN fx_matches m USING (job_offer_id) GROUP BY 1"""


def a18_skill_preview(t: Tables) -> DataFrame:
    return t.skills().select(
        "candidate_id",
        text.skill_preview(F.col("skills.technical_skills")).alias("technical"),
        text.skill_preview(F.col("skills.soft_skills"), 6).alias("soft"),
    )


def a19_skill_line(t: Tables) -> DataFrame:
    return t.skills().select(
        "candidate_id",
        text.skill_line(F.col("skills.technical_skills"), F.col("skills.soft_skills")).alias("line"),
    )


_LISTS = """(SELECT candidate_id,
  list_sort(list(skill) FILTER (kind = 'technical')) AS t,
  list_sort(list(skill) FILTER (kind = 'soft')) AS s FROM fx_skill GROUP BY 1)"""


def a20_text_preview(t: Tables) -> DataFrame:
    p = text.text_preview(F.col("text"))
    return t.raw("documents").select(
        "doc_id", F.length(p).alias("size"), F.md5(p.cast("binary")).alias("digest")
    )


def _file_names(t: Tables) -> DataFrame:
    ending = (
        F.when(F.col("lang") == "en", ".TXT")
        .when(F.col("lang") == "fr", ".pdf")
        .when(F.col("lang") == "de", ".docx")
        .otherwise("")
    )
    name = F.concat(F.lit("My CV ("), F.col("doc_id").cast("string"), F.lit(")_"), "source", ending)
    return t.raw("documents").select("doc_id", "lang", "text", name.alias("filename"))


def a21_file_names(t: Tables) -> DataFrame:
    f = F.col("filename")
    at = F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")
    return _file_names(t).select(
        "doc_id",
        text.file_extension(f).alias("extension"),
        text.clean_stem(f).alias("stem"),
        text.object_key("cvs", f, at).alias("object_key"),
        text.content_type(text.file_extension(f)).alias("content_type"),
    )


A21 = """SELECT doc_id,
  CASE lang WHEN 'en' THEN 'txt' WHEN 'fr' THEN 'pdf' WHEN 'de' THEN 'docx' ELSE '' END AS extension,
  'My CV ' || doc_id || '_' || source AS stem,
  'cvs/20240506_070809_My CV ' || doc_id || '_' || source || CASE lang
    WHEN 'en' THEN '.TXT' WHEN 'fr' THEN '.pdf' WHEN 'de' THEN '.docx' ELSE '' END AS object_key,
  CASE lang WHEN 'en' THEN 'text/plain' WHEN 'fr' THEN 'application/pdf'
    WHEN 'de' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
    ELSE 'application/octet-stream' END AS content_type
FROM documents"""


def a23_dates(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", F.to_date("ts").alias("day"))


def a24_math(t: Tables) -> DataFrame:
    q, p = F.col("l_quantity"), F.col("l_discount")
    return t.raw("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.round(F.sqrt(q), 6).alias("root"),
        F.round(F.exp(-p), 6).alias("decay"),
        F.round(F.abs(p - 0.05), 4).alias("gap"),
        F.round(F.pow(q, 2), 6).alias("square"),
        scores.clamp(q / 25).alias("clamped"),
        scores.percent_1(p).alias("percent"),
    )


A24 = """SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) AS root,
  round(exp(-l_discount), 6) AS decay, round(abs(l_discount - 0.05::DOUBLE), 4) AS gap,
  round(power(l_quantity, 2), 6) AS square,
  least(greatest(l_quantity / 25, 0), 1) AS clamped, round(l_discount * 100, 1) AS percent
FROM lineitem"""


def x01_skill_sets(t: Tables) -> DataFrame:
    s = t.skills().select(
        "candidate_id",
        text.merged_skill_set(
            F.col("skills.technical_skills"), F.col("skills.soft_skills")
        ).alias("all_skills"),
        "skills.technical_skills",
    )
    return s.select(
        "candidate_id",
        F.size("all_skills").alias("in_union"),
        F.size(F.array_intersect("all_skills", "technical_skills")).alias("in_both"),
    )


def d01_sorted_files(t: Tables) -> DataFrame:
    """Every document as a file: readable ones and rejected ones with the reason."""
    files = _file_names(t).select(
        F.col("doc_id").cast("string").alias("path"),
        "filename",
        text.file_extension(F.col("filename")).alias("extension"),
        F.octet_length("text").cast("bigint").alias("length"),
        F.encode("text", "UTF-8").alias("content"),
    )
    kept, rejected = docs.sort_files(files)
    return kept.select(
        "path", "extension", F.md5(F.col("text").cast("binary")).alias("digest"), F.lit(None).cast("string").alias("reason")
    ).unionByName(rejected.select("path", "extension", F.lit(None).cast("string").alias("digest"), "reason"))


def d01_read_files(t: Tables) -> DataFrame:
    """Documents written as one text file each, and read as files."""
    path = new_folder(t.spark, "files")
    texts = t.raw("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs.write_files(texts, path, "doc_id")
    kept, rejected = docs.sort_files(docs.read_files(t.spark, f"{path}/{docs.FOLDER}=*"))
    doc_id = F.regexp_extract("path", "doc_id=([0-9]+)[/.]", 1).cast("bigint").alias("doc_id")
    found = kept.select(doc_id, "extension", F.md5(F.col("text").cast("binary")).alias("digest"), F.lit(None).cast("string").alias("reason"))
    return found.unionByName(rejected.select(doc_id, "extension", F.lit(None).cast("string").alias("digest"), "reason"))


D01_FILES = r"""SELECT doc_id, 'txt' AS extension,
  CASE WHEN regexp_matches(text, '\S') THEN md5(text || chr(10)) END AS digest,
  CASE WHEN NOT coalesce(regexp_matches(text, '\S'), false) THEN 'no text in file' END AS reason
FROM documents"""

D01 = r"""SELECT CAST(doc_id AS VARCHAR) AS path,
  CASE lang WHEN 'en' THEN 'txt' WHEN 'fr' THEN 'pdf' WHEN 'de' THEN 'docx' ELSE '' END AS extension,
  CASE WHEN lang = 'en' AND regexp_matches(text, '\S') THEN md5(text) END AS digest,
  CASE WHEN lang IN ('fr', 'de') THEN 'needs a document parser'
       WHEN lang <> 'en' THEN 'unsupported file format'
       WHEN text = '' THEN 'empty file'
       WHEN NOT regexp_matches(text, '\S') THEN 'no text in file' END AS reason
FROM documents"""


def d02_decode(t: Tables) -> DataFrame:
    """Texts as ISO-8859-1 bytes where they fit it, else UTF-8, and back."""
    fits = ~F.col("text").rlike(r"[^\x00-\xff]")
    latin = F.encode(F.when(fits, F.col("text")), "ISO-8859-1")
    raw = F.when(fits, latin).otherwise(F.encode("text", "UTF-8"))
    back = t.raw("documents").select("doc_id", text.decode_bytes(raw).alias("text"))
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


def d03_has_text(t: Tables) -> DataFrame:
    return docs.has_text(t.raw("documents")).select("doc_id", "n_chars")


def d04_language(t: Tables) -> DataFrame:
    d = t.raw("documents")
    return docs.tag_language(d, docs.language_profile(d))


def d04_language_by_join(t: Tables) -> DataFrame:
    """The same with a profile too large to broadcast."""
    d = t.raw("documents")
    return docs.tag_language(d, docs.language_profile(d), broadcast_rows=0)


def d04_language_of_turns(t: Tables) -> DataFrame:
    """Texts that took no part in the profile."""
    turns = t.raw("conversations").withColumn("turn_id", F.concat_ws("-", "conv_id", "turn"))
    return docs.tag_language(turns.select("turn_id", "text").dropDuplicates(["turn_id"]), docs.language_profile(t.raw("documents")), "turn_id")


_PROFILE = r"""flat AS (SELECT lang, string_split(
    regexp_replace(lower(trim(text)), '\s+', ' ', 'g'), '') AS c FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL),
n AS (SELECT lang, gram, count(*) AS n FROM (SELECT lang, unnest(list_transform(range(1, len(c) - 1),
        lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM flat) GROUP BY 1, 2),
v AS (SELECT DISTINCT gram FROM n),
tot AS (SELECT lang, sum(n) AS total FROM n GROUP BY 1),
w AS (SELECT v.gram, tot.lang,
             CAST(round(ln((coalesce(n.n, 0) + 1.0::DOUBLE) / (tot.total + (SELECT count(*) FROM v))) * 1e6) AS BIGINT) AS w
      FROM v CROSS JOIN tot LEFT JOIN n ON n.gram = v.gram AND n.lang = tot.lang)"""


def _tagged_sql(table: str, key: str) -> str:
    return rf"""WITH {_PROFILE},
own AS (SELECT DISTINCT ON ({key}) {key} AS key, text FROM {table}),
d AS (SELECT key, gram, count(*) AS k FROM (SELECT key, unnest(list_transform(range(1, len(c) - 1),
        lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram
      FROM (SELECT key, string_split(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'), '') AS c FROM own)) GROUP BY 1, 2),
s AS (SELECT key, w.lang, sum(k * w) AS s FROM d JOIN w USING (gram) GROUP BY 1, 2),
b AS (SELECT key, lang FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s DESC, lang) AS place FROM s) WHERE place = 1)"""


D04 = _tagged_sql("documents", "doc_id") + """
SELECT key AS doc_id, coalesce(b.lang, 'unknown') AS language FROM own LEFT JOIN b USING (key)"""

D04_TURNS = _tagged_sql("conversations", "conv_id || '-' || turn") + """
SELECT key AS turn_id, coalesce(b.lang, 'unknown') AS language FROM own LEFT JOIN b USING (key)"""


CHECKS = {
    "a01_skill_set": (
        a01_skill_set,
        sql("""SELECT candidate_id, skill FROM fx_skill
               WHERE kind = 'technical' AND candidate_id % 4 IN (1, 2)
               UNION SELECT candidate_id, lower(skill) FROM fx_skill WHERE candidate_id % 4 IN (0, 3)"""),
    ),
    "a01_skills_document": (
        a01_skills_document,
        sql(f"""SELECT candidate_id,
                  CASE WHEN candidate_id % 4 = 3 THEN upper(array_to_string(t, '|'))
                       ELSE array_to_string(t, '|') END AS technical,
                  CASE WHEN candidate_id % 4 IN (1, 2) THEN ''
                       ELSE array_to_string(s, '|') END AS soft FROM {_LISTS}"""),
    ),
    "a02_vector_text": (
        a02_vector_text,
        """SELECT vec_id, CAST(len(embedding) AS INT) AS length,
                  round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings""",
    ),
    "a03_vector_size": (
        a03_vector_size,
        """SELECT vec_id, 32::INT AS size_32, 100::INT AS size_100,
                  round(list_sum(CAST(embedding AS DOUBLE[])[1:32]), 6) AS total_32,
                  round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total_100 FROM embeddings""",
    ),
    "a04_json_field": (
        a04_json_field,
        "SELECT event_id, CAST(props->>'$.k' AS INT) AS k, 0::INT AS missing FROM events",
    ),
    "a05_json_rows": (
        a05_json_rows,
        sql("SELECT candidate_id, skill FROM fx_skill WHERE kind = 'soft'"),
    ),
    "a06_to_json": (
        a06_to_json,
        sql(f"""SELECT candidate_id, CAST(to_json({{'technical_skills': t, 'soft_skills': s}})
                  AS VARCHAR) AS document FROM {_LISTS}"""),
    ),
    "a07_nested_experience": (
        a07_nested_experience,
        """SELECT o_orderkey, o_orderpriority AS title, o_orderstatus AS company,
                  CAST(year(o_orderdate) AS VARCHAR) AS start_year,
                  CAST(month(o_orderdate) AS VARCHAR) AS start_month, '12' AS end_month,
                  o_orderstatus = 'O' AS en_cours FROM orders""",
    ),
    "a08_field_names": (
        a08_field_names,
        """SELECT o_orderkey, o_orderpriority AS job_title,
                  CASE WHEN o_orderkey % 3 = 2 THEN 'Company' ELSE o_orderstatus END AS company,
                  CASE WHEN o_orderkey % 3 = 2 THEN '2 y' ELSE '' END AS years FROM orders""",
    ),
    "a09_text_lines": (a09_text_lines, A09),
    "a10_complete_profile": (
        a10_complete_profile,
        """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS first_name,
                  '' AS email, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END AS job_category,
                  CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END::INT AS schools,
                  0::INT AS technical_skills FROM customer""",
    ),
    "a11_int_or_zero": (
        a11_int_or_zero,
        """SELECT o_orderkey, coalesce(try_cast(substr(o_orderpriority, 1, 1) AS INT), 0) AS rank,
                  coalesce(try_cast(o_orderpriority AS INT), 0) AS bad FROM orders""",
    ),
    "a12_text_defaults": (
        a12_text_defaults,
        sql("""SELECT candidate_id, coalesce(job_category, '') AS job_category,
                      coalesce(education_level, 'Unknown') AS education_level FROM fx_candidates"""),
    ),
    "a13_education": (
        a13_education,
        sql("SELECT candidate_id, coalesce(education_level, 'Other') AS level FROM fx_candidates"),
    ),
    "a14_email_check": (
        a14_email_check,
        "SELECT doc_id, contains(text, '@') AS is_email FROM documents",
    ),
    "a15_hash_id": (
        a15_hash_id,
        sql("""SELECT candidate_id, CAST(CAST('0x' || substr(md5(email), 1, 6) AS BIGINT) % 99999999 + 1
                 AS BIGINT) AS hash_id FROM fx_candidates"""),
    ),
    "a17_percent_text": (a17_percent_text, sql(A17)),
    "a18_skill_preview": (
        a18_skill_preview,
        sql(f"""SELECT candidate_id,
                  array_to_string(t[1:5], ', ') || CASE WHEN len(t) > 5 THEN '...' ELSE '' END AS technical,
                  array_to_string(s, ', ') AS soft FROM {_LISTS}"""),
    ),
    "a19_skill_line": (
        a19_skill_line,
        sql(f"SELECT candidate_id, array_to_string(list_concat(t, s), ' | ') AS line FROM {_LISTS}"),
    ),
    "a20_text_preview": (
        a20_text_preview,
        """SELECT doc_id, CAST(length(p) AS INT) AS size, md5(p) AS digest FROM (
             SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '...'
                                 ELSE text END AS p FROM documents)""",
    ),
    "a21_file_names": (a21_file_names, A21),
    "a23_dates": (a23_dates, "SELECT event_id, CAST(ts AS DATE) AS day FROM events"),
    "a24_math": (a24_math, A24),
    "x01_skill_sets": (
        x01_skill_sets,
        sql("""SELECT candidate_id, CAST(count(DISTINCT skill) AS INT) AS in_union,
                      CAST(count(DISTINCT skill) FILTER (kind = 'technical') AS INT) AS in_both
               FROM (SELECT candidate_id, kind, lower(skill) AS skill FROM fx_skill) GROUP BY 1"""),
    ),
    "d01_sorted_files": (d01_sorted_files, D01),
    "d02_decode": (d02_decode, "SELECT doc_id, md5(text) AS digest FROM documents"),
    "d03_has_text": (
        d03_has_text,
        r"SELECT doc_id, n_chars FROM documents WHERE regexp_matches(text, '\S')",
    ),
    "d01_read_files": (d01_read_files, D01_FILES),
    "d04_language": (d04_language, D04),
    "d04_language_by_join": (d04_language_by_join, D04),
    "d04_language_of_turns": (d04_language_of_turns, D04_TURNS),
}
