"""Column expressions over text, JSON and nested profile fields.

All of them are built-in Spark expressions; none starts a Python worker.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TECHNICAL, SOFT = "technical_skills", "soft_skills"

# Accepted spellings of an education level, lower case.
EDUCATION_SPELLINGS = {
    "high school": "High School",
    "bachelor": "Bachelor",
    "bachelors": "Bachelor",
    "bachelor's": "Bachelor",
    "master": "Master",
    "masters": "Master",
    "master's": "Master",
    "phd": "PhD",
    "ph.d": "PhD",
    "doctorate": "PhD",
    "unknown": "Other",
}

# Content type by file extension.
CONTENT_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "doc": "application/msword",
    "txt": "text/plain",
}

# Fields every extracted profile must have.
PROFILE_LIST_FIELDS = [
    "technical_skills",
    "soft_skills",
    "experience",
    "certifications",
    "schools",
]
PROFILE_TEXT_FIELDS = [
    "first_name",
    "last_name",
    "email",
    "phone",
    "current_job",
    "country",
    "city",
    "job_category",
    "linkedin",
    "education_level",
]


BLANKS = " \t\n\r\x0b\x0c"


def strip(c: Column) -> Column:
    """Without blanks, tabs and line ends on either side."""
    return F.trim(c, F.lit(BLANKS))


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def clean_list(items: Column) -> Column:
    """Trim every item and drop NULL and blank ones."""
    return F.filter(F.transform(items, strip), lambda s: s.isNotNull() & (s != ""))


def split_list(text: Column, pattern: str = ",") -> Column:
    return clean_list(F.split(text, pattern))


def strings_of(json_text: Column) -> Column:
    """JSON array text, or comma text, to an array of strings."""
    return F.when(
        strip(json_text).startswith("["),
        F.coalesce(
            clean_list(F.from_json(json_text, "array<string>")), split_list(json_text)
        ),
    ).otherwise(split_list(json_text))


def json_strings(doc: Column, field: str) -> Column:
    """The string array held in a field of a JSON object; anything else is empty."""
    return F.coalesce(strings_of(F.get_json_object(doc, f"$.{field}")), _no_strings())


def _is_object(raw: Column) -> Column:
    return strip(raw).startswith("{") & F.get_json_object(raw, "$").isNotNull()


def _flat_strings(raw: Column) -> Column:
    """Skill text that is not a JSON object: a list, a quoted string or comma text."""
    bare = strip(raw).rlike(r"^(null|true|false|-?[0-9.]+([eE][+-]?[0-9]+)?)$")
    unquoted = F.when(strip(raw).rlike('^".*"$'), F.get_json_object(raw, "$"))
    return F.when(bare, _no_strings()).otherwise(strings_of(F.coalesce(unquoted, raw)))


def skills_document(raw: Column) -> Column:
    """Any stored skill text to ``struct(technical_skills, soft_skills)``, case kept.

    An object must hold ``technical_skills`` to count; a plain list or comma text
    is taken as technical skills.
    """
    tech_text = F.get_json_object(raw, f"$.{TECHNICAL}")
    tech = F.when(_is_object(raw), json_strings(raw, TECHNICAL)).otherwise(_flat_strings(raw))
    soft = F.when(_is_object(raw) & tech_text.isNotNull(), json_strings(raw, SOFT))
    return F.struct(
        F.coalesce(tech, _no_strings()).alias(TECHNICAL),
        F.coalesce(soft, _no_strings()).alias(SOFT),
    )


def fold(items: Column) -> Column:
    """Trimmed lower-case distinct items."""
    lowered = F.transform(F.coalesce(items, _no_strings()), lambda s: F.lower(strip(s)))
    return F.array_distinct(F.filter(lowered, lambda s: s.isNotNull() & (s != "")))


def skill_set(raw: Column) -> Column:
    """Any stored skill text to one lower-case set, both skill kinds together."""
    both = F.concat(json_strings(raw, TECHNICAL), json_strings(raw, SOFT))
    return fold(F.when(_is_object(raw), both).otherwise(_flat_strings(raw)))


def merged_skill_set(technical: Column, soft: Column) -> Column:
    return fold(F.concat(F.coalesce(technical, _no_strings()), F.coalesce(soft, _no_strings())))


def vector_or_null(raw: Column) -> Column:
    """Vector text (JSON or comma) to doubles; NULL where it cannot be read."""
    body = strip(raw)
    parsed = F.from_json(body, "array<double>")
    parts = F.transform(
        F.split(F.regexp_replace(body, r"[\[\]]", ""), ","),
        lambda x: F.trim(x).try_cast("double"),
    )
    whole = F.when(~F.exists(parts, lambda x: x.isNull()), parts)
    return F.when(
        body.isin("", "[]", "null"), F.array().cast("array<double>")
    ).otherwise(F.coalesce(parsed, whole))


def vector_or_empty(raw: Column) -> Column:
    return F.coalesce(vector_or_null(raw), F.array().cast("array<double>"))


def as_json(value: Column) -> Column:
    return F.to_json(value)


def nested_experience(entries: Column) -> Column:
    """Flat profile entries (start/end year and month columns) to the stored nesting."""
    return F.transform(
        entries,
        lambda e: F.struct(
            e["title"].alias("title"),
            e["company"].alias("company"),
            F.struct(
                F.struct(e["start_year"].alias("year"), e["start_month"].alias("month")).alias(
                    "start"
                ),
                F.struct(e["end_year"].alias("year"), e["end_month"].alias("month")).alias("end"),
            ).alias("duration"),
            e["en_cours"].alias("en_cours"),
            e["description"].alias("description"),
        ),
    )


# Accepted field names of a job entry, in order, and the default.
JOB_ENTRY_NAMES = {
    "job_title": (["job_title", "title", "position"], "Position"),
    "company": (["company", "employer", "organization"], "Company"),
    "years": (["years", "duration", "period"], ""),
}


def job_entry(json_entry: Column) -> Column:
    """One job entry (JSON text) under any accepted naming to one naming."""

    def pick(names: Sequence[str], default: str) -> Column:
        return F.coalesce(
            *[F.get_json_object(json_entry, f"$.{n}") for n in names], F.lit(default)
        )

    return F.struct(
        *[pick(names, default).alias(out) for out, (names, default) in JOB_ENTRY_NAMES.items()]
    )


def job_entries(json_array: Column) -> Column:
    """JSON array of job entries to an array of ``struct(job_title, company, years)``."""
    named = "array<struct<{}>>".format(
        ",".join(f"{n}:string" for names, _ in JOB_ENTRY_NAMES.values() for n in names)
    )
    return F.transform(
        F.from_json(json_array, named),
        lambda e: F.struct(
            *[
                F.coalesce(*[e[n] for n in names], F.lit(default)).alias(out)
                for out, (names, default) in JOB_ENTRY_NAMES.items()
            ]
        ),
    )


def text_lines(raw: Column) -> Column:
    return split_list(raw, "[;,\n]")


def complete_profile(raw: Column) -> Column:
    """Extracted profile JSON to a struct with every required field present."""
    texts = [
        F.coalesce(F.get_json_object(raw, f"$.{n}"), F.lit("")).alias(n)
        for n in PROFILE_TEXT_FIELDS
    ]
    lists = [
        F.coalesce(
            F.from_json(F.get_json_object(raw, f"$.{n}"), "array<string>"), _no_strings()
        ).alias(n)
        for n in PROFILE_LIST_FIELDS
    ]
    return F.struct(*texts, *lists)


def int_or_zero(raw: Column) -> Column:
    return F.coalesce(raw.try_cast("int"), F.lit(0))


def text_or(raw: Column, default: str = "") -> Column:
    return F.coalesce(F.nullif(raw.cast("string"), F.lit("")), F.lit(default))


def canonical_education(raw: Column) -> Column:
    pairs = [F.lit(x) for pair in EDUCATION_SPELLINGS.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[F.lower(raw)], F.lit("Other"))


def is_email(raw: Column) -> Column:
    return F.coalesce(strip(raw).contains("@"), F.lit(False))


def email_hash_id(email: Column) -> Column:
    """Numeric id in 1..99,999,999 from the first 24 bits of the e-mail's MD5."""
    digest = F.md5(F.lower(strip(email)).cast("binary"))
    return F.conv(F.substring(digest, 1, 6), 16, 10).cast("bigint") % 99999999 + 1


def pair_id(candidate_id: Column, job_offer_id: Column) -> Column:
    """Repeatable match id of a (candidate, offer) pair."""
    return F.md5(F.concat_ws("-", candidate_id, job_offer_id).cast("binary"))


def skill_preview(skills: Column, n: int = 5) -> Column:
    head = F.array_join(F.slice(skills, 1, n), ", ")
    return F.when(F.size(skills) > n, F.concat(head, F.lit("..."))).otherwise(head)


def skill_line(technical: Column, soft: Column) -> Column:
    return F.array_join(
        F.concat(F.coalesce(technical, _no_strings()), F.coalesce(soft, _no_strings())), " | "
    )


def text_preview(text: Column, n: int = 2000) -> Column:
    """Display form of a long text; the text itself is never cut."""
    return F.when(
        F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))
    ).otherwise(text)


def file_extension(filename: Column) -> Column:
    """Lower-case extension without the dot; '' where the name has none."""
    base = F.regexp_extract(filename, r"([^/]*)$", 1)
    return F.lower(F.regexp_extract(base, r"^\.*[^.].*\.([^.]*)$", 1))


def clean_stem(filename: Column) -> Column:
    base = F.regexp_extract(filename, r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"(?<=[^.])\.[^.]*$", "")
    return F.trim(F.regexp_replace(stem, r"[^\p{L}\p{N} _-]", ""))


def object_key(folder: str, filename: Column, at: Column) -> Column:
    dotted = F.regexp_extract(filename, r"(?<=[^./])(\.[^./]*)$", 1)
    return F.concat(
        F.lit(folder + "/"),
        F.date_format(at, "yyyyMMdd_HHmmss"),
        F.lit("_"),
        clean_stem(filename),
        dotted,
    )


def content_type(extension: Column) -> Column:
    pairs = [F.lit(x) for pair in CONTENT_TYPES.items() for x in pair]
    return F.coalesce(
        F.create_map(*pairs)[F.lower(F.ltrim(extension, F.lit(".")))],
        F.lit("application/octet-stream"),
    )


def decode_bytes(content: Column) -> Column:
    """UTF-8 where the bytes are valid UTF-8, else ISO-8859-1."""
    return F.when(
        F.is_valid_utf8(content.cast("string")), content.cast("string")
    ).otherwise(F.decode(content, "ISO-8859-1"))
