"""Declared schemas of the recruitment entities and a check against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_S, _L, _I, _D, _B, _TS = (
    T.StringType(),
    T.LongType(),
    T.IntegerType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


SKILLS = _struct(technical_skills=T.ArrayType(_S), soft_skills=T.ArrayType(_S))
CERTIFICATION = _struct(name=_S, year=_S, issuer=_S, details=_S)
MONTH = _struct(year=_S, month=_S)
EXPERIENCE = _struct(
    title=_S,
    company=_S,
    duration=_struct(start=MONTH, end=MONTH),
    en_cours=_B,
    description=_S,
)

CANDIDATES = _struct(
    candidate_id=_L,
    first_name=_S,
    last_name=_S,
    email=_S,
    phone=_S,
    linkedin=_S,
    job_category=_S,
    current_job=_S,
    country=_S,
    city=_S,
    experience_years=_I,
    education_level=_S,
    skills=SKILLS,
    skills_vector=T.ArrayType(_D),
    certifications=T.ArrayType(CERTIFICATION),
    experience=T.ArrayType(EXPERIENCE),
    filename=_S,
    url=_S,
    document_extension=_S,
    document_language=_S,
    visibility_setting=_B,
    blocked=_B,
    created_at=_TS,
    updated_at=_TS,
    processed_at=_TS,
    location_id=_L,
)

JOB_OFFERS = _struct(
    job_offer_id=_L,
    client_id=_L,
    job_title=_S,
    company_name=_S,
    job_category=_S,
    city=_S,
    country=_S,
    job_type=_S,
    remote_option=_S,
    education_level=_S,
    experience_required=_I,
    salary_min=_D,
    salary_max=_D,
    currency=_S,
    description=_S,
    technical_skills=T.ArrayType(_S),
    soft_skills=T.ArrayType(_S),
    skills_vector=T.ArrayType(_D),
    created_at=_TS,
    status=_S,
)

JOB_MATCHES = _struct(
    match_id=_S,
    candidate_id=_L,
    job_offer_id=_L,
    similarity_score=_D,
    distance=_D,
    overall_evaluation=_D,
    created_at=_TS,
    updated_at=_TS,
)

CLIENTS = _struct(client_id=_L, company_name=_S)
REGION = _struct(
    location_id=_L, city=_S, country=_S, continent=_S, created_at=_TS, updated_at=_TS
)
SKILL_DIMENSION = _struct(skill_id=_L, name=_S, skill_type=_S, updated_at=_TS)


def missing_or_mistyped(df: DataFrame, schema: T.StructType) -> list[str]:
    """Names of declared columns that ``df`` lacks or holds with another type."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [f.name for f in schema.fields if actual.get(f.name) != f.dataType.simpleString()]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring ``df`` to ``schema``: cast, order, and add missing columns as NULL."""
    have = set(df.columns)
    from pyspark.sql import functions as F

    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )
