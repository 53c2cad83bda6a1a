"""Small tables with every odd case, and comparison with SQL."""

from collections import Counter

import duckdb

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, source="a", lang="en"):
    """One document per text; an entry may be (doc_id, text, source) instead."""
    rows = []
    for i, x in enumerate(texts):
        doc_id, text, own = x if isinstance(x, tuple) else (i, x, source)
        rows.append((doc_id, text, lang, own, len(text or "")))
    return spark.createDataFrame(rows, DOCUMENTS)


def odd_texts():
    line = "The quick brown fox jumps over the lazy dog today.\nA second line follows it at once.\n"
    passage = (
        "It was noted by the committee that all members had arrived in time. Nobody objected to the plan "
        "that the chair had laid out. The vote was then taken without further delay."
    )
    return [
        None,
        "",
        " \n\t\x0b",
        "word",
        "One. Two. Three.",
        line * 40,
        line * 40,
        passage,
        "Before it. " + passage + " After it there is more to read here.",
        passage.upper() + "\nTail",
        "ÄÖÜ äöü ñ ß é 😀 😀 😀",
        "x " * 5000,
        "a\nb\nc\n" + line + "d",
        (3, "a repeated doc_id with its own text", "b"),
        (4, "One. Two. Three.", "a"),
        (None, "no id here at all, but a text", None),
    ]


def clashing(df):
    """Columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    names = "size start key hash chunk removed place h c lines fp component_id root kept lang_pred score tokens".split()
    return df.withColumns({n: F.lit(1) for n in names})


def rows(df):
    names = sorted(df.columns)
    return Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())


def _plain(x):
    return round(x, 9) if isinstance(x, float) else x


def by_sql(df, sql):
    """The rows of ``sql`` over ``df`` as table documents."""
    db = duckdb.connect()
    db.register("documents", df.toArrow())
    cursor = db.execute(sql)
    columns = [d[0] for d in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in cursor.fetchall())
