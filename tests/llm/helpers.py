"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, node long, _range int"


def documents(spark, rows):
    """Rows of (doc_id, text, lang, source) with extra columns whose names operators also use inside."""
    return spark.createDataFrame(
        [(i, t, lang, source, len(t or ""), 7, False, 1, 3) for i, t, lang, source in rows], SCHEMA
    )


def awkward(spark):
    long_text = "\n".join(f"line {k} " + " ".join(f"w{k * 7 % 31}x{j}" for j in range(12)) for k in range(400))
    return documents(
        spark,
        [
            (1, "alpha beta gamma", "en", "a"),
            (1, "alpha beta gamma", "en", "a"),
            (2, None, "en", "a"),
            (3, "", None, None),
            (None, "alpha beta gamma", "de", "b"),
            (4, long_text, "en", "a"),
            (5, long_text + " end", "en", "b"),
            (6, " \t\n\n \r\n", "fr", None),
            (7, "é" * 5000, "fr", "c"),
        ],
    )


def nothing(spark):
    return documents(spark, [])


def as_tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
