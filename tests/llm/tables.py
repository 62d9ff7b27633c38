"""Small document tables, with the cases that every operator must take."""

from __future__ import annotations

PROSE = "the quick brown fox jumps over the lazy dog and runs away from it in the night "
SHARED = "this very line is found in many of the documents, word by word"


def messy(spark, *clashing: str):
    """Nulls, empty and very long texts, repeated rows, and columns named as those made."""
    texts = [
        (1, PROSE * 8),
        (2, PROSE * 8),
        (2, PROSE * 8),
        (3, None),
        (None, PROSE),
        (None, None),
        (4, ""),
        (5, " \t\n\x0b\n"),
        (6, PROSE * 20_000),
        (7, "x" * 300_000),
        (8, "ünïcödé 中文 😀 \x00 " * 30),
        *[(10 + i, f"{SHARED}\nown line {i}\n  {SHARED.upper()}") for i in range(6)],
    ]
    extra = ", ".join(f"{c} int" for c in clashing)
    rows = [(d, t, None, "s", 1, *[0] * len(clashing)) for d, t in texts]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, schema + (f", {extra}" if extra else ""))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}
