"""Rows that every operator must take: NULLs in any column, empty and long texts, ties, repeated rows, and columns
named like those that operators add."""

import random

from pyspark.sql import functions as F

FIELDS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
CLASHES = [
    "n_words", "kept", "score", "lang_pred", "base_failed", "ids", "decoded", "doc", "key", "data", "rep", "n_links",
    "class_id", "n_removed", "n_sentences", "_doc", "_key", "_n", "row_id", "h", "set", "ratio_score", "start", "length",
]


def words(seed: int, n: int) -> str:
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 7))) for _ in range(n))


def sentences(seed: int, n: int) -> str:
    return " ".join(words(seed * 1000 + i, 9).capitalize() + "." for i in range(n))


def documents() -> list[tuple]:
    base = words(1, 120)
    near = base.split()
    near[60] = "changed"
    shared = sentences(7, 8)
    long = "\n".join(sentences(100 + i, 20) for i in range(150))
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", None, 4),
        (4, "one two", None, "a", 7),
        (5, base, "en", "a", 1),
        (6, base, "en", "b", 1),
        (6, base, "en", "b", 1),  # a repeated row
        (7, " ".join(near), "de", "a", 1),
        (8, words(2, 70) + " " + shared, "de", "a", 1),
        (9, shared + " " + words(3, 70), "fr", "a", 1),
        (10, long, "fr", "a", 1),
        (11, "x" * 70_000, "en", "a", 1),
        (12, "the same again " * 40, "en", "a", 1),
        (13, "<|endoftext|> café 日本語 \U0001f600 don't 12345", None, "a", 1),
        (14, "*** $$$ %%% 123", "de", "a", 1),
        (None, words(4, 60), "en", "a", 1),
        (None, base, None, "a", 1),
        (-3, words(5, 60), "es", "a", 1),
    ]
    return rows


def frame(spark, rows=None, clashing=True):
    df = spark.createDataFrame(documents() if rows is None else rows, FIELDS)
    return df.withColumns({c: F.lit("given") for c in CLASHES}) if clashing else df


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:])))
