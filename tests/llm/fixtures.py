"""Small tables with all that operators must stand: nulls, empty and long texts, repeats, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators make themselves; an input that has them too must not confuse them.
CLASHING = ["score", "n_tokens", "component_id", "kept", "row", "held_out", "bands", "media", "tie", "label", "c", "h", "u", "v", "word", "rep", "found"]


def prose(seed: int, n: int, words: str = "the of river stone quiet morning lantern walks under bridge seven old doors") -> str:
    r = random.Random(seed)
    return " ".join(r.choice(words.split()) + str(r.randrange(40)) for _ in range(n))


def rows() -> list[tuple]:
    long = "\n".join(prose(i, 60) for i in range(300))
    base = "\n".join(prose(900 + i, 12) for i in range(12))
    near = base.replace("river", "creek", 1)
    out = [
        (1, "Hello there, world.\nSecond line here\nThird line\nFourth one", "en", "a", 10),
        (2, None, "en", "a", None),
        (3, "", None, "b", 0),
        (4, "   \n\t ", "en", None, 6),
        (5, long, "en", "a", len(long)),
        (6, base, "en", "a", len(base)),
        (7, base, "de", "b", len(base)),
        (8, near, "en", "c", len(near)),
        (9, "12345 !!! ---", "fr", "a", 13),
        (10, "é" * 300 + " Ünïcödé ß 日本語 😀", "fr", "a", 300),
        (11, "aaaa" * 200, "en", "a", 800),
        (12, "word", "en", "a", 4),
        (12, "word", "en", "a", 4),
        (13, "x<|endoftext|>y  two  spaces\n\n\nend ", "en", "a", 30),
        (None, "a row without an id\nand two\nlines more", "en", "a", 20),
        (14, "a row without an id\nand two\nlines more", None, "a", 20),
    ]
    return out


def documents(spark, empty: bool = False):
    df = spark.createDataFrame([] if empty else rows(), SCHEMA)
    return df.repartition(3)


def clashing(df):
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit("x").alias(c) for c in CLASHING if c not in df.columns))
