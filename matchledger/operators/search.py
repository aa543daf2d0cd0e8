"""Search in texts: tokens, phrases, dictionaries, line windows, kinds of fragments, scores in print."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import words


def with_all(df: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """Rows whose text has every term as a word."""
    return df.filter(F.size(F.array_except(F.array(*map(F.lit, terms)), words(F.col(text)))) == 0)


def ranked(df: DataFrame, name: str, needle: str, key: str, limit: int) -> DataFrame:
    """Rows whose name holds a needle: equal names first, then those that start with it, then others."""
    low, want = F.lower(name), needle.lower()
    tier = F.when(low == want, 0).when(low.startswith(want), 1).when(low.contains(want), 2)
    return df.withColumn("tier", tier).filter("tier IS NOT NULL").orderBy("tier", name, key).limit(min(max(limit, 1), 200))


def index(df: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, n): an inverted index."""
    return df.select(key, F.explode(words(F.col(text))).alias("term")).groupBy("term", key).agg(F.count("*").alias("n"))


def phrase_hits(texts: DataFrame, key: str, text: str, phrases: DataFrame, phrase_key: str, phrase: str, size: int) -> DataFrame:
    """Texts that hold the first ``size`` words of a phrase in a row; phrases of fewer words take no part. Both sides
    meet on the words themselves, each text's distinct runs once."""

    def runs(w: Column) -> Column:
        return F.when(F.size(w) >= size, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.array_join(F.slice(w, i + 1, size), " ")))).otherwise(F.array().cast("array<string>"))

    left = texts.select(key, words(F.col(text)).alias("_w")).select(key, F.explode(runs(F.col("_w"))).alias("_run"))
    right = phrases.select(phrase_key, words(F.col(phrase)).alias("_w")).filter(F.size("_w") >= size)
    right = right.select(phrase_key, F.array_join(F.slice("_w", 1, size), " ").alias("_run"))
    return left.join(right, "_run").select(key, phrase_key).distinct()


def whole_phrases(texts: DataFrame, key: str, text: str, phrases: DataFrame, phrase_key: str, phrase: str) -> DataFrame:
    """Texts that hold all words of a phrase in a row, whatever their number. Both sides meet on the phrase's word that is
    in the fewest texts, and the whole phrase confirms them."""
    padded = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    held = texts.select(F.col(key).alias("_k"), words(F.col(text)).alias("_w"))
    each = held.select("_k", F.explode(F.array_distinct("_w")).alias("_word"))
    asked = phrases.select(F.col(phrase_key).alias("_p"), words(F.col(phrase)).alias("_w")).select("_p", padded("_w").alias("_form"), F.explode(F.array_distinct("_w")).alias("_word"))
    counts = each.join(asked.select("_word").distinct(), "_word", "left_semi").groupBy("_word").agg(F.count("*").alias("_n"))
    anchors = asked.join(counts, "_word").groupBy("_p", "_form").agg(F.min_by("_word", F.struct("_n", "_word")).alias("_word"))
    found = each.join(anchors, "_word").select(F.col("_k").alias("_at"), "_p", "_form")
    rows = found.join(held, F.col("_at").eqNullSafe(F.col("_k"))).filter(F.contains(padded("_w"), F.col("_form")))
    return rows.select(F.col("_k").alias(key), F.col("_p").alias(phrase_key)).distinct()


def shared_runs(texts: DataFrame, key: str, text: str, phrases: DataFrame, phrase_key: str, phrase: str, size: int) -> DataFrame:
    """How many distinct runs of ``size`` words of a passage a text holds, wherever in the passage they stand. Rows of one key
    count once a run; only runs that both sides have are brought together for that."""

    def runs(df: DataFrame, k: str, t: str) -> DataFrame:
        w = F.col("_w")
        own = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.array_join(F.slice(w, i + 1, size), " "))
        return df.select(k, words(F.col(t)).alias("_w")).filter(F.size("_w") >= size).select(k, F.explode(F.array_distinct(own)).alias("_run"))

    met = runs(texts, key, text).join(runs(phrases, phrase_key, phrase).distinct(), "_run").select(key, phrase_key, "_run").distinct()
    return met.groupBy(key, phrase_key).agg(F.count("*").alias("runs"))


def line_windows(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each line with the next one, two lines in a row of the same text."""
    lines = df.select(key, F.split(text, "\n").alias("_l")).filter(F.size("_l") >= 2)
    pair = lambda i: F.struct(i.alias("line"), F.concat_ws("\n", F.get("_l", i), F.get("_l", i + 1)).alias("window"))
    return lines.select(key, F.inline(F.transform(F.sequence(F.lit(0), F.size("_l") - 2), pair)))


def printed_scores(text: Column) -> Column:
    """Scores in print such as 3-1 or 3 – 1, with misread digits repaired, each side at most 30."""
    raw = F.regexp_extract_all(text, F.lit("(?<![0-9OIl-])([0-9OIl]{1,2} ?[-–—] ?[0-9OIl]{1,2})(?![0-9OIl-])"), F.lit(1))
    fixed = F.transform(raw, lambda r: F.split(F.translate(F.regexp_replace(r, " ?[-–—] ?", "-"), "OIl", "011"), "-"))
    pairs = F.transform(fixed, lambda p: F.struct(F.get(p, F.lit(0)).cast("int").alias("home"), F.get(p, F.lit(1)).cast("int").alias("away")))
    return F.filter(pairs, lambda p: (p["home"] <= 30) & (p["away"] <= 30))


def kind(text: Column) -> Column:
    """What a fragment is, by the share of its digits, marks and line ends."""
    n = F.greatest(F.length(text), F.lit(1))
    digits = F.length(F.regexp_replace(text, "[^0-9]", "")) / n
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    stops = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    return F.when(bars >= 3, "table").when(digits > 0.2, "result_list").when((stops >= 3) & (n >= 200), "article").when(n < 80, "notice").otherwise("other")


def novel_first(df: DataFrame, key: str, group: str, order: list) -> DataFrame:
    """Rows of a group in order, each key once."""
    w = Window.partitionBy(group, key).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")
