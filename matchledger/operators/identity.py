"""Who is who: cascading lookups, near spellings, longer forms, names as of a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import covers
from ..functions.text import in_locale


def cascade(rows: DataFrame, key: str, levels: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """Looks each row up in a list of (level, column, dictionary of form and id), best level first. A level with several
    ids is ambiguous and ends the search; ``found`` is null then. Rows found nowhere have level ``none``. Dictionaries are
    brought to one row a form, so that rows are never grouped; ``key`` names a row and stays as it is."""
    out, hits = rows, []
    for rank, (level, column, forms) in enumerate(levels):
        ids = F.struct(F.lit(level).alias("level"), F.count_distinct("id").alias("ids"), F.min("id").alias("id"))
        one = forms.groupBy(F.col("form").alias(f"_form{rank}")).agg(ids.alias(f"_hit{rank}"))
        out = out.join(one, F.col(column) == F.col(f"_form{rank}"), "left").drop(f"_form{rank}")
        hits.append(f"_hit{rank}")
    out = out.withColumn("_hit", F.coalesce(*hits))
    unique = F.col("_hit.ids") == 1
    return out.withColumns({"found": F.when(unique, F.col("_hit.id")), "level": F.when(unique, F.col("_hit.level")).when(F.col("_hit").isNotNull(), "ambiguous").otherwise("none")}).drop("_hit", *hits)


#: Names longer than this meet on whole parts, shorter ones on what deletions leave of them.
LONG = 40


def near_names(names: DataFrame, name: str, most: int = 1) -> DataFrame:
    """Pairs of different names within ``most`` edits. Two such names become equal by at most so many deletions in each, so they
    meet on their variants with up to ``most`` letters deleted: a common beginning brings no names together. Names of over
    ``LONG`` letters, whose variants are many, meet on parts instead. No pair is lost."""
    rows = names.select(F.col(name).alias("n")).filter("n IS NOT NULL").distinct()
    longer = _by_parts(rows.filter(F.length("n") > LONG - most), most).filter(F.greatest(F.length("a"), F.length("b")) > LONG)
    return _within(_by_deletions(rows.filter(F.length("n") <= LONG), most), most).unionByName(_within(longer, most))


def _within(pairs: DataFrame, most: int) -> DataFrame:
    return pairs.withColumn("edits", F.levenshtein("a", "b", most)).filter("edits >= 0")


def _by_deletions(rows: DataFrame, most: int) -> DataFrame:
    """Names that both lose ``most`` letters are within so many edits only if each letter gave way to another in its place, so they meet on the places too; else one
    of them loses fewer. Sizes of exploded rows are unknown to the planner, so no side is broadcast."""
    none = F.struct(F.array().cast("array<int>").alias("gone"), F.col("n").alias("v"))
    steps = [F.array(none)]
    for _ in range(most):
        # Places are those of the whole name, taken from behind.
        less = F.transform(steps[-1], lambda x: F.transform(F.filter(F.sequence(F.lit(0), F.length("n")), lambda i: (i > 0) & ((F.size(x["gone"]) == 0) | (i < F.get(x["gone"], F.lit(0))))), lambda i: F.struct(F.concat(F.array(i), x["gone"]).alias("gone"), F.concat(F.substr(x["v"], F.lit(1), i - 1), F.substr(x["v"], i + 1)).alias("v"))))
        steps.append(F.flatten(less))
    variants = lambda held: rows.select("n", F.explode(F.array_distinct(F.transform(F.flatten(F.array(*held)), lambda x: x["v"]))).alias("v"))
    fewer, all_of, last = variants(steps[:-1]), variants(steps), rows.select("n", F.inline(steps[-1]))
    named = lambda df, c, *on: df.select(F.col("n").alias(c), *on)
    in_place = named(last, "a", "gone", "v").join(named(last, "b", "gone", "v").hint("merge"), ["gone", "v"]).filter("a < b").select("a", "b")
    met = named(fewer, "a", "v").join(named(all_of, "b", "v").hint("merge"), "v").filter("a <> b")
    pairs = in_place.unionByName(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    # With one edit a pair meets once: in one place, or where the longer name loses its letter.
    return pairs if most == 1 else pairs.distinct()


def _by_parts(rows: DataFrame, most: int) -> DataFrame:
    """A name keeps at least one of most + 1 parts whole under so many edits, so pairs meet on a part and its place, shifted by up to
    ``most``."""
    pieces = most + 1
    size = F.length("n")

    def cut(length: Column, i: int) -> tuple[Column, Column]:
        start = F.floor(length * i / pieces).cast("int")
        return start, F.floor(length * (i + 1) / pieces).cast("int") - start

    def keys(length: Column, shift: int) -> list[Column]:
        out = []
        for i in range(pieces):
            start, width = cut(length, i)
            out.append(F.struct(length.cast("int").alias("len"), F.lit(i).alias("i"), F.substr(F.col("n"), F.greatest(start + shift, F.lit(0)) + 1, width).alias("part")))
        return out

    indexed = rows.select(F.col("n").alias("a"), F.explode(F.array(*keys(size, 0))).alias("k"))
    probes = rows.select(F.col("n").alias("b"), F.explode(F.array_distinct(F.flatten(F.array(*(F.array(*keys(size + d, s)) for d in range(-most, most + 1) for s in range(-most, most + 1)))))).alias("k"))
    return indexed.join(probes.hint("merge"), "k").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def prefix_extensions(names: DataFrame, key: str) -> DataFrame:
    """Pairs in which the longer key is the shorter one, a hyphen and a tail that isn't a number."""
    rows = names.select(F.col(key).alias("longer")).distinct()
    parts = F.split("longer", "-")
    each = rows.withColumn("_p", parts).select("longer", F.posexplode(F.when(F.size("_p") > 1, F.transform(F.sequence(F.lit(1), F.size("_p") - 1), lambda i: F.array_join(F.slice(F.col("_p"), 1, i), "-"))).otherwise(F.array().cast("array<string>"))).alias("_i", "shorter"))
    tail = F.expr("substr(longer, length(shorter) + 2)")
    return each.join(names.select(F.col(key).alias("shorter")).distinct(), "shorter").filter(~tail.rlike("^[0-9]+$")).select("shorter", "longer")


def token_subsets(names: DataFrame, name: str) -> DataFrame:
    """Pairs in which all words of the shorter name (two at least) are words of the longer one. Pairs meet on the
    shorter name's rarest word."""
    rows = names.select(F.col(name).alias("n")).filter("n IS NOT NULL").distinct().withColumn("w", F.array_distinct(F.split("n", " ")))
    each = rows.select("n", "w", F.explode("w").alias("t"))
    freq = each.groupBy("t").agg(F.count("*").alias("f"))
    rare = each.filter(F.size("w") >= 2).join(freq, "t").groupBy("n").agg(F.min(F.struct("f", "t"))["t"].alias("t"), F.first("w").alias("w"))
    a, b = rare.select(F.col("n").alias("shorter"), F.col("w").alias("_a"), "t"), each.select(F.col("n").alias("longer"), F.col("w").alias("_b"), "t")
    return a.join(b, "t").filter((F.size("_a") < F.size("_b")) & (F.size(F.array_except("_a", "_b")) == 0)).select("shorter", "longer")


def name_as_of(names: Column, fallback: Column, at: Column) -> Column:
    """The first of a list of (name, from, to) whose span holds a date, else the fallback."""
    return F.coalesce(F.get(F.filter(names, lambda n: covers(n["from"], n["to"], at)), F.lit(0))["name"], fallback)


def nearest(left: DataFrame, right: DataFrame, on: str, left_day: str, right_day: str, left_key: str, right_key: str, before: int, after: int) -> DataFrame:
    """For each left row the nearest right row of the same group from ``before`` days earlier to ``after`` days later.
    Both sides meet on exact days; ties go to the earlier day, then to the smaller key."""
    days = left.select(left_key, on, F.col(left_day).cast("date").alias("_day")).withColumn("_at", F.explode(F.sequence(F.date_sub("_day", before), F.date_add("_day", after))))
    rows = right.groupBy(on, F.col(right_day).cast("date").alias("_at")).agg(F.min(right_key).alias("match"))
    met = days.join(rows, [on, "_at"]).withColumn("days", F.datediff("_at", "_day"))
    w = Window.partitionBy(left_key).orderBy(F.abs("days"), "days", "match")
    return met.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").select(left_key, "match", "days")


def preferred_spellings(rows: DataFrame, on: list[str], name: str, locale: str = "nb") -> DataFrame:
    """(on..., spelling, spellings, n): names that differ in case only count as one; the most frequent spelling stands for them, of equally frequent
    ones the first in the language's order. Null names are left out."""
    counted = rows.filter(F.col(name).isNotNull()).groupBy(*on, name).agg(F.count("*").alias("_n"))
    order = F.struct(-F.col("_n"), in_locale(name, locale), F.col(name))
    grouped = counted.groupBy(*on, in_locale(name, locale, ignore_case=True).alias("_same")).agg(F.min_by(name, order).alias("spelling"), F.count("*").alias("spellings"), F.sum("_n").alias("n"))
    return grouped.drop("_same")
