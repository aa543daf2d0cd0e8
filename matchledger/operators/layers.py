"""Evidence layers side by side: canonical results, claims, conflicts. Layers are never added together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_levels(canonical: DataFrame, claims: DataFrame, columns: list[str], limit: int, order: list) -> DataFrame:
    """Canonical rows and claims without a canonical row, each with its level of evidence."""
    both = canonical.select(*columns, F.lit("canonical").alias("evidence_level")).unionByName(claims.select(*columns, F.lit("unlinked_claim").alias("evidence_level")))
    return both.orderBy(*order).limit(limit)


def grouped_claims(claims: DataFrame, group: list[str], value: str) -> DataFrame:
    """Claims of one event as a group: the value if all agree, how many say so, and the sources in order."""
    return claims.groupBy(*group).agg(
        F.when(F.count_distinct(value) == 1, F.max(value)).alias("agreed"),
        F.count("*").alias("claims"),
        F.count_distinct(value).alias("values"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
    )


def preferred_spelling(df: DataFrame, key: str, name: str) -> DataFrame:
    """One spelling per key: one with letters beyond ASCII first, then the most frequent, then by code points."""
    counts = df.groupBy(key, name).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc(F.col(name).rlike("[^\\x00-\\x7F]")), F.desc("n"), name)
    return counts.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").select(key, F.col(name).alias("preferred"), "n")


def conflicts(rows: DataFrame, key: list[str], field: str, value: str) -> DataFrame:
    """Fields of an entity for which at least two known values differ, one row per value."""
    known = rows.filter(F.col(value).isNotNull())
    said = known.groupBy(*key, field, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*key, field)
    return said.withColumn("values", F.count("*").over(w)).filter("values > 1")


def decided(conflicts_: DataFrame, key: list[str], field: str, value: str, priority: list) -> DataFrame:
    """Conflict rows with the value chosen by an order of priority."""
    w = Window.partitionBy(*key, field).orderBy(*priority, value)
    return conflicts_.withColumn("is_chosen", (F.row_number().over(w) == 1).cast("int"))


def merged(old: DataFrame, new: DataFrame, key: str, fields: list[str], manual: str) -> DataFrame:
    """A record's fields from a fresh one, but for those that were set by hand and those the fresh one lacks, with what
    happens to it: create, update, skip or keep. Old rows have a list (not null) of the fields set by hand."""
    fresh = new.select(key, *(F.col(f).alias("_new_" + f) for f in fields), F.lit(True).alias("_there"))
    joined = old.join(fresh, key, "full_outer")
    pick = lambda f: F.when(F.array_contains(F.coalesce(manual, F.array().cast("array<string>")), f), F.col(f)).otherwise(F.coalesce("_new_" + f, f)).alias(f)
    changed = [~F.col(f).eqNullSafe(pick(f)) for f in fields]
    action = F.when(F.col("_there").isNull(), "keep")
    any_change = changed[0]
    for c in changed[1:]:
        any_change = any_change | c
    action = action.when(F.col(manual).isNull(), "create").when(any_change, "update").otherwise("skip")
    return joined.select(key, *(pick(f) for f in fields), action.alias("action"))
