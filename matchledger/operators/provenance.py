"""Provenance: snapshots compared, additions accounted for, hashes of payloads, fields that are complete or missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_hash


def compared(base: DataFrame, head: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Every record of two snapshots with its change and the names of the fields that differ, null-safe."""
    a = base.select(*key, F.struct(*fields).alias("_a"))
    b = head.select(*key, F.struct(*fields).alias("_b"))
    both = a.join(b, key, "full_outer")
    differ = F.array_compact(F.array(*(F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.lit(f)) for f in fields)))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size(differ) > 0, "changed").otherwise("same")
    return both.select(*key, change.alias("change"), F.when(change == "changed", F.array_join(differ, ",")).alias("fields"))


def additive(base: DataFrame, head: DataFrame, key: list[str], fields: list[str], exceptions: DataFrame | None = None) -> DataFrame:
    """One row per field that isn't the same in both snapshots. Filling a null is safe; a new record is an addition;
    anything else is destructive, unless ``exceptions`` (key, field) approves it."""
    value = lambda c: F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f).cast("string")))).alias(c)
    both = base.select(*key, value("_a")).join(head.select(*key, value("_b")), key, "full_outer")
    rows = both.select(*key, "_a", "_b", F.explode(F.array(*map(F.lit, fields))).alias("field"))
    old, new = F.col("_a")[F.col("field")], F.col("_b")[F.col("field")]
    status = F.when(F.col("_a").isNull(), "ADDITION").when(old.eqNullSafe(new), "UNCHANGED").when(old.isNull(), "SAFE_ENRICHMENT").otherwise("DESTRUCTIVE_CHANGE")
    rows = rows.select(*key, "field", status.alias("status")).filter("status <> 'UNCHANGED'")
    if exceptions is None:
        return rows
    approved = exceptions.select(*key, "field", F.lit(True).alias("_ok")).distinct()
    return rows.join(approved, [*key, "field"], "left").select(*key, "field", F.when(F.col("_ok") & (F.col("status") == "DESTRUCTIVE_CHANGE"), "APPROVED_EXCEPTION").otherwise(F.col("status")).alias("status"))


def unexplained(additions: DataFrame, findings: DataFrame, key: list[str]) -> DataFrame:
    """Additions that no finding names."""
    return additions.join(findings.select(*key).distinct(), key, "left_anti")


def hashed(df: DataFrame, key: str, *fields: str) -> DataFrame:
    return df.select(key, stable_hash(*fields).alias("payload_hash"))


def changed_payloads(old: DataFrame, new: DataFrame, key: str, *fields: str) -> DataFrame:
    """Records to write: those whose hash is new or has changed. Fields left out, such as times of retrieval, don't count."""
    was = hashed(old, key, *fields).withColumnRenamed("payload_hash", "_was")
    now = hashed(new, key, *fields)
    rows = now.join(was, key, "left").filter(~F.col("payload_hash").eqNullSafe(F.col("_was")))
    return rows.select(key, "payload_hash", F.when(F.col("_was").isNull(), "create").otherwise("update").alias("action"))


def completeness(checks: dict[str, tuple[Column, int]]) -> tuple[Column, Column]:
    """The weighted share of checks that hold, to two places, and the names of those that don't, in order."""
    total = sum(w for _, w in checks.values())
    held = sum((F.when(c, w).otherwise(0) for c, w in checks.values()), F.lit(0))
    missing = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, (c, _) in checks.items())))
    return F.round(held / F.lit(total), 2), missing


def lineage(claims: DataFrame, moves: DataFrame) -> DataFrame:
    """Claims by their present coordinates, and whether an old coordinate leads to exactly one. claims: claim_id,
    coordinate; moves: old, new."""
    here = claims.select(F.col("coordinate").alias("asked"), "claim_id", F.lit("exact").alias("how"))
    moved = moves.join(claims, moves["new"] == claims["coordinate"]).select(F.col("old").alias("asked"), "claim_id", F.lit("superseded").alias("how"))
    both = here.unionByName(moved.join(here.select("asked"), "asked", "left_anti"))
    return both.groupBy("asked").agg(F.when(F.count_distinct("claim_id") > 1, "ambiguous").otherwise(F.min("how")).alias("state"), F.when(F.count_distinct("claim_id") == 1, F.min("claim_id")).alias("claim_id"))


def holders(spells: DataFrame, office: str, holder: str, start: str, end: str) -> DataFrame:
    """Years in which an office that one person holds has several holders. A year in which one spell ends and another
    starts is a handover, no conflict."""
    from ..functions.dates import year_span

    years = spells.select(office, holder, start, end, F.explode(year_span(F.col(start), F.col(end))).alias("year"))
    rows = years.groupBy(office, "year").agg(F.count_distinct(holder).alias("holders"), F.count_if(F.col(end) == F.col("year")).alias("ending"), F.count_if(F.col(start) == F.col("year")).alias("starting"))
    return rows.filter((F.col("holders") > 1) & ~((F.col("holders") == 2) & (F.col("ending") >= 1) & (F.col("starting") >= 1))).select(office, "year", "holders")


def removals(base: DataFrame, head: DataFrame, key: str, parts: str, approved: DataFrame | None = None) -> DataFrame:
    """(key, status, merged_into) of every record that only one snapshot has. A record that is gone counts as merged if one record that remains carries all of
    its parts (the smallest key of several), as approved if ``approved`` (key) names it, else as destroyed; a record of the head alone is new. Sets of parts are
    compared once each: a set meets those that hold the rarest of its parts, and containment confirms. Records without parts are never merged; rows without
    key are left out; keys are unique in either snapshot."""
    held = lambda df: df.filter(F.col(key).isNotNull()).select(key, F.array_sort(F.array_distinct(F.array_compact(F.coalesce(parts, F.array().cast(df.schema[parts].dataType))))).alias("_parts"))
    was, now = held(base), held(head)
    gone = was.join(now.select(key), key, "left_anti")
    carriers = now.filter(F.size("_parts") > 0).groupBy(F.col("_parts").alias("_held")).agg(F.min(key).alias("merged_into"))
    each = carriers.withColumn("_part", F.explode("_held"))
    sets = gone.filter(F.size("_parts") > 0).select("_parts").distinct()
    counts = each.groupBy("_part").agg(F.count("*").alias("_n"))
    # a part that no remaining record has is the rarest of all, and its set meets nothing
    rarest = sets.withColumn("_part", F.explode("_parts")).join(counts, "_part", "left").groupBy("_parts").agg(F.min_by("_part", F.struct(F.coalesce("_n", F.lit(0)), "_part")).alias("_part"))
    met = rarest.join(each, "_part").filter(F.size(F.array_except("_parts", "_held")) == 0).groupBy("_parts").agg(F.min("merged_into").alias("merged_into"))
    out = gone.join(met, "_parts", "left").select(key, "merged_into")
    known = out.withColumn("_ok", F.lit(False)) if approved is None else out.join(approved.select(key, F.lit(True).alias("_ok")).distinct(), key, "left")
    status = F.when(F.col("merged_into").isNotNull(), "merged").when(F.col("_ok"), "approved").otherwise("destroyed")
    fresh = now.join(was.select(key), key, "left_anti").select(key, F.lit("new").alias("status"), F.lit(None).cast(out.schema["merged_into"].dataType).alias("merged_into"))
    return known.select(key, status.alias("status"), "merged_into").unionByName(fresh)
