"""Rights of sources: whether rows may be fetched and published. What isn't settled is refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.validate import Issues


def _may(said: str, no: str) -> Column:
    agreed = (F.col("permission_status") == "granted") | (F.col("ingest_decision") == "accepted_risk")
    return F.when(F.col("ingest_decision") == "blocked", False).when(F.col(said) == "allowed", True).when(F.col(said) == no, False).otherwise(F.coalesce(agreed, F.lit(False)))


def may_fetch() -> Column:
    return _may("automated_access", "blocked")


def may_publish() -> Column:
    return _may("public_redistribution", "denied")


def refused(rows: DataFrame, providers: DataFrame, provider: str, right: Column) -> DataFrame:
    """Providers of rows that lack a right, or aren't known, with their number of rows."""
    known = providers.select(F.col("provider_id").alias(provider), right.alias("_ok"))
    counted = rows.groupBy(provider).agg(F.count("*").alias("rows"))
    return counted.join(known, provider, "left").filter(~F.coalesce("_ok", F.lit(False))).select(provider, "rows")


def require(rows: DataFrame, providers: DataFrame, provider: str, right: Column) -> DataFrame:
    """The rows, if all of their providers have the right; otherwise an error that names some."""
    found = refused(rows, providers, provider, right).limit(3).collect()
    if found:
        raise Issues("not settled: " + ", ".join(str(r[0]) for r in found))
    return rows
