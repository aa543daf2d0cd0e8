"""Writers that refuse, skip or resume. Each commits by appending one row or one Parquet job, so a lost executor
leaves nothing half written that a reader would see."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stable_hash
from ..operators.validate import Issues, gate


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet folder, or None before its first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def build(tables: dict[str, DataFrame], issues: DataFrame, folder: str) -> str:
    """A full build of all tables as a new version. With an issue, or with every table empty, nothing is written; readers
    see the version once all of its tables are there."""
    gate(issues)
    if all(df.isEmpty() for df in tables.values()):
        raise Issues("nothing to build")
    version = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    done = issues.sparkSession.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("at"))
    done.write.mode("append").parquet(f"{folder}/versions")
    return version


def current(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the last complete build."""
    version = spark.read.parquet(f"{folder}/versions").agg(F.max_by("version", F.struct("at", "version"))).head()[0]
    return spark.read.parquet(f"{folder}/{version}/{name}")


def write_plan(plan: DataFrame, issues: DataFrame, path: str) -> None:
    """A plan is written only where it has no issue."""
    gate(issues)
    plan.write.mode("overwrite").parquet(path)


def append_changed(new: DataFrame, path: str, key: str, at: str) -> None:
    """Append the records whose content differs from their last version, leaving out ``at``, the time of retrieval."""
    spark = new.sparkSession
    fields = sorted(c for c in new.columns if c not in (key, at))
    now = new.withColumn("_hash", stable_hash(*fields))
    old = stored(spark, path)
    if old is not None:
        last = old.groupBy(key).agg(F.max_by("_hash", F.struct(at, "_hash")).alias("_hash"))
        now = now.join(last, [key, "_hash"], "left_anti")
    now.write.mode("append").parquet(path)


def remaining(todo: DataFrame, path: str, key: str) -> DataFrame:
    """What a batch that was stopped still has to do: entries whose key has no report yet."""
    done = stored(todo.sparkSession, path)
    return todo if done is None else todo.join(done.select(key).distinct(), key, "left_anti")


def report(done: DataFrame, path: str) -> None:
    done.write.mode("append").parquet(path)
