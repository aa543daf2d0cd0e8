"""Rules over rows and across tables. Every check gives issue rows (check, key, message); a build with issues stops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ISSUE = "check string, key string, message string"


class Issues(RuntimeError):
    """Raised where a build has issues; nothing is written then."""


def _rows(df: DataFrame, check: str, key: Column, message: Column) -> DataFrame:
    return df.select(F.lit(check).alias("check"), key.cast("string").alias("key"), message.cast("string").alias("message"))


def constraints(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One issue for each rule that a row breaks; a rule that is null isn't broken."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items())))
    return _rows(df.select(F.col(key).alias("_key"), F.explode(broken).alias("_rule")), "constraint", F.col("_key"), F.col("_rule"))


def references(df: DataFrame, key: str, column: str, to: DataFrame, to_key: str) -> DataFrame:
    """Values that their table lacks; null refers to nothing."""
    missing = df.filter(F.col(column).isNotNull()).join(to.select(F.col(to_key).alias("_to")).distinct(), F.col(column) == F.col("_to"), "left_anti")
    return _rows(missing, "reference", F.col(key), F.concat(F.lit(column + " "), F.col(column).cast("string")))


def duplicates(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once."""
    found = df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")
    return _rows(found, "duplicate", F.concat_ws("-", *key), F.col("n"))


def consistent(df: DataFrame, group: str, *columns: str) -> DataFrame:
    """Groups whose rows differ in a column that they must share."""
    found = df.groupBy(group).agg(*(F.count_distinct(c).alias(c) for c in columns))
    wrong = F.array_compact(F.array(*(F.when(F.col(c) > 1, F.lit(c)) for c in columns)))
    return _rows(found.select(F.col(group).alias("_g"), F.explode(wrong).alias("_c")), "group", F.col("_g"), F.col("_c"))


def sequence(df: DataFrame, partition: str, number: str) -> DataFrame:
    """Rows whose numbers don't run from 1 without holes."""
    nth = F.row_number().over(Window.partitionBy(partition).orderBy(number))
    wrong = df.withColumn("_nth", nth).filter(~F.col(number).eqNullSafe(F.col("_nth")))
    return _rows(wrong, "sequence", F.col(partition), F.coalesce(F.col(number).cast("string"), F.lit("none")))


def together(*issues: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), issues)


def gate(issues: DataFrame) -> None:
    """Stops a build that has an issue."""
    found = issues.limit(3).collect()
    if found:
        raise Issues("; ".join(f"{r['check']} {r['key']}: {r['message']}" for r in found))
