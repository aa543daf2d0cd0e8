"""Ordered computation: running tables, islands, interval merges, neighbours, carry-forward, quotas, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def running_table(encounters: DataFrame, points: int = 3) -> DataFrame:
    """Standings after each round of a season and competition, on a full grid of teams and rounds: points, then goal
    difference, goals for and team decide the position."""
    key = ["season", "competition"]
    side = lambda team, own, other: F.struct(F.col(team).alias("team"), F.col(own).alias("gf"), F.col(other).alias("ga"))
    rows = encounters.select(*key, "round", F.inline(F.array(side("home_id", "home_score", "away_score"), side("away_id", "away_score", "home_score"))))
    won = F.when(F.col("gf") > F.col("ga"), points).when(F.col("gf") == F.col("ga"), 1).otherwise(0)
    each = rows.groupBy(*key, "round", "team").agg(F.count("*").alias("p"), F.sum(won).alias("pts"), F.sum("gf").alias("f"), F.sum("ga").alias("a"))
    grid = each.select(*key, "team").distinct().join(each.select(*key, "round").distinct(), key)
    full = grid.join(each, [*key, "team", "round"], "left")
    past = Window.partitionBy(*key, "team").orderBy("round").rowsBetween(Window.unboundedPreceding, 0)
    summed = full.select(*key, "round", "team", *(F.coalesce(F.sum(c).over(past), F.lit(0)).alias(n) for c, n in (("p", "played"), ("pts", "points"), ("f", "goals_for"), ("a", "goals_against"))))
    rank = Window.partitionBy(*key, "round").orderBy(F.desc("points"), F.desc(F.col("goals_for") - F.col("goals_against")), F.desc("goals_for"), "team")
    return summed.withColumn("position", F.row_number().over(rank))


def points_fit(tables: DataFrame) -> DataFrame:
    """Whether two or three points for a win explain more rows of a printed table; three where both do equally.
    tables: season, competition, wins, draws, points."""
    explains = lambda n: F.count_if(F.col("points") == n * F.col("wins") + F.col("draws"))
    fit = tables.groupBy("season", "competition").agg(explains(2).alias("rows_two"), explains(3).alias("rows_three"))
    return fit.withColumn("points_per_win", F.when(F.col("rows_two") > F.col("rows_three"), 2).otherwise(3))


def islands(df: DataFrame, partition: list[str], order: list[str], value: str, start: str, end: str) -> DataFrame:
    """Runs of consecutive rows with one value, within a partition: first and last ``start``/``end`` and length."""
    w = Window.partitionBy(*partition).orderBy(*order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    numbered = df.withColumn("_change", changed).withColumn("spell", F.sum("_change").over(w).cast("int"))
    return numbered.groupBy(*partition, "spell", value).agg(F.min(start).alias("first"), F.max(end).alias("last"), F.count("*").alias("n"))


def merged_intervals(df: DataFrame, partition: list[str], start: str, end: str, gap: int = 1) -> DataFrame:
    """Intervals of a partition merged where one starts at most ``gap`` after all earlier ones end."""
    w = Window.partitionBy(*partition).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.datediff(F.col(start), reach) > gap), 1).otherwise(0)
    numbered = df.withColumn("_fresh", fresh).withColumn("_part", F.sum("_fresh").over(w))
    return numbered.groupBy(*partition, "_part").agg(F.min(start).alias("first"), F.max(end).alias("last"), F.count("*").alias("n")).drop("_part")


def neighbours(df: DataFrame, partition: list[str], order: list[str], value: str) -> DataFrame:
    """The nearest known value before and after each row."""
    w = Window.partitionBy(*partition).orderBy(*order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return df.withColumns({f"previous_{value}": before, f"next_{value}": after})


def carried(df: DataFrame, partition: list[str], order: list[str], heading: Column, values: list[str]) -> DataFrame:
    """Values carried forward within a section; a heading starts a new one and resets them."""
    w = Window.partitionBy(*partition).orderBy(*order)
    sections = df.withColumn("section", F.sum(heading.cast("int")).over(w).cast("int"))
    inner = Window.partitionBy(*partition, "section").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return sections.withColumns({f"carried_{v}": F.last(v, ignorenulls=True).over(inner) for v in values})


def blocks(lines: DataFrame, partition: list[str], order: str, member: Column, least: int) -> DataFrame:
    """Maximal runs of member rows of at least ``least`` rows."""
    w = Window.partitionBy(*partition).orderBy(order)
    rows = lines.withColumn("_member", member).withColumn("_break", F.sum((~F.col("_member")).cast("int")).over(w)).filter("_member")
    return rows.groupBy(*partition, "_break").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).filter(F.col("n") >= least).drop("_break")


def longest_block(found: DataFrame, partition: list[str]) -> DataFrame:
    """The longest block of each partition, the first of equals."""
    w = Window.partitionBy(*partition).orderBy(F.desc("n"), "first")
    return found.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def first_per_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_nth = 1").drop("_nth")


def quota(df: DataFrame, group: list[str], bucket: str, order: list, per_bucket: int, budget: int) -> DataFrame:
    """At most ``per_bucket`` rows of each bucket first, then others in order, up to ``budget`` for each group."""
    inner = F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order))
    rows = df.withColumn("_late", (inner > per_bucket).cast("int"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("_late", *order))
    return rows.withColumn("place", place).filter(F.col("place") <= budget).drop("_late")


def novel(df: DataFrame, key: list[str], period: str) -> DataFrame:
    """Distinct keys of each period, and whether the period before lacks them; null where that one is unknown."""
    rows = df.select(*key, period).distinct()
    before = rows.withColumn(period, F.col(period) + 1).withColumn("_was", F.lit(True))
    known = rows.select((F.col(period) + 1).alias(period)).distinct().withColumn("_known", F.lit(True))
    out = rows.join(before, [*key, period], "left").join(known, period, "left")
    return out.select(*key, period, F.when(F.col("_known"), F.col("_was").isNull()).alias("is_new"))


def trimmed_history(turns: DataFrame, last: int = 6, budget: int = 12000) -> DataFrame:
    """The newest turns of each conversation within a number of turns and of characters, starting at a user's turn."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = turns.withColumns({"_nth": F.row_number().over(newest), "_held": F.sum(F.length("text")).over(newest.rowsBetween(Window.unboundedPreceding, 0))})
    rows = rows.filter((F.col("_nth") <= last) & (F.col("_held") <= budget))
    oldest = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    begun = F.max((F.col("role") == "user").cast("int")).over(oldest)
    return rows.withColumn("_begun", begun).filter("_begun = 1").drop("_nth", "_held", "_begun")


def covering_prefix(counts: DataFrame, group: list[str], n: str, order: list, share: float = 0.9) -> DataFrame:
    """The smallest ranked prefix of each group whose counts reach a share of the group's total."""
    w = Window.partitionBy(*group).orderBy(F.desc(n), *order)
    before = F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum(n).over(Window.partitionBy(*group))
    rows = counts.withColumns({"_before": before, "_total": total, "place": F.row_number().over(w)})
    return rows.filter(F.col("_before") < share * F.col("_total")).drop("_before", "_total")
