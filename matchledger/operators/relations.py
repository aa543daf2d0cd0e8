"""Relations between records: compatible pairs, links, summaries of groups and of snapshots, and orders with stated ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def compatible_pairs(rows: DataFrame, ident: str, keys: list[str], date: str, days: int, open_keys: list[str]) -> DataFrame:
    """(a, b), a < b: rows with equal ``keys`` and at most ``days`` between their dates, whose ``open_keys`` are equal or missing on
    one side. Dates meet by buckets of ``days`` + 1, so that a key with many rows is split by time."""
    width = days + 1
    bucket = F.floor(F.datediff(F.col(date), F.lit("1970-01-01")) / width)
    rows = rows.select(ident, *keys, date, *open_keys, bucket.alias("_bucket"))
    left = rows.select(*keys, F.col(ident).alias("a"), F.col(date).alias("_da"), *(F.col(c).alias(f"_a_{c}") for c in open_keys), "_bucket")
    right = rows.select(*keys, F.col(ident).alias("b"), F.col(date).alias("_db"), *(F.col(c).alias(f"_b_{c}") for c in open_keys), F.explode(F.array(*(F.col("_bucket") + k for k in (-1, 0, 1)))).alias("_bucket"))
    met = left.join(right, [*keys, "_bucket"]).filter((F.col("a") < F.col("b")) & (F.abs(F.datediff("_da", "_db")) <= days))
    for c in open_keys:
        met = met.filter(F.coalesce(F.col(f"_a_{c}") == F.col(f"_b_{c}"), F.lit(True)))
    return met.select("a", "b")


def possible_links(claims: DataFrame, records: DataFrame, keys: list[str], ident: str, record: str) -> DataFrame:
    """Each claim with the number of records it may be about and the smallest of them. Records are counted by key before they
    meet the claims, so no claim meets more than one row."""
    known = records.groupBy(*keys).agg(F.count("*").alias("links"), F.min(record).alias("first_link"))
    return claims.select(ident, *keys).join(known, keys, "left").select(ident, F.coalesce("links", F.lit(0)).alias("links"), "first_link")


def running_ids(rows: DataFrame, period: str, order: list[str]) -> DataFrame:
    """``nth`` within each period, in order, and an id of both."""
    nth = F.row_number().over(Window.partitionBy(period).orderBy(*order))
    return rows.withColumn("nth", nth).withColumn("running_id", F.concat_ws("-", F.col(period).cast("string"), F.lpad(F.col("nth").cast("string"), 6, "0")))


def population(rows: DataFrame, group: str) -> DataFrame:
    """How many groups have each size, and what share of all rows they hold in percent."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("groups"))
    total = sizes.agg(F.sum(F.col("size") * F.col("groups")).alias("total"))
    return sizes.join(F.broadcast(total)).select("size", "groups", (F.col("size") == 1).alias("singleton"), F.round(100.0 * F.col("size") * F.col("groups") / F.col("total"), 4).alias("percent"))


def quiet_buckets(rows: DataFrame, bucket: str, share: float = 0.15) -> DataFrame:
    """Buckets with at most max(1, share of the upper median) rows. The median is found over the counts of equal coverage, which
    are few, and not over the buckets."""
    counts = rows.groupBy(bucket).agg(F.count("*").alias("n"))
    levels = counts.groupBy("n").agg(F.count("*").alias("k"))
    w = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    below = levels.withColumn("upto", F.sum("k").over(w)).crossJoin(F.broadcast(levels.agg(F.sum("k").alias("all"))))
    median = below.filter(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("n").alias("median"))
    limit = F.greatest(F.lit(1.0), F.lit(share) * F.col("median"))
    return counts.join(F.broadcast(median)).filter(F.col("n") <= limit).select(bucket, "n", "median")


def metric_report(base: DataFrame, head: DataFrame, ident: str, fields: list[str]) -> DataFrame:
    """One row: records added, removed and changed between two snapshots, and changes by field."""
    b = base.select(ident, F.struct(*fields).alias("_b"))
    h = head.select(ident, F.struct(*fields).alias("_h"))
    both = b.join(h, ident, "full")
    was, now = F.col("_b").isNotNull(), F.col("_h").isNotNull()
    differs = {f: was & now & ~F.col(f"_b.{f}").eqNullSafe(F.col(f"_h.{f}")) for f in fields}
    anything = F.lit(False)
    for d in differs.values():
        anything = anything | d
    counts = [F.count_if(~was & now).alias("added"), F.count_if(was & ~now).alias("removed"), F.count_if(anything).alias("changed")]
    return both.agg(*counts, *(F.count_if(d).alias(f"changed_{f}") for f, d in differs.items()))


def standings(matches: DataFrame, keys: list[str]) -> DataFrame:
    """The final table of each competition from matches seen from both sides: three points for a win, one for a draw; ties by goal
    difference, goals for, and id."""
    home = matches.select(*keys, F.col("home_id").alias("team"), F.col("home_score").alias("gf"), F.col("away_score").alias("ga"))
    away = matches.select(*keys, F.col("away_id").alias("team"), F.col("away_score").alias("gf"), F.col("home_score").alias("ga"))
    rows = home.unionByName(away).groupBy(*keys, "team").agg(
        F.count("*").alias("played"),
        F.count_if(F.col("gf") > F.col("ga")).alias("wins"),
        F.count_if(F.col("gf") == F.col("ga")).alias("draws"),
        F.sum("gf").cast("long").alias("goals_for"),
        F.sum("ga").cast("long").alias("goals_against"),
    )
    rows = rows.withColumn("points", 3 * F.col("wins") + F.col("draws"))
    order = Window.partitionBy(*keys).orderBy(F.desc("points"), F.desc(F.col("goals_for") - F.col("goals_against")), F.desc("goals_for"), "team")
    return rows.withColumn("position", F.row_number().over(order))


def cases_first(column: str, order: list[str]) -> Column:
    """A sort key: the place of a value in a list, after all of them for any other."""
    out = F.lit(len(order))
    for i, value in reversed(list(enumerate(order))):
        out = F.when(F.col(column) == value, i).otherwise(out)
    return out


def primary(rows: DataFrame, period: str, rank: Column, then: list[Column]) -> DataFrame:
    """The row of each period that comes first by rank."""
    nth = F.row_number().over(Window.partitionBy(period).orderBy(rank, *then))
    return rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def either_key(rows: DataFrame, one: str, two: str, names: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows joined to names where the key is either of two columns: two equi joins, the second without what the first had."""
    first = rows.join(names, rows[one] == names[key])
    second = rows.filter(~F.col(one).eqNullSafe(F.col(two))).join(names, rows[two] == names[key])
    return first.select(*columns).unionAll(second.select(*columns))


def months_around(rows: DataFrame, date: str) -> DataFrame:
    """Each row once for the month before its date, its own and the next, as yyyy-MM."""
    months = F.array(*(F.date_format(F.add_months(F.col(date), k), "yyyy-MM") for k in (-1, 0, 1)))
    return rows.withColumn("month", F.explode(months))
