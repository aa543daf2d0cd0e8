"""Tables by name, and encounters: the relation of two-sided contests that the views are built on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Statuses whose results count.
COUNTED = ("played", "awarded")
FOCAL = 7
#: Parts that lines and orders of one nation are dealt over; by size alone, large parts of narrow rows would meet in one task.
PARTS = 96


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def encounters(spark: SparkSession, sf_dir: str, focal: int | None = None) -> DataFrame:
    """One row per contest between two nations: the supplier's at home, the customer's away. With ``focal`` only the contests of one
    nation: those at home start from its suppliers, those away from its customers, so that lines and orders are cut down before they meet."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    homes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("home_id"))
    aways = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("away_id"))
    same = F.col("l_orderkey") == F.col("o_orderkey")
    if focal is None:
        joined = lines.join(orders, same).join(homes, "l_suppkey").join(aways, "o_custkey")
    else:
        own_lines = lines.join(homes.filter(F.col("home_id") == focal), "l_suppkey")
        own_orders = orders.join(aways.filter(F.col("away_id") == focal), "o_custkey")
        by_line, by_order = (lambda df: df.repartition(PARTS, "l_orderkey")), (lambda df: df.repartition(PARTS, "o_orderkey"))
        at_home, away = by_line(own_lines).join(by_order(orders), same), by_line(lines).join(by_order(own_orders), same)
        joined = at_home.join(aways, "o_custkey").unionByName(away.join(homes, "l_suppkey"))
    return joined.filter("home_id <> away_id").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("match_id"),
        F.year("o_orderdate").alias("season"),
        F.col("o_orderpriority").alias("competition"),
        F.month("o_orderdate").alias("round"),
        F.col("o_orderdate").cast("date").alias("match_date"),
        F.when(F.col("o_orderstatus") == "F", "played").when(F.col("o_orderstatus") == "O", "scheduled").otherwise("awarded").alias("status"),
        "home_id",
        "away_id",
        (F.col("q") % 6).alias("home_score"),
        ((F.col("q") * 7 + F.col("l_linenumber")) % 6).alias("away_score"),
    )


ENCOUNTERS_SQL = """
encounters AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS match_id, CAST(year(o_orderdate) AS INTEGER) AS season,
         o_orderpriority AS competition, CAST(month(o_orderdate) AS INTEGER) AS round, CAST(o_orderdate AS DATE) AS match_date,
         CASE o_orderstatus WHEN 'F' THEN 'played' WHEN 'O' THEN 'scheduled' ELSE 'awarded' END AS status,
         s_nationkey AS home_id, c_nationkey AS away_id, CAST(CAST(l_quantity AS INTEGER) % 6 AS INTEGER) AS home_score,
         CAST((CAST(l_quantity AS INTEGER) * 7 + l_linenumber) % 6 AS INTEGER) AS away_score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
  WHERE s_nationkey <> c_nationkey)"""

MATCHES_SQL = (
    ENCOUNTERS_SQL
    + """,
sides AS (
  SELECT match_id, season, competition, round, match_date, status, CAST(home_id = 7 AS INTEGER) AS is_home,
         CASE WHEN home_id = 7 THEN away_id ELSE home_id END AS opponent_id,
         CASE WHEN home_id = 7 THEN home_score ELSE away_score END AS own_score,
         CASE WHEN home_id = 7 THEN away_score ELSE home_score END AS opponent_score
  FROM encounters WHERE home_id = 7 OR away_id = 7),
matches AS (
  SELECT *, own_score - opponent_score AS goal_difference,
         CASE WHEN status NOT IN ('played', 'awarded') THEN NULL WHEN own_score > opponent_score THEN 'S'
              WHEN own_score < opponent_score THEN 'T' WHEN own_score = opponent_score THEN 'U' END AS result
  FROM sides)"""
)
