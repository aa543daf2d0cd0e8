"""Queries on encounters: the views, tables and ordered computation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import ENCOUNTERS_SQL, FOCAL, MATCHES_SQL, encounters, table
from ..operators import views, windows

COUNTED_SQL = "status IN ('played', 'awarded')"


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.perspective(encounters(spark, sf_dir, FOCAL), FOCAL)


def last_heavy_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.last_heavy_loss(matches(spark, sf_dir), 4)


def stats_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.long_form(matches(spark, sf_dir), {"score": ("own_score", "opponent_score")})


def seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.seasons(matches(spark, sf_dir))


TALLY_SQL = f"""
  count(*) FILTER ({COUNTED_SQL}) AS played, count(*) FILTER (result = 'S') AS wins, count(*) FILTER (result = 'U') AS draws,
  count(*) FILTER (result = 'T') AS losses, CAST(coalesce(sum(own_score) FILTER ({COUNTED_SQL}), 0) AS BIGINT) AS goals_for,
  CAST(coalesce(sum(opponent_score) FILTER ({COUNTED_SQL}), 0) AS BIGINT) AS goals_against,
  CAST(coalesce(sum(goal_difference) FILTER ({COUNTED_SQL}), 0) AS BIGINT) AS goal_difference"""

SEASONS_SQL = f"""
WITH {MATCHES_SQL},
s AS (
  SELECT season, competition, count(*) AS matches, {TALLY_SQL}, min(match_date) AS first_date, max(match_date) AS last_date,
    count(DISTINCT round) FILTER ({COUNTED_SQL}) AS rounds_played, count(DISTINCT round) AS rounds, min(round) AS first_round,
    max(round) AS last_round, count(*) FILTER (NOT {COUNTED_SQL}) AS open,
    CAST(round(avg(own_score * 1000) FILTER (is_home = 1 AND {COUNTED_SQL}), 0) AS INTEGER) AS home_average
  FROM matches GROUP BY season, competition)
SELECT *, CASE WHEN rounds = 0 THEN 'no_rounds' WHEN first_round = 1 AND rounds = last_round AND last_round >= 12 AND open = 0 THEN 'complete'
  WHEN first_round = 1 AND rounds = last_round AND last_round >= 12 THEN 'in_progress'
  WHEN first_round = 1 AND rounds = last_round THEN 'prefix' WHEN rounds_played = 0 THEN 'scheduled_only' ELSE 'partial' END AS coverage
FROM s"""


def opponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").filter(F.col("n_nationkey") != FOCAL)
    return views.opponents(matches(spark, sf_dir), names.select(F.col("n_nationkey").alias("opponent_id"), F.col("n_name").alias("name")))


OPPONENTS_SQL = f"""
WITH {MATCHES_SQL},
t AS (SELECT opponent_id, {TALLY_SQL}, min(match_date) FILTER ({COUNTED_SQL}) AS first_meeting,
        max(match_date) FILTER ({COUNTED_SQL}) AS last_meeting, min(match_date) AS first_any_status,
        count(*) FILTER (status = 'scheduled') AS scheduled FROM matches GROUP BY opponent_id)
SELECT n_nationkey AS opponent_id, n_name AS name, coalesce(played, 0) AS played, coalesce(wins, 0) AS wins, coalesce(draws, 0) AS draws,
  coalesce(losses, 0) AS losses, coalesce(goals_for, 0) AS goals_for, coalesce(goals_against, 0) AS goals_against,
  coalesce(goal_difference, 0) AS goal_difference, first_meeting, last_meeting, first_any_status, coalesce(scheduled, 0) AS scheduled
FROM nation LEFT JOIN t ON n_nationkey = opponent_id WHERE n_nationkey <> 7"""


def rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.all_rankings(matches(spark, sf_dir), 10).select("ranking", "match_id", "match_date", "goal_difference", "goals")


def _rankings_sql() -> str:
    part = "(SELECT '{0}' AS ranking, match_id, match_date, goal_difference, own_score + opponent_score AS goals FROM matches WHERE " + COUNTED_SQL + " ORDER BY {1}, match_date DESC, match_id LIMIT 10)"
    orders = {"largest_win": "goal_difference DESC", "largest_defeat": "goal_difference", "most_goals": "goals DESC", "fewest_goals": "goals", "newest": "match_date DESC", "oldest": "match_date ASC"}
    parts = []
    for name, order in orders.items():
        body = part.format(name, order)
        if name == "oldest":
            body = body.replace("match_date ASC, match_date DESC", "match_date")
        parts.append(body)
    return f"WITH {MATCHES_SQL} " + " UNION ALL ".join(parts)


def counts_by_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.distribution(matches(spark, sf_dir).filter(views.counted()), "competition")


def by_decade(spark: SparkSession, sf_dir: str) -> DataFrame:
    decade = F.concat((F.floor(F.col("season") / 10) * 10).cast("int").cast("string"), F.lit("s"))
    return views.distribution(matches(spark, sf_dir).withColumn("decade", decade), "decade", "status")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.tiles(matches(spark, sf_dir))


def next_scheduled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first scheduled match on or after a date."""
    rows = matches(spark, sf_dir).filter((F.col("status") == "scheduled") & (F.col("match_date") >= F.lit("1998-01-01").cast("date")))
    return rows.orderBy("match_date", "match_id").limit(1).select("match_id", "match_date")


def adjacent_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previous and next match in the same season and competition."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("season", "competition").orderBy("match_date", "match_id")
    return matches(spark, sf_dir).select("match_id", F.lag("match_id").over(w).alias("previous_id"), F.lead("match_id").over(w).alias("next_id"))


def standings_progression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.running_table(encounters(spark, sf_dir).filter(views.counted()))


STANDINGS_SQL = f"""
WITH {ENCOUNTERS_SQL},
rows AS (
  SELECT season, competition, round, home_id AS team, home_score AS gf, away_score AS ga FROM encounters WHERE {COUNTED_SQL}
  UNION ALL SELECT season, competition, round, away_id, away_score, home_score FROM encounters WHERE {COUNTED_SQL}),
each AS (SELECT season, competition, round, team, count(*) AS p, sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) AS pts,
           sum(gf) AS f, sum(ga) AS a FROM rows GROUP BY ALL),
grid AS (SELECT * FROM (SELECT DISTINCT season, competition, team FROM each) JOIN (SELECT DISTINCT season, competition, round FROM each)
         USING (season, competition)),
sums AS (
  SELECT season, competition, round, team, CAST(coalesce(sum(p) OVER w, 0) AS BIGINT) AS played, CAST(coalesce(sum(pts) OVER w, 0) AS BIGINT) AS points,
    CAST(coalesce(sum(f) OVER w, 0) AS BIGINT) AS goals_for, CAST(coalesce(sum(a) OVER w, 0) AS BIGINT) AS goals_against
  FROM grid LEFT JOIN each USING (season, competition, round, team)
  WINDOW w AS (PARTITION BY season, competition, team ORDER BY round ROWS UNBOUNDED PRECEDING))
SELECT *, CAST(row_number() OVER (PARTITION BY season, competition, round
  ORDER BY points DESC, goals_for - goals_against DESC, goals_for DESC, team) AS INTEGER) AS position FROM sums"""


def points_per_win(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables printed with two points for a win up to 1994, three after."""
    rows = encounters(spark, sf_dir).filter(views.counted())
    own = rows.select("season", "competition", F.col("home_id").alias("team"), (F.col("home_score") > F.col("away_score")).cast("int").alias("w"), (F.col("home_score") == F.col("away_score")).cast("int").alias("d"))
    printed = own.groupBy("season", "competition", "team").agg(F.sum("w").alias("wins"), F.sum("d").alias("draws"))
    printed = printed.withColumn("points", F.when(F.col("season") <= 1994, 2).otherwise(3) * F.col("wins") + F.col("draws"))
    return windows.points_fit(printed)


POINTS_SQL = f"""
WITH {ENCOUNTERS_SQL},
t AS (SELECT season, competition, home_id, count(*) FILTER (home_score > away_score) AS w, count(*) FILTER (home_score = away_score) AS d
      FROM encounters WHERE {COUNTED_SQL} GROUP BY ALL),
p AS (SELECT *, CASE WHEN season <= 1994 THEN 2 ELSE 3 END * w + d AS points FROM t),
f AS (SELECT season, competition, count(*) FILTER (points = 2 * w + d) AS rows_two, count(*) FILTER (points = 3 * w + d) AS rows_three FROM p GROUP BY ALL)
SELECT *, CAST(CASE WHEN rows_two > rows_three THEN 2 ELSE 3 END AS INTEGER) AS points_per_win FROM f"""


def actor_spells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one event type per user."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return windows.islands(rows, ["user_id"], ["ts", "event_id"], "event_type", "ts", "ts")


SPELLS_SQL = """
WITH c AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS change
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, CAST(sum(change) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS spell FROM c)
SELECT user_id, spell, event_type, min(ts) AS first, max(ts) AS last, count(*) AS n FROM n GROUP BY ALL"""


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as 30-day spans, merged per customer."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("start"))
    return windows.merged_intervals(rows.withColumn("end", F.date_add("start", 30)), ["o_custkey"], "start", "end")


MERGE_SQL = """
WITH o AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + 30 AS e FROM orders),
r AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM o),
p AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > 1 THEN 1 ELSE 0 END)
        OVER (PARTITION BY o_custkey ORDER BY s, e RANGE UNBOUNDED PRECEDING) AS part FROM r)
SELECT o_custkey, CAST(min(s) AS DATE) AS first, CAST(max(e) AS DATE) AS last, count(*) AS n FROM p GROUP BY o_custkey, part"""


def neighbour_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest known value around events whose value is blanked where the id divides by 3."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    return windows.neighbours(rows, ["user_id"], ["ts", "event_id"], "value").select("event_id", "previous_value", "next_value")


NEIGHBOUR_SQL = """
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events)
SELECT event_id,
  last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_value,
  first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_value
FROM e"""


def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of type ``login`` (or the first type by name) head a section; values known in it carry forward."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", F.when(F.col("event_id") % 4 == 0, F.col("value")).alias("value"))
    out = windows.carried(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", ["value"])
    return out.select("event_id", "section", "carried_value")


CARRY_SQL = """
WITH e AS (SELECT event_id, user_id, ts, event_type, CASE WHEN event_id % 4 = 0 THEN value END AS value,
             CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS section
           FROM events)
SELECT event_id, section, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id, section ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried_value FROM e"""


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of at least three long lines of a document, the longest of each."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    return windows.longest_block(windows.blocks(rows, ["doc_id"], "line", F.length("content") >= 40, 3), ["doc_id"])


BLOCKS_SQL = """
WITH l AS (SELECT doc_id, i - 1 AS line, length(ls[i]) >= 40 AS member
           FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, CAST(len(ls) + 1 AS BIGINT))) AS u(i)),
b AS (SELECT *, sum(CASE WHEN member THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS part FROM l),
g AS (SELECT doc_id, min(line) AS first, max(line) AS last, count(*) AS n FROM b WHERE member GROUP BY doc_id, part HAVING count(*) >= 3)
SELECT doc_id, CAST(first AS INTEGER) AS first, CAST(last AS INTEGER) AS last, n FROM g
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1"""


def month_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dear orders of each priority: two a month first, ten in all."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", F.month("o_orderdate").alias("month"))
    out = windows.quota(rows, ["o_orderpriority"], "month", [F.desc("o_totalprice"), "o_orderkey"], 2, 30)
    return out.select("o_orderpriority", "month", "o_orderkey", "place")


QUOTA_SQL = """
WITH o AS (SELECT o_orderkey, o_orderpriority, o_totalprice, CAST(month(o_orderdate) AS INTEGER) AS month FROM orders),
i AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, month ORDER BY o_totalprice DESC, o_orderkey) > 2 AS late FROM o)
SELECT o_orderpriority, month, o_orderkey, CAST(place AS INTEGER) AS place FROM
  (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY late, o_totalprice DESC, o_orderkey) AS place FROM i) WHERE place <= 30"""


def novel_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matches(spark, sf_dir).select("opponent_id", "competition", "season")
    return windows.novel(rows, ["opponent_id", "competition"], "season")


NOVEL_SQL = f"""
WITH {MATCHES_SQL}, a AS (SELECT DISTINCT opponent_id, competition, season FROM matches), k AS (SELECT DISTINCT season FROM a)
SELECT a.opponent_id, a.competition, a.season, CASE WHEN k.season IS NOT NULL THEN b.season IS NULL END AS is_new
FROM a LEFT JOIN a b ON a.opponent_id = b.opponent_id AND a.competition = b.competition AND b.season = a.season - 1
LEFT JOIN k ON k.season = a.season - 1"""


def history_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.trimmed_history(table(spark, sf_dir, "conversations"), 6, 1200).select("conv_id", "turn", "role")


HISTORY_SQL = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS nth,
             sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS held FROM conversations),
k AS (SELECT *, max(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS begun
      FROM r WHERE nth <= 6 AND held <= 1200)
SELECT conv_id, turn, role FROM k WHERE begun = 1"""


def ninety_percent_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months that hold 90 % of a year's orders."""
    rows = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month")).agg(F.count("*").alias("n"))
    return windows.covering_prefix(rows, ["year"], "n", ["month"])


PREFIX_SQL = """
WITH c AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n FROM orders GROUP BY ALL),
s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY year ORDER BY n DESC, month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(n) OVER (PARTITION BY year) AS total, row_number() OVER (PARTITION BY year ORDER BY n DESC, month) AS place FROM c)
SELECT year, month, n, CAST(place AS INTEGER) AS place FROM s WHERE before < 0.9 * total"""

DEFINED = {
    "last_heavy_loss": (last_heavy_loss, f"WITH {MATCHES_SQL} SELECT * FROM matches WHERE {COUNTED_SQL} AND is_home = 1 AND goal_difference <= -4 ORDER BY match_date DESC, match_id LIMIT 1"),
    "perspective_flatten": (matches, f"WITH {MATCHES_SQL} SELECT * FROM matches"),
    "stats_long_form": (stats_long, f"WITH {MATCHES_SQL} SELECT match_id, 'own' AS side, own_score AS score FROM matches UNION ALL SELECT match_id, 'opponent', opponent_score FROM matches"),
    "seasons": (seasons, SEASONS_SQL),
    "opponents": (opponents, OPPONENTS_SQL),
    "rankings": (rankings, _rankings_sql()),
    "counts_by_competition": (counts_by_competition, f"WITH {MATCHES_SQL} SELECT competition, count(*) AS n FROM matches WHERE {COUNTED_SQL} GROUP BY competition"),
    "by_decade": (by_decade, f"WITH {MATCHES_SQL} SELECT CAST(season // 10 * 10 AS VARCHAR) || 's' AS decade, status, count(*) AS n FROM matches GROUP BY ALL"),
    "coverage_tiles": (tiles, f"WITH {MATCHES_SQL} SELECT count(*) AS matches, count(*) FILTER ({COUNTED_SQL}) AS counted, count(DISTINCT season) AS seasons, count(DISTINCT opponent_id) AS opponents, count(DISTINCT (competition, season)) AS competition_seasons, min(match_date) AS first_date, max(match_date) AS last_date, count(*) FILTER (is_home = 1) AS home FROM matches"),
    "next_scheduled": (next_scheduled, f"WITH {MATCHES_SQL} SELECT match_id, match_date FROM matches WHERE status = 'scheduled' AND match_date >= DATE '1998-01-01' ORDER BY match_date, match_id LIMIT 1"),
    "adjacent_matches": (adjacent_matches, f"WITH {MATCHES_SQL} SELECT match_id, lag(match_id) OVER w AS previous_id, lead(match_id) OVER w AS next_id FROM matches WINDOW w AS (PARTITION BY season, competition ORDER BY match_date, match_id)"),
    "standings_progression": (standings_progression, STANDINGS_SQL),
    "points_per_win": (points_per_win, POINTS_SQL),
    "actor_spells": (actor_spells, SPELLS_SQL),
    "interval_merge": (interval_merge, MERGE_SQL),
    "neighbour_dates": (neighbour_dates, NEIGHBOUR_SQL),
    "carry_forward": (carry_forward, CARRY_SQL),
    "line_blocks": (line_blocks, BLOCKS_SQL),
    "month_quota": (month_quota, QUOTA_SQL),
    "novel_vs_previous_period": (novel_actors, NOVEL_SQL),
    "history_budget_trim": (history_budget, HISTORY_SQL),
    "ninety_percent_prefix": (ninety_percent_prefix, PREFIX_SQL),
}
