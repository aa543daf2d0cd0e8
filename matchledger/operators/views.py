"""Views from the focal participant's side: matches, statistics, seasons, opponents, rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import COUNTED


def counted(status: str = "status") -> Column:
    """The one definition of a result that counts."""
    return F.col(status).isin(*COUNTED)


def result_letter(own: Column, opponent: Column) -> Column:
    """S, U or T; null without both scores."""
    return F.when(own > opponent, "S").when(own < opponent, "T").when(own == opponent, "U")


def perspective(encounters: DataFrame, focal: int) -> DataFrame:
    """Encounters of one participant, with its own side first."""
    home = F.col("home_id") == focal
    pick = lambda a, b: F.when(home, F.col(a)).otherwise(F.col(b))
    sides = encounters.filter(home | (F.col("away_id") == focal)).select(
        "match_id",
        "season",
        "competition",
        "round",
        "match_date",
        "status",
        home.cast("int").alias("is_home"),
        pick("away_id", "home_id").alias("opponent_id"),
        pick("home_score", "away_score").alias("own_score"),
        pick("away_score", "home_score").alias("opponent_score"),
    )
    own, other = F.col("own_score"), F.col("opponent_score")
    return sides.withColumns({"goal_difference": own - other, "result": F.when(counted(), result_letter(own, other))})


def long_form(matches: DataFrame, metrics: dict[str, tuple[str, str]]) -> DataFrame:
    """Two rows per match: each metric of the own and of the opponent's side."""
    sides = [F.struct(F.lit(side).alias("side"), *(F.col(c[i]).alias(m) for m, c in metrics.items())) for i, side in enumerate(("own", "opponent"))]
    return matches.select("match_id", F.inline(F.array(*sides)))


def tally() -> list[Column]:
    """Aggregates of results that count."""
    n = lambda letter: F.count_if(F.col("result") == letter)
    total = lambda c: F.coalesce(F.sum(F.when(counted(), F.col(c))), F.lit(0))
    return [
        F.count_if(counted()).alias("played"),
        n("S").alias("wins"),
        n("U").alias("draws"),
        n("T").alias("losses"),
        total("own_score").alias("goals_for"),
        total("opponent_score").alias("goals_against"),
        total("goal_difference").alias("goal_difference"),
    ]


def coverage(expected: Column, counted_rounds: Column, distinct: Column, first: Column, last: Column, missing_scores: Column) -> Column:
    """How complete a season's rounds are."""
    return (
        F.when(distinct == 0, "no_rounds")
        .when((first == 1) & (distinct == last) & (last >= expected) & (missing_scores == 0), "complete")
        .when((first == 1) & (distinct == last) & (last >= expected), "in_progress")
        .when((first == 1) & (distinct == last), "prefix")
        .when(counted_rounds == 0, "scheduled_only")
        .otherwise("partial")
    )


def seasons(matches: DataFrame, expected_rounds: int = 12) -> DataFrame:
    """One row per season and competition: totals, first and last match, and how complete its rounds are."""
    played = counted()
    rows = matches.groupBy("season", "competition").agg(
        F.count("*").alias("matches"),
        *tally(),
        F.min("match_date").alias("first_date"),
        F.max("match_date").alias("last_date"),
        F.count_distinct(F.when(played, F.col("round"))).alias("rounds_played"),
        F.count_distinct("round").alias("rounds"),
        F.min("round").alias("first_round"),
        F.max("round").alias("last_round"),
        F.count_if(~played).alias("open"),
        F.round(F.avg(F.when((F.col("is_home") == 1) & played, F.col("own_score") * 1000)), 0).cast("int").alias("home_average"),
    )
    kind = coverage(F.lit(expected_rounds), F.col("rounds_played"), F.col("rounds"), F.col("first_round"), F.col("last_round"), F.col("open"))
    return rows.withColumn("coverage", kind)


def opponents(matches: DataFrame, names: DataFrame) -> DataFrame:
    """Head-to-head totals for every opponent, also those never met; names: opponent_id, name."""
    totals = matches.groupBy("opponent_id").agg(
        *tally(),
        F.min(F.when(counted(), F.col("match_date"))).alias("first_meeting"),
        F.max(F.when(counted(), F.col("match_date"))).alias("last_meeting"),
        F.min("match_date").alias("first_any_status"),
        F.count_if(F.col("status") == "scheduled").alias("scheduled"),
    )
    zero = [c for c in totals.columns if c not in ("opponent_id",) and not c.startswith(("first", "last"))]
    return names.join(totals, "opponent_id", "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})


RANKINGS = {
    "largest_win": [F.desc, "goal_difference"],
    "largest_defeat": [F.asc, "goal_difference"],
    "most_goals": [F.desc, "goals"],
    "fewest_goals": [F.asc, "goals"],
    "newest": [F.desc, "match_date"],
    "oldest": [F.asc, "match_date"],
}


def ranked(matches: DataFrame, ranking: str, limit: int = 20, most: int = 100) -> DataFrame:
    """The first matches under a ranking; ties go to the later date, then to the smaller id."""
    order, column = RANKINGS[ranking]
    rows = matches.filter(counted()).withColumn("goals", F.col("own_score") + F.col("opponent_score"))
    return rows.orderBy(order(column), F.desc("match_date"), "match_id").limit(min(max(limit, 1), most))


def all_rankings(matches: DataFrame, limit: int = 20, most: int = 100) -> DataFrame:
    """The first matches under every ranking, from one pass: each part of the input keeps its own first rows before any are
    shuffled. Ties as in ``ranked``; matches without the value come last."""
    rows = matches.filter(counted()).withColumn("goals", F.col("own_score") + F.col("opponent_score"))
    size = {"match_date": F.unix_date("match_date")}
    keys = {name: size.get(c, F.col(c)) * (1 if order is F.asc else -1) for name, (order, c) in RANKINGS.items()}
    each = rows.select("*", F.inline(F.array(*(F.struct(F.lit(name).alias("ranking"), k.alias("_key")) for name, k in keys.items()))))
    place = F.row_number().over(Window.partitionBy("ranking").orderBy(F.asc_nulls_last("_key"), F.desc("match_date"), "match_id"))
    return each.withColumn("_place", place).filter(F.col("_place") <= min(max(limit, 1), most)).drop("_key", "_place")


def filtered(df: DataFrame, conditions: list[Column | None]) -> DataFrame:
    """All conditions that are given."""
    given = [c for c in conditions if c is not None]
    return df.filter(reduce(lambda a, b: a & b, given)) if given else df


def last_heavy_loss(matches: DataFrame, margin: int) -> DataFrame:
    """The latest home loss by at least so many."""
    rows = matches.filter(counted() & (F.col("is_home") == 1) & (F.col("goal_difference") <= -margin))
    return rows.orderBy(F.desc("match_date"), "match_id").limit(1)


def distribution(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def tiles(matches: DataFrame) -> DataFrame:
    """Counts over the whole archive in one pass."""
    return matches.agg(
        F.count("*").alias("matches"),
        F.count_if(counted()).alias("counted"),
        F.count_distinct("season").alias("seasons"),
        F.count_distinct("opponent_id").alias("opponents"),
        F.count_distinct("competition", "season").alias("competition_seasons"),
        F.min("match_date").alias("first_date"),
        F.max("match_date").alias("last_date"),
        F.count_if((F.col("is_home") == 1)).alias("home"),
    )
