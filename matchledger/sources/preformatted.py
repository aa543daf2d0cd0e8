"""Preformatted result pages: round and date headings, results and table rows, one a line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RESULT = "^\\s*(\\S.*?)\\s+-\\s+(\\S.*?)\\s+(\\d{1,2})-(\\d{1,2})(?!\\d)\\s*(.*)$"
#: Name, then played, wins, draws, losses, goals and points.
TABLE = "^\\s*(?:\\d+\\.\\s*)?(\\S.*?)\\s+(\\d+)\\s+(\\d+)\\s+(\\d+)\\s+(\\d+)\\s+(\\d+)-(\\d+)\\s+(\\d+)\\s*(.*)$"


def lines(pages: DataFrame, page: str, text: str) -> DataFrame:
    return pages.select(page, F.posexplode(F.split(text, "\\r?\\n")).alias("nth", "line"))


def results(pages: DataFrame, page: str, text: str) -> DataFrame:
    """Result lines with the round and date of the last headings before them on their page. A heading of a round ends
    the date before it."""
    rows = lines(pages, page, text)
    rnd = F.regexp_extract("line", "(?i)^\\s*round\\s+(\\d+)", 1).try_cast("int")
    day = [F.regexp_extract("line", "^\\s*(\\d{1,2})/(\\d{1,2})\\s*:", i).try_cast("int") for i in (1, 2)]
    before = Window.partitionBy(page).orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_round", rnd).withColumn("_day", F.when(day[0].isNotNull(), F.struct(day[1].alias("month"), day[0].alias("day"))))
    rows = rows.select("*", F.last("_round", True).over(before).alias("round"), F.last(F.when(F.col("_day").isNotNull() | F.col("_round").isNotNull(), F.struct("_day")), True).over(before).alias("_last"))
    body = rows.withColumn("_body", F.regexp_replace("line", "^\\s*\\d{1,2}/\\d{1,2}\\s*:", "")).filter(F.col("_body").rlike(RESULT))
    part = lambda i: F.regexp_extract("_body", RESULT, i)
    return body.select(
        page, "nth", "round", F.col("_last._day.month").alias("month"), F.col("_last._day.day").alias("day"),
        part(1).alias("home"), part(2).alias("away"), part(3).cast("int").alias("home_score"), part(4).cast("int").alias("away_score"), F.nullif(part(5), F.lit("")).alias("note"),
    )


def standings(pages: DataFrame, page: str, text: str) -> DataFrame:
    """Table rows in order, with their position on the page. A name may end in digits: a row counts where wins, draws
    and losses sum to the matches played."""
    rows = lines(pages, page, text).filter(F.col("line").rlike(TABLE))
    part = lambda i: F.regexp_extract("line", TABLE, i)
    names = ("played", "wins", "draws", "losses", "goals_for", "goals_against", "points")
    rows = rows.select(page, "nth", part(1).alias("name"), *(part(i + 2).try_cast("int").alias(n) for i, n in enumerate(names)), F.nullif(part(9), F.lit("")).alias("status"))
    rows = rows.filter("wins + draws + losses = played")
    return rows.select(page, F.row_number().over(Window.partitionBy(page).orderBy("nth")).alias("position"), "name", *names, "status")
