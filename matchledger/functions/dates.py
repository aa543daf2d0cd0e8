"""Dates as text and as dates: partial dates, spans, windows, references relative to an issue's date."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pattern of a phrase (scanned text may lack its space), days from the issue's date, confidence; the first that a text has is
#: taken. Fixed values.
RELATIVE = (
    ("i\\s?går", -1, "high"), ("gårsdagens", -1, "high"), ("i\\s?morgen", 1, "high"), ("morgendagens", 1, "high"),
    ("kveldens kamp", 0, "high"), ("i\\s?kveld", 0, "medium"), ("i\\s?dag", 0, "medium"),
)
WEEKDAYS = ("mandag", "tirsdag", "onsdag", "torsdag", "fredag", "lørdag", "søndag")


def precision(c: Column) -> Column:
    """How exact a date is that may be a year, a month or a day."""
    return F.when(c.rlike("^\\d{4}$"), "year").when(c.rlike("^\\d{4}-\\d{2}$"), "month").when(F.try_to_date(c, F.lit("yyyy-MM-dd")).isNotNull() & c.rlike("^\\d{4}-\\d{2}-\\d{2}$"), "day")


def year_of(c: Column) -> Column:
    return F.substring(c, 1, 4).try_cast("int")


def covers(start: Column, end: Column, at: Column) -> Column:
    """Whether a span holds a value; open ends hold everything."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (end >= at))


def year_span(start: Column, end: Column, most: int = 40) -> Column:
    """All years of a span; none where it is longer than ``most`` or runs backwards."""
    last = F.coalesce(end, start)
    return F.when((last >= start) & (last - start <= most), F.sequence(start, last)).otherwise(F.array().cast("array<int>"))


def relative_date(text: Column, issue: Column) -> Column:
    """(date, confidence) that a text gives relative to its issue, by phrase or else by the weekday named first."""
    low = F.lower(text)
    phrase = F.lit(None)
    for pattern, days, confidence in reversed(RELATIVE):
        met = low.rlike(f"(?<![\\p{{L}}\\p{{N}}_]){pattern}(?![\\p{{L}}\\p{{N}}_])")
        phrase = F.when(met, F.struct(F.date_add(issue, days).alias("date"), F.lit(confidence).alias("confidence"))).otherwise(phrase)
    places = F.array(*(F.when(F.locate(d, low) > 0, F.struct(F.locate(d, low).alias("at"), F.lit(i).alias("day"))) for i, d in enumerate(WEEKDAYS)))
    first = F.array_min(F.array_compact(places))
    back = F.pmod(F.weekday(issue) - first["day"], F.lit(7))
    named = F.struct(F.date_sub(issue, F.when(back == 0, 7).otherwise(back)).alias("date"), F.lit("low").alias("confidence"))
    return F.coalesce(phrase, F.when(first.isNotNull(), named))


def local_time(at: Column, zone: str = "Europe/Oslo") -> Column:
    """The date and the time of day (HH:mm) in a zone of a time in UTC, whatever the session's zone is."""
    local = F.convert_timezone(F.lit("UTC"), F.lit(zone), at.cast("timestamp_ntz"))
    return F.struct(local.cast("date").alias("date"), F.date_format(local, "HH:mm").alias("time"))
