"""Dates, spans of weeks and days, and places in a film, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A span of weeks and days as models write it. Fixed value.
WEEKS_DAYS = "\\(?[\"']?([0-9]+)\\s*(weeks?)?[\"']?,?\\s*[\"']?([0-9]+)\\s*(days?)?[\"']?\\s*\\)?"


def within_dates(moment: Column, start: str | None = None, end: str | None = None) -> Column:
    """Whether a moment lies between two days, both inclusive; the end is its midnight."""
    out = F.lit(True)
    if start is not None:
        out = out & (moment >= F.lit(start).cast("timestamp"))
    if end is not None:
        out = out & (moment <= F.lit(end).cast("timestamp"))
    return out


def same_date(a: Column, b: Column) -> Column:
    """Whether two dates like 3/7/2024 are the same; what isn't one raises."""

    def date(x: Column) -> Column:
        fits = F.regexp_like(x, F.lit("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"))
        day = F.try_to_timestamp(x, F.lit("M/d/yyyy"))
        return F.when(fits & day.isNotNull(), day).otherwise(F.raise_error(F.concat(F.lit("not a date: "), F.coalesce(x, F.lit("null")))).cast("timestamp"))

    return date(a) == date(b)


def weeks_and_days(text: Column) -> Column:
    """(weeks, days) of a text; null if it has none."""
    return F.when(F.regexp_like(text, F.lit(WEEKS_DAYS)), F.struct(F.regexp_extract(text, WEEKS_DAYS, 1).cast("int").alias("weeks"), F.regexp_extract(text, WEEKS_DAYS, 3).cast("int").alias("days")))


def same_span(answer: Column, truth: Column) -> Column:
    """Whether two texts name the same weeks and days; an answer without any doesn't."""
    return F.coalesce(weeks_and_days(answer) == weeks_and_days(truth), F.lit(False))


def seconds(milliseconds: Column) -> Column:
    return milliseconds / 1000.0


def frame_time(frame: Column, rate: Column) -> Column:
    """The second of a frame, to four places."""
    return F.bround(frame / rate, 4)


def length_bucket(length_seconds: Column, width: int = 10, most: int = 60) -> Column:
    """The bucket of a film's minutes, such as (10, 20]; its upper edge belongs to it, and beyond the last is open."""
    minutes = length_seconds / 60.0
    n = F.greatest(F.ceil(minutes / width), F.lit(1))
    edge = lambda k: (k * width).cast("int").cast("string")
    return F.when(minutes > most, f"{most}+").otherwise(F.concat(F.lit("("), edge(n - 1), F.lit(", "), edge(n), F.lit("]")))
