"""Dates and times as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ["yyyy-MM-dd", "ddMMMyyyy", "dd-MMM-yyyy", "MM/dd/yyyy"]


def parsed(c: Column) -> Column:
    """First of the accepted formats that fits; a two-digit year from 69 on is of the last century."""
    short = F.try_to_timestamp(c, F.lit("dd-MMM-yy")).cast("date")
    short = F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short)
    tries = [F.when(F.regexp_like(c, F.lit(p)), F.try_to_timestamp(c, F.lit(f)).cast("date")) for f, p in zip(FORMATS, (r"^\d{4}-\d{1,2}-\d{1,2}$", r"^\d{1,2}[A-Za-z]{3}\d{4}$", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", r"^\d{1,2}/\d{1,2}/\d{4}$"), strict=True)]
    return F.coalesce(tries[0], tries[1], F.when(F.regexp_like(c, F.lit(r"^\d{1,2}-[A-Za-z]{3}-\d{2}$")), short), *tries[2:])


def cohort_of(c: Column, boundary: str = "2023-03-14") -> Column:
    """Era of a founding date: months count by month, years as their January, anything else as the early era."""
    s = F.trim(F.coalesce(c, F.lit("")))
    month = F.regexp_like(s, F.lit(r"^\d{4}-(0[1-9]|1[0-2])$")) & (s >= boundary[:7])
    year = F.regexp_like(s, F.lit(r"^\d{4}$")) & (F.concat(s, F.lit("-01-01")) >= boundary)
    day = ~F.regexp_like(s, F.lit(r"^\d{4}(-\d{2})?$")) & (parsed(s) >= F.lit(boundary).cast("date"))
    return F.when(F.coalesce(month | year | day, F.lit(False)), "GENAI-ERA").otherwise("PRE-GENAI")


def founded_month(c: Column) -> Column:
    """YYYY-MM, else the first run of four digits from 1900 to 2100, else as it is; Unknown if missing."""
    s = F.trim(F.coalesce(c, F.lit("")))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 3, F.lit(1))), lambda i: F.substr(s, i, F.lit(4)))
    years = F.filter(runs, lambda y: F.regexp_like(y, F.lit(r"^\d{4}$")) & (y >= "1900") & (y <= "2100"))
    return (
        F.when(F.lower(s).isin("", "nan", "none", "nat"), "Unknown")
        .when(F.regexp_like(s, F.lit(r"^\d{4}-\d{2}$")), s)
        .otherwise(F.coalesce(F.date_format(parsed(s), "yyyy-MM"), F.get(years, 0), s))
    )


def founded_bucket(date: Column) -> Column:
    y = F.year(date)
    return F.when(y.isNull(), "unknown").when(y <= 2018, "<=2018").when(y >= 2024, "2024+").otherwise(y.cast("string"))


def stamp14(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("yyyyMMddHHmmss"))


def iso_time(c: Column) -> Column:
    """An ISO date and time; one without an offset is UTC, whatever the session's zone; null for anything else."""
    s = F.trim(c)
    shaped = F.regexp_like(s, F.lit(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?([Zz]|[+-]\d{2}:?\d{2})?$"))
    zoned = F.when(F.regexp_like(s, F.lit(r"([Zz]|[+-]\d{2}:?\d{2})$")), F.regexp_replace(s, r"([+-]\d{2})(\d{2})$", "$1:$2")).otherwise(F.concat(s, F.lit("Z")))
    seconds = F.regexp_replace(F.upper(zoned), r"([T ]\d{2}:\d{2})(?=[Z+-])", "$1:00")
    return F.when(shaped, seconds.try_cast("timestamp"))


def day_gap(a: Column, b: Column) -> Column:
    """Absolute value of the whole days from b to a, rounded down first."""
    return F.abs(F.floor((F.unix_timestamp(a) - F.unix_timestamp(b)) / 86400))


def duration_seconds(c: Column) -> Column:
    """Plain seconds, or a sum of numbers with ms, s, m or h; null for anything else."""
    s = F.replace(F.lower(F.trim(c)), F.lit(","), F.lit(""))
    parts = F.regexp_extract_all(s, F.lit(r"(\d+(?:\.\d+)?(?:ms|s|m|h))"), F.lit(1))
    unit = lambda p: F.regexp_extract(p, "[a-z]+$", 0)
    size = lambda p: F.when(unit(p) == "ms", 0.001).when(unit(p) == "s", 1.0).when(unit(p) == "m", 60.0).otherwise(3600.0)
    total = F.aggregate(parts, F.lit(0.0), lambda acc, p: acc + F.regexp_extract(p, r"^[\d.]+", 0).cast("double") * size(p))
    return F.coalesce(F.expr("try_cast(null as double)"), F.when(F.regexp_like(s, F.lit(r"^\d+(\.\d+)?$")), s.try_cast("double")), F.when(F.regexp_like(s, F.lit(r"^(\d+(\.\d+)?(ms|s|m|h))+$")), total))


def clock(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    return F.when(s >= 3600, F.format_string("%dh %02dm", F.floor(s / 3600), F.floor(s % 3600 / 60))).when(s >= 60, F.format_string("%dm %02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))
