"""Calendar columns: Easter, movable and fixed holidays, relative and displayed dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Holidays on a fixed day, and those by their distance to Easter.
FIXED = ("01-01", "04-21", "05-01", "09-07", "10-12", "11-02", "11-15", "11-20", "12-25")
MOVABLE = (-48, -47, -2, 60)


def easter(year: Column) -> Column:
    """Gregorian Easter by integer arithmetic."""
    div = lambda a, b: F.floor(a / b)
    a, b, c = year % 19, div(year, 100), year % 100
    h = (19 * a + b - div(b, 4) - div(b - div(b + 8, 25) + 1, 3) + 15) % 30
    low = (32 + 2 * (b % 4) + 2 * div(c, 4) - h - c % 4) % 7
    m = div(a + 11 * h + 22 * low, 451)
    n = h + low - 7 * m + 114
    return F.make_date(year.cast("int"), div(n, 31).cast("int"), (n % 31 + 1).cast("int"))


def calendar(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(d, holiday, business, n_business): each day of a span with its running number of business days."""
    days = spark.sql(f"select explode(sequence(date '{first}', date '{last}')) as d")
    e = easter(F.year("d"))
    holiday = F.date_format("d", "MM-dd").isin(*FIXED) | F.datediff("d", e).isin(*MOVABLE)
    work = ~holiday & ~F.dayofweek("d").isin(1, 7)
    from pyspark.sql import Window

    return days.select("d", holiday.alias("holiday"), work.alias("business"), F.sum(work.cast("int")).over(Window.orderBy("d")).alias("n_business"))


def relative_date(text: Column, today: Column) -> Column:
    """``hoje``, ``ontem``, ``há N dias`` or ``dd/MM/yyyy``; else null."""
    t = F.lower(F.trim(text))
    n = F.regexp_extract(t, "h[áa] (\\d+) dias?", 1)
    return F.when(t.startswith("hoje"), today).when(t.startswith("ontem"), F.date_sub(today, 1)).when(n != "", F.date_sub(today, F.try_to_number(F.nullif(n, F.lit("")), F.lit("9999")).cast("int"))).otherwise(F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(t, "(\\d{2}/\\d{2}/\\d{4})", 1), F.lit("")), F.lit("dd/MM/yyyy"))))


def shown_date(ts: Column, now: Column) -> Column:
    day, today = F.to_date(ts), F.to_date(now)
    return F.when(day == today, F.concat(F.lit("hoje "), F.date_format(ts, "HH:mm"))).when(day == F.date_sub(today, 1), "ontem").otherwise(F.date_format(ts, "dd/MM"))
