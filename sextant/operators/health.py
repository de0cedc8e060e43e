"""Levels of a source's daily volume."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_rest(day: Column) -> Column:
    """Weekends and the first day of the year."""
    return F.dayofweek(day).isin(1, 7) | (F.date_format(day, "MM-dd") == "01-01")


def health_level(volume: Column, day: Column, least: Column | int) -> Column:
    """No volume is critical but for days of rest; less than the source's ``least`` calls for attention."""
    least = F.lit(least) if isinstance(least, int) else least
    return F.when(volume == 0, F.when(is_rest(day), "ok").otherwise("critico")).when(volume < least, "atencao").otherwise("ok")
