"""Scores, verdicts and points of postings and news."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Caps and points of the scores, bounds in days with their points.
AREA_CAP = 40
ADHERENCE_CAP = 55
ELIGIBILITY_POINTS = {"elegivel_agora": 30, "elegivel_futuro": 15, "indeterminada": 10}
URGENCY = ((7, 15), (15, 12), (30, 9))
RECENCY = ((3, 30), (7, 22), (14, 15), (30, 8))
CLOSE_AREAS = ("Design", "UX/IHC")


def steps(days: Column, bounds: tuple[tuple[int, int], ...], beyond: int) -> Column:
    found = None
    for most, points in bounds:
        found = F.when(days <= most, points) if found is None else found.when(days <= most, points)
    return found.otherwise(beyond)


def urgency_points(deadline: Column, now: Column) -> Column:
    """By whole days left, rounded up, so that the last day counts as 0; 7 if unknown, 2 if over."""
    days = F.ceil((F.unix_timestamp(deadline.cast("timestamp")) - F.unix_timestamp(now.cast("timestamp"))) / 86400)
    return F.when(deadline.isNull(), 7).when(days < 0, 2).otherwise(steps(days, URGENCY, 5))


def recency_points(published: Column, now: Column) -> Column:
    """By whole days since, rounded down; 5 if unknown, 30 if in the future."""
    days = F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(published.cast("timestamp"))) / 86400)
    return F.when(published.isNull(), 5).otherwise(steps(days, RECENCY, 3))


def eligibility(degree: Column, master_confirmed: bool = True) -> Column:
    d = F.lower(F.coalesce(degree, F.lit("")))
    now = F.lit("elegivel_agora")
    return (
        F.when(d.contains("doutorado"), "elegivel_futuro")
        .when(d.contains("mestrado"), now if master_confirmed else F.lit("elegivel_futuro"))
        .when(d.rlike("especializa(c|ç)(a|ã)o|gradua(c|ç)(a|ã)o"), now)
        .otherwise("indeterminada")
    )


def area_fit(area: Column, verdict: Column) -> Column:
    return F.when((verdict == "elegivel_agora") & (F.coalesce(area, F.lit("")) != ""), F.when(area.isin(*CLOSE_AREAS), "compativel").otherwise("a_verificar_na_banca"))


def teaching_score(area_weight: Column, verdict: Column, urgency: Column, negative: Column) -> Column:
    points = F.coalesce(*(F.when(verdict == k, v) for k, v in ELIGIBILITY_POINTS.items()))
    return F.when(negative, 0).otherwise(F.least(F.lit(AREA_CAP), F.coalesce(area_weight, F.lit(0))) + points + urgency)


def market_score(adherence: Column, recency: Column) -> Column:
    return F.when(F.coalesce(adherence, F.lit(0)) == 0, 0).otherwise(F.least(F.lit(ADHERENCE_CAP), adherence) + recency)


def raw_signal(points: Column, comments: Column, publishers: Column) -> Column:
    """Rounded before ties are counted."""
    known = 2 * F.log10(points + 1) + 1.5 * F.log10(F.coalesce(comments, F.lit(0)) + 1)
    return F.round(F.when(points.isNotNull(), known).otherwise(F.coalesce(publishers, F.lit(1)).cast("double")), 4)


def market_bucket(age: Column) -> Column:
    return F.when(age.isNull() | (age > 90), 5).when(age <= 0, 1).when(age <= 7, 2).when(age <= 30, 3).otherwise(4)


def match_class(score: Column) -> Column:
    return F.when(score.isNull(), "sem_nota").when(score >= 70, "forte").when(score >= 51, "media").otherwise("fraca")
