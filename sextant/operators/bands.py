"""The cascade of news bands: representatives, diversity floors and the exclusion of what earlier bands show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: Days of each band (0 is the civil day), rows a tab shows.
BAND_DAYS = (0, 7, 15, 30)
SHOWN = 20


def best(key: str, rows: DataFrame) -> DataFrame:
    """The best row of each key by score, then the latest, then the first id; rows without a key stay."""
    rest = [c for c in rows.columns if c not in ("score", "ts", "id")]
    top = F.max(F.struct("score", "ts", (-F.col("id")).alias("minus_id"), *rest)).alias("x")
    found = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("by_key"), F.col("tab").alias("by_tab")).agg(top)
    found = found.select(*(F.col(f"x.{c}") if c != "id" else (-F.col("x.minus_id")).alias("id") for c in rows.columns))
    return found.unionByName(rows.where(F.col(key).isNull()))


def representatives(rows: DataFrame) -> DataFrame:
    """One row a cluster, then one a link."""
    return best("link", best("cluster", rows))


def order() -> list[Column]:
    return [F.desc("score"), F.desc("ts"), F.asc("id")]


def with_floors(rows: DataFrame, volumes: DataFrame, shown: int = SHOWN) -> DataFrame:
    """``rows(id, tab, theme, score, ts, ..)`` and ``volumes(tab, theme, volume)`` to the ``shown`` rows of each tab with their places.

    A theme's floor is its share of the tab's volume, at least one and at most what it has; while floors come to more than ``shown``
    the largest gives way.  The best rows by score are taken; where a theme lies below its floor its best missing rows
    replace the lowest rows of themes above theirs.  Only the first ``shown`` rows of each theme matter, so all steps after that are small.
    """
    themed = rows.withColumn("theme_place", F.row_number().over(Window.partitionBy("tab", "theme").orderBy(*order()))).where(F.col("theme_place") <= shown)
    c = written(themed.withColumn("place", F.row_number().over(Window.partitionBy("tab").orderBy(*order()))), "candidates")
    base = F.col("place") <= shown
    themes = c.groupBy("tab", "theme").agg(F.count("*").alias("has"), F.count_if(base).alias("taken"), F.min("place").alias("at")).join(volumes, ["tab", "theme"])
    all_of_tab = Window.partitionBy("tab")
    floor = F.least(F.greatest(F.lit(1), F.floor(F.lit(shown) * F.col("volume") / F.sum("volume").over(all_of_tab) + 0.5)), F.col("has"))
    themes = with_absent(themes, volumes).withColumn("floor", F.when(F.col("has") > 0, floor).otherwise(0))
    units = themes.where("floor > 1").select("tab", "theme", "at", F.explode(F.sequence(F.lit(2), "floor")).alias("level"))
    over = themes.groupBy("tab").agg((F.sum("floor") - shown).alias("over"))
    cut = units.withColumn("n", F.row_number().over(Window.partitionBy("tab").orderBy(F.desc("level"), "at"))).join(over, "tab").where("n <= over").groupBy("tab", "theme").agg(F.count("*").alias("cut"))
    themes = themes.join(cut, ["tab", "theme"], "left").withColumn("floor", F.col("floor") - F.coalesce("cut", F.lit(0)))
    needs = F.greatest(F.lit(0), F.col("floor") - F.col("taken"))
    themes = themes.withColumn("needs", needs).withColumn("spare", F.greatest(F.lit(0), F.col("taken") - F.col("floor")))
    themes = themes.withColumn("swaps", F.least(F.sum("needs").over(all_of_tab), F.sum("spare").over(all_of_tab))).withColumn("needs_before", F.sum("needs").over(all_of_tab.orderBy("at", "theme")) - F.col("needs"))
    j = c.join(themes.select("tab", "theme", "taken", "needs", "spare", "swaps", "needs_before"), ["tab", "theme"])
    lowest = F.row_number().over(Window.partitionBy("tab", "theme", base).orderBy("score", "place"))
    j = j.withColumn("lowest", lowest).withColumn("can_go", base & (F.col("lowest") <= F.col("spare")))
    j = j.withColumn("goes", F.col("can_go") & (F.row_number().over(Window.partitionBy("tab", "can_go").orderBy("score", "place")) <= F.col("swaps")))
    missing = F.col("theme_place") - F.col("taken")
    comes = ~base & (missing <= F.col("needs")) & (F.col("needs_before") + missing <= F.col("swaps"))
    chosen = j.where((base & ~F.col("goes")) | comes)
    return chosen.withColumn("place", F.row_number().over(Window.partitionBy("tab").orderBy(*order()))).select(*rows.columns, "place")


def with_absent(themes: DataFrame, volumes: DataFrame) -> DataFrame:
    """Themes without a candidate count in the tab's volume and have no floor."""
    absent = volumes.join(themes.select("tab", "theme"), ["tab", "theme"], "left_anti").join(themes.select("tab").distinct(), "tab", "left_semi")
    return themes.unionByName(absent.withColumn("has", F.lit(0).cast("long")).withColumn("taken", F.lit(0).cast("long")).withColumn("at", F.lit(None).cast("int")))


def in_band(ts: Column, days: int, now: Column) -> Column:
    """The civil day at UTC-3 for 0 days, else not older than that; rows without a time are in none."""
    civil = lambda t: F.to_date(t - F.expr("interval 3 hours"))
    return civil(ts) == civil(now) if not days else ts >= now - F.expr(f"interval {days} days")


def cascade(rows: DataFrame, now: Column, days: tuple[int, ...] = BAND_DAYS) -> DataFrame:
    """``rows(id, tab, theme, link, cluster, score, ts)`` to (id, tab, theme, band, place); a band shows no cluster or link that an earlier one shows in its tab."""
    volumes = rows.groupBy("tab", "theme").agg(F.count("*").alias("volume"))
    shown = None
    for band in days:
        left = rows.where(in_band(F.col("ts"), band, now))
        if shown is not None:
            for key in ("cluster", "link"):
                seen = shown.where(F.col(key).isNotNull()).select("tab", key).distinct()
                left = left.join(F.broadcast(seen), ["tab", key], "left_anti")  # 20 rows a tab and band
        picked = with_floors(representatives(left), volumes).withColumn("band", F.lit(band))
        picked = written(picked.select("id", "tab", "theme", "link", "cluster", "band", "place"), "band")
        shown = picked if shown is None else shown.union(picked)
    return shown.select("id", "tab", "theme", "band", "place")
