"""Diversity floors and the band cascade against step-by-step replays."""

import datetime
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sextant.operators import bands
from sextant.plans.more_queries import band_slice

START = datetime.datetime(2024, 1, 1)


def order(r):
    return -r["score"], -r["ts"].timestamp(), r["id"]


def replay(reps, volume, total, shown=20):
    """Swaps one at a time."""
    reps = sorted(reps, key=order)
    by_theme = defaultdict(list)
    for r in reps:
        by_theme[r["theme"]].append(r)
    floors = {t: min(max(1, int(shown * volume[t] / total + 0.5)), len(x)) for t, x in by_theme.items()}
    while sum(floors.values()) > shown:
        largest = max(floors, key=lambda t: floors[t])
        if floors[largest] == 1:
            break
        floors[largest] -= 1
    chosen = reps[:shown]
    for theme, floor in floors.items():
        missing = [r for r in by_theme[theme] if r not in chosen]
        for r in missing[: max(0, floor - sum(x["theme"] == theme for x in chosen))]:
            count = Counter(x["theme"] for x in chosen)
            spare = [x for x in chosen if count[x["theme"]] > floors[x["theme"]]]
            if not spare:
                break
            worst = min(spare, key=lambda x: x["score"])
            chosen[chosen.index(worst)] = r
    return [r["id"] for r in sorted(chosen, key=order)]


def rows(seed, n, themes):
    r = random.Random(seed)
    scores = r.sample(range(10 * n), n)
    return [{"id": k, "tab": r.choice("ab"), "theme": f"t{min(r.randrange(themes), r.randrange(themes))}", "link": r.choice([None, f"l{r.randrange(n)}"]), "cluster": r.choice([None, r.randrange(n)]), "score": scores[k] + (200 * n if k % 3 == 0 else 0), "ts": START + datetime.timedelta(hours=r.randrange(24 * 30))} for k in range(n)]


SCHEMA = "id long, tab string, theme string, link string, cluster long, score long, ts timestamp"


def test_floors_match_a_replay_of_swaps(spark):
    for seed, n, themes in ((1, 200, 9), (2, 60, 4), (3, 25, 9), (4, 400, 19)):
        data = rows(seed, n, themes)
        frame = spark.createDataFrame([tuple(x.values()) for x in data], SCHEMA)
        found = bands.with_floors(frame, frame.groupBy("tab", "theme").agg(F.count("*").alias("volume"))).collect()
        for tab in "ab":
            own = [x for x in data if x["tab"] == tab]
            got = [x.id for x in sorted((x for x in found if x.tab == tab), key=lambda x: x.place)]
            assert got == replay(own, Counter(x["theme"] for x in own), len(own))


def test_cascade_matches_a_replay(spark):
    now = START + datetime.timedelta(days=29, hours=20)
    data = rows(7, 500, 6)
    found = bands.cascade(spark.createDataFrame([tuple(x.values()) for x in data], SCHEMA), F.lit(now.isoformat(" ")).cast("timestamp")).collect()
    got = defaultdict(list)
    for x in sorted(found, key=lambda x: x.place):
        got[x.tab, x.band].append(x.id)
    civil = lambda t: (t - datetime.timedelta(hours=3)).date()
    for tab in "ab":
        own = [x for x in data if x["tab"] == tab]
        clusters, links = set(), set()
        for days in bands.BAND_DAYS:
            left = [x for x in own if (civil(x["ts"]) == civil(now) if not days else x["ts"] >= now - datetime.timedelta(days=days)) and x["cluster"] not in clusters and x["link"] not in links]
            for key in ("cluster", "link"):
                firsts = {}
                for x in sorted(left, key=order):
                    firsts.setdefault((x[key],) if x[key] is not None else x["id"], x)
                left = list(firsts.values())
            want = replay(left, Counter(x["theme"] for x in own), len(own))
            assert got[tab, days] == want
            clusters |= {x["cluster"] for x in own if x["id"] in want} - {None}
            links |= {x["link"] for x in own if x["id"] in want} - {None}


def test_an_unknown_band_is_an_error(spark):
    shown = spark.createDataFrame([(1, 7, 1), (2, 7, 9), (3, 0, 1)], "id int, band int, place int")
    assert [x.id for x in band_slice(shown, "semana", 5).collect()] == [1]
    with pytest.raises(ValueError, match="unknown band"):
        band_slice(shown, "ano")
