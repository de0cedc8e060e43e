"""Guarded clusters against a plain replay over all pairs, and streams and backfills that are taken up again."""

import datetime
import random
from collections import defaultdict

from pyspark.sql import functions as F

from sextant.operators import replay
from sextant.operators.clusters import ACROSS, COMMON, INSIDE, clustered, similar_pairs
from sextant.operators.components import connected
from sextant.operators.storage import new_dir
from sextant.streaming.jobs import insert_unseen
from sextant.streaming.ledger import backfill, ledger, read_table

START = datetime.datetime(2024, 1, 1)


def plain(items):
    """Anchor by anchor, in the order of first appearance, then pair by pair."""
    cluster = {}
    blocks = defaultdict(list)
    for x in items:
        blocks[x[1], x[2]].append(x)
    for block in blocks.values():
        holders = defaultdict(list)
        for x in block:
            for a in x[5]:
                holders[a].append(x)
        often = {a for a, xs in holders.items() if len(block) >= 20 and len(xs) > 0.15 * len(block)}
        sets = {x[0]: set(x[5]) - often for x in block}
        root = {x[0]: x[0] for x in block}

        def find(i, root=root):
            return i if root[i] == i else find(root[i])

        def close(s, t, least):
            both = len(s & t)
            return both >= COMMON and both / len(s | t) >= least

        seen = set()
        for a, xs in holders.items():
            if a in often:
                continue
            for m, x in enumerate(xs):
                for y in xs[m + 1 :]:
                    if (x[0], y[0]) in seen or abs(x[4] - y[4]) > datetime.timedelta(hours=36):
                        continue
                    seen.add((x[0], y[0]))
                    least = INSIDE if x[3] == y[3] else ACROSS
                    p, q = find(x[0]), find(y[0])
                    if close(sets[x[0]], sets[y[0]], least) and (p == q or close(sets[p], sets[q], least)):
                        root[q] = p
        members = defaultdict(list)
        for i in root:
            members[find(i)].append(i)
        cluster |= {i: min(m) for m in members.values() for i in m}
    return cluster


def test_guarded_clusters_match_a_plain_replay(spark):
    r = random.Random(8)
    stories = [[f"w{s}_{k}" for k in range(8)] for s in range(14)]
    items = []
    for i in range(260):
        words = r.sample(stories[r.randrange(14)], r.randint(3, 5)) + r.sample([f"x{k}" for k in range(60)], r.randint(0, 3))
        r.shuffle(words)
        items.append((i, r.choice("ab"), r.choice(("pt", "en")), f"d{r.randrange(4)}", START + datetime.timedelta(hours=r.randrange(90)), words))
    frame = spark.createDataFrame(items, "id long, tab string, lang string, domain string, ts timestamp, anchors array<string>").repartition(3)
    found = dict(replay.guarded_clusters(frame).collect())
    want = plain(items)
    assert found == want
    sizes = defaultdict(int)
    for c in want.values():
        sizes[c] += 1
    assert max(sizes.values()) > 2


def test_equal_items_are_led_by_one(spark):
    words = ["alfa", "beta", "gama", "delta"]
    at = lambda h: START + datetime.timedelta(hours=h)
    items = [(k, "a", "pt", None if k % 2 else "d", at(1), words) for k in range(40)]
    items += [(100, "a", "pt", "e", at(20), words[:3]), (101, "a", "pt", "d", at(60), words), (102, "a", "pt", "d", None, words), (103, "a", "pt", "d", at(1), words[:1]), (104, "a", "pt", "d", at(1), words[:1])]
    items += [(200 + k, "a", "pt", "z", at(1), [f"o{k}", f"p{k}"]) for k in range(400)]  # else the shared words are too common
    frame = spark.createDataFrame(items, "id long, tab string, lang string, domain string, ts timestamp, anchors array<string>")
    found = dict(clustered(frame).collect())
    want = {k: 0 for k in range(40)} | {100: 0, 101: 101, 102: 102, 103: 103, 104: 104} | {200 + k: 200 + k for k in range(400)}
    loose = dict(connected(similar_pairs(frame).select("a", "b")).collect())
    assert all(want[i] == c for i, c in loose.items())
    assert found == want


def test_unseen_items_over_several_batches_and_runs(spark):
    rows = [[(1, 10), (2, 20), (1, 5)], [(2, 1), (3, 30)], [(3, 2), (4, 40), (4, 39)]]
    landing, folder = new_dir(spark, "landing"), new_dir(spark, "unseen-test")
    want = {}
    for k, batch in enumerate(rows):  # each run reads what has landed since the last one
        spark.createDataFrame(batch, "key int, at int").coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema("key int, at int").option("maxFilesPerTrigger", 1).parquet(landing)
        found = dict(insert_unseen(stream, ["key"], "at", "first", folder).collect())
        firsts = {}
        for key, at in batch:
            firsts[key] = min(at, firsts.get(key, at))
        want = firsts | want
        assert found == want, k


def test_a_backfill_goes_on_where_it_stopped(spark):
    path, runs = new_dir(spark, "backfill-test"), []
    lo, hi = datetime.date(2024, 1, 1), datetime.date(2024, 1, 31)

    def work(days):
        runs.append(days.count())
        return days.select("day", F.dayofmonth("day").alias("n"), F.when(F.dayofmonth("day") == 9, "no answer").alias("error"))

    first = backfill(spark, path, lo, hi, work, step=7, stop_after=2)
    assert backfill(spark, path, lo, hi, work, step=7) == first and sum(runs) == 31
    found = read_table(spark, path, first)
    assert found.count() == found.select("day").distinct().count() == 31
    assert [(r["day"].day, r["outcome"], r["error"]) for r in ledger(spark, path, first).where("outcome != 'ok'").collect()] == [(9, "error", "no answer")]
    assert backfill(spark, path, lo, hi, work, step=7) == first and sum(runs) == 31
    assert backfill(spark, path, lo, datetime.date(2024, 2, 2), work, step=40) == first + 1 and sum(runs) == 31 + 33
    # a row that doesn't parse starts anew
    spark.createDataFrame([('{"lo": "2024-01-01", "hi',)], "value string").write.mode("append").text(f"{path}/ledger/generation-{first + 1}")
    assert backfill(spark, path, lo, datetime.date(2024, 2, 2), work, step=40) == first + 2 and sum(runs) == 31 + 66
