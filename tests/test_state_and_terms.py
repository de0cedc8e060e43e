"""Snapshots, state merges, streams with state, terms, set-similar pairs and growing clusters against plain Python."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from sextant.functions import text
from sextant.operators import clusters, merges
from sextant.operators.health import health_level
from sextant.operators.snapshots import Conflict, Snapshots
from sextant.operators.storage import new_dir
from sextant.operators.terms import term_hits
from sextant.sources.landed import SourceAdapter, land
from sextant.streaming import stateful

DAY = datetime.datetime(2024, 1, 2)
NOW = "2024-02-01 10:00:00"
STATE = "url long, track string, enrolled boolean, discarded boolean, stage string, stage_at timestamp, enrolled_at timestamp, discarded_at timestamp, owner string, note string"
STORED = [(1, "a", True, False, "sent", DAY, DAY, None, "robo", "seen"), (2, "b", False, True, "", None, None, DAY, "humano", ""), (3, "b", True, False, "old", None, DAY, None, "humano", "n")]


def test_a_writer_that_dies_leaves_the_last_version(spark):
    rows = spark.createDataFrame([(1, True)], "a int, changed boolean")
    store = Snapshots(spark, new_dir(spark, "snapshots"))
    assert store.read() is None and store.latest() is None
    first = store.commit(rows, None)
    store.write(rows.union(rows))  # never published
    assert store.latest() == first and store.read().count() == 1
    second = store.commit(rows.union(rows), first)
    with pytest.raises(Conflict):
        store.commit(rows, first)
    assert store.latest() == second and store.read().count() == 2 and store.read(first).count() == 1
    assert store.refresh(rows.withColumn("changed", F.lit(False)), "changed", second) == second
    assert store.refresh(rows, "changed", second) == second + 1


def test_captures_keep_rows_that_nobody_captured(spark):
    stored = spark.createDataFrame(STORED, STATE)
    seen = [(2, "", False, False, 1), (2, "x", True, False, 2), (2, "y", False, True, 3), (4, "", True, False, 1), (5, "z", False, False, 1), (3, "q", True, False, 1)]
    found = {r["url"]: r for r in merges.harvest_flags(stored, spark.createDataFrame(seen, "url long, track string, enrolled boolean, discarded boolean, place int"), NOW).collect()}
    assert set(found) == {1, 2, 3, 4}
    assert tuple(found[1])[:10] == STORED[0] and not found[1]["changed"]
    now = datetime.datetime.fromisoformat(NOW)
    assert (found[2]["track"], found[2]["enrolled"], found[2]["discarded"], found[2]["enrolled_at"], found[2]["discarded_at"]) == ("x", True, True, now, DAY)
    assert tuple(found[3])[:10] == STORED[2] and not found[3]["changed"]
    assert tuple(found[4]) == (4, "", True, False, "", None, now, None, "humano", "", True)


def test_a_robot_adds_rows_and_a_person_wins(spark):
    stored = spark.createDataFrame(STORED, STATE)
    says = [(1, "", False, 1), (3, "r", False, 1), (6, "new", True, 1), (7, "", False, 1)]
    writes = spark.createDataFrame(says, "url long, track string, says boolean, place int")
    once = merges.robot_write(stored, writes, NOW)
    found = {r["url"]: r for r in once.collect()}
    assert set(found) == {1, 2, 3, 6}
    assert (found[1]["enrolled"], found[1]["owner"], found[1]["track"]) == (False, "robo", "a")
    assert found[3]["enrolled"] and found[3]["diverges"] and found[3]["note"].startswith("n | robô diz não inscrito")
    assert (found[6]["enrolled"], found[6]["owner"], found[6]["track"]) == (True, "robo", "new") and tuple(found[2])[:10] == STORED[1]
    again = {r["url"]: r for r in merges.robot_write(once.select(*merges.STATE), writes, NOW).collect()}
    assert again[3]["note"] == found[3]["note"] and not any(r["changed"] for r in again.values())


def test_upsert_keeps_facts(spark):
    stored = spark.createDataFrame([(1, "t", 5, 0), (2, "u", 6, 0)], "id int, title string, score int, updated_at int")
    fresh = spark.createDataFrame([(2, "other", None, 9), (3, "v", 8, 9)], "id int, title string, score int, updated_at int")
    found = merges.upsert(stored, fresh, "id", ["score"], F.lit(1)).orderBy("id").collect()
    assert list(map(tuple, found)) == [(1, "t", 5, 0, False), (2, "u", None, 1, False), (3, "v", 8, 1, True)]


def test_first_times_survive_a_restart(spark):
    folder, landing = new_dir(spark, "first"), new_dir(spark, "landing")
    for k, rows in enumerate([[("a", 5), ("b", 7), ("a", 6)], [("a", 9), ("c", 3), ("b", 2)], []]):
        at = [(x, DAY + datetime.timedelta(hours=h)) for x, h in rows]
        spark.createDataFrame(at, "key string, at timestamp").coalesce(1).write.mode("append").parquet(landing)
        found = {r["key"]: (r["first_seen"] - DAY).seconds // 3600 for r in stateful.first_seen(spark.readStream.schema("key string, at timestamp").parquet(landing), folder).collect()}
        assert found == ({"a": 5, "b": 7} if k == 0 else {"a": 5, "b": 2, "c": 3})


def test_a_silent_source_alerts(spark):
    landing = new_dir(spark, "volumes")
    rows = [(s, datetime.datetime(2024, 1, d, 5)) for s, days in (("x", (2, 3, 4, 5, 8)), ("y", (2, 8))) for d in days]
    spark.createDataFrame(rows, "source string, at timestamp").write.parquet(landing)
    stream = spark.readStream.schema("source string, at timestamp").parquet(landing)
    _, alerts = stateful.volume_monitor(stream, "source", "at", lambda v: v.withColumn("level", health_level(F.col("n"), F.col("day"), 1)))
    assert sorted((r["source"], r["day"].day, r["level"]) for r in alerts.collect()) == [("y", d, "critico") for d in (3, 4, 5)]


def test_corrupt_records_go_beside_the_rows(spark):
    landing = new_dir(spark, "lines")
    spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": ',), ('{"a": "many"}',), ("",)], "value string").write.text(landing)
    rows, errors = stateful.split_corrupt(spark.readStream.schema("value string").text(landing), "a long, b string")
    assert list(map(tuple, rows.collect())) == [(1, "x")]
    assert sorted((r["value"], r["error"]) for r in errors.collect()) == [("", "json"), ('{"a": ', "json"), ('{"a": "many"}', "field")]
    assert [r["a"] for r in stateful.replayed(errors, "a string").collect()] == ["many"]


def test_terms_are_those_of_expressions(spark):
    terms = ["ux", "tion*", "machine learning", "deep learn*", "ci/cd", "c-3po", "the", "Educação", "a b c", "x*"]
    texts = ["UX auxiliar ux2", "The machine  learning", "machine learning, deep learners", "ci/cd CI / CD", "educacao a b c-3po", "ambition tiona xylo", "", "deep learn", "the-ux.the", "a b cd a b c"]
    texts = [(k, t) for k, t in enumerate(texts)] + [(99, None)]
    found = {(r["id"], r["term"]) for r in term_hits(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    plain = lambda s: s.lower().replace("ç", "c").replace("ã", "a")
    edge = lambda t: rf"(?<![a-z0-9_]){re.escape(t[:-1])}" if t.endswith("*") else rf"(?<![a-z0-9_]){re.escape(t)}(?![a-z0-9_])"
    assert found == {(k, t) for k, s in texts if s for t in terms if re.search(edge(plain(t)), plain(s))}
    with pytest.raises(ValueError, match="no word edges"):
        term_hits(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([("c++",)], "term string"))


def stories(n, seed, hot=False):
    r = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for k in range(n):
        story = r.randrange(n // 4)
        anchors = {f"s{story}-{j}" for j in range(6) if r.random() < 0.6} | {f"w{r.randrange(40)}" for _ in range(r.randint(0, 3))}
        rows.append((k, "t", "pt" if story % 3 else "en", f"d{r.randrange(3)}", start + datetime.timedelta(hours=r.randrange(200)), sorted(anchors | ({"hot"} if hot else set()))))
    return rows


ITEMS = "id long, tab string, lang string, domain string, ts timestamp, anchors array<string>"


def plain_pairs(rows):
    found = set()
    for lang in ("pt", "en"):
        block = [x for x in rows if x[2] == lang and x[5]]
        often = {a for a in {a for x in block for a in x[5]} if len(block) >= 20 and sum(a in x[5] for x in block) > 0.15 * len(block)}
        sets = {x[0]: set(x[5]) - often for x in block}
        for i, a in enumerate(block):
            for b in block[i + 1 :]:
                s, t = sets[a[0]], sets[b[0]]
                both = len(s & t)
                if both >= 2 and both / len(s | t) >= (0.6 if a[3] == b[3] else 0.34) and abs((a[4] - b[4]).total_seconds()) <= 36 * 3600:
                    found.add((a[0], b[0], both))
    return found


def test_pairs_are_all_pairs_that_are_alike(spark, monkeypatch):
    monkeypatch.setattr(clusters, "SPLIT", 3)
    rows = stories(300, 1)
    found = clusters.similar_pairs(spark.createDataFrame(rows, ITEMS))
    assert sorted((r["a"], r["b"], r["common"]) for r in found.collect()) == sorted(plain_pairs(rows))


def test_an_anchor_of_all_items_makes_few_candidates(spark):
    # one block of many unlike items that share one anchor, too few of them to be cut
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, "t", "pt", "d", start, [f"a{k}", f"b{k // 2}", "hot" if k % 8 == 0 else f"c{k}"]) for k in range(8000)]
    kept = clusters.kept_anchors(spark.createDataFrame(rows, ITEMS))
    sets = kept.groupBy("anchor").count().where("anchor = 'hot'").first()["count"]
    assert sets == 1000 and clusters.pairs_of(kept).count() == 0


@pytest.mark.parametrize("seed", [2, 3])
def test_two_batches_cluster_as_one(spark, seed):
    rows = stories(260, seed)
    whole = spark.createDataFrame(rows, ITEMS)
    want = {r["id"]: r["cluster"] for r in clusters.clustered(whole).collect()}
    first = spark.createDataFrame(rows[:170], ITEMS)
    stored = first.join(clusters.clustered(first), "id")
    got = {r["id"]: r["cluster"] for r in clusters.with_fresh(stored, spark.createDataFrame(rows[170:], ITEMS)).collect()}
    assert got == want and len(set(want.values())) < 260


def test_references_are_decoded_in_turn(spark):
    said = ["&lt;b&gt; &amp;lt; &#38;lt; &#38;#39; &#38;#x41; &AMP;amp; &nope; &#; &#x; &#0; &#x1F600; &#8217; & &copy;", "plain", "", None, "&&amp;&"]
    rows = spark.createDataFrame([(k, s) for k, s in enumerate(said)], "id int, s string")
    found = {r["id"]: r["x"] for r in rows.select("id", text.decode_entities(F.col("s")).alias("x")).collect()}
    assert found == {0: "<b> &lt; &lt; &#39; A &amp; &nope; &#; &#x;  \U0001f600 ’ & &copy;", 1: "plain", 2: "", 3: None, 4: "&&&"}


def test_an_adapter_tells_payloads_it_cannot_read(spark):
    feeds = spark.createDataFrame([(1, "feed", None, "p", "t", "x", ["wanted*"]), (2, "json", None, "p", "t", "x", None), (3, "feed", "EBCDIC", "p", "t", "x", None), (4, "feed", "UTF-16LE", "p", "t", "x", [])], "feed long, kind string, charset string, publisher string, tab string, theme string, terms array<string>")
    item = "<item><title>{}</title><link>http://x/{}</link></item>"
    landed = [(1, ("<rss>" + item.format("Wanted thing", 1) + item.format("Other", 2) + "</rss>").encode()), (1, b"\xff\xfe broken"), (2, b'{"hits": [{"title": "t", "url": "u", "children": [1, 2]}]}'), (2, b'{"hits": ['), (3, b"<rss></rss>"), (4, ("<rss>" + item.format("é", 3) + "</rss>").encode("utf-16-le")), (9, b"<rss></rss>")]
    path = new_dir(spark, "landed-test")
    land(spark.createDataFrame(landed, "feed long, payload binary"), path)
    land(spark.createDataFrame(landed, "feed long, payload binary"), path)  # a fetch that runs again
    adapter = SourceAdapter(feeds, path, part_bytes=50)
    assert sorted((r["feed"], r["title"], r["comments"]) for r in adapter.items().collect()) == [(1, "Wanted thing", None), (2, "t", 2), (4, "é", None)]
    assert sorted((r["feed"], r["error"]) for r in adapter.errors().collect()) == [(1, "charset"), (2, "payload"), (3, "charset"), (9, "feed")]
