import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sextant.llm.html_text import extract_main_text, main_text
from sextant.llm.line_dedup import drop_recurring_lines
from sextant.llm.mixing import mix
from sextant.llm.quality_model import score_quality
from sextant.llm.quality_rules import COUNTS, estimate, judged, posterior

from .conftest import SCHEMA, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0d]+")

REST = rows()[0][4:]


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:]))
    twice = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(twice)


def test_quality_counts_match_plain_python(docs):
    found = judged(docs, ["doc_id", "text"], "verdict").select("doc_id", "text", "verdict.*").collect()
    assert len(found) == len(rows())
    for r in found:
        want = counts(r.text)
        assert tuple(r[k] for k in COUNTS) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)
    kept = {r.doc_id for r in found if r.kept}
    assert {5, 6, 7, 8, 12} <= kept and not kept & {1, 2, 3, 4, 10, 11}


def test_quality_of_nothing(no_docs):
    assert judged(no_docs, ["doc_id"], "verdict").count() == 0


def test_estimation_separates_agreeing_rules():
    clean, bars, loud = (1,) * 11, (-1, 1, 1, 1, 1, 1, -1, 1, 1, 0, 1), (1, -1, -1, 1, -1, -1, 1, 1, 1, 1, -1)
    noisy, alone = (1, 1, 1, 1, 1, 1, 1, -1, 1, 1, 1), (1, 1, 1, 1, 1, 1, 1, 1, 1, -1, 1)
    share, odds = estimate([(clean, 900), (bars, 50), (loud, 50), (noisy, 60), (alone, 1)])
    assert 0.85 < share < 0.95 and odds[0][-1][0] > odds[0][-1][1]
    # one junk vote of a rule that errs often is overruled by the others; where rules agree, it isn't
    assert odds[7][-1][1] > 0.03 and posterior(noisy, share, odds) > 0.9 and posterior(clean, share, odds) > 0.99
    assert posterior(bars, share, odds) < 0.01 and posterior(loud, share, odds) < 0.01


def test_the_posterior_overrules_one_junk_vote(spark):
    plain = [prose(i, 120) for i in range(120)]
    twice = [f"{x}\n" + "Read\nNext\nBack\n" * 2 for x in plain[:12]]  # short lines repeat, nothing else is wrong
    junk = [" ".join(f"{w}### |" for w in prose(900 + i, 120).split()) for i in range(30)]
    r = [(i, t, "en", "a", *REST) for i, t in enumerate([*plain[12:], *twice, *junk])]
    found = {x.doc_id: x for x in judged(spark.createDataFrame(r, SCHEMA), ["doc_id"], "v").select("doc_id", "v.*").collect()}
    assert all(found[i].kept for i in range(120)) and not any(found[i].kept for i in range(120, 150))
    assert all(found[i].votes["lines"] == -1 for i in range(108, 120))


def test_mixing_comes_near_its_targets(spark, docs):
    r = [(i, prose(i, 20 + i % 50), "en", f"s{i % 3}" if i % 4 else None, *REST) for i in range(400)]
    d = spark.createDataFrame(r, SCHEMA)
    found = mix(d, ["doc_id", "source"]).select("row.*", "size", "source_size", "target", "copies", "taken").collect()
    assert len(found) == 400
    total = sum(x.size for x in found)
    for s in {x.source for x in found}:
        own = [x for x in found if x.source == s]
        assert own[0].source_size == sum(x.size for x in own)
        assert abs(sum(x.taken for x in own) - own[0].target) <= max(x.size for x in own)
        assert all(x.taken == x.copies * x.size and x.copies <= 3 for x in own)
    assert abs(sum({x.source: x.target for x in found}.values()) - total) < 1e-6 * total
    again = mix(d.repartition(5), ["doc_id", "source"]).select("row.doc_id", "taken").collect()
    assert sorted(map(tuple, again)) == sorted((x.doc_id, x.taken) for x in found)


def test_mixing_edge_cases(docs, no_docs):
    found = mix(docs, docs.columns).select("row.*", F.col("size").alias("words"), "taken").collect()
    assert len(found) == len(rows())
    assert all(x.words == len(WORD.findall(x.text or "")) and x.taken <= 3 * x.words for x in found)
    assert mix(no_docs, ["doc_id"]).count() == 0


def test_long_documents_are_likelier_in_a_mix(spark):
    r = [(i, "w " * (4 if i % 2 else 64), "en", "ab"[i % 4 // 2], *REST) for i in range(2000)]
    taken = mix(spark.createDataFrame(r, SCHEMA), ["source"], weights=(1, 3)).where("row.source = 'a'").groupBy("size").agg(F.avg("copies").alias("rate")).collect()
    rate = {x["size"]: x["rate"] for x in taken}
    # the square root of the size classes makes them four times as likely
    assert rate[64] / rate[4] == pytest.approx(4, rel=0.3)


def test_targets_stop_at_three_times_a_source(spark):
    r = [(i, "w " * n, "en", s, *REST) for i, (s, n) in enumerate([("a", 1000), ("b", 10), ("c", 5), ("d", 400)])]
    found = {x.source: x.target for x in mix(spark.createDataFrame(r, SCHEMA), ["source"]).select("row.source", "target").collect()}
    # b and c stop at 30 and 15; the rest is shared 1 : 1 between a and d, whose weights are both 1
    assert found == pytest.approx({"a": 685, "b": 30, "c": 15, "d": 685})


def test_recurring_lines_go_and_copies_stay(spark, docs, no_docs):
    boiler = "All rights are reserved by somebody."
    texts = [f"{prose(100 + i, 60)}\n{boiler}\nPage {i} of the big report\n{prose(200 + i, 60)}" for i in range(12)]
    copy = "\n".join(prose(900 + k, 40) for k in range(5))
    r = [(i, t, "en", "a", *REST) for i, t in enumerate([*texts, *[copy] * 20, None, "", boiler])]
    found = {x.doc_id: x for x in drop_recurring_lines(spark.createDataFrame(r, SCHEMA)).select("doc_id", "text", F.col("line_dedup.text").alias("cut"), "line_dedup.n_dropped").collect()}
    for i in range(12):
        assert found[i].cut == "\n".join(x for x in texts[i].split("\n") if x != boiler and not x.startswith("Page "))
    assert all(found[i].cut == copy and found[i].n_dropped == 0 for i in range(12, 32))
    assert found[32].cut is None and found[33].cut == "" and found[34].cut == ""
    kept = drop_recurring_lines(docs).select("text", "line_dedup.text").collect()
    assert len(kept) == len(rows()) and all(a == b for a, b in kept)
    assert drop_recurring_lines(no_docs).count() == 0


def test_quality_model_on_held_out_rows(spark, docs, no_docs):
    good = [(i, prose(i, 80)) for i in range(300)]
    bad = [(1000 + i, " ".join(f"{w}$$$" for w in prose(i, 80).split())) for i in range(60)]
    r = [(i, t, "en", "a", *REST) for i, t in good + bad + [(5000, None), (5001, "")]]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[::2]] + [(i, 0, 0) for i, _ in bad[::2]], "doc_id long, quality int, toxic int")
    found = {x.doc_id: x for x in score_quality(spark.createDataFrame(r, SCHEMA), labels).collect()}
    assert len(found) == 362 and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in found.values())
    assert any(x.held_out for x in found.values()) and found[5000].score == found[5001].score
    right = sum(found[i].predicted == 1 for i, _ in good if found[i].held_out) + sum(found[i].predicted == 0 for i, _ in bad if found[i].held_out)
    assert right >= 0.95 * sum(found[i].held_out for i, _ in good + bad)
    assert score_quality(docs, labels.limit(0)).count() == len(rows())
    assert score_quality(no_docs, labels).count() == 0


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain  text", "plain text"),
        ("<p>&lt;b&gt; &amp;amp;</p>", "<b> &amp;"),
        ("<div></div>", ""),
        ('<nav>Menu</nav><article><h1>Title</h1><p>A first paragraph, long enough.<p>Short.</article><div class="comments"><p>Nice words here</p></div>', "Title A first paragraph, long enough. Short."),
        ('<body class="with-sidebar"><header>Top</header><div class="post"><p>The one paragraph that matters to readers.</p><script>var a="</p>";</script><div class="ad">Buy</div></div><footer>End', "The one paragraph that matters to readers."),
    ],
)
def test_main_text(html, text):
    assert main_text(html) == text


LONG = "A paragraph of the article that is long enough to be dense, as most of them are on such a page."
TEMPLATES = [
    '<div class="layout has-sidebar"><div id="menu"><a href="/">Home</a></div><div class="body"><h2>Head</h2><p>{0}</p><p>{0}</p></div></div>',
    '<div class="page no-comments"><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul><div><h2>Head</h2><p>{0}</p><p>{0}</p></div><div class="comments"><p>{0}</p></div></div>',
    '<div id="top"><a href="/">Home</a></div><div class="post-related-content"><h2>Head</h2><p>{0}</p><p>{0}</p></div>',
    '<table><tr><td><a href="/a">One</a><br><a href="/b">Two</a></td><td><h2>Head</h2><p>{0}</p><p>{0}</p></td></tr></table>',
    '<body><h2>Head</h2><p>{0}</p><p>{0}</p><div><ul><li><a href="/a">More one</a></li><li><a href="/b">More two</a></li></ul></div>',
    '<div class="related"><article><h2>Head</h2><p>{0}</p><p>{0}</p></article></div>',
    '<article><div class="post-header"><h2>Head</h2></div><p>{0}</p><p>{0}</p><section class="replies"><article><p>{0}</p></article></section><div><a href="/x">Next page</a> <a href="/y">Last page</a></div></article>',
]


@pytest.mark.parametrize("template", TEMPLATES)
def test_articles_of_other_templates(template):
    assert main_text(template.format(LONG)) == f"Head {LONG} {LONG}"


@pytest.mark.parametrize("wrapper", ['<div class="login-page">{}</div>', '<div id="comments-enabled">{}</div>', '<div class="ads-free">{}</div>', '<form id="aspnetForm">{}</form>', '<form><div class="ads-free layout">{}</div></form>'])
def test_suspect_words_of_a_wrapper_lose_no_article(wrapper):
    body = f'<nav><a href="/">Home</a></nav><h2>Head</h2><p>{LONG}</p><p>{LONG}</p><div class="ad-slot"><p>Buy this now.</p></div><form><label>Mail</label><input></form>'
    assert main_text(wrapper.format(body)) == f"Head {LONG} {LONG}"
    assert main_text(wrapper.format(f"<article>{body}</article>")) == f"Head {LONG} {LONG}"


@pytest.mark.parametrize("tag", ['<div class="comments">', '<div class="ad-slot">', '<form class="search">', '<section class="comments-area">'])
def test_suspect_containers_beside_the_article_go(tag):
    end = tag.split()[0].strip("<>")
    assert main_text(f"<div><h2>Head</h2><p>{LONG}</p></div>{tag}<p>{LONG}</p></{end}>") == f"Head {LONG}"


def test_the_threshold_decides():
    page = TEMPLATES[3].format(LONG)
    assert main_text(page, cut=0.0) == f"One Two Head {LONG} {LONG}" != main_text(page)
    inside = TEMPLATES[6].format(LONG)
    assert main_text(inside, cut=0.0).endswith("Next page Last page") and not main_text(inside).endswith("page Last page")
    short = f"<article><p>{LONG}</p><ul><li>One</li><li>Two</li></ul></article>"
    assert main_text(short) == f"{LONG} One Two"


def test_pages_of_a_table(spark):
    long = "<p>" + "word " * 200_000 + "</p>"
    pages = [(1, "u", None), (2, None, f"<article><p>{LONG}</article>"), (2, None, f"<article><p>{LONG}</article>"), (3, "v", long), (None, "w", "")]
    frame = spark.createDataFrame([(*x, "t", 5) for x in pages], "page_id long, url string, html string, text string, n_chars int")
    found = sorted(extract_main_text(frame).collect(), key=lambda x: x.page_id or 0)
    assert [(x.page_id, x.url, x.n_chars) for x in found] == [(None, "w", 0), (1, "u", 0), (2, None, len(LONG)), (2, None, len(LONG)), (3, "v", 999_999)]
    assert all(x.n_chars == len(x.text) for x in found) and extract_main_text(frame.limit(0)).count() == 0


def cut_lines(spark, texts):
    """What line dedup leaves of each text, by its place."""
    r = [(i, t, "en", "a", *REST) for i, t in enumerate(texts)]
    return {x.doc_id: x.cut for x in drop_recurring_lines(spark.createDataFrame(r, SCHEMA)).select("doc_id", F.col("line_dedup.text").alias("cut")).collect()}


def test_unlike_documents_count_apart_whatever_lines_they_share(spark):
    boiler = [f"{w} footer stands below every page." for w in ("First", "Second", "Third", "Fourth")]
    own = [" ".join(prose(3000 + i, 40).split()) for i in range(20)]
    assert cut_lines(spark, ["\n".join([x, *boiler]) for x in own]) == dict(enumerate(own))


def test_near_copies_keep_the_lines_they_share(spark):
    body = [" ".join(prose(4000 + k, 30).split()) for k in range(20)]
    near = ["\n".join([*body[:i], f"{body[i]} but changed", *body[i + 1 :]]) for i in range(20)]
    assert cut_lines(spark, near) == dict(enumerate(near))


def test_copies_of_one_document_rescue_no_line(spark):
    boiler = "One footer stands below every page."
    own = [" ".join(prose(5000 + i, 40).split()) for i in range(12)]
    found = cut_lines(spark, [f"{own[max(0, i - 300)]}\n{boiler}" for i in range(312)])
    assert found == {i: own[max(0, i - 300)] for i in range(312)}


def test_short_lines_need_more_than_a_common_opening(spark):
    unlike = [f"I do not {w}" for w in "sing dance cook swim read write paint climb".split()]
    fields = [f"Number of visits {n}" for n in range(8)]
    own = [" ".join(prose(7000 + i, 40).split()) for i in range(8)]
    assert cut_lines(spark, [f"{x}\n{y}\n{z}" for x, y, z in zip(own, unlike, fields, strict=True)]) == {i: f"{x}\n{y}" for i, (x, y) in enumerate(zip(own, unlike, strict=True))}
