"""Templates of lines against the same rounds in plain Python, and long near duplicates."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sextant.llm import near_duplicates as nd
from sextant.llm.line_dedup import drop_recurring_lines, lines_of, recurring, recurring_lines

from .conftest import prose
from .test_at_size import frame_of


def plain_recurring(texts, depth=3, min_docs=5):
    """Lines that recur; copies of a text count once, near copies are left out of the fixtures."""
    documents = {tuple(dict.fromkeys(x for x in t.split("\n") if x.split())) for t in texts}
    sets = defaultdict(set)
    for d in documents:
        for x in d:
            if len(x.split()) >= 3:
                sets[x].add(d)
    digit = lambda t: any(c.isdigit() and c.isascii() for c in t)
    leaves = defaultdict(list)
    for x in sets:
        w = x.split()
        leaves[len(w), tuple("<*>" if digit(t) else t for t in w[:depth])].append(x)
    gone = {x for x, s in sets.items() if len(s) >= min_docs}
    for own in leaves.values():
        while True:
            count = defaultdict(int)
            for x in own:
                for k, t in enumerate(x.split()):
                    count[k, t] += len(sets[x])
            groups = defaultdict(list)
            for x in own:
                w = x.split()
                fixed = tuple((k, t) for k, t in enumerate(w) if not digit(t) and count[k, t] >= min_docs)
                if len(fixed) >= max(3, 0.6 * len(w)) and (fixed[-1][0] >= depth or len(fixed) == sum(not digit(t) for t in w)):
                    groups[fixed].append(x)
            found = {x for g in groups.values() if len(set().union(*(sets[x] for x in g))) >= min_docs for x in g}
            if not found:
                break
            gone |= found
            own = [x for x in own if x not in found]
    return gone


def check(spark, texts):
    frame = frame_of(spark, enumerate(texts)).repartition(4)
    found = {r["doc_id"]: r["cut"] for r in drop_recurring_lines(frame).select("doc_id", F.col("line_dedup.text").alias("cut")).collect()}
    gone = plain_recurring(texts)
    for i, t in enumerate(texts):
        assert found[i] == "\n".join(x for x in t.split("\n") if x not in gone)
    return gone


@pytest.mark.parametrize("copies", [0, 500])
@pytest.mark.parametrize("n", [2, 5, 6, 20])
def test_templates_of_one_leaf(spark, n, copies):
    r = random.Random(n)
    names = ["".join(r.choices("bcdfglmnprst", k=6)) for _ in range(n)]
    texts = [" ".join(prose(9000 + k, 40).split()) + f"\nSee our page {names[k % n]} for visit number {r.randint(0, 40)} of {names[k % n]}" for k in range(30 * n)]
    texts += [" ".join(prose(8999, 40).split()) + "\nSee our page unlike the other lines of this leaf"] * copies
    gone = check(spark, texts)
    assert sum(x.split("\n")[1] in gone for x in texts) == 30 * n


def test_fields_of_words_digits_and_one_document(spark):
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]
    texts = []
    for k in range(60):
        own = " ".join(prose(500 + k, 30).split())
        texts.append(f"{own}\nPosted by {r.choice(words)}{r.choice('abcdefgh')} on the board today\nRead all {r.choice(words)} news in the {r.choice(words)} paper\nTake the {prose(k, 1)} road")
    texts.append(" ".join(prose(77, 30).split()) + "".join(f"\nChapter on the {w} matter of one book alone" for w in words))
    texts += ["Four documents hold this very line here\n" + " ".join(prose(600 + k, 30).split()) for k in range(4)]
    texts += ["Five documents hold that very line here\n" + " ".join(prose(700 + k, 30).split()) for k in range(5)]
    gone = check(spark, texts)
    assert "Five documents hold that very line here" in gone and "Four documents hold this very line here" not in gone
    assert not any(x.startswith("Chapter") for x in gone)


def test_templates_are_named(spark):
    texts = [" ".join(prose(40 + k, 30).split()) + f"\nPosted by user{k} on the board" for k in range(6)]
    lines = lines_of(frame_of(spark, enumerate(texts)), 3, 3)
    found = recurring_lines(lines, 3, 5).collect()
    assert {(r["template"], r["n_docs"]) for r in found} == {("Posted by <*> on the board", 6)} and len(found) == 6
    assert recurring(lines.limit(0), 3, 5)[0].count() == 0


def nearly(seed, words, share):
    other = set(random.Random(seed).sample(range(len(words)), round(share * len(words))))
    return " ".join(f"x{seed}y{k}" if k in other else w for k, w in enumerate(words))


@pytest.mark.parametrize("n", [300, 8000])
def test_few_pairs_are_left_of_texts_below_the_threshold(spark, monkeypatch, n):
    base = [f"w{k}" for k in range(n)]
    counts = []
    compared = nd.residual_pairs

    def counted(*args):
        found = compared(*args)
        counts.append(found.count())
        return found

    monkeypatch.setattr(nd, "residual_pairs", counted)
    found = nd.near_duplicates(frame_of(spark, [(k, nearly(k, base, 0.028)) for k in range(120)]).repartition(4), shingle=4).collect()
    assert all(r["component_id"] == r["doc_id"] for r in found)
    assert counts[0] <= 120  # of 7,140


def test_links_of_long_texts(spark):
    base = [f"w{k}" for k in range(6000)]
    texts = [nearly(k, base, 0.005 if k % 2 else 0.03) for k in range(40)]
    found = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(frame_of(spark, enumerate(texts)).repartition(4), shingle=4).collect()}
    sets = [{tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (t.split() for t in texts)]
    group = {k: k for k in range(40)}
    for a in range(40):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((group[a], group[b]))
                group = {k: x if v == y else v for k, v in group.items()}
    assert found == group and 1 < len(set(group.values())) < 40


def test_lines_are_worked_out_once(spark):
    """The filters that Spark infers for an inner explode had split, hashed and masked each text three times."""
    texts = ["", " \n\t", "two words", "1 2 3\n1 2 3\n4 5 6 7", None]
    lines = lines_of(frame_of(spark, enumerate(texts)), 3, 3)
    assert lines.groupBy("leaf").count()._jdf.queryExecution().optimizedPlan().toString().count("array_distinct(") == 1
    assert sorted((r["doc_id"], r["line"], r["chars"]) for r in lines.collect()) == [(3, "1 2 3", 12), (3, "4 5 6 7", 12)]
    copies = frame_of(spark, ((k, f"1 2 3\nown {k} x{k}") for k in range(6)))
    assert {r["h"] for r in recurring(lines_of(copies, 3, 3), 3, 5)[0].collect()} == {r[0] for r in spark.range(1).select(F.xxhash64(F.lit("1 2 3"))).collect()}
