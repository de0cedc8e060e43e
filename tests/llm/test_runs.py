"""Suffix trees and runs against plain searches."""

import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sextant.llm.periodic_runs import periodic_runs, repeated_tail
from sextant.llm.suffix_tree import repetitions


def plain_runs(w, exponent=4, least=6):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda x: (x[0], x[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40), st.integers(1, 12), st.integers(0, 4))
def test_repetitions_are_those_of_a_plain_search(word, period, times):
    word = word + word[:period] * times
    assert repetitions(word) == plain_runs(word, 2, 2)
    assert repetitions(word, 4, 6) == plain_runs(word)


def plain(doc_id, text, tails):
    w = (text or "").encode().split()
    if tails and doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    found = plain_runs(w)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in found)]
    best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=(None,) * 3)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found).encode()
    return doc_id, len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(listed).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


TEXTS = [
    "la " * 5,
    "la " * 6,
    "a b " * 4,
    "x a b a b a b a y",
    "a a b " * 4 + "c " + "a a b " * 4,
    "one two three four " * 4 + "one two x " + "u v " * 9,
    "a b c d e f g h " * 7 + "a b c",
    "ab a b ab a b " * 8,
    "té té\tté\nté\x0bté\x0cté",
    "a\xa0a " * 6 + "A " * 6,
    ("q " * 7 + "r ") * 6,
]


@pytest.mark.parametrize("tails", [False, True])
def test_runs_of_documents(spark, docs, tails):
    extra = spark.createDataFrame([(k, x) for k, x in enumerate(TEXTS * 10, 100)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    found = periodic_runs(rows, tails=tails).drop("runs")
    want = {}
    for r in rows.collect():
        if len(r["text"] or "") < 9000:
            want.setdefault(r["doc_id"], []).append(plain(r["doc_id"], r["text"], tails))
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], []).append(tuple(r))
    for k, v in want.items():
        assert sorted(got[k], key=repr) == sorted(v, key=repr)
    assert sum(map(len, got.values())) == rows.count()


def test_a_long_tail_is_one_run(spark):
    n = 30_000
    ids = [k for k in range(400) if (t := repeated_tail(k, n)) and (n - t[0]) // t[1] >= 5][:3]
    rows = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(n))) for k in ids], "doc_id long, text string")
    for r in periodic_runs(rows, tails=True).collect():
        a, p = repeated_tail(r["doc_id"], n)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (1, a, n - a, p)


def test_no_rows_and_clashing_names(spark, no_docs):
    assert periodic_runs(no_docs).count() == 0
    rows = spark.createDataFrame([(1, "a " * 8, 5, "x")], "doc_id long, text string, runs int, n_runs string")
    assert periodic_runs(rows).first()["n_runs"] == 1
