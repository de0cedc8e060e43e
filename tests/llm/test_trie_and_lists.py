"""The conversation trie against one built turn by turn, and nearest neighbours against all inner products."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sextant.llm import conversation_trie as trie
from sextant.llm import posting_lists as lists


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        built = own.get(c - c % 100, [])[:h] + own[c][h:]
        for d in range(len(built) + 1):
            members[tuple(built[:d])].append(c)
        ends[tuple(built)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    found = {}
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves = sum(found[x][5] for x in below) if below else 1
        saved = sum(found[x][6] for x in below) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
        digest = hashlib.sha256(",".join(map(str, ends.get(node, []))).encode()).hexdigest()
        found[node] = (members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]), len(below), leaves, saved, digest)
    return sorted(found.values(), key=repr)


def conversations():
    r = random.Random(5)
    texts = ["yes", "no", "", None, "naïve \U0001f600", "why", "so " * 50]
    rows = [(c, t, r.choice(("user", "assistant", None)), r.choice(texts)) for c in [*range(0, 130), *range(290, 320), 1001] for t in range(r.randint(1, 7))]
    rows += [(c, t, "user", "hi") for c in range(400, 460) for t in range(3)]
    rows += [(7, None, "user", "first"), (8, 0, "user", "tie"), (8, 0, "user", "tie"), (8, 0, "assistant", "tie"), (None, 1, "user", "nobody")]
    rows += [(200, t, "user", f"turn {t % 7}") for t in range(3000)]
    return rows


COLUMNS = "conv_id long, turn long, role string, text string"


def columns(nodes):
    return sorted((tuple(r) for r in nodes.drop("k1", "k2").collect()), key=repr)


def test_trie_is_that_of_whole_sequences(spark):
    rows = conversations()
    nodes, stored = trie.conversation_trie(spark.createDataFrame(rows, COLUMNS).repartition(5))
    assert columns(nodes) == plain_trie(rows)
    known = {(r["k1"], r["k2"]): (r["role"], r["text"]) for r in stored.collect()}
    assert set(known.values()) == {(role or "", text or "") for c, _, role, text in rows if c is not None}
    assert {(r["k1"], r["k2"]) for r in nodes.where("depth > 0").collect()} <= set(known)


def test_trie_of_fingerprints_that_collide(spark, monkeypatch):
    rows = [(c, t, "user", str((c * 7 + t) % 5)) for c in range(300, 340) for t in range(5)]
    monkeypatch.setattr(trie, "bases", lambda salt: (1, 1) if salt < 3 else (12345678901, 98765432101))
    nodes, _ = trie.conversation_trie(spark.createDataFrame(rows, COLUMNS))
    assert columns(nodes) == plain_trie(rows)


def test_trie_of_nothing_and_clashing_names(spark):
    assert trie.conversation_trie(spark.createDataFrame([], COLUMNS))[0].count() == 0
    rows = [(1, 0, "user", "a", 1, 2, 3), (1, 1, "user", "b", 1, 2, 3)]
    nodes, _ = trie.conversation_trie(spark.createDataFrame(rows, COLUMNS + ", depth int, k1 int, heads int"))
    assert columns(nodes) == plain_trie([x[:4] for x in rows])


def test_products_modulo_the_prime():
    r = random.Random(2)
    a, b = ([r.randrange(trie.PRIME) for _ in range(500)] + [0, 1, trie.PRIME - 1] for _ in range(2))
    found = trie.times(np.array(a, np.uint64), np.array(b[::-1], np.uint64)).tolist()
    assert found == [x * y % trie.PRIME for x, y in zip(a, b[::-1], strict=True)]
    assert trie.sums(np.array(a, np.uint64)).tolist() == [sum(a[: k + 1]) % trie.PRIME for k in range(len(a))]


def plain_nearest(rows, top):
    sound = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    size = max({len(v) for _, v in sound}, key=lambda n: (sum(len(v) == n for _, v in sound), n), default=0)
    sound = [(i, np.array(v, np.float32).astype(float)) for i, v in sound if len(v) == size]
    found = {}
    for q in {i for i, _ in sound if i % 20 == 0}:
        best = {}
        for _, x in (s for s in sound if s[0] == q):
            for i, v in sound:
                if i != q:
                    score = 0.0
                    for a, b in zip(x, v, strict=True):
                        score += a * b
                    best[i] = max(best.get(i, -np.inf), score)
        found[q] = sorted(((-s, i) for i, s in best.items()))[:top]
    return {q: [(k, i, -s) for k, (s, i) in enumerate(v, 1)] for q, v in found.items()}


def answers(spark, rows, top=20, more=""):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>" + more)
    found = defaultdict(list)
    for r in sorted(lists.nearest(frame, frame.where("vec_id % 20 = 0"), top).collect()):
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return dict(found)


def test_few_vectors_are_all_compared(spark):
    r = np.random.default_rng(1)
    rows = [(k, r.normal(size=6).tolist()) for k in range(25)]
    rows += [(100, None), (120, []), (140, [0.0] * 6), (160, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (180, [float("nan")] * 6), (200, [float("inf")] * 6), (None, [1.0] * 6), (220, [1.0, 2.0])]
    rows += [(40, rows[3][1]), (60, rows[3][1]), (61, rows[3][1]), (61, rows[4][1]), (80, rows[5][1]), (80, rows[6][1])]
    assert answers(spark, rows) == plain_nearest(rows, 20)
    assert answers(spark, rows[:3]) == plain_nearest(rows[:3], 20)


def test_copies_and_neighbours_at_size(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 24))
    vectors = centres[r.integers(0, 40, 4000)] + 0.5 * r.normal(size=(4000, 24))
    vectors *= r.uniform(0.5, 2, (4000, 1))
    vectors[:1500] = vectors[0]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    found = answers(spark, rows)
    x = vectors.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 4000, 20):
        scores = np.zeros(4000)
        for k in range(24):
            scores += x[q, k] * x[:, k]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(4000), -scores))[:20]
        own = found[q]
        assert [k for k, _, _ in own] == list(range(1, 21))
        assert all(scores[i] == s for _, i, s in own)
        assert sorted(own, key=lambda y: (-y[2], y[1])) == own
        hits += len({i for _, i, _ in own} & set(best.tolist()))
    assert hits >= 0.95 * 20 * 200


def test_no_vectors_and_clashing_names(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert lists.nearest(empty, empty).count() == 0
    rows = [(20, [1.0, 2.0], 1, 2, 3, "x"), (21, [2.0, 1.0], 1, 2, 3, "x")]
    assert answers(spark, rows, more=", id int, vec int, list int, key string") == {20: [(1, 21, 4.0)]}


@pytest.mark.parametrize("k", [1, 2, 7])
def test_the_walk_reaches_every_centroid(k):
    index = lists.Index(np.random.default_rng(k).normal(size=(k, 5)), 1.0)
    assert np.isfinite(index.search(np.ones((2, 5), np.float32), np.inf, 1)).all()


def shuffled(spark):
    """Bytes that all stages have written for others so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_rows_move_a_few_times_however_many_lists_are_read(spark):
    r = np.random.default_rng(8)
    vectors = r.normal(size=(16_000, 48))
    vectors /= np.sqrt((vectors**2).sum(1))[:, None]
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(4).cache()
    frame.count()
    before = shuffled(spark)
    found = lists.nearest(frame, frame.where("vec_id % 20 = 0"), 20).collect()
    assert shuffled(spark) - before <= 4 * 16_000 * 48 * 4
    x = vectors.astype(np.float32).astype(float)
    own = defaultdict(set)
    for row in found:
        own[row["query_id"]].add(row["vec_id"])
    hits = 0
    for q in range(0, 16_000, 20):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(own[q] & set(np.argpartition(-scores, 20)[:20].tolist()))
    assert hits >= 0.9 * 20 * 800
    frame.unpersist()


def test_many_blocks_and_guesses_that_are_too_high(spark, monkeypatch):
    r = np.random.default_rng(9)
    vectors = np.round(r.normal(size=(1500, 8)) * r.uniform(0.1, 30, (1500, 1)), 2)
    vectors[200:260] = vectors[20]
    rows = [(k % 1400, v.tolist()) for k, v in enumerate(vectors)]
    monkeypatch.setattr(lists, "BLOCK_BYTES", 4096)
    # nobody reaches the guess, so all are asked again under sure bounds and see all lists
    monkeypatch.setattr(lists.Index, "learn_bounds", lambda self, *_: setattr(self, "closer", 0.0))
    assert answers(spark, rows) == plain_nearest(rows, 20)


def test_vectors_of_doubles(spark):
    r = np.random.default_rng(12)
    x = r.normal(size=(400, 5)) * 1e30
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {(y["query_id"], y["rank"]): y["score"] for y in lists.nearest(frame, frame.where("vec_id % 20 = 0"), 1).collect()}
    assert found.keys() == {(q, 1) for q in range(0, 400, 20)}
    best = [max(x[q] @ x[k] for k in range(400) if k != q) for q in range(0, 400, 20)]
    assert sum(abs(found[q, 1] - b) <= 1e-12 * abs(b) for q, b in zip(range(0, 400, 20), best, strict=True)) >= 18


def test_single_precision_errs_less_than_the_slack():
    r = np.random.default_rng(10)
    q, x = r.normal(size=(300, 64)), (r.normal(size=(500, 64)) * 10.0 ** r.integers(-6, 7, (500, 1))).astype(np.float32)
    wrong = np.abs(lists.units(q) @ x.T - (q / np.sqrt((q * q).sum(1))[:, None]) @ x.T.astype(float))
    assert (wrong <= lists.slack(x)).all()
