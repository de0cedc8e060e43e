import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from sextant.llm import warc
from sextant.llm.media import fingerprints, from_wav, media_column, media_features, to_wav
from sextant.llm.near_duplicates import components, near_duplicates, super_minhash
from sextant.llm.shared import new_dir

from .conftest import SCHEMA, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(data, k=5, percent=80):
    sets = [shingles(t, k) for _, t in data]
    parent = {i: i for i, _ in data}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(data)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(data[a][0]), find(data[b][0])
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for (i, _), s in zip(data, sets, strict=True))


def edited(text, seed, n):
    r = np.random.default_rng(seed)
    w = text.split(" ")
    for k in r.choice(len(w), n, replace=False):
        w[k] = f"edit{r.integers(1000)}"
    return " ".join(w)


def test_near_duplicates_match_brute_force(spark):
    base = [prose(k, 150) for k in range(6)]
    data = [(k, t) for k, t in enumerate(base)]
    data += [(100 + k, edited(base[k % 6], k, 1 + k % 5)) for k in range(60)]
    data += [(300 + k, base[0].upper() if k % 2 else base[0]) for k in range(20)]
    chain = base[5]
    for k in range(8):  # each near the one before only
        chain = edited(chain, 50 + k, 2)
        data.append((400 + k, chain))
    data += [(500, None), (501, ""), (502, "a b"), (503, "A  b"), (504, "b a")]
    frame = spark.createDataFrame([(i, t, "en", "a", *rows()[0][4:]) for i, t in data], SCHEMA).repartition(4)
    for k in (4, 5):
        found = near_duplicates(frame, shingle=k).collect()
        assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in found) == brute(data, k)
        assert all(x.kept == (x.doc_id == x.component_id) for x in found)


def test_near_duplicates_edge_cases(docs, no_docs):
    found = near_duplicates(docs).collect()
    assert len(found) == len(rows())
    by_id = defaultdict(list)
    for x in found:
        by_id[x.doc_id].append(x)
    assert [by_id[i][0].component_id for i in (1, 2, 3, 5, 6, 7, 14, 15)] == [1, 2, 3, 5, 5, 5, 14, 14]
    assert len(by_id[12]) == 2 and by_id[None][0].component_id is None and by_id[None][0].kept
    assert near_duplicates(no_docs).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(200, 201), (201, 200), (300, 300)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect())
    assert all(found[k] == 0 for k in range(41)) and all(found[100 + k] == 100 for k in range(30)) and found[201] == 200


def test_super_minhash_estimates_jaccard():
    r = np.random.default_rng(3)
    error = []
    for _ in range(30):
        a = r.integers(0, 2**63, 300, dtype=np.uint64)
        b = np.concatenate([a[:240], r.integers(0, 2**63, 60, dtype=np.uint64)])
        error.append((super_minhash(a, 180) == super_minhash(b, 180)).mean() - 240 / 360)
    assert abs(np.mean(error)) < 0.02 and np.std(error) < (2 / 3 * 1 / 3 / 180) ** 0.5
    assert (super_minhash(a, 180) == super_minhash(a[::-1].copy(), 180)).all() and (super_minhash(a[:1], 180) >> np.uint64(32)).max() == 179


PAGES = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (3, "http://a/é", None), (4, None, ""), (5, "u", "WARC/1.1\r\n\x1f\x08 é " * 9000), (6, "u", "x"), (6, "u", "x"), (None, "n", "y"), (None, "n", "<p>same</p>")]


def test_archives_round_trip_in_any_split(spark):
    pages = spark.createDataFrame([(*p, 1, "d") for p in PAGES], "page_id long, url string, html string, keeper int, digest string")
    folder = new_dir(spark, "warc")
    manifest = warc.write_archives(pages, folder)
    assert manifest.agg(F.sum("records")).first()[0] == len(PAGES)
    for split in (64, 1000, 1 << 20):
        found = warc.read_archives(manifest, folder, split_bytes=split).collect()
        assert len(found) == len(PAGES)
        for x in found:
            html = next(h for p, _, h in PAGES if p == x.page_id and (x.page_id is not None or len((h or "").encode()) == x.payload_bytes)) or ""
            assert (x.payload_bytes, x.payload_digest) == (len(html.encode()), base64.b32encode(hashlib.sha1(html.encode()).digest()).decode())
            assert x.record_type == ("response" if x.refers_to is None else "revisit") and (x.payload is None or bytes(x.payload) == html.encode())
        refers = {x.page_id: x.refers_to for x in found if x.page_id}
        assert refers == {1: 2, 2: None, 3: 4, 4: None, 5: None, 6: None}
    assert warc.read_archives(warc.write_archives(pages.limit(0), folder), folder).count() == 0


def test_shorter_payloads_are_all_responses(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    folder = new_dir(spark, "warc")
    found = warc.read_archives(warc.write_archives(pages, folder, min_bytes=100), folder).collect()
    assert all(x.record_type == "response" for x in found)


def test_media_hold_their_payload(docs, no_docs):
    payloads = docs.select("doc_id", F.col("text").cast("binary").alias("payload"), "key")
    found = media_features(media_column(payloads)).collect()
    want = sorted(((i is not None, i or 0, len((t or "").encode()), (t or "").encode()) for i, t, *_ in rows()))
    got = sorted(((x.doc_id is not None, x.doc_id or 0, x.n_bytes, x) for x in found), key=lambda x: x[:3])
    assert len(got) == len(want)
    for (_, _, n, x), (_, _, m, data) in zip(got, want, strict=True):
        padded = data + b" " * (max(192, -(-m // 192) * 192) - m)
        assert (n, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (m, len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert x.media_sha256 == hashlib.sha256(to_wav(padded)).hexdigest() and from_wav(to_wav(padded)) == padded
        assert x.fingerprints == fingerprints(np.frombuffer(padded, np.uint8)).tolist() == sorted(x.fingerprints)
    assert media_column(no_docs.select("doc_id", F.col("text").cast("binary").alias("payload"))).count() == 0


def test_fingerprints_of_a_tone_and_of_silence():
    t = np.arange(192 * 40)
    tone = (128 + 100 * np.sin(2 * np.pi * t * 24 / 192) * (t // 192 % 4 == 0)).astype(np.uint8)
    found = fingerprints(tone)
    assert len(found) and ((found >> 16 & 0xFF) == 24).any()
    assert len(fingerprints(np.full(1920, 128, np.uint8))) == 0
