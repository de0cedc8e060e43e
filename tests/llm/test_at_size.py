"""Groups of some size against brute force, and results that have to hold on the driver's tables."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sextant.llm import near_duplicates as nd
from sextant.llm.line_dedup import drop_recurring_lines
from sextant.llm.media import op7_wav_fingerprints
from sextant.llm.quality_model import class_prior, op10_quality_model

from .conftest import SCHEMA, prose, rows
from .test_files_and_groups import brute, edited

TABLES = "/root/testdata/sf0.01"


def frame_of(spark, data):
    rest = rows()[0][4:]
    return spark.createDataFrame([(i, t, "en", "a", *rest) for i, t in data], SCHEMA)


def test_a_hot_group_of_near_copies_matches_brute_force(spark, monkeypatch):
    r = random.Random(5)
    base = prose(1, 110)
    data = [(k, edited(base, k, r.randint(0, 7))) for k in range(1700)]  # near the base, about it and past it
    data += [(5000 + k, edited(prose(10 + k // 4, 90), k, r.randint(0, 4))) for k in range(400)]
    counts = []
    compared = nd.residual_pairs

    def counted(*args):
        found = compared(*args)
        counts.append(found.count())
        return found

    monkeypatch.setattr(nd, "residual_pairs", counted)
    monkeypatch.setattr(nd, "SPLIT", 300)
    found = nd.near_duplicates(frame_of(spark, data).repartition(6), shingle=4).collect()
    want = {i: c for i, _, c in brute(data, 4)}
    got = {x.doc_id: x.component_id for x in found}
    assert got == want
    assert 1 < len({c for i, c in want.items() if i < 1700}) < 1700
    assert counts[0] <= 3 * len(data)  # the group has 1.4 million pairs


def test_bounds_never_rule_out_a_link():
    r = np.random.default_rng(2)
    sets = []
    for _ in range(60):
        own = set(r.choice(400, r.integers(40, 70), replace=False).tolist()) if r.random() < 0.3 else set(range(50)) ^ set(r.integers(0, 70, r.integers(0, 14)).tolist())
        sets.append({int(nd.mix(np.array([x], np.uint64))[0]) for x in own})
    lead = sets[0]
    alone = {x for s in sets for x in s if sum(x in t for t in sets) == 1}
    block = {c: np.array(v) for c, v in {"n": [len(s) for s in sets], "s": [len(s - alone) for s in sets], "common": [len(s & lead) for s in sets], "component": list(range(60))}.items()}
    block["bitmap"] = np.zeros((60, nd.WORDS), np.uint64)
    for k, s in enumerate(sets):
        bits = np.zeros(64 * nd.WORDS, np.uint8)
        bits[[x >> (64 - (64 * nd.WORDS - 1).bit_length()) for x in s - alone]] = 1
        block["bitmap"][k] = np.packbits(bits).view(np.uint64)
    i, j = nd.may_link(block, block, 80)
    open_ = set(zip(i.tolist(), j.tolist(), strict=True))
    linked = {(a, b) for a in range(60) for b in range(60) if a != b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert linked and linked <= open_ and len(open_) < 3540


def test_recurring_lines_of_twenty_families_go(spark):
    families = []
    for f in range(20):
        boiler = [f"{w} {prose(40 * f + k, 3).replace(chr(10), ' ')} stands on every page of number {w}" for k, w in enumerate(("first", "second", "third", "fourth"))]
        families += [(f, [*boiler, " ".join(prose(9000 + 20 * f + d, 30).split())]) for d in range(8)]
    texts = ["\n".join(x) for _, x in families]
    found = {x.doc_id: x.cut for x in drop_recurring_lines(frame_of(spark, enumerate(texts))).select("doc_id", F.col("line_dedup.text").alias("cut")).collect()}
    for i, (_, lines) in enumerate(families):
        sets = {x: len({t for t in texts if x in t.split("\n")}) for x in lines}
        assert found[i] == "\n".join(x for x in lines if sets[x] < 5) == lines[-1]


def test_media_features_come_from_a_stored_table(spark, docs, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    found = op7_wav_fingerprints(spark, str(tmp_path))
    assert "MapInArrow" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "/media-" in found.inputFiles()[0] and plan.count("MapInArrow") == 1
    by_text = {}
    for x, (_, t, *_) in zip(sorted(found.collect(), key=lambda x: (x.doc_id is not None, x.doc_id or 0)), sorted(rows(), key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        assert x.n_bytes == len((t or "").encode()) and by_text.setdefault(t or "", x.feature) == x.feature


def test_the_prior_is_read_off_positives_and_unlabelled_rows():
    r = np.random.default_rng(4)
    for share in (0.3, 0.6, 0.85):
        good = lambda n: r.normal(1, 1, (n, 4))
        mixed = np.concatenate([good(int(3000 * share)), r.normal(-2, 1, (3000 - int(3000 * share), 4))])
        assert class_prior(good(1500), mixed) == pytest.approx(share, abs=0.06)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the driver's tables")
def test_held_out_rows_are_told_apart(spark):
    labels = spark.read.parquet(f"{TABLES}/labels.parquet").select("doc_id", "quality")
    found = op10_quality_model(spark, TABLES).where("held_out").join(labels, "doc_id").collect()
    good, bad = ([x.score for x in found if x.quality == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(bad) >= 5 and auc >= 0.95 and np.mean([x.predicted == x.quality for x in found]) >= 0.95


def test_stages_bear_clashing_names_and_ids_that_repeat(spark):
    names = ("col", "line_dedup", "quality_verdict", "near_class", "near_text_key", "row")
    two = [prose(31, 150), prose(32, 150)]
    data = [(1, two[0]), (1, two[1]), (1, two[1]), (2, two[0]), (3, two[1].replace("the", "THE")), (4, ""), (4, ""), (None, two[0])]
    frame = spark.createDataFrame([(i, t, "en", "a", 1, *names) for i, t in data], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, "")
        assert out.columns == frame.columns and out.collect() is not None, name
        assert all(r[n] == n for r in out.collect() for n in names)
    stay = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.near_dedup(spark, frame, "").collect())
    assert stay == sorted([(0, two[0]), (1, two[0]), (1, two[1]), (4, "")])
