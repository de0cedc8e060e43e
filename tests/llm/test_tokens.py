import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from sextant.llm.packing import Plan, basis_inverse, greedy_basis, pack
from sextant.llm.shared import new_dir
from sextant.llm.token_files import read_token_files, write_token_files
from sextant.llm.tokens import ChunkEncoder, default_vocabulary

from .conftest import rows


def whole(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_chunks_give_the_ids_of_the_whole_text():
    e = ChunkEncoder(default_vocabulary(), cache_entries=50)
    r = random.Random(5)
    letters = " \n\t\r\x0b\x1c\xa0　ab.,'s1é漢$!<|>"
    texts = [x[1] for x in rows()] + ["".join(r.choice(letters) for _ in range(r.randint(0, 16))) for _ in range(4000)]
    assert [e.ids(x).tolist() for x in e.encode(texts)] == [whole(e, x) for x in texts]


def test_token_files_round_trip(spark, docs):
    folder = new_dir(spark, "files")
    manifest = write_token_files(docs, folder)
    got = sorted(map(tuple, read_token_files(manifest, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda x: x[1])
    e = ChunkEncoder(default_vocabulary())
    want = sorted(((i, len(ids := whole(e, t)), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t, *_ in rows()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [(i, n, c) for i, _, n, c in got] == want
    assert [s for _, s, _, _ in got] == [0, *np.cumsum([n for _, n, _ in want])[:-1].tolist()]


def test_token_files_of_nothing(spark, no_docs):
    folder = new_dir(spark, "files")
    assert read_token_files(write_token_files(no_docs, folder), folder).count() == 0


def held(pieces, size=1024):
    fill = defaultdict(list)
    for p in pieces:
        fill[p.sequence_id].append((p.offset, p.length))
    pad = 0
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert 0 < at <= size
        pad += 0 if at & (at - 1) == 0 else size - at
    return pad


def test_packing_holds_each_id_once(docs):
    pieces = pack(docs).collect()
    e = ChunkEncoder(default_vocabulary())
    by_doc = defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for i in {x[0] for x in rows()}:
        same = [x for x in rows() if x[0] == i]
        ids = np.array(whole(e, same[0][1]), "<u4")
        assert sum(p.length for p in by_doc[i]) == len(ids) * len(same)
        for p in by_doc[i]:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        times = Counter(k for p in by_doc[i] for k in range(p.start, p.start + p.length))
        assert times == dict.fromkeys(range(len(ids)), len(same))
    assert held(pieces) <= 0.02 * sum(p.length for p in pieces)


def test_packing_of_nothing(no_docs):
    assert pack(no_docs).count() == 0


def test_the_greedy_basis_is_inverted_by_substitution():
    r = random.Random(3)
    lengths = np.array(sorted(r.sample(range(1, 64), 30)))
    patterns, _, own = greedy_basis(lengths, np.array([float(r.randint(1, 50)) for _ in lengths]), 64)
    product = (patterns[:, :, None] * basis_inverse(patterns, own)[None]).sum(1)
    assert np.abs(product - np.eye(30)).max() < 1e-9


def test_plans_hold_any_histogram():
    r = random.Random(2)
    cases = [{}, {1: 1}, {1023: 7}, {600: 500}, {512: 3, 511: 3, 2: 1}, {k: r.randint(1, 9) for k in range(1, 1024)}, {k: 1 for k in range(1, 1024, 7)}]
    for counts in cases:
        plan = Plan(counts, 1024)
        fill = defaultdict(list)
        for length, n in counts.items():
            for rank in range(n):
                found = plan.pieces(length, rank)
                assert [s for s, _, _, _ in found] == np.cumsum([0, *(t for _, t, _, _ in found)])[:-1].tolist() and sum(t for _, t, _, _ in found) == length
                for _, take, sequence, offset in found:
                    fill[sequence].append((offset, take))
        total = sum(k * v for k, v in counts.items())
        pad = 0
        for spans in fill.values():
            at = 0
            for offset, take in sorted(spans):
                assert offset == at
                at += take
            assert at <= 1024
            pad += 0 if at & (at - 1) == 0 else 1024 - at
        assert sorted(fill) == list(range(plan.sequences)) and pad <= 0.016 * max(total, 1)
