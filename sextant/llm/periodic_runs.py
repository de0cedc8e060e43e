"""Runs: stretches of words that repeat with a period.

A document's words are numbered; a run is a stretch with smallest period q (words q apart are identical) that no neighbouring word extends, of at
least ``EXPONENT`` periods and ``LEAST`` words.  Runs come from suffix trees (:mod:`suffix_tree`): trees of the words and of their reversal give
the longest common extension of two places in constant time, the longest Lyndon word at each place, in both orders of the words, is a
candidate for a run's root, and each candidate is extended in both directions.

Trees are built where a run can be.  Inside a run, beyond its first period, each three words have stood at most one period earlier, and that holds for
three periods' length; so a document is cut to the stretches where that holds, with a period and a word on both sides.  The condition is
necessary, so no run is lost, and what it lets through the trees decide.

There is no exchange: a document is worked on where it is read.  The trees take about 1 KB for each word of a stretch that may hold a run.

Edge cases: null, empty and blank texts have no words and no runs; a null doc_id is kept and its words stay as they are; repeated rows are apart but alike; of
runs of one length the first leads, then that of the smaller period; an empty table gives no rows; other columns are ignored; very long
texts are worked on whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shingles import BASE, blocks, mix, word_hashes
from .suffix_tree import repetitions

EXPONENT = 4
LEAST = 6
#: Words of the sequences whose earlier places are looked up.
GRAM = 3


def may_repeat(hashes: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int, int]]:
    """(document, first word, end) of the stretches that hold all runs, words numbered inside their document."""
    n = len(hashes) - GRAM + 1
    if n < 1:
        return []
    grams = hashes[:n].copy()
    for k in range(1, GRAM):
        grams = mix(grams * BASE + hashes[k : n + k])
    order = np.argsort(grams, kind="stable")
    same = grams[order[1:]] == grams[order[:-1]]
    at, gap = order[1:][same], (order[1:] - order[:-1])[same]
    document = np.searchsorted(firsts, at, side="right") - 1
    inside = (at - gap >= firsts[document]) & (at + GRAM <= firsts[document + 1])
    at, gap, document = at[inside], gap[inside], document[inside]
    by_place = np.argsort(at)
    at, gap, document = at[by_place], gap[by_place], document[by_place]
    while len(at):
        new = np.concatenate(([True], (np.diff(at) > 1) | (np.diff(document) > 0)))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.concatenate((starts, [len(at)])))
        # a run of period q has 3 q - GRAM + 1 such places at least
        most = np.where(sizes >= LEAST - GRAM, (sizes + GRAM - 1) // (EXPONENT - 1), 0)
        fits = gap <= np.repeat(most, sizes)
        if fits.all():
            break
        at, gap, document = at[fits], gap[fits], document[fits]
    else:
        return []
    found: list[tuple[int, int, int]] = []
    for a, size, q in zip(starts.tolist(), sizes.tolist(), most.tolist(), strict=True):
        d = int(document[a])
        base, end = int(firsts[d]), int(firsts[d + 1])
        lo, hi = max(base, int(at[a]) - q - 1) - base, min(end, int(at[a]) + size + GRAM) - base
        if found and found[-1][0] == d and found[-1][2] >= lo:
            found[-1] = (d, found[-1][1], max(hi, found[-1][2]))
        else:
            found.append((d, lo, hi))
    return found


def repeated_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(first word, period) of the tail that a document's words are made to repeat in, by the checksum of its id."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def runs_of(words: list[bytes], stretches: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    found = []
    for lo, hi in stretches:
        numbers: dict[bytes, int] = {}
        own = [numbers.setdefault(w, len(numbers) + 1) for w in words[lo:hi]]
        found += [(lo + start, length, period) for start, length, period in repetitions(own, EXPONENT, LEAST)]
    return sorted(found, key=lambda x: (x[0], x[2]))


RUNS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, runs array<struct<start:long,length:long,period:long>>"
_NAMES = [x.split()[0] for x in RUNS.split(", ")]
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema(list(zip(_NAMES, [pa.int64()] * 6 + [pa.string()] * 2 + [pa.list_(_RUN)], strict=True)))


def _find(batches: Iterator[pa.RecordBatch], tails: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        for first, block in blocks(batch.column("text").to_pylist()):
            hashes, firsts = word_hashes(block)
            split = [x.split() for x in block]
            for k, words in enumerate(split):
                if tails and (tail := repeated_tail(ids[first + k], len(words))):
                    a, p = tail
                    places = a + np.arange(len(words) - a) % p
                    split[k] = words[:a] + [words[j] for j in places.tolist()]
                    own = hashes[firsts[k] : firsts[k + 1]]
                    own[a:] = own[places]
            stretches: dict[int, list[tuple[int, int]]] = {}
            for d, lo, hi in may_repeat(hashes, firsts):
                stretches.setdefault(d, []).append((lo, hi))
            rows = []
            for k, words in enumerate(split):
                found = runs_of(words, stretches.get(k, []))
                kept = np.ones(len(words), bool)
                for start, length, period in found:
                    kept[start + period : start + length] = False
                best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
                collapsed = b" ".join(words if not found else [words[j] for j in np.flatnonzero(kept).tolist()])
                digests = (hashlib.sha256(x).hexdigest() for x in (listed.encode(), collapsed))
                rows.append((ids[first + k], len(found), *best, 1000 * best[1] // best[2] if found else None, *digests, [dict(zip(("start", "length", "period"), x, strict=True)) for x in found]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def periodic_runs(docs: DataFrame, tails: bool = False) -> DataFrame:
    """``docs(doc_id, text)`` to one row a document: its runs, the greatest of them, and digests of the runs and of the text without what they repeat.

    With ``tails`` a tenth of the documents, by the checksum of their id, has its words from some place on repeat (:func:`repeated_tail`).
    """
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(lambda it: _find(it, tails), RUNS)


OP12_SQL = r"""
with own as (
  select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_transform(range(8 * length(cast(doc_id as varchar))), lambda i: case when i % 8 = 0 then ascii(substr(cast(doc_id as varchar), i // 8 + 1, 1)) else 0 end) as bits
  from documents),
summed as (
  select r, doc_id, w, len(w) as n, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(bits, lambda x: x::bigint)),
    lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295) as h
  from own),
placed as (
  select *, case when h % 10 = 0 and n > 0 then (h // 10) % n else n end as a,
    1 + (n - case when h % 10 = 0 and n > 0 then (h // 10) % n else n end) // (3 + (h // 10) % 8) as p
  from summed),
texts as (
  select r, doc_id, n, list_transform(range(n), lambda i: w[case when i < a then i else a + (i - a) % p end + 1]) as w from placed),
words as (select r, n, unnest(w) as word, unnest(range(n)) as i from texts),
pairs as (
  select x.r, x.i, y.i - x.i as q from words x join words y on x.r = y.r and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= x.n),
islands as (select r, q, i, i - row_number() over (partition by r, q order by i) as island from pairs),
stretches as (select r, q, min(i) as start, count(*) + q as length from islands group by r, q, island having count(*) + q >= greatest(6, 4 * q)),
runs as (select r, start, length, min(q) as period from stretches group by r, start, length),
dropped as (select distinct r, unnest(range(start + period, start + length)) as i from runs),
kept as (
  select x.r, string_agg(x.word, ' ' order by x.i) as text from words x left join dropped d on x.r = d.r and x.i = d.i where d.i is null group by x.r),
listed as (
  select r, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as listed,
    arg_max(struct_pack(s := start, l := length, q := period), struct_pack(l := length, s := -start, q := -period)) as best
  from runs group by r)
select t.doc_id, coalesce(l.n_runs, 0) as n_runs, l.best.s as start, l.best.l as length, l.best.q as period, 1000 * l.best.l // l.best.q as exponent_milli,
  sha256(coalesce(l.listed, '')) as runs_sha256, sha256(coalesce(k.text, '')) as collapsed_sha256
from texts t left join listed l on t.r = l.r left join kept k on t.r = k.r
"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all ``documents``, a tenth of them with a repeated tail."""
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), tails=True).drop("runs")
