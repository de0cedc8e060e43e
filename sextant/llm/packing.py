"""Packing documents into sequences of at most ``size`` tokens by cutting-stock column generation.

A document of n ids gives n // size full sequences and a remainder.  The histogram of remainder lengths (at most size - 1
rows, whatever the corpus) is the demand of a cutting-stock problem: a linear program over patterns, whose columns a
knapsack dynamic program prices.  The rounded-down patterns are assigned to the documents of each length by rank, in parallel.
What rounding leaves over (bounded by the number of patterns, not by the corpus) is packed best-fit.  Remainders that would
sit in a pattern or sequence with more than ``size / 64`` to pad are cut at powers of two instead, and those pieces fill sequences
by rank without a gap.  So each document's cuts are among few known places, whose checksums the one pass over the text takes.

Sequences are padded to ``size`` (a power of two) unless their length is a power of two.

Edge cases: a null or empty text is its end id alone; rows that share a doc_id are packed apart; an empty table
gives no pieces; ties of length are ranked by partition and row order of the written length table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise
from .tokens import default_vocabulary, encoder

SIZE = 1024
MAX_PIVOTS = 400
GAP = 5e-4
#: Of ``size``: a pattern with more to pad isn't used.
WASTE = 64


# ---- the linear program


def price(values: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Unbounded knapsack: counts of the pattern of most value within ``size``, and that value."""
    best = np.zeros(size + 1)
    last = np.full(size + 1, -1)
    useful = values > 1e-12
    item, worth = lengths[useful], values[useful]
    index = np.flatnonzero(useful)
    ends = np.searchsorted(item, np.arange(size + 1), side="right")
    for room in range(1, size + 1):
        n = ends[room]
        best[room], last[room] = best[room - 1], -1
        if n:
            total = best[room - item[:n]] + worth[:n]
            k = int(total.argmax())
            if total[k] > best[room] + 1e-12:
                best[room], last[room] = total[k], k
    counts = np.zeros(len(lengths), np.int64)
    room = size
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            counts[index[last[room]]] += 1
            room -= item[last[room]]
    return counts, float(best[size])


def greedy_basis(lengths: np.ndarray, demand: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """A first solution of little waste: longest first, filled up with the longest that fit, until one length is used up.

    Each pattern holds a length that no later one holds (the third part names its place), so the patterns are a basis.
    """
    m = len(lengths)
    left = demand.astype(np.float64).copy()
    at = {int(x): k for k, x in enumerate(lengths)}
    open_ = np.ones(m, bool)
    patterns, amounts, own = [], [], []
    longest = m - 1
    while len(patterns) < m:
        while longest >= 0 and not open_[longest]:
            longest -= 1
        counts = np.zeros(m)
        room, k = size, longest
        while k >= 0:
            if open_[k] and lengths[k] <= room:
                rest = int(room - lengths[k])
                exact = at.get(rest)
                counts[k] += 1
                room = rest
                if exact is not None and open_[exact]:
                    counts[exact] += 1
                    break
                k = min(k, int(np.searchsorted(lengths, room, side="right")) - 1)
            else:
                k -= 1
        use = counts > 0
        times = float((left[use] / counts[use]).min())
        left -= times * counts
        gone = np.flatnonzero(use & (left <= 1e-9))
        open_[gone] = False
        patterns.append(counts)
        amounts.append(times)
        own.append(int(gone[0]))
        for k in gone[1:].tolist():  # used up at once: a pattern of its own, used no times
            counts = np.zeros(m)
            counts[k] = size // lengths[k]
            patterns.append(counts)
            amounts.append(0.0)
            own.append(k)
    return np.array(patterns).reshape(m, m), np.array(amounts), own


def basis_inverse(patterns: np.ndarray, own: list[int]) -> np.ndarray:
    """Inverse of a greedy basis: triangular once lengths are in the order of ``own``, so rows are substituted from the last."""
    inverse = np.zeros_like(patterns)
    for i in range(len(own) - 1, -1, -1):
        row = -np.einsum("k,kj->j", patterns[i][(others := np.flatnonzero(patterns[i]))], inverse[others])
        row[i] += 1
        inverse[own[i]] = row / patterns[i, own[i]]
    return inverse


def column_generation(lengths: np.ndarray, demand: np.ndarray, size: int, max_pivots: int = MAX_PIVOTS, gap: float = GAP) -> tuple[np.ndarray, np.ndarray]:
    """Fractional use of patterns that meets the demand: (patterns as rows of counts, amounts).

    Revised simplex from the greedy basis.  Stops when no column improves, at a relative gap to
    the bound sum(duals * demand) / best price, or after ``max_pivots`` pivots; any stop leaves a valid solution.
    """
    patterns, amounts, own = greedy_basis(lengths, demand, size)
    inverse = basis_inverse(patterns, own).T.copy()
    for _ in range(max_pivots):
        duals = inverse.sum(0)
        counts, value = price(duals, lengths, size)
        if value <= 1 + 1e-9 or amounts.sum() <= (1 + gap) * max((duals * demand).sum() / value, (lengths * demand).sum() / size):
            break
        used = np.flatnonzero(counts)
        step = (inverse[:, used] * counts[used]).sum(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, amounts / step, np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        taken = ratio[out]
        amounts = np.maximum(amounts - taken * step, 0)
        amounts[out] = taken
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        patterns[out] = counts
    return patterns.round().astype(np.int64), amounts


def whole_patterns(counts: dict[int, int], size: int) -> tuple[list[tuple[list[tuple[int, int]], int]], dict[int, int], dict[int, int]]:
    """(patterns of little waste with times, what rounding left of these, what wasteful patterns hold), by length.

    Never asks for more of a length than there is; the second part is bounded by the number of patterns.
    """
    if not counts:
        return [], {}, {}
    lengths = np.array(sorted(counts))
    left = np.array([counts[x] for x in lengths.tolist()])
    patterns, amounts = column_generation(lengths, left.astype(np.float64), size)
    good = size - patterns @ lengths <= size // WASTE
    chosen = []
    for k in np.argsort(-amounts, kind="stable"):
        row = patterns[k]
        use = row > 0
        times = min(int(amounts[k] + 1e-6), int((left[use] // row[use]).min()))
        if times > 0 and good[k]:
            left = left - times * row
            chosen.append(([(int(a), int(b)) for a, b in zip(lengths[use], row[use], strict=True)], times))
    wasted = (amounts[~good].astype(np.int64)[:, None] * patterns[~good]).sum(0)
    wide = np.minimum(left, wasted)
    return chosen, dict(zip(lengths.tolist(), (left - wide).tolist(), strict=True)), dict(zip(lengths.tolist(), wide.tolist(), strict=True))


def powers(length: int) -> list[int]:
    """Powers of two that sum to a length, largest first."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def best_fit(rest: dict[int, int], size: int) -> list[list[int]]:
    """Lengths of each sequence, longest lengths first, each into the sequence with the least room that holds it."""
    bins: dict[int, list[list[int]]] = defaultdict(list)  # by room
    for length in sorted(rest, reverse=True):
        for _ in range(rest[length]):
            room = next((r for r in range(length, size) if bins.get(r)), None)
            into = bins[room].pop() if room is not None else []
            into.append(length)
            bins[(size if room is None else room) - length].append(into)
    return [x for xs in bins.values() for x in xs]


# ---- the jobs

LENGTHS = "part int, doc_id long, doc_tokens long, rest int, rest_rank long, full_before long, crcs array<long>, cut_crcs array<long>"


def _lengths(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, size: int) -> Iterator[pa.RecordBatch]:
    """Ids of each document, cut at multiples of ``size``: crc32 of each piece, those of the remainder's powers of two, and this partition's running counts."""
    enc = encoder(vocabulary, end_id)
    part = TaskContext.get().partitionId()
    seen, full = defaultdict(int), 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256)
            out = defaultdict(list)
            for encoded in enc.encode(rows.column("text").to_pylist()):
                ids = enc.ids(encoded).astype("<u4")
                n, rest = len(ids), len(ids) % size
                out["doc_tokens"].append(n)
                out["rest"].append(rest)
                out["rest_rank"].append(seen[rest])
                out["full_before"].append(full)
                out["crcs"].append([zlib.crc32(ids[a : a + size].tobytes()) for a in range(0, n, size)])
                cuts = np.cumsum([n - rest, *powers(rest)]).tolist()
                out["cut_crcs"].append([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(cuts, cuts[1:], strict=False)])
                seen[rest] += 1
                full += n // size
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * rows.num_rows, pa.int32()), rows.column("doc_id"), pa.array(out["doc_tokens"], pa.int64()), pa.array(out["rest"], pa.int32()), pa.array(out["rest_rank"], pa.int64()), pa.array(out["full_before"], pa.int64()), pa.array(out["crcs"], pa.list_(pa.int64())), pa.array(out["cut_crcs"], pa.list_(pa.int64()))],
                [x.split()[0] for x in LENGTHS.split(", ")],
            )


class Plan:
    """Where the r-th remainder of each length goes; its size depends on ``size`` alone, not on the corpus."""

    def __init__(self, counts: dict[int, int], size: int):
        spans = defaultdict(list)  # length -> (first rank, end rank, number in a pattern, first sequence, first offset)
        self.size = size
        self.sequences = 0
        used: dict[int, int] = defaultdict(int)

        def add(pattern: list[tuple[int, int]], times: int) -> None:
            offset = 0
            for length, number in pattern:
                spans[length].append((used[length], used[length] + times * number, number, self.sequences, offset))
                used[length] += times * number
                offset += length * number
            self.sequences += times

        chosen, rounded, _ = whole_patterns(counts, size)
        for pattern, times in chosen:
            add(pattern, times)
        for lengths in best_fit(rounded, size):
            room = size - sum(lengths)
            if room <= size // WASTE or sum(lengths) in powers(sum(lengths)):
                add([(x, lengths.count(x)) for x in dict.fromkeys(lengths)], 1)
        self.spans = {k: np.array(v, np.int64) for k, v in spans.items()}
        self.covered = dict(used)
        # the others are cut: pieces of each power of two are numbered by length, then by rank
        self.cut_base: dict[tuple[int, int], int] = {}
        number: dict[int, int] = defaultdict(int)
        for length in sorted(counts):
            for power in powers(length):
                self.cut_base[length, power] = number[power]
                number[power] += counts[length] - used[length]
        self.cut_first: dict[int, int] = {}
        for power in sorted(number):
            self.cut_first[power] = self.sequences
            self.sequences += number[power] // (size // power)
        # the last pieces of each power, largest first, fill sequences without a gap; the last of those ends at each power of its length
        self.last: dict[tuple[int, int], tuple[int, int]] = {}
        tail = [(p, k) for p in sorted(number, reverse=True) for k in range(number[p] - number[p] % (size // p), number[p])]
        total, at = sum(p for p, _ in tail), 0
        ends = np.cumsum([size] * (total // size) + powers(total % size)).tolist()
        which = 0
        for p, k in tail:
            self.last[p, k] = (self.sequences + which, at - (ends[which - 1] if which else 0))
            at += p
            which += at == ends[which]
        self.sequences += len(ends)

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the remainder, size, sequence, offset) of each piece."""
        if rank < (covered := self.covered.get(length, 0)):
            first, _, number, sequence, offset = self.spans[length][int(np.searchsorted(self.spans[length][:, 1], rank, side="right"))].tolist()
            return [(0, length, sequence + (rank - first) // number, offset + (rank - first) % number * length)]
        found, start = [], 0
        for p in powers(length):
            k, n = self.cut_base[length, p] + rank - covered, self.size // p
            found.append((start, p, *(self.last.get((p, k)) or (self.cut_first[p] + k // n, k % n * p))))
            start += p
        return found


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _place(batches: Iterator[pa.RecordBatch], plan: Plan, size: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            out = []
            for r in batch.slice(at, 2048).to_pylist():
                n, rest, crcs = r["doc_tokens"], r["rest"], r["crcs"]
                first = plan.sequences + r["full_base"] + r["full_before"]
                out += [(r["doc_id"], k * size, size, crcs[k], n, first + k, 0) for k in range(n // size)]
                found = plan.pieces(rest, r["rest_base"] + r["rest_rank"]) if rest else []
                own = crcs[-1:] if len(found) == 1 else r["cut_crcs"]
                out += [(r["doc_id"], n - rest + start, take, crc, n, sequence, offset) for (start, take, sequence, offset), crc in zip(found, own if found else [], strict=True)]
            columns = list(zip(*out, strict=True)) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=schema)


def pack(docs: DataFrame, vocabulary: str | None = None, size: int = SIZE, end_id: int = 0) -> DataFrame:
    """Packs ``docs(doc_id, text)``; one row for each piece of a document."""
    vocabulary = vocabulary or default_vocabulary()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lengths = materialise(texts.mapInArrow(lambda it: _lengths(it, vocabulary, end_id, size), LENGTHS), "lengths")

    by_part = materialise(lengths.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum(F.expr(f"doc_tokens div {size}")).alias("full")), "length-counts")
    plan = Plan({r["rest"]: r["n"] for r in by_part.where("rest > 0").groupBy("rest").agg(F.sum("n").alias("n")).collect()}, size)

    earlier = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row for each partition of the length table
    parts = by_part.groupBy("part").agg(F.sum("full").alias("full"))
    parts = parts.select("part", F.coalesce(F.sum("full").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full_base"))
    bases = by_part.select("part", "rest", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rest_base")).join(parts, "part")
    placed = lengths.join(bases, ["part", "rest"])
    return placed.select("doc_id", "doc_tokens", "rest", "rest_rank", "full_before", "crcs", "cut_crcs", "rest_base", "full_base").mapInArrow(lambda it: _place(it, plan, size), PIECES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 1024 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
