"""Approximate nearest neighbours by inner product: balanced posting lists with replicated boundary vectors.

1. A bounded sample is cut into balanced clusters: halves of halves, then rounds of means with a price on size.  The centroids are linked in a
   graph of near neighbours, which each task holds in memory and searches best first.
2. A query takes the lists whose centroids lie within a ratio of the distance of its ``REPLICAS``-th nearest.  The ratio is the least that finds ``TARGET`` of
   the true neighbours, among all rows of the table, of ``TRIALS`` queries.
3. Rows are dealt out once by a hash of their vector, into as many blocks as the table needs at ``BLOCK_BYTES``, so a hot list is spread over all blocks.  Queries
   are a table that the task of each block reads through.
4. Within a block equal vectors are one entry with as many of its ids, least first, as an answer can hold, so a group of copies is one entry however large it is.
   Every entry joins the list of its nearest centroid, and, where it lies at a boundary, those of other centroids almost as near.
5. A list and the queries that take it are compared in single precision, with a bound on its error; what may be among a query's best is worked out in double
   precision, as sums in the order of the components, so equal vectors tie.  What a query's best reach is guessed from ``GUESS`` sampled rows and the trials, so
   that blocks send only what lies above.
6. A query that finds fewer rows above its guess than an answer holds looks into all lists, under a bound that is sure.

Largest inner product is nearness in one more dimension: an entry x, in units of the greatest length, gets sqrt(1 - x * x), a query gets length 1 and zero.

Bounds: the sample has at most ``SAMPLE`` vectors and ``SAMPLE_BYTES``; the centroids, at most one for 16 of these, are broadcast with their graph and ``GUESS`` of the sample.

Edge cases: vectors that are null, empty, zero or hold a null or a non-finite component take no part, nor do those without vec_id or of another length than most
(of lengths as frequent, the greater); rows that share a vec_id are one, at its best score; ties go to the smaller vec_id; where there are fewer
candidates all are returned; an empty table has no answers; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import file_system, materialise

#: Most vectors, and bytes of vectors, that the index is fitted on.
SAMPLE = 131_072
SAMPLE_BYTES = 1 << 26
#: Sampled vectors for each list.
SHARE = 16
#: Lists that an entry stands in, and how much farther than the nearest the others' centroids may be.
REPLICAS = 8
BOUNDARY = 1.2
#: Links of a centroid, without those back.
LINKS = 12
#: Share of true neighbours to find, and queries that the ratio is fitted on.
TARGET = 0.95
TRIALS = 256
#: Sampled rows that bound a query's best at first.
GUESS = 8192
#: Bytes of the vectors of a block.
BLOCK_BYTES = 64 << 20
#: Queries that a task compares at a time, and tasks for each core at least.
HELD = 16_384
TASKS = 2
#: Rows worked on at a time.
SHORT = 4096
#: Found pairs that wait to be cut to the best.
WAITING = 200_000


class Index:
    """Centroids and the graph between them."""

    def __init__(self, centroids: np.ndarray, greatest: float):
        self.centroids = centroids.astype(np.float32)
        self.squares = (self.centroids.astype(np.float64) ** 2).sum(1)
        self.greatest = greatest
        self.ratio = np.inf
        #: Share of what the first bounds lack to the greatest inner product that a query's best lack at most, or so the trials say.
        self.closer = 1.0
        #: Rows, no two of one id, for the first bounds.
        self.guess = np.zeros((0, self.centroids.shape[1] - 1))
        self._link()

    def _link(self) -> None:
        c, k = self.centroids, len(self.centroids)
        links: list[dict[int, None]] = [{} for _ in range(k)]
        for at in range(0, k, 256):
            part = self._between(np.arange(at, min(k, at + 256)), np.arange(k))
            part[np.arange(len(part)), np.arange(at, at + len(part))] = np.inf
            for a, near in enumerate(np.argsort(part, axis=1, kind="stable")[:, : 4 * LINKS], at):
                among = self._between(near, near)
                own: list[int] = []
                for b in range(len(near)):
                    # a link is spared where one that is kept leads nearer
                    if len(own) < LINKS and near[b] != a and (not own or among[b, own].min() > part[a - at, near[b]]):
                        own.append(b)
                for b in near[own].tolist():
                    links[a][b] = links[b][a] = None
        self.entry = int(self.squares.argmin())
        reached, rest = {self.entry}, [self.entry]
        while True:
            while rest:
                rest += (new := [b for b in links[rest.pop()] if b not in reached])
                reached.update(new)
            if len(reached) == k:
                break
            inside = sorted(reached)
            outside = [a for a in range(k) if a not in reached]
            a, b = inside[0], outside[int(self._between(np.array(inside[:1]), np.array(outside))[0].argmin())]
            links[a][b] = links[b][a] = None
            reached.add(b)
            rest = [b]
        self.links = np.full((k, max(map(len, links), default=1) or 1), -1)
        for a, own in enumerate(links):
            self.links[a, : len(own)] = list(own)

    def _between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        c = self.centroids
        return np.sqrt(np.maximum(0, self.squares[a, None] + self.squares[b] - 2 * (c[a] @ c[b].T)))

    def extended(self, x: np.ndarray, query: bool) -> np.ndarray:
        x = x / self.greatest
        square = (x * x).sum(1)
        if query:
            return np.concatenate((x / np.sqrt(square)[:, None], np.zeros((len(x), 1))), 1).astype(np.float32)
        return np.concatenate((x, np.sqrt(np.maximum(0, 1 - square))[:, None]), 1).astype(np.float32)

    def search(self, points: np.ndarray, ratio: float, least: int) -> np.ndarray:
        """Distance to each centroid that the best-first walk has met (others infinite).

        The walk goes on from the nearest centroid not left yet, until ``least`` have been left and that is farther than ``ratio`` times the ``REPLICAS``-th nearest met.
        """
        return self._walk(points, ratio, least)[0]

    def _walk(self, points: np.ndarray, ratio: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(what ``search`` gives, distance of the ``REPLICAS``-th nearest met)."""
        m, k = len(points), len(self.centroids)
        own = (points.astype(np.float64) ** 2).sum(1)
        met = np.full((m, k), np.inf, np.float32)
        ahead = np.full((m, k), np.inf, np.float32)
        place = min(REPLICAS, k) - 1
        nearest = np.full((m, place + 1), np.inf, np.float32)

        def meet(rows: np.ndarray, nodes: np.ndarray) -> None:
            new = (nodes >= 0) & ~np.isfinite(met[rows[:, None], nodes])
            far = np.full(nodes.shape, np.inf, np.float32)
            at, nodes = np.nonzero(new)[0], nodes[new]
            dots = np.einsum("ij,ij->i", points[rows[at]], self.centroids[nodes])
            far[new] = np.sqrt(np.maximum(0, own[rows[at]] + self.squares[nodes] - 2 * dots))
            met[rows[at], nodes] = ahead[rows[at], nodes] = far[new]
            nearest[rows] = np.partition(np.concatenate((nearest[rows], far), 1), place, axis=1)[:, : place + 1]

        rows = np.arange(m)
        meet(rows, np.full((m, 1), self.entry))
        left = 0
        while len(rows):
            node = ahead[rows].argmin(1)
            far = ahead[rows, node]
            base = nearest[rows].max(1) if left >= least else np.inf
            on = np.isfinite(far) & (far <= ratio * base)
            rows, node = rows[on], node[on]
            ahead[rows, node] = np.inf
            meet(rows, self.links[node])
            left += 1
        return met, nearest.max(1).astype(np.float64)

    def lists_of_entries(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists that entries join."""
        points, k = self.extended(x, False), min(REPLICAS, len(self.centroids))
        near, away = np.empty((len(points), k), np.int64), np.empty((len(points), k))
        own = (points.astype(np.float64) ** 2).sum(1)
        points = np.concatenate((points, np.ones((len(points), 1), np.float32)), 1)
        table = np.concatenate((-2 * self.centroids, self.squares[:, None]), 1, dtype=np.float32, casting="same_kind").T
        for at in range(0, len(points), 128):
            far = points[at : at + 128] @ table
            rows = np.arange(len(far))
            for place in range(k):
                near[at + rows, place] = nearest = far.argmin(1)
                away[at + rows, place] = far[rows, nearest]
                far[rows, nearest] = np.inf
        away = np.sqrt(np.maximum(0, own[:, None] + away))
        rows, places = np.nonzero(away <= BOUNDARY * away[:, :1])
        return rows, near[rows, places]

    def base(self, x: np.ndarray) -> np.ndarray:
        """Distance of queries to the ``REPLICAS``-th nearest centroid that the walk meets."""
        return self._walk(self.extended(x, True), 1.0, 2 * REPLICAS)[1]

    def first_bounds(self, x: np.ndarray, most: int) -> np.ndarray:
        """What the ``most``-th best inner product of each query, taken as of length 1, reaches at least."""
        if len(self.guess) < most:
            return np.full(len(x), -np.inf)
        unit, rows = units(x), self.guess.astype(np.float32)
        scores = unit @ rows.T
        scores -= slack(rows)
        return np.partition(scores, -most, axis=1)[:, -most].astype(np.float64)

    def likely_bounds(self, x: np.ndarray, most: int) -> np.ndarray:
        """What it reaches as far as the trials tell: a query that then finds too few has to be asked again."""
        return self.greatest - (self.greatest - self.first_bounds(x, most)) * self.closer

    def learn_bounds(self, x: np.ndarray, most: int, best: np.ndarray) -> None:
        """``best``: the ``most``-th best of trials, taken as of length 1.  As far again as the farthest trial lies from the middle one is left free."""
        lack = self.greatest - self.first_bounds(x, most)
        sound = np.isfinite(lack) & np.isfinite(best) & (lack > 0)
        if sound.any():
            shares = (self.greatest - best[sound]) / lack[sound]
            self.closer = float(np.clip(2 * shares.max() - np.median(shares), 0, 1))


def units(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None]).astype(np.float32)


def slack(rows: np.ndarray) -> np.ndarray:
    """How far a single-precision inner product of a row and a vector of length 1 can be wrong."""
    lengths = np.sqrt(np.einsum("ij,ij->i", rows, rows, dtype=np.float64))
    return (lengths * (rows.shape[1] + 16) * 2.0**-23).astype(np.float32)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """Means of ``k`` clusters of about equal size."""
    r = np.random.default_rng(7)
    parts, todo = [], [(np.arange(len(x)), k)]
    while todo:
        rows, n = todo.pop()
        if n <= 1 or len(rows) < 2:
            parts.append(rows)
            continue
        own = x[rows]
        a, b = own[r.choice(len(rows), 2, replace=False)].astype(np.float64)
        for _ in range(4):
            side = own @ (b - a).astype(np.float32) * 2 > (b * b).sum() - (a * a).sum()
            if side.all() or not side.any():
                break
            a, b = own[~side].mean(0, dtype=np.float64), own[side].mean(0, dtype=np.float64)
        order = rows[np.argsort(own @ (b - a).astype(np.float32), kind="stable")]
        cut = len(rows) * (n // 2) // n
        todo += [(order[:cut], n // 2), (order[cut:], n - n // 2)]
    centroids = np.array([x[p].mean(0, dtype=np.float64) for p in parts if len(p)], np.float32)
    sizes = np.array([len(p) for p in parts if len(p)], np.float64)
    for _ in range(rounds):
        squares = (centroids**2).sum(1)
        spread = np.var(x, axis=0).sum()
        price = (squares + 0.1 * spread * sizes / sizes.mean()).astype(np.float32)
        near = np.concatenate([(price - 2 * (x[at : at + 1024] @ centroids.T)).argmin(1) for at in range(0, len(x), 1024)])
        sizes = np.bincount(near, minlength=len(centroids)).astype(np.float64)
        order = np.argsort(near, kind="stable")
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        full = sizes > 0
        centroids[full] = (np.add.reduceat(x[order].astype(np.float64), starts[full]) / sizes[full, None]).astype(np.float32)
    return np.unique(centroids, axis=0)


def fitted(sample: np.ndarray, greatest: float) -> Index:
    """The index of a sample, without a ratio."""
    unit = Index(np.zeros((1, sample.shape[1] + 1)), greatest)
    return Index(balanced_centroids(unit.extended(sample, False), max(1, len(sample) // SHARE)), greatest)


def least_ratio(index: Index, queries: np.ndarray, which: np.ndarray, lists: list[np.ndarray]) -> float:
    """The least ratio by which ``TARGET`` of neighbours are found; a neighbour of query ``which`` stands in ``lists``."""
    if not len(which):
        return np.inf
    base, points = index.base(queries), index.extended(queries, True).astype(np.float64)
    away = np.sqrt(np.maximum(0, (points**2).sum(1)[:, None] + index.squares[None] - 2 * points @ index.centroids.T.astype(np.float64)))
    needed = np.array([away[q, own].min() for q, own in zip(which.tolist(), lists, strict=True)])
    with np.errstate(divide="ignore", invalid="ignore"):
        ratios = np.where(needed <= base[which], 1.0, needed / base[which])
    return float(np.quantile(ratios, TARGET, method="higher")) * (1 + 1e-6)


def values(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def matrix(column: pa.Array) -> np.ndarray:
    return values(column).astype(np.float64)


def collapse(x: np.ndarray, sizes: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal rows as one with their ``most`` least ids: (rows, where each row's ids begin and the end, ids)."""
    bits = x.view(np.uint32 if x.dtype == np.float32 else np.uint64)
    mix = np.random.default_rng(11).integers(1, 1 << 63, x.shape[1], np.uint64) | np.uint64(1)
    mark = np.concatenate([(bits[at : at + SHORT] * mix).sum(1) for at in range(0, len(x), SHORT)])
    order = np.argsort(mark, kind="stable")
    same = np.flatnonzero(mark[order[1:]] == mark[order[:-1]])
    # rows of one mark that are unlike stay apart
    same = np.concatenate([same[at : at + SHORT][(x[order[same[at : at + SHORT]]] == x[order[same[at : at + SHORT] + 1]]).all(1)] for at in range(0, len(same) or 1, SHORT)])
    if len(same):
        new = np.ones(len(x), bool)
        new[same + 1] = False
        group = np.empty(len(x), np.int64)
        group[order] = np.cumsum(new) - 1
        x = x[order[new]]
    else:
        group = np.arange(len(x))
    owner = np.repeat(group, sizes)
    by = np.lexsort((ids, owner))
    owner, ids = owner[by], ids[by]
    fresh = np.ones(len(owner), bool)
    fresh[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
    owner, ids = owner[fresh], ids[fresh]
    kept = np.arange(len(owner)) - np.searchsorted(owner, owner) < most
    return x, np.concatenate(([0], np.cumsum(np.bincount(owner[kept], minlength=len(x))))), ids[kept]


def _collapsed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Equal vectors of a batch as one, with its ``most`` least ids."""
    for batch in batches:
        if not batch.num_rows:
            continue
        vecs = batch.column("vec")
        x, firsts, ids = collapse(values(vecs) + 0.0, np.ones(len(vecs), np.int64), batch.column("vec_id").to_numpy(), most)
        ends = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x.ravel())), pa.ListArray.from_arrays(pa.array(firsts, pa.int32()), pa.array(ids))], ["vec", "ids"])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mark, vec), vec without nulls and not empty, to (mark, size, square of the length)."""
    for batch in batches:
        if batch.num_rows:
            vecs = batch.column("vec")
            ends = vecs.offsets.to_numpy() - vecs.offsets[0].as_py()
            squares = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64) ** 2
            yield pa.RecordBatch.from_arrays([batch.column("mark"), pa.array(np.diff(ends).astype(np.int32)), pa.array(np.add.reduceat(squares, ends[:-1]))], ["mark", "size", "square"])


def _neighbours(batches: Iterator[pa.RecordBatch], index: object, queries: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (vec, ids) to the best that a task has for each of a few queries: (q, score, id, equal to the query, lists)."""
    own, unit = index.value, units(queries)
    least = own.first_bounds(queries, most).astype(np.float32)
    held = [np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int64), np.zeros((0, queries.shape[1]))]
    waiting = [held]

    def pruned() -> list[np.ndarray]:
        q, score, ids, vecs = (np.concatenate(x) for x in zip(*waiting, strict=True))
        order = np.lexsort((ids, -score, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == most - 1
        least[q[last]] = np.maximum(least[q[last]], score[order[last]])
        order = order[place < most]
        return [q[place < most], score[order], ids[order], vecs[order]]

    for batch in batches:
        x, firsts, all_ids = values(batch.column("vec")), *flat_ids(batch.column("ids"))
        for at in range(0, len(x), SHORT):
            scores = unit @ x[at : at + SHORT].astype(np.float32).T
            q, j = np.nonzero(scores >= least[:, None])
            sizes = np.diff(firsts)[at + j]
            waiting.append([np.repeat(q, sizes), np.repeat(scores[q, j], sizes), all_ids[runs(firsts[at + j], sizes)], x[np.repeat(at + j, sizes)].astype(np.float64)])
            if sum(len(w[0]) for w in waiting) > 4 * most * len(queries):
                waiting = [pruned()]
    q, score, ids, vecs = pruned()
    if len(q):
        rows, lists = own.lists_of_entries(vecs)
        offsets = pa.array(np.searchsorted(rows, np.arange(len(q) + 1)), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(score.astype(np.float64)), pa.array(ids), pa.array((vecs == queries[q]).all(1)), pa.ListArray.from_arrays(offsets, pa.array(lists.astype(np.int32)))], ["q", "score", "id", "equal", "lists"])


def _bounded(batches: Iterator[pa.RecordBatch], index: object, most: int, every: bool) -> Iterator[pa.RecordBatch]:
    """Queries (key, vec) with the distance of the farthest centroid whose list they take, and what their best reach at least."""
    own = index.value
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            rows = batch.slice(at, 256)
            x = matrix(rows.column("vec"))
            cut = np.full(len(x), np.inf) if every or np.isinf(own.ratio) else own.ratio * own.base(x)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cut), pa.array(own.first_bounds(x, most) if every else own.likely_bounds(x, most))], [*rows.schema.names, "cut", "least"])


def runs(firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """firsts[0], firsts[0] + 1, ... sizes[0] of them, then those of firsts[1], and so on."""
    return np.arange(sizes.sum()) + np.repeat(firsts - np.cumsum(sizes) + sizes, sizes)


def flat_ids(ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(where each row's ids begin, and the end; all ids)."""
    return ids.offsets.to_numpy() - ids.offsets[0].as_py(), ids.flatten().to_numpy()


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products row by row, component after component."""
    q, v = np.ascontiguousarray(q.T, np.float64), np.ascontiguousarray(v.T, np.float64)
    found = np.zeros(q.shape[1])
    for a, b in zip(q, v, strict=True):
        found += a * b
    return found


class Block:
    """Entries in memory, each with its ids, and the lists they stand in."""

    def __init__(self, batches: Iterator[pa.RecordBatch], index: Index, most: int, expected: int):
        self.index, self.most = index, most
        x, at, sizes, ids = None, 0, [], []
        for batch in batches:
            own = values(batch.column("vec"))
            if x is None:
                x = np.empty((expected, own.shape[1]), own.dtype)
            if at + len(own) > len(x):
                x = np.concatenate((x[:at], np.empty((len(x) // 2 + len(own), x.shape[1]), x.dtype)))
            x[at : at + len(own)] = own
            at += len(own)
            firsts, of = flat_ids(batch.column("ids"))
            sizes.append(np.diff(firsts))
            ids.append(of)
        x = x[:at]
        x += 0.0  # no -0.0
        self.x, self.firsts, self.ids = collapse(x, np.concatenate(sizes), np.concatenate(ids), most)
        self.slack = slack(self.x)
        # rows with one first id count once for a bound
        _, self.code = np.unique(self.ids[self.firsts[:-1]], return_inverse=True)
        self.shared = self.code.max(initial=-1) + 1 < len(self.code)
        self.rows = self.starts = None

    def _fill(self) -> None:
        index = self.index
        pairs = [((at + rows).astype(np.int32), lists.astype(np.int16 if len(index.centroids) < 1 << 15 else np.int32)) for at in range(0, len(self.x), 2048) for rows, lists in [index.lists_of_entries(self.x[at : at + 2048].astype(np.float64))]]
        rows, lists = (np.concatenate(x) for x in zip(*pairs, strict=True))
        self.rows = rows[np.argsort(lists, kind="stable")]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(lists, minlength=len(index.centroids)))))

    def best(self, keys: np.ndarray, vecs: np.ndarray, cut: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
        """The best of each query in the lists that it takes: (key, scores, ids)."""
        index, most = self.index, self.most
        self.least, self.room = least.astype(np.float32), np.empty(512 * 1024, np.float32)
        self.waiting, self.n_waiting = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))], 0
        unit = units(vecs)
        if np.isinf(cut).all():
            self._compare(unit, np.arange(len(unit)), np.arange(len(self.x)))
        else:
            self._compare_lists(unit, index.extended(vecs, True), cut)
        self._prune()
        return self._rows(keys, vecs, least)

    def _compare_lists(self, unit: np.ndarray, points: np.ndarray, cut: np.ndarray) -> None:
        if self.rows is None:
            self._fill()
        index = self.index
        # a list is taken where the product with its centroid, less half the centroid's square, reaches this
        needed = (((points.astype(np.float64) ** 2).sum(1) * (1 - 1e-6) - cut**2) / 2).astype(np.float32)
        points = np.concatenate((points, np.ones((len(points), 1), np.float32)), 1)
        centroids = np.concatenate((index.centroids, -index.squares[:, None] / 2), 1).astype(np.float32)
        for at in range(0, len(centroids), 128):
            taken = centroids[at : at + 128] @ points.T >= needed
            for k in range(len(taken)):
                rows = self.rows[self.starts[at + k] : self.starts[at + k + 1]]
                if len(rows) and len(asking := np.flatnonzero(taken[k])):
                    self._compare(unit, asking, rows)

    def _compare(self, unit: np.ndarray, asking: np.ndarray, rows: np.ndarray) -> None:
        for a in range(0, len(rows), 1024):
            part = rows[a : a + 1024]
            entries, wrong = np.take(self.x, part, axis=0).astype(np.float32, copy=False).T, self.slack[part]
            for b in range(0, len(asking), 512):
                own = asking[b : b + 512]
                least = self.least[own]
                scores = np.matmul(np.take(unit, own, axis=0), entries, out=self.room[: len(own) * len(part)].reshape(len(own), len(part)))
                # few queries have one of their best here; what isn't comparable goes on
                some = np.flatnonzero(~(scores.max(1) + wrong.max() < least))
                if len(some):
                    above = scores[some] + wrong
                    q, j = np.nonzero(~(above < least[some, None]))
                    self.waiting.append((own[some[q]].astype(np.int32), part[j], above[q, j]))
                    self.n_waiting += len(q)
            if self.n_waiting > 4 * self.most * len(self.least) + WAITING:
                self._prune()

    def _prune(self) -> None:
        """Leaves the pairs that may be among a query's best, and lifts the bounds."""
        slot, row, above = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        _, once = np.unique(slot.astype(np.int64) * len(self.x) + row, return_index=True)
        slot, row, above = slot[once], row[once], above[once]
        below = np.nan_to_num(above - 2 * self.slack[row], nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        order = np.lexsort((-below, slot))
        if self.shared:
            _, first = np.unique(slot[order].astype(np.int64) * len(self.x) + self.code[row[order]], return_index=True)
            order = order[np.sort(first)]
        held = slot[order]
        last = np.arange(len(held)) - np.searchsorted(held, held) == self.most - 1
        self.least[held[last]] = np.maximum(self.least[held[last]], below[order[last]])
        kept = ~(above < self.least[slot])
        self.waiting, self.n_waiting = [(slot[kept], row[kept], above[kept])], int(kept.sum())

    def _rows(self, keys: np.ndarray, vecs: np.ndarray, least: np.ndarray) -> pa.RecordBatch:
        slot, row, _ = self.waiting[0]
        scores = np.concatenate([np.zeros(0), *(exact(vecs[slot[at : at + 2048]], self.x[row[at : at + 2048]]) for at in range(0, len(slot), 2048))])
        # what lies below the bound may be only some of what does
        kept = scores >= (least * np.sqrt((vecs * vecs).sum(1)))[slot]
        slot, row, scores = slot[kept], row[kept], scores[kept]
        sizes = np.diff(self.firsts)[row]
        return best_rows(np.repeat(keys[slot], sizes), np.repeat(scores, sizes), self.ids[runs(self.firsts[row], sizes)], self.most)


def best_rows(keys: np.ndarray, scores: np.ndarray, ids: np.ndarray, most: int) -> pa.RecordBatch:
    """Each key's ``most`` best, each id once at its best score, as one row (key, scores, ids)."""
    order = np.lexsort((-scores, ids, keys))
    keys, scores, ids = keys[order], scores[order], ids[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    keys, scores, ids = keys[fresh], scores[fresh], ids[fresh]
    order = np.lexsort((ids, -scores, keys))
    keys, scores, ids = keys[order], scores[order], ids[order]
    kept = np.arange(len(keys)) - np.searchsorted(keys, keys) < most
    keys, scores, ids = keys[kept], scores[kept], ids[kept]
    held, starts = np.unique(keys, return_index=True)
    offsets = pa.array([*starts.tolist(), len(keys)], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(scores, pa.float64())), pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int64()))], ["key", "scores", "ids"])


def _queries(files: list[str], block: int, blocks: int) -> Iterator[pa.Table]:
    """Rows of a table's files whose key falls to a block, ``HELD`` and more at a time."""
    held: list[pa.RecordBatch] = []
    for uri in files:
        system, path = file_system(uri)
        with system.open_input_file(path) as file:
            for batch in pq.ParquetFile(file).iter_batches(batch_size=HELD, use_threads=False):
                held.append(batch.filter(pa.array(batch.column("key").to_numpy() % blocks == block)) if blocks > 1 else batch)
                if sum(x.num_rows for x in held) >= HELD:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks()


def _compared(batches: Iterator[pa.RecordBatch], index: object, most: int, expected: int, files: list[str], q_blocks: int) -> Iterator[pa.RecordBatch]:
    """All rows (cell, vec, ids) of one cell to the best of each of its queries."""
    filled = (b for b in batches if b.num_rows)
    if (first := next(filled, None)) is None:
        return
    block = Block(chain([first], filled), index.value, most, expected)
    for rows in _queries(files, first.column("cell")[0].as_py() % q_blocks, q_blocks):
        yield block.best(rows.column("key").to_numpy(), matrix(rows.column("vec")), rows.column("cut").to_numpy(), rows.column("least").to_numpy())


def _merged(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, scores, ids), those of a key one after another, to one row for each key."""
    held: pa.Table | None = None

    def merged(rows: pa.Table) -> pa.RecordBatch:
        ids, scores = rows.column("ids").combine_chunks(), rows.column("scores").combine_chunks()
        sizes = np.diff(flat_ids(ids)[0])
        return best_rows(np.repeat(rows.column("key").to_numpy(), sizes), scores.flatten().to_numpy(), ids.flatten().to_numpy(), most)

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows]).combine_chunks()
        key = held.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if last:
            yield merged(held.slice(0, last).combine_chunks())
            held = held.slice(last)
    if held is not None and held.num_rows:
        yield merged(held.combine_chunks())


def takes_part(vec: Column, kind: str) -> Column:
    # a vector with a null neither holds NaN nor doesn't; NaN is the greatest
    most, least, limit = F.array_max(vec), F.array_min(vec), F.lit(float("inf"))
    return F.coalesce(~F.array_contains(vec, F.lit(float("nan")).cast(kind)) & (most < limit) & (least > -limit) & ((most > 0) | (least < 0)), F.lit(False))


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 20) -> DataFrame:
    """``top`` nearest of ``vectors(vec_id, embedding)`` to each of ``queries`` (same columns), but for rows of the query's own id: (query_id, rank, vec_id, score)."""
    spark = vectors.sparkSession
    kind = "double" if "double" in vectors.schema["embedding"].dataType.simpleString() else "float"
    sound = lambda rows: rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vec")).where("vec_id is not null").where(takes_part(F.col("vec"), kind))
    marked = sound(vectors).select(F.xxhash64("vec").alias("mark"), "vec").mapInArrow(_sizes, "mark long, size int, square double")
    lengths = marked.groupBy("size").agg(F.count("*").alias("n"), F.approx_count_distinct("mark").alias("unlike"), F.max("square").alias("square")).orderBy(F.desc("n"), F.desc("size")).first()
    answers = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], answers)
    size, most = lengths["size"], top + 1
    own = lambda rows: sound(rows).where(F.size("vec") == size)
    collapsed = own(vectors).mapInArrow(lambda it: _collapsed(it, most), f"vec array<{kind}>, ids array<long>")
    # a key for each vector: several may share their ids
    asked = materialise(own(queries).select("vec").distinct().select(F.monotonically_increasing_id().alias("key"), "vec"), "query-vectors")

    wanted = max(1, min(SAMPLE, SAMPLE_BYTES // (4 * size)))
    chosen = own(vectors).where(F.pmod(F.xxhash64("vec"), F.lit(max(1, lengths["unlike"]))) < wanted).groupBy("vec").agg(F.min("vec_id").alias("id")).limit(2 * wanted).toArrow()
    ids = chosen.column("id").to_numpy()
    order = np.argsort(ids, kind="stable")
    sample = matrix(chosen.column("vec"))[order]
    greatest = float(np.sqrt(lengths["square"]))
    index = fitted(sample, greatest) if len(sample) else Index(np.zeros((1, size + 1)), greatest)
    once = np.unique(ids[order], return_index=True)[1]
    index.guess = sample[once[np.linspace(0, len(once) - 1, min(GUESS, len(once))).astype(np.int64)]]

    trials = asked.orderBy(F.xxhash64("vec"), "key").limit(TRIALS).select("vec").toArrow()
    if not trials.num_rows:
        return spark.createDataFrame([], answers)
    trial = matrix(trials.column("vec"))
    shared = spark.sparkContext.broadcast(index)
    true = collapsed.mapInArrow(lambda it: _neighbours(it, shared, trial, most), "q int, score double, id long, equal boolean, lists array<int>")
    true = true.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id", "equal", "lists"))), 1, most).alias("best")).collect()
    # but for the query's own row
    near = [(r["q"], x["lists"]) for r in true for k, x in enumerate(r["best"]) if k != next((k for k, y in enumerate(r["best"]) if y["equal"]), top)]
    index.ratio = least_ratio(index, trial, np.array([q for q, _ in near], np.int64), [np.array(x) for _, x in near])
    last = np.full(len(trial), np.nan)
    for r in true:
        if len(r["best"]) == most:
            last[r["q"]] = -r["best"][-1]["minus"]
    index.learn_bounds(trial, most, last)
    fitted_index = spark.sparkContext.broadcast(index)

    cores, n_bytes = spark.sparkContext.defaultParallelism, lengths["n"] * size * (8 if kind == "double" else 4)

    def found(asking: DataFrame, every: bool) -> DataFrame:
        """The best of each query: (key, scores, ids)."""
        bounded = materialise(asking.mapInArrow(lambda it: _bounded(it, fitted_index, most, every), f"key long, vec array<{kind}>, cut double, least double"), "bounded-queries")
        files, n_asking = bounded.inputFiles(), asking.count()
        v_blocks = -(-n_bytes // BLOCK_BYTES)
        v_blocks = -(-v_blocks // cores) * cores if v_blocks > cores else v_blocks
        # each block of queries moves all rows again, each block of rows another list for each query
        moved = lambda v: -(-TASKS * cores // v) * n_bytes + v * n_asking * most * 16
        v_blocks = min(range(v_blocks, max(v_blocks, TASKS * cores) + 1), key=moved)
        q_blocks = min(-(-TASKS * cores // v_blocks), n_asking)
        parts = F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
        rows = collapsed.withColumn("q", parts).select((F.pmod(F.xxhash64("vec"), F.lit(v_blocks)) * q_blocks + F.col("q")).cast("int").alias("cell"), "vec", "ids")
        expected = int(1.05 * lengths["n"] / v_blocks) + 2 * SHORT
        best = "key long, scores array<double>, ids array<long>"
        compared = rows.repartitionById(v_blocks * q_blocks, F.col("cell")).mapInArrow(lambda it: _compared(it, fitted_index, most, expected, files, q_blocks), best)
        return compared.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _merged(it, most), best)

    best = materialise(found(asked, False), "best")
    if np.isfinite(index.ratio):
        full = best.where(F.size("ids") == most).select("key")
        short = asked.join(full, "key", "left_anti")
        if not short.isEmpty():
            best = best.join(full, "key", "left_semi").unionByName(found(short, True))
    best = best.select("key", F.arrays_zip(F.transform("scores", lambda x: -x).alias("minus"), F.col("ids").alias("vec_id")).alias("best"))

    asking = own(queries).join(asked, "vec").select(F.col("vec_id").alias("query_id"), "key").distinct()
    others = asking.join(best, "key").select("query_id", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, top).alias("best"))
    # an id with several vectors has several answers: the best of each other id counts
    merged = others.groupBy("query_id").agg(F.flatten(F.collect_list("best")).alias("best")).select("query_id", F.array_sort("best").alias("best"))
    once = F.filter("best", lambda x, k: ~F.array_contains(F.transform(F.slice("best", F.lit(1), k), lambda y: y["vec_id"]), x["vec_id"]))
    return merged.select("query_id", F.posexplode(F.slice(once, 1, top)).alias("place", "x")).select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))


def op13_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all ``embeddings`` to each row whose vec_id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
