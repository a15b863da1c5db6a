"""Approximate nearest neighbours by inner product, over robust-pruned directed graphs, one for each shard.

Method. Vectors are dealt to shards by a hash of their content, and inside a shard to bands whose norms differ by a factor of
two at most, so that one long vector cannot hide the distances of the others. A band of at most ``EXACT`` vectors is scanned. A
larger one is a graph: it adds one coordinate to its vectors that makes all norms equal, which turns the largest inner product
into the smallest distance (taken from differences, in double precision). It inserts its vectors in batches of doubling size:
a greedy beam search over the graph so far proposes neighbours, and pruning keeps the nearest one and drops all that are
closer to it than to the vector, relaxed by ``ALPHA``, until ``DEGREE`` diverse edges remain; reverse edges are added
and pruned alike. Every query runs a beam search in every shard, longest band first, and leaves out only bands whose norm is too
small to reach its results so far; found vectors are scored anew in double
precision from the original numbers, and the best of all shards are kept.

Scale. A shard holds at most about ``SHARD_ROWS`` distinct vectors, so a task's memory is bounded; the number of shards grows
beyond that. Queries reach a shard as a sorted stream after its vectors, never as a whole. Equal vectors are one node that
carries its smallest ids only, as many as a result can show, cut before the shuffle, so a vector that a third of all rows
share takes no more room than any other.

Rows with a null id, and vectors that are null, empty, zero or hold a null or non-finite number, take no part. Vectors meet only
those of their own length. Of different vectors with one id all are candidates, and the smallest is the query. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEGREE, ALPHA = 32, 1.2
#: vectors kept by a beam search while building and while answering, and how many of them are expanded at once
BUILD_BEAM, QUERY_BEAM, EXPAND = 64, 96, 4
SHARDS, SHARD_ROWS = 12, 100_000
BATCH = 512
#: a band of at most so many vectors is scanned; a beam search would meet nearly all of them
EXACT = 256
#: numbers that a step of the pruning holds, about
CELLS = 1 << 22
#: numbers of vectors that are compared at a time, about: as many as a core's cache holds
NEAR_CELLS = 1 << 15


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def log_norms(vectors: np.ndarray) -> np.ndarray:
    """Binary logarithm of each norm; no square overflows or vanishes."""
    largest = np.abs(vectors).max(1)
    return np.log2(largest) + np.log2(np.linalg.norm(vectors / largest[:, None], axis=1))


def _scaled(vectors: np.ndarray, power: int | np.ndarray) -> np.ndarray:
    """The vectors over a power of two, in two steps where one would leave the range of doubles."""
    half = np.floor_divide(power, 2)
    return np.ldexp(np.ldexp(vectors, -half), half - power)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...d,...d->...", d, d)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers of a sorted array, the place of the first of each, and how many there are of each."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return values[first], first, np.diff(first, append=len(values))


class Graph:
    """A directed graph over vectors of similar norm."""

    def __init__(self, vectors: np.ndarray):
        norms = np.einsum("nd,nd->n", vectors, vectors)
        lift = np.sqrt(np.maximum(norms.max() - norms, 0))
        self.x = np.column_stack([vectors, lift]) / np.sqrt(norms.max())
        n = len(vectors)
        self.edges = np.full((n, DEGREE), -1, np.int32)
        self.entry = int(np.argmin(_squared(self.x, self.x.mean(0))))
        order = np.random.default_rng(7).permutation(n)
        order = np.concatenate([[self.entry], order[order != self.entry]])
        done = 1
        while done < n:
            size = min(max(1, done), BATCH, n - done)
            self._insert(order[done : done + size])
            done += size

    def _apart(self, points: np.ndarray, owner: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Distances of pairs, so many at a time that the copied vectors stay in the cache."""
        dist, step = np.empty(len(owner)), max(1, NEAR_CELLS // self.x.shape[1])
        for lo in range(0, len(owner), step):
            dist[lo : lo + step] = _squared(points[owner[lo : lo + step]], self.x[near[lo : lo + step]])
        return dist

    def _distance(self, points: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return _squared(points[:, None], self.x[ids])

    def search(self, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the ``beam`` nearest found for each point, nearest first; -1 and inf where fewer."""
        m = len(points)
        ids, far = np.full((m, beam), -1, np.int64), np.full((m, beam), np.inf)
        open_, seen = np.zeros((m, beam), bool), np.zeros((m, len(self.x)), bool)
        ids[:, 0], open_[:, 0], seen[:, self.entry] = self.entry, True, True
        met = seen.ravel()  # the same bits by owner * len(self.x) + vector
        far[:, 0] = self._distance(points, np.full((m, 1), self.entry))[:, 0]
        active = np.arange(m)
        while len(active):
            rank = np.cumsum(open_[active], axis=1)
            take = open_[active] & (rank <= EXPAND)
            open_[active] &= ~take
            row, col = np.nonzero(take)
            owner = np.repeat(active[row], DEGREE)
            near = self.edges[ids[active[row], col]].ravel().astype(np.int64)
            good = near >= 0
            flat = owner[good] * len(self.x) + near[good]
            flat = _runs(np.sort(flat[~met[flat]]))[0]
            met[flat] = True
            owner, near = np.divmod(flat, len(self.x))
            if len(owner):
                dist = self._apart(points, owner, near)
                rows, first, count = _runs(owner)
                width = int(count.max())
                place = np.arange(len(owner)) - np.repeat(first, count)
                row = np.repeat(np.arange(len(rows)), count)
                new_ids, new_far = np.full((len(rows), width), -1, np.int64), np.full((len(rows), width), np.inf)
                new_ids[row, place], new_far[row, place] = near, dist
                all_far = np.concatenate([far[rows], new_far], 1)
                all_ids = np.concatenate([ids[rows], new_ids], 1)
                all_open = np.concatenate([open_[rows], new_ids >= 0], 1)
                best = np.argsort(all_far, 1, kind="stable")[:, :beam]
                ids[rows], far[rows] = np.take_along_axis(all_ids, best, 1), np.take_along_axis(all_far, best, 1)
                open_[rows] = np.take_along_axis(all_open, best, 1)
            active = active[open_[active].any(1)]
        return ids, far

    def _prune(self, points: np.ndarray, ids: np.ndarray, far: np.ndarray) -> np.ndarray:
        """At most DEGREE diverse neighbours of each point among its candidates (sorted by distance; -1 for none)."""
        out = np.full((len(points), DEGREE), -1, np.int32)
        step = max(1, CELLS // (ids.shape[1] * self.x.shape[1]))
        for lo in range(0, len(points), step):
            own, to, dist = points[lo : lo + step], ids[lo : lo + step], far[lo : lo + step]
            local = self.x[np.maximum(to, 0)] - self.x[own][:, None]  # seen from the point, no digits are lost
            dots = local @ local.transpose(0, 2, 1)
            norms = np.einsum("mkk->mk", dots)
            alive = (to >= 0) & (to != own[:, None])
            rows = np.arange(len(own))
            for k in range(DEGREE):
                rows = rows[alive[rows].any(1)]
                if not len(rows):
                    break
                pick = alive[rows].argmax(1)
                out[lo + rows, k] = to[rows, pick]
                alive[rows, pick] = False
                apart = np.maximum(norms[rows, pick][:, None] + norms[rows] - 2 * dots[rows, pick], 0)
                alive[rows] &= ALPHA * ALPHA * apart >= dist[rows]  # where all distances tie, edges stay
        return out

    def _insert(self, points: np.ndarray) -> None:
        ids, far = self.search(self.x[points], BUILD_BEAM)
        kept = self._prune(points, ids, far)
        self.edges[points] = kept
        to, source = kept.ravel(), np.repeat(points, DEGREE)
        to, source = to[to >= 0].astype(np.int64), source[to >= 0]
        dist = _squared(self.x[to], self.x[source])
        order = np.lexsort((dist, to))
        to, source, dist = to[order], source[order], dist[order]
        nodes, first, count = _runs(to)
        place = np.arange(len(to)) - np.repeat(first, count)
        near = place < DEGREE  # of the new ones, the nearest
        row = np.repeat(np.arange(len(nodes)), count)[near]
        for lo in range(0, len(nodes), 4 * BATCH):
            own = nodes[lo : lo + 4 * BATCH]
            mine = (row >= lo) & (row < lo + len(own))
            new = np.full((len(own), DEGREE), -1, np.int64)
            new[row[mine] - lo, place[near][mine]] = source[near][mine]
            ids = np.concatenate([self.edges[own].astype(np.int64), new], 1)
            full = (ids >= 0).sum(1) > DEGREE
            # those with room take the new edges as they are
            slack = ids[~full]
            side = np.argsort(slack < 0, 1, kind="stable")[:, :DEGREE]
            self.edges[own[~full]] = np.take_along_axis(slack, side, 1)
            if full.any():
                own, ids = own[full], ids[full]
                far = np.where(ids >= 0, self._distance(self.x[own], np.maximum(ids, 0)), np.inf)
                order = np.argsort(far, 1, kind="stable")
                self.edges[own] = self._prune(own, np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class _Band:
    """Vectors of a shard whose norms differ by a factor of two at most: a graph, or all of them if they are few."""

    def __init__(self, members: np.ndarray, vectors: np.ndarray, log_norm: float):
        self.members, self.norm = members, 2.0 ** min(log_norm, 1023)
        x = _scaled(vectors, int(np.ceil(log_norm)))
        self.x, self.graph = (x, None) if len(x) <= EXACT else (None, Graph(x))

    def search(self, points: np.ndarray, top: int) -> list[np.ndarray]:
        """Members near each point (of length one): all that can be among the first ``top``, or those that the graph finds."""
        if self.graph is not None:
            found, _ = self.graph.search(np.column_stack([points, np.zeros(len(points))]), max(QUERY_BEAM, 2 * top))
            return [self.members[ids[ids >= 0]] for ids in found]
        scores = points @ self.x.T
        k = max(len(self.x) - top - 1, 0)  # one more, which may be the query's own
        least = np.partition(scores, k, axis=1)[:, k] - 1e-9
        return [self.members[s >= low] for s, low in zip(scores, least, strict=True)]


class _Shard:
    """Vectors of one (shard, length) as they stream in, then the bands over them."""

    def __init__(self):
        self.vectors, self.ids, self.bands = [], [], None

    def add(self, batch: pa.RecordBatch, width: int) -> None:
        self.vectors.append(_matrix(batch.column("v"), width))
        self.ids += batch.column("ids").to_pylist()

    def _split(self) -> None:
        self.matrix = np.concatenate(self.vectors)
        self.vectors = [self.matrix]
        logs = log_norms(self.matrix)
        number = np.floor(logs.max() - logs).astype(int)
        members = [np.flatnonzero(number == k) for k in np.unique(number)]
        self.bands = [_Band(m, self.matrix[m], float(logs[m].max())) for m in members]

    def answer(self, query_ids: np.ndarray, points: np.ndarray, top: int) -> list[tuple[int, int, float]]:
        if not self.vectors:
            return []
        if self.bands is None:
            self._split()
        logs = log_norms(points)
        lengths = 2.0 ** np.minimum(logs, 1023)
        unit = _scaled(points, np.floor(logs).astype(int)[:, None])
        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
        best = [[] for _ in points]
        for band in self.bands:
            with np.errstate(over="ignore"):
                bound = lengths * band.norm * (1 + 1e-9) + np.finfo(float).tiny  # no vector of the band scores more
            left = [n for n, b in enumerate(best) if len(b) < top or not -b[-1][0] > bound[n]]
            if not left:
                continue
            for n, ids in zip(left, band.search(unit[left], top), strict=True):
                scores = (self.matrix[ids] * points[n]).sum(1)
                new = [(-s, i) for s, k in zip(scores.tolist(), ids.tolist(), strict=True) for i in self.ids[k] if i != query_ids[n]]
                best[n] = sorted(best[n] + new)[:top]
        return [(int(q), i, -s) for q, found in zip(query_ids, best, strict=True) for s, i in found]


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 20, shards: int = SHARDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` the ``top`` rows of ``vectors`` of the largest inner
    product found, without the query's own id. Both have (vec_id, embedding)."""
    own = lambda df: df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & usable(F.col("v")))
    copies = own(vectors).distinct().withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("n") <= top + 1)
    nodes = copies.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    count = max(shards, -(-nodes.count() // shard_rows))
    nodes = nodes.select(F.pmod(F.xxhash64("v"), F.lit(count)).cast("int").alias("shard"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("id"), "ids", "v")
    asked = own(queries).groupBy("id").agg(F.min("v").alias("v")).select(
        F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("shard"), F.lit(1).alias("kind"), "id", F.array().cast("array<long>").alias("ids"), "v"
    )
    rows = nodes.union(asked).withColumn("width", F.size("v"))
    rows = rows.repartitionByRange(count, "shard", "width").sortWithinPartitions("shard", "width", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard = None, _Shard()
        for batch in batches:
            place = np.column_stack([batch.column(c).to_numpy() for c in ("shard", "width", "kind")])
            cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1), len(place)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                part = batch.slice(lo, hi - lo)
                if (now := tuple(place[lo][:2])) != key:
                    key, shard = now, _Shard()
                if place[lo][2] == 0:
                    shard.add(part, int(key[1]))
                    continue
                points, ids = _matrix(part.column("v"), int(key[1])), part.column("id").to_numpy()
                for k in range(0, len(ids), BATCH // 2):
                    found = shard.answer(ids[k : k + BATCH // 2], points[k : k + BATCH // 2], top)
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    found = rows.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
