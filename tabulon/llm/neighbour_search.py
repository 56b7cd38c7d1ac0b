"""Nearest neighbours by inner product with collision-counting hashing.

Each vector has one projection on each of many random lines.  On a line, sorted,
a query has a window around its own place; what lies in it is one collision, and
vectors with enough collisions are verified by the exact inner product.  Windows
follow the search radius: they begin narrow and are widened (virtual rehashing:
the same sorted lines, cut wider) until enough neighbours within the radius are
verified; from then on the radius is the distance of the last of them and only
shrinks.  The count needed is calibrated to the recall asked for.

Inner products become distances by one more component: vectors are scaled by
the largest length of their block, and what is missing to length 1 is added.
Blocks are ranges of length, longest first, so that the scale stays near the
vectors' own lengths, and a block whose length times the query's can't beat what
was found is left out.

Equal vectors are one class with its least ids.  Every query meets every class,
in blocks: queries are dealt to groups and classes to shards, both of bounded
size, and a task streams one shard past one group and returns what is best there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.embedding_dedup import colliding_pairs, collisions_needed, projections
from tabulon.plans.lineage import cut

K, LINES, SEED = 20, 48, 11
#: Half-width of a window by the search radius, and the share of vectors at the radius that reach the count.
WINDOW, RECALL = 1.5, 0.98
#: First radius, by the length of a unit vector, and how much each rehashing widens it; no two unit vectors are more than 2 apart.
RADIUS, WIDER, FARTHEST = 0.6, 1.25, 2.0
#: Queries of a group, vectors compared at once (fewer while radii are sought) and the number of shards by the number of classes.
GROUP, BLOCK, BEGIN, SHARD = 512, 1024, 256, 400
#: Most partitions that the tasks are dealt to; one may hold several tasks, one after the other.
PARTITIONS = 20_000
#: Id lists that a task keeps before it drops those out of use.
KEPT = 1 << 16


def sound(vec: Column) -> Column:
    """Whether a vector is neither null, empty nor zero and has finite components only."""
    finite = F.forall(vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vec, lambda c: c != 0), F.lit(False))


class Search:
    """What a group of queries has found in the vectors of one length streamed past it so far."""

    def __init__(self, dim: int, k: int, lines: int, recall: float):
        self.k, self.lines, self.need = k, lines, collisions_needed(lines, WINDOW, recall)
        self.asked: list[tuple[np.ndarray, np.ndarray]] = []
        self.own: np.ndarray | None = None
        self.waiting: list[tuple[np.ndarray, list]] = []
        # Best classes by query, score (falling) and least id: one row each, as flat arrays; lists of ids by number.
        self.at, self.score, self.first, self.list = (np.zeros(0, t) for t in (np.int64, float, np.int64, np.int64))
        self.lists: list[np.ndarray] = []
        self.size, self.dim = 0, dim

    def ask(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Queries, all of them before the first vector; the first column of ids is what vectors of its own are known by."""
        self.asked.append((ids, vectors))

    def _begin(self) -> None:
        self.own, self.query = (np.concatenate(x) for x in zip(*self.asked, strict=True))
        self.length = np.linalg.norm(self.query, axis=1)
        flat = np.zeros((len(self.query), self.dim + 1))
        flat[:, :-1] = self.query / self.length[:, None]
        self.line = projections(flat, self.lines, SEED)
        self.last = np.full(len(self.query), -np.inf)

    def pass_by(self, vectors: np.ndarray, ids: list) -> None:
        """Vectors, longest first over all calls, and the ids of each."""
        if not self.asked:
            return
        self.waiting.append((vectors, ids))
        self.size += len(ids)
        if self.size >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if not self.waiting:
            return
        if self.own is None:
            self._begin()
        vectors, ids = np.concatenate([v for v, _ in self.waiting]), [x for _, own in self.waiting for x in own]
        self.waiting, self.size = [], 0
        at = 0
        while at < len(ids):
            to = at + (BLOCK if (self.last > -np.inf).all() else min(BEGIN, BLOCK))
            self._block(vectors[at:to], ids[at:to])
            at = to

    def _block(self, x: np.ndarray, ids: list) -> None:
        norm = np.linalg.norm(x, axis=1)
        unit = np.zeros((len(x), self.dim + 1))
        unit[:, :-1] = x / norm.max()
        unit[:, -1] = np.sqrt(np.maximum(0, 1 - (unit[:, :-1] ** 2).sum(axis=1)))
        line, reach = projections(unit, self.lines, SEED), self.length * norm.max()
        base = len(self.lists)
        self.lists += ids
        first = np.array([own[0] for own in ids], np.int64)

        def radius(of: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(0, 2 - 2 * self.last[of] / reach[of])) + 1e-9

        def take(a: np.ndarray, b: np.ndarray) -> None:
            """Verify pairs, which come in order of queries, a query's at a time, and keep the best classes of each."""
            score, edge = np.empty(len(a)), [*(np.flatnonzero(a[1:] != a[:-1]) + 1), len(a)]
            for lo, hi in zip([0, *edge], edge, strict=False):
                if hi > lo:
                    score[lo:hi] = np.einsum("ij,j->i", x[b[lo:hi]], self.query[a[lo]])
            good = score >= self.last[a]
            a, b, score = a[good], b[good], score[good]
            at, value, least, number = (np.concatenate(pair) for pair in ((self.at, a), (self.score, score), (self.first, first[b]), (self.list, base + b)))
            order = np.lexsort((least, -value, at))
            at, value, least, number = at[order], value[order], least[order], number[order]
            best = np.arange(len(at)) - np.searchsorted(at, at) <= self.k
            self.at, self.score, self.first, self.list = at[best], value[best], least[best], number[best]
            full = np.bincount(self.at, minlength=len(self.own)) > self.k
            end = np.searchsorted(self.at, np.arange(len(self.own)), "right") - 1
            self.last[full] = self.score[end[full]]

        full = self.last > -np.inf
        known, waiting = np.flatnonzero(full & (self.last <= reach * (1 + 1e-12))), np.flatnonzero(~full)
        if len(known):
            a, b = colliding_pairs(self.line[known], line, WINDOW * radius(known), self.need)
            take(known[a], b)
        # Wider windows hold all that narrower ones held, so only what is new is verified.
        seen, r = np.zeros((len(self.own) if len(waiting) else 0, len(x)), bool), RADIUS
        while len(waiting):
            if r < FARTHEST:
                a, b = colliding_pairs(self.line[waiting], line, WINDOW * r, self.need)
                a = waiting[a]
            else:
                # Wider than any two unit vectors are apart: all is in the windows.
                a, b = np.repeat(waiting, len(x)), np.tile(np.arange(len(x)), len(waiting))
            new = ~seen[a, b]
            a, b = a[new], b[new]
            seen[a, b] = True
            take(a, b)
            waiting = waiting[~((self.last[waiting] > -np.inf) & (radius(waiting) <= r))] if r < FARTHEST else waiting[:0]
            r *= WIDER
        if len(self.lists) > KEPT:
            used, self.list = np.unique(self.list, return_inverse=True)
            self.lists = [self.lists[u] for u in used]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of the query, vector id, score): the k best of each query, itself left out."""
        self._flush()
        if self.own is None:
            return np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(0)
        many = np.fromiter((len(self.lists[c]) for c in self.list), np.int64, len(self.list))
        row = np.repeat(np.arange(len(self.list)), many)
        ids = np.concatenate([np.zeros(0, np.int64), *(self.lists[c] for c in self.list)])
        at, score = self.at[row], self.score[row]
        other = ids != self.own[at, 0]
        at, score, ids = at[other], score[other], ids[other]
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        best = np.arange(len(at)) - np.searchsorted(at, at) < self.k
        return self.own[at[best]], ids[best], score[best]


def nearest_neighbours(queries: DataFrame, vectors: DataFrame, k: int = K, lines: int = LINES, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of vectors (vec_id, embedding) of largest inner product with each row of queries (the same columns).

    Nearest first, ties to the smaller vec_id; all rows, if there are fewer.  Rows
    that share the query's id are its own and aren't found.  Rows without id and
    vectors that are null, empty or zero or hold null or non-finite components
    take no part; vectors of other lengths than the query's aren't found.  Equal
    rows (id and vector) are one row; different vectors under one id are each
    found, and as queries each have ranks of their own.  No rows give no rows;
    other columns are left out.
    """

    def rows(of: DataFrame) -> DataFrame:
        vec = F.col("embedding")
        same = of.schema["embedding"].dataType.simpleString() == "array<float>" == vectors.schema["embedding"].dataType.simpleString() == queries.schema["embedding"].dataType.simpleString()
        vec = vec if same else vec.cast("array<double>")
        return of.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & sound(F.col("vec"))).dropDuplicates(["vec_id", "vec"])

    # Of equal vectors no query needs more than its k least ids besides its own.
    least = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    ids = F.array_sort(F.collect_list("vec_id")).alias("ids")
    classes = cut(rows(vectors).withColumn("r", least).where(F.col("r") <= k + 1).groupBy("vec").agg(ids))
    asked = cut(rows(queries))
    groups, shards = math.ceil(asked.count() / GROUP) or 1, math.ceil(math.sqrt(classes.count() / SHARD)) or 1
    double = F.col("vec").cast("array<double>")
    norm = F.sqrt(F.aggregate(double, F.lit(0.0), lambda a, c: a + c * c))

    def dealt(of: DataFrame, side: int, own: tuple[str, int], others: tuple[str, int], by: list[str]) -> DataFrame:
        placed = of.withColumn(own[0], F.pmod(F.xxhash64(*by), F.lit(own[1])).cast("int"))
        placed = placed.withColumn(others[0], F.explode(F.sequence(F.lit(0), F.lit(others[1] - 1))))
        return placed.select("group", "shard", F.size("vec").alias("dim"), F.lit(side).alias("side"), norm.alias("norm"), "ids", "vec")

    # A hash of the vector tells queries that share an id apart.
    asked = dealt(asked.withColumn("ids", F.array("vec_id", F.xxhash64("vec"))), 0, ("group", groups), ("shard", shards), ["ids", "vec"])
    stream = asked.union(dealt(classes, 1, ("shard", shards), ("group", groups), ["vec"]))
    order = ["group", "shard", "dim", "side"]
    stream = stream.repartition(min(groups * shards, PARTITIONS), "group", "shard").sortWithinPartitions(*order, F.desc("norm"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, now = None, None

        def out() -> pa.RecordBatch:
            own, ids, score = search.found()
            return pa.RecordBatch.from_arrays([pa.array(own[:, 0]), pa.array(own[:, 1]), pa.array(ids), pa.array(score)], names=["query_id", "query", "vec_id", "score"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in order])
            edges = [*np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))).tolist(), batch.num_rows] if batch.num_rows else []
            for lo, hi in zip(edges, edges[1:], strict=False):
                task, side = tuple(keys[:3, lo].tolist()), keys[3, lo]
                if task != now:
                    if search is not None:
                        yield out()
                    search, now = Search(task[2], k, lines, recall), task
                part = batch.slice(lo, hi - lo)
                vec = part.column("vec").flatten().to_numpy().astype(float).reshape(hi - lo, task[2])
                lists = part.column("ids")
                if side == 0:
                    search.ask(lists.flatten().to_numpy().reshape(-1, 2), vec)
                else:
                    flat, cuts = lists.flatten().to_numpy(), np.cumsum(np.fromiter(map(len, lists), np.int64, hi - lo))
                    search.pass_by(vec, np.split(flat, cuts[:-1]))
        if search is not None:
            yield out()

    found = stream.select(*order, "ids", "vec").mapInArrow(scan, "query_id long, query long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
