"""Operator 11: exact top-k search by inner product with a pivot-distance index.

Largest inner products are nearest neighbours once every vector x gets one more
component, sqrt(M**2 - |x|**2) with M the largest norm, and a query a zero:
|q' - x'|**2 = |q|**2 + M**2 - 2 q.x.  In that space each vector is keyed by its
nearest pivot and its distance to it; the distances of a pivot are cut into
annuli of similar size, stored as sorted blocks.

A query's annuli are ranked by the least distance that the triangle inequality
allows, max(0, low - d, d - high) with d its distance to the pivot.  Rounds
expand them in that order, a few first, then four times as many; after each
round the k-th best score bounds the distance of what can still enter, and
annuli and blocks beyond it are never opened.  A query stops when none is left.
Scores are whole numbers; distances only decide what is opened, with some slack
for rounding, so results are exact.

Sizes: pivots and annuli are at most ``pivots`` and ``pivots * most_rings``,
whatever the table's size, and so is the directory that reaches the driver.
Blocks hold at most ``block`` vectors, so a pivot with a third of all rows, or
one vector repeated without end, becomes many blocks over many tasks.  Queries
travel in packs of at most ``block``.

Defined results: vectors that are null, hold null or non-finite components, or
are longer than 2**27.5 after scaling take no part; shorter vectors count as
filled up with zeros.  Repeated rows are rows of their own: each is a query and
a candidate of the others.  A null id is never a query but may be found, after
equal scores with an id.  Fewer than k candidates: all.  No rows, no result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .common import discard, materialise, pack, partitions, unpack

BLOCK = "ring int, low double, high double, n int, blob binary"


def choose_pivots(x: np.ndarray, extra: np.ndarray, most: int, steps: int = 6) -> np.ndarray:
    """Centres of a bounded sample in the widened space, by a few k-means steps."""
    y = np.column_stack([x.astype(np.float64), extra])
    n = max(1, min(most, len(y) // 8))
    centre = y[np.linspace(0, len(y) - 1, n).astype(int)].copy()
    for _ in range(steps):
        near = np.argmin(_distances(y, centre), axis=1)
        for p in range(n):
            if (own := near == p).any():
                centre[p] = y[own].mean(axis=0)
    return centre


def _distances(y: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", y, y)[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None] - 2 * (y @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


class Space:
    """The widened space: pivots, the largest squared norm, and the slack of
    distances computed in doubles."""

    def __init__(self, pivots: np.ndarray, top: float):
        self.pivots, self.top, self.dim = pivots, top, pivots.shape[1] - 1
        self.slack = 1e-6 * (1 + np.sqrt(top))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        f = x.astype(np.float64)
        return _distances(np.column_stack([f, np.sqrt(np.maximum(self.top - np.einsum("ij,ij->i", f, f), 0))]), self.pivots)

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return _distances(np.column_stack([q.astype(np.float64), np.zeros(len(q))]), self.pivots)

    def reach(self, q: np.ndarray, least: np.ndarray, bounded: np.ndarray) -> np.ndarray:
        """Distance that a row of score ``least`` has; infinite where not bounded."""
        f = q.astype(np.float64)
        square = np.einsum("ij,ij->i", f, f) + self.top - 2 * least.astype(np.float64)
        return np.where(bounded, np.sqrt(np.maximum(square, 0)) + self.slack, np.inf)


class Rings:
    """Annuli by number: pivot, least and largest distance of their rows."""

    def __init__(self, pivot: np.ndarray, low: np.ndarray, high: np.ndarray, number: np.ndarray):
        self.pivot, self.low, self.high, self.number = pivot, low, high, number

    def bounds(self, d: np.ndarray) -> np.ndarray:
        """Least possible distance of each query (its distances to the pivots
        are a line of ``d``) to each annulus."""
        own = d[:, self.pivot]
        return np.maximum(0, np.maximum(self.low - own, own - self.high))


def _key(space: Space):
    def run(batches):
        for b in batches:
            d = space.of_rows(vectors.matrix(b.column("v"), space.dim))
            p = np.argmin(d, axis=1)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("asks"), b.column("v"), pa.array(p, pa.int32()), pa.array(d[np.arange(len(p)), p])], names=["row", "vec_id", "asks", "v", "pivot", "dist"])

    return run


def _cut(cuts: dict[int, np.ndarray], first: dict[int, int], dim: int, block: int):
    """Rows sorted by pivot and distance -> blocks of one annulus."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            p, d = b.column("pivot").to_numpy(), b.column("dist").to_numpy()
            ring = np.empty(len(p), dtype=np.int64)
            for one in np.unique(p).tolist():
                own = p == one
                ring[own] = first[one] + np.searchsorted(cuts[one], d[own], side="right")
            x, row = vectors.matrix(b.column("v"), dim), b.column("row").to_numpy()
            vec_id, null = vectors.ids(b.column("vec_id"))
            edge = np.flatnonzero(np.diff(ring)) + 1
            out = []
            for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(ring)], strict=True):
                for k in range(i, j, block):
                    m = min(j, k + block)
                    out.append((int(ring[k]), d[k], d[m - 1], m - k, pack(row[k:m], vec_id[k:m], null[k:m], vectors.narrow(x[k:m]))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary()), strict=True)], names=["ring", "low", "high", "n", "blob"])

    return run


def _expand(space: Space, rings: Rings, start: int, stop: int, block: int):
    """Queries (row, vec_id, v, least) -> packs for the annuli ranked from
    ``start`` to ``stop`` that may hold a better row."""

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, block):
                b = whole.slice(i, block)
                q, row = vectors.matrix(b.column("v"), space.dim), b.column("row").to_numpy()
                vec_id, _ = vectors.ids(b.column("vec_id"))
                least, open_ = vectors.ids(b.column("least"))
                bound = rings.bounds(space.of_queries(q))
                order = np.argsort(bound, axis=1, kind="stable")[:, start:stop]
                near = np.take_along_axis(bound, order, axis=1) <= space.reach(q, least, open_ == 0)[:, None]
                line, place = np.nonzero(near)
                ring = order[line, place]
                by = np.argsort(ring, kind="stable")
                line, ring = line[by], ring[by]
                edge = np.flatnonzero(np.diff(ring)) + 1
                names, blobs = [], []
                for a, z in zip([0, *edge.tolist()], [*edge.tolist(), len(ring)], strict=True):
                    if z > a:
                        own = line[a:z]
                        names.append(int(rings.number[ring[a]]))
                        blobs.append(pack(row[own], vec_id[own], least[own], open_[own], vectors.narrow(q[own])))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], names=["ring", "pack"])

    return run


def _score(space: Space, pivot_of: dict[int, int], k: int):
    """Packs joined with the blocks of their annulus -> each query's best rows."""

    def run(batches):
        for b in batches:
            for ring, low, high, n, blob, told in zip(*(b.column(c).to_pylist() for c in ("ring", "low", "high", "n", "blob", "pack")), strict=True):
                q_row, q_id, least, open_, q = unpack(told, "<i8", "<i8", "<i8", "u1", "u1")
                q = vectors.widened(q, len(q_row), space.dim)
                d = space.of_queries(q)[:, pivot_of[ring]]
                near = np.maximum(0, np.maximum(low - d, d - high)) <= space.reach(q, least, open_ == 0)  # the block is narrower than its annulus
                if not near.any():
                    continue
                q, q_row, q_id, least, open_ = q[near], q_row[near], q_id[near], least[near], open_[near]
                row, vec_id, null, x = unpack(blob, "<i8", "<i8", "u1", "u1")
                s = vectors.products(q, vectors.widened(x, n, space.dim))
                ok = (row[None] != q_row[:, None]) & ((s >= least[:, None]) | (open_ == 1)[:, None])
                line, col = vectors.best_of(q_row, s, ok, vec_id, null, k)
                if len(line):
                    yield pa.RecordBatch.from_arrays([pa.array(q_row[line]), pa.array(q_id[line]), pa.array(row[col]), pa.array(vec_id[col], mask=null[col] == 1), pa.array(s[line, col])], names=["row", "query_id", "other", "vec_id", "score"])

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(table: DataFrame, queries: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = 64, most_rings: int = 64, block: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the largest integer inner
    product with each row that ``queries`` holds for."""
    spark = table.sparkSession
    rows = vectors.integers(table, id_col, vector_col, scale, asks=F.coalesce(queries, F.lit(False)))
    some, dim, top = vectors.sample(rows)
    if not len(some):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    square = np.einsum("ij,ij->i", some.astype(np.float64), some.astype(np.float64))
    space = Space(choose_pivots(some, np.sqrt(np.maximum(top - square, 0)), pivots), top)
    keyed = materialise(rows.mapInArrow(_key(space), "row long, vec_id long, asks boolean, v array<long>, pivot int, dist double"), "keyed")
    discard(rows)

    # annuli of each pivot: at most most_rings, of about a block's rows while there are fewer
    marks = keyed.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("dist", [i / most_rings for i in range(1, most_rings)], 2000).alias("at")).collect()
    cuts, first, upto = {}, {}, 0
    for r in sorted(marks, key=lambda r: r.pivot):
        count = min(most_rings, -(-r.n // block))
        cuts[r.pivot] = np.unique([r["at"][min(most_rings - 2, most_rings * i // count - 1)] for i in range(1, count)])
        first[r.pivot] = upto
        upto += len(cuts[r.pivot]) + 1
    parts = partitions(keyed, 16)
    ordered = keyed.select("pivot", "dist", "row", "vec_id", "v").repartitionByRange(parts, "pivot", "dist", "row").sortWithinPartitions("pivot", "dist", "row")
    blocks = materialise(ordered.mapInArrow(_cut(cuts, first, dim, block), BLOCK), "blocks")
    seen = blocks.groupBy("ring").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("ring").collect()
    number = np.array([r.ring for r in seen], dtype=np.int64)
    starts, owners = np.array(sorted(first.values())), np.array(sorted(first))
    rings = Rings(owners[np.searchsorted(starts, number, side="right") - 1], np.array([r.low for r in seen]), np.array([r.high for r in seen]), number)
    pivot_of = dict(zip(number.tolist(), rings.pivot.tolist(), strict=True))

    asked = materialise(keyed.where("asks").select("row", "vec_id", "v", "pivot", "dist").repartitionByRange("pivot", "dist", "row").sortWithinPartitions("pivot", "dist", "row").drop("pivot", "dist"), "queries")
    discard(keyed)
    best, start, stop = None, 0, 2
    while start < len(number):
        least = None if best is None else best.groupBy("row").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")
        state = asked.withColumn("least", F.lit(None).cast("long")) if least is None else asked.join(least, "row", "left")
        packs = materialise(state.select("row", "vec_id", "v", "least").mapInArrow(_expand(space, rings, start, stop, block), "ring int, pack binary"), "packs")
        if packs.isEmpty():
            discard(packs)
            break
        found = packs.join(blocks, "ring").mapInArrow(_score(space, pivot_of, k), "row long, query_id long, other long, vec_id long, score long")
        old = best
        best = materialise(_merged(found if old is None else old.drop("rank").unionByName(found), k), "best")
        discard(packs, old)
        start, stop = stop, stop * 4
    discard(blocks, asked)
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best.select("query_id", "rank", "vec_id", "score")
