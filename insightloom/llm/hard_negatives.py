"""Operator 13: hard negatives by a dual-tree search.

A binary tree of split planes is fitted on a bounded sample; every row descends
it.  Anchors and candidates each have a tree of balls over these planes: a
node's centre is the sample's, its radius covers all rows that came there, and
below the leaves stand blocks of rows with centres of their own.  For two nodes
every inner product lies within

    cA.cC -+ (rA |cC| + rC |cA| + rA rC)

and a pair of nodes whose interval misses all that the anchors below still ask
for is dropped with everything under it: a whole group of anchors at once.
Pairs of blocks that remain are scored exactly, in whole numbers.

An anchor's questions are score ranges: first "the 5 best of my label", later
one range for each positive.  Each search has two passes: anchors meet the
candidates of their own leaf, which raises the lower ends of the ranges to the
k-th best found; then both trees are descended together for the rest.

Sizes: the trees have at most 2**8 and 2**10 leaves, so a descent is a bounded
task whatever the table's size; for positives there is one descent a label.
A leaf with a third of all rows becomes many blocks, and pairs of blocks are
joined with their vectors on block numbers, which are even.

Defined results: rows with a null label, vectors that are null, hold null or
non-finite components, or are longer than 2**27.5 after scaling take no part;
shorter vectors count as filled up with zeros.  Repeated rows are rows of their
own.  Null ids are no anchors, and stand last among equal scores.  Fewer than
asked: all.  A positive of negative score has no negatives (its range is empty).
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .common import discard, materialise, pack, partitions, unpack

LOW, HIGH = -(1 << 62), 1 << 62

BLOCK = "block long, g long, path int, center binary, radius double, radii array<double>, lo long, hi long, blob binary"


class Tree:
    """Split planes and node centres; level l has 2**l nodes, and the children
    of node p are 2p and 2p + 1."""

    def __init__(self, x: np.ndarray, depth: int):
        x = x.astype(np.float64)
        at = np.zeros(len(x), dtype=np.int64)
        self.centers, self.planes, self.offsets = [x.mean(axis=0, keepdims=True)], [], []
        for level in range(depth):
            n = 1 << level
            plane, offset, center = np.zeros((n, x.shape[1])), np.zeros(n), np.repeat(self.centers[-1], 2, axis=0)
            below = 2 * at
            for p in range(n):
                own = np.flatnonzero(at == p)
                if len(own) < 2:
                    continue
                part = x[own]
                # across the two rows that are far apart
                a = part[np.argmax(((part - part[0]) ** 2).sum(axis=1))]
                b = part[np.argmax(((part - a) ** 2).sum(axis=1))]
                w = b - a
                to = part @ w
                t = np.median(to)
                right = to > t
                if not right.any():
                    continue
                plane[p], offset[p] = w, t
                below[own] += right
                center[2 * p], center[2 * p + 1] = part[~right].mean(axis=0), part[right].mean(axis=0)
            at = below
            self.planes.append(plane)
            self.offsets.append(offset)
            self.centers.append(center)
        self.depth, self.dim = depth, x.shape[1]

    def descend(self, x: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Each row's node at ``depth``, and where it lies along the last plane."""
        f, at, along = x.astype(np.float64), np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
        for level in range(depth):
            along = np.einsum("ij,ij->i", f, self.planes[level][at])
            at, along = 2 * at + (along > self.offsets[level][at]), along - self.offsets[level][at]
        return at, along


def _place(tree: Tree, depth: int, names: list[str]):
    def run(batches):
        for b in batches:
            path, along = tree.descend(vectors.matrix(b.column("v"), tree.dim), depth)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(path, pa.int32()), pa.array(along)], names=[*names, "path", "along"])

    return run


def _cut(tree: Tree, depth: int, size: int):
    """Rows (row, vec_id, label, v, g, asks, path, along) in order -> blocks."""

    def run(batches):
        number = itertools.count(TaskContext.get().partitionId() << 33)
        for b in batches:
            if not b.num_rows:
                continue
            g, path, row, label = (b.column(c).to_numpy(zero_copy_only=False) for c in ("g", "path", "row", "label"))
            vec_id, null = vectors.ids(b.column("vec_id"))
            x = vectors.matrix(b.column("v"), tree.dim)
            asks = b.column("asks").to_pylist()
            edge = np.flatnonzero((np.diff(g) != 0) | (np.diff(path) != 0)) + 1
            out = []
            for i, j in zip([0, *edge.tolist()], [*edge.tolist(), len(g)], strict=True):
                for k in range(i, j, size):
                    m = min(j, k + size)
                    part = x[k:m].astype(np.float64)
                    center = part.mean(axis=0)
                    radii = [float(np.sqrt(((part - tree.centers[d][path[k] >> (depth - d)]) ** 2).sum(axis=1).max())) for d in range(depth + 1)]
                    told = np.array([(n, a["ask"], a["lo"], a["hi"]) for n, some in enumerate(asks[k:m]) for a in some or ()], dtype=np.int64).reshape(-1, 4)
                    ends = (int(told[:, 2].min()), int(told[:, 3].max())) if len(told) else (HIGH, LOW)
                    blob = pack(row[k:m], vec_id[k:m], null[k:m], label[k:m].astype(np.int64), told, vectors.narrow(x[k:m]))
                    out.append((next(number), int(g[k]), int(path[k]), center.tobytes(), float(np.sqrt(((part - center) ** 2).sum(axis=1).max())), radii, *ends, blob))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.float64(), pa.list_(pa.float64()), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["block", "g", "path", "center", "radius", "radii", "lo", "hi", "blob"])

    return run


def _blocks(rows: DataFrame, tree: Tree, depth: int, size: int, name: str) -> DataFrame:
    """rows (row, vec_id, label, v, g, asks) -> table of blocks, the rows of a
    leaf beside each other along its last plane."""
    cols = ["row", "vec_id", "label", "v", "g", "asks"]
    kinds = "row long, vec_id long, label long, v array<long>, g long, asks array<struct<ask:int,lo:long,hi:long>>"
    placed = rows.select(*cols).mapInArrow(_place(tree, depth, cols), f"{kinds}, path int, along double")
    order = ("g", "path", "along", "row")
    return materialise(placed.repartitionByRange(partitions(rows, 16), *order).sortWithinPartitions(*order).mapInArrow(_cut(tree, depth, size), BLOCK), name)


def _nodes(blocks: DataFrame, depth: int) -> DataFrame:
    """(g, level, node, radius, lo, hi) of every node that has rows."""
    each = blocks.select("g", "path", "lo", "hi", F.posexplode("radii").alias("level", "radius"))
    return each.groupBy("g", "level", F.expr(f"shiftright(path, {depth} - level)").alias("node")).agg(F.max("radius").alias("radius"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _interval(ca, ra, cc, rc):
    """Least and largest inner product of two balls, line by line, with slack
    for rounding."""
    na, nc = np.sqrt((ca * ca).sum(axis=-1)), np.sqrt((cc * cc).sum(axis=-1))
    mid, half = (ca * cc).sum(axis=-1), ra * nc + rc * na + ra * rc
    half = half + 1e-9 * (1 + (na + ra) * (nc + rc))
    return mid - half, mid + half


def _descend_both(tree: Tree, deep_a: int, deep_c: int):
    """Nodes of both trees of one group -> pairs of leaves that may hold an
    answer, without those of one leaf (the first pass had them)."""

    def run(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(c):
            return pd.DataFrame({"g": [], "a_path": [], "c_path": []}).astype({"g": "int64", "a_path": "int32", "c_path": "int32"})
        g = int(a["g"].iloc[0])

        def by_level(t, depth, lo_hi):
            radius = [np.full(1 << d, -1.0) for d in range(depth + 1)]
            ends = [(np.full(1 << d, HIGH), np.full(1 << d, LOW)) for d in range(depth + 1)]
            for level, part in t.groupby("level"):
                at = part["node"].to_numpy()
                radius[level][at] = part["radius"].to_numpy()
                if lo_hi:
                    ends[level][0][at], ends[level][1][at] = part["lo"].to_numpy(), part["hi"].to_numpy()
            return radius, ends

        ra, ends = by_level(a, deep_a, True)
        rc, _ = by_level(c, deep_c, False)
        i = j = 0
        left = right = np.zeros(1, dtype=np.int64)
        while True:
            keep = (ra[i][left] >= 0) & (rc[j][right] >= 0)
            left, right = left[keep], right[keep]
            ca, cc = tree.centers[i], tree.centers[j]
            na, nc = np.sqrt((ca * ca).sum(axis=1))[left], np.sqrt((cc * cc).sum(axis=1))[right]
            one, two = ra[i][left], rc[j][right]
            half = one * nc + two * na + one * two
            half = half + 1e-9 * (1 + (na + one) * (nc + two))
            mid = (ca @ cc.T)[left, right]
            keep = (mid + half >= ends[i][0][left]) & (mid - half <= ends[i][1][left])
            left, right = left[keep], right[keep]
            if i == deep_a and j == deep_c:
                break
            if i < deep_a and (j == deep_c or i * deep_c <= j * deep_a):
                left, right, i = np.concatenate([2 * left, 2 * left + 1]), np.concatenate([right, right]), i + 1
            else:
                left, right, j = np.concatenate([left, left]), np.concatenate([2 * right, 2 * right + 1]), j + 1
        apart = right >> (deep_c - deep_a) != left
        left, right = left[apart], right[apart]
        return pd.DataFrame({"g": np.full(len(left), g), "a_path": left.astype(np.int32), "c_path": right.astype(np.int32)})

    return run


def _balls_meet(dim: int):
    """Pairs of blocks whose interval meets what the anchors of the one ask."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ca, cc = (np.frombuffer(b"".join(b.column(c).to_pylist())).reshape(-1, dim) for c in ("a_center", "c_center"))
            low, high = _interval(ca, b.column("a_radius").to_numpy(), cc, b.column("c_radius").to_numpy())
            keep = (high >= b.column("lo").to_numpy()) & (low <= b.column("hi").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(b.column(c).to_numpy()[keep]) for c in ("a_block", "c_block")], names=["a_block", "c_block"])

    return run


def _score(dim: int, k: int, same: bool):
    def run(batches):
        for b in batches:
            for one, two in zip(b.column("a_blob").to_pylist(), b.column("c_blob").to_pylist(), strict=True):
                a_row, _, _, a_label, told, ax = unpack(one, "<i8", "<i8", "u1", "<i8", "<i8", "u1")
                row, vec_id, null, label, _, cx = unpack(two, "<i8", "<i8", "u1", "<i8", "<i8", "u1")
                told = told.reshape(-1, 4)
                if not len(told):
                    continue
                s = vectors.products(vectors.widened(ax, len(a_row), dim), vectors.widened(cx, len(row), dim))
                who = told[:, 0]
                allowed = (a_label[:, None] == label[None]) == same
                allowed &= a_row[:, None] != row[None]
                s = s[who]
                line, col = vectors.best_of(who, s, allowed[who] & (s >= told[:, 2:3]) & (s <= told[:, 3:4]), vec_id, null, k)
                if len(line):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a_row[who[line]]), pa.array(told[line, 1].astype(np.int32)), pa.array(row[col]), pa.array(vec_id[col], mask=null[col] == 1), pa.array(s[line, col])], names=["a_row", "ask", "row", "vec_id", "score"]
                    )

    return run


FOUND = "a_row long, ask int, row long, vec_id long, score long"


def _scored(pairs: DataFrame, a: DataFrame, c: DataFrame, tree: Tree, k: int, same: bool) -> DataFrame:
    """pairs (g, a_path, c_path) of leaves -> best rows of each question."""
    from_a = a.select("g", F.col("path").alias("a_path"), F.col("block").alias("a_block"), F.col("center").alias("a_center"), F.col("radius").alias("a_radius"), "lo", "hi")
    from_c = c.select("g", F.col("path").alias("c_path"), F.col("block").alias("c_block"), F.col("center").alias("c_center"), F.col("radius").alias("c_radius"))
    met = pairs.join(from_a, ["g", "a_path"]).join(from_c, ["g", "c_path"]).mapInArrow(_balls_meet(tree.dim), "a_block long, c_block long")
    # anchors go to the pairs first; the candidates' vectors, the most, move once
    with_a = met.join(a.select(F.col("block").alias("a_block"), F.col("blob").alias("a_blob")), "a_block")
    return with_a.join(c.select(F.col("block").alias("c_block"), F.col("blob").alias("c_blob")), "c_block").mapInArrow(_score(tree.dim, k, same), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("a_row", "ask").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def best_in_ranges(anchors: DataFrame, candidates: DataFrame, tree: Tree, deep_a: int, deep_c: int, k: int, same: bool, a_block: int, c_block: int) -> DataFrame:
    """anchors (row, vec_id, label, v, asks), candidates (row, vec_id, label, v)
    -> (a_row, ask, row, vec_id, score, rank): for each question (ask, lo, hi)
    of an anchor the k best candidates of its label (``same``) or of other
    labels with a score from lo to hi."""
    g = F.col("label") if same else F.lit(0).cast("long")
    c = _blocks(candidates.withColumns({"g": g, "asks": F.lit(None).cast("array<struct<ask:int,lo:long,hi:long>>")}), tree, deep_c, c_block, "candidates")
    a = _blocks(anchors.withColumn("g", g), tree, deep_a, a_block, "anchors")
    own = a.select("g", F.col("path").alias("a_path")).distinct().join(c.select("g", F.col("path").alias("c_path"), F.expr(f"shiftright(path, {deep_c - deep_a})").alias("a_path")).distinct(), ["g", "a_path"])
    near = materialise(_best(_scored(own, a, c, tree, k, same), k), "near")

    # the k-th best so far is the least that is still of use
    kth = near.where(F.col("rank") == k).groupBy("a_row").agg(F.map_from_entries(F.collect_list(F.struct("ask", "score"))).alias("kth"))  # one entry a question
    raised = anchors.join(kth, anchors["row"] == kth["a_row"], "left").drop("a_row").withColumn("asks", F.transform("asks", lambda q: F.struct(q["ask"].alias("ask"), F.greatest(q["lo"], F.try_element_at("kth", q["ask"])).alias("lo"), q["hi"].alias("hi")))).drop("kth")
    a2 = _blocks(raised.withColumn("g", g), tree, deep_a, a_block, "anchors")
    pairs = _nodes(a2, deep_a).groupBy("g").cogroup(_nodes(c, deep_c).groupBy("g")).applyInPandas(_descend_both(tree, deep_a, deep_c), "g long, a_path int, c_path int")
    out = materialise(_best(near.drop("rank").unionByName(_scored(pairs, a2, c, tree, k, same)), k), "best")
    discard(a, a2, c, near)
    return out


def _depth(n: int, leaf: int, most: int) -> int:
    return max(0, min(most, (max(1, n) // leaf).bit_length() - 1))


def mine(table: DataFrame, anchors: Column, label: Column, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, a_block: int = 256, c_block: int = 512) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score): for each row that ``anchors`` holds for and each of its
    ``positives`` best rows of the same label, the ``negatives`` best rows of
    other labels with least * p <= 100 * score <= most * p, p the positive's
    score (least and most in percent)."""
    spark = table.sparkSession
    rows = vectors.integers(table.where(label.isNotNull()), id_col, vector_col, scale, label=label.cast("long"), asked=F.coalesce(anchors, F.lit(False)))
    some, dim, _ = vectors.sample(rows)
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not len(some):
        return empty
    n, n_asked = rows.agg(F.count("*"), F.count_if("asked")).first()
    deep_c = _depth(n, c_block, 10)
    deep_a = min(deep_c, _depth(n_asked, a_block, 8))
    tree = Tree(some, deep_c)
    asked, all_rows = rows.where("asked").drop("asked"), rows.drop("asked")
    whole = F.array(F.struct(F.lit(0).alias("ask"), F.lit(LOW).cast("long").alias("lo"), F.lit(HIGH).cast("long").alias("hi")))
    found = best_in_ranges(asked.withColumn("asks", whole), all_rows, tree, deep_a, deep_c, positives, True, a_block, c_block)

    p = F.col("score")
    low = F.expr(f"{least} * score div 100 + if({least} * score % 100 > 0, 1, 0)")
    high = F.expr(f"({most} * score - pmod({most} * score, 100)) div 100")
    ranges = found.select("a_row", F.col("rank").alias("ask"), F.col("vec_id").alias("positive_id"), p.alias("positive_score"), low.alias("lo"), high.alias("hi"))
    asks = ranges.where("lo <= hi").groupBy("a_row").agg(F.collect_list(F.struct("ask", "lo", "hi")).alias("asks"))  # at most ``positives``
    ready = materialise(asked.join(asks, asked["row"] == asks["a_row"]).drop("a_row"), "ranges")
    against = best_in_ranges(ready, all_rows, tree, deep_a, deep_c, negatives, False, a_block, c_block)
    names = asked.select(F.col("row").alias("a_row"), F.col("vec_id").alias("anchor_id"))
    of = against.select("a_row", "ask", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = of.join(ranges.drop("lo", "hi"), ["a_row", "ask"]).join(names, "a_row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
