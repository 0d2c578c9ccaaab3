"""Integer vectors in blocks: what the two exact searches (operators 11 and 13)
share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Rows behind a pivot set or a split tree; the index itself takes every row.
SAMPLE = 4096

#: Squared norms stay below this, so that no product, nor a hundred times it, leaves a long.
MOST_NORM = float(1 << 55)


def integers(df: DataFrame, id_col: str, vector_col: str, scale: int, **more: Column) -> DataFrame:
    """(row, vec_id, *more, v): each component x as floor(scale * x), x as
    double, in a table of its own; ``row`` tells repeated ids apart.  Vectors
    that are null, hold a null or non-finite component, or have a squared
    norm of 2**55 or more after scaling take no part.  Shorter vectors count as
    filled up with zeros."""
    x = F.col(vector_col).cast("array<double>")
    good = F.col(vector_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    rows = df.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), *(c.alias(k) for k, c in more.items()), v.alias("v"))
    small = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double")) < MOST_NORM
    return materialise(rows.where(small).select(F.monotonically_increasing_id().alias("row"), *rows.columns), "vectors")


def sample(rows: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, int, float]:
    """At most ``most`` vectors, chosen by a hash; the longest vector's length
    and the largest squared norm of all rows."""
    size = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    dim, norm = rows.agg(F.max(F.size("v")), F.max(size)).first()
    got = rows.orderBy(F.xxhash64("row"), "row").select("v").limit(most).collect()
    return padded([r.v for r in got], dim or 0), dim or 0, norm or 0.0


def padded(lists: list, dim: int) -> np.ndarray:
    out = np.zeros((len(lists), dim), dtype=np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    """A list column as rows of length ``dim``."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    size = np.diff(at)
    if (size == dim).all():
        return flat.reshape(len(size), dim)
    out = np.zeros((len(size), dim), dtype=np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(at[:-1] - at[0], size)] = flat
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """Half the bytes where the numbers allow it."""
    return x.astype("<i4") if not x.size or np.abs(x).max() < 1 << 31 else x.astype("<i8")


def widened(raw: np.ndarray, n: int, dim: int) -> np.ndarray:
    kind = "<i4" if raw.nbytes == 4 * n * dim else "<i8"
    return raw.view(kind).reshape(n, dim).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of two integer matrices."""
    fa, fb = a.astype(np.float64), b.astype(np.float64)
    most = np.sqrt(np.einsum("ij,ij->i", fa, fa).max(initial=0) * np.einsum("ij,ij->i", fb, fb).max(initial=0))
    if most < 1 << 51:  # every partial sum is a whole number that a double holds
        return (fa @ fb.T).astype(np.int64)
    return a @ b.T


def ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and where they are null."""
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)


def best_of(owner: np.ndarray, score: np.ndarray, ok: np.ndarray, vec_id: np.ndarray, null: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of the k best allowed entries of each line of ``score``:
    higher scores first, ties by smaller id, null ids last."""
    low = np.iinfo(np.int64).min
    held = np.where(ok, score, low)
    if held.shape[1] > k:
        kth = np.partition(held, held.shape[1] - k, axis=1)[:, -k]
        ok = ok & (held >= kth[:, None])
    line, col = np.nonzero(ok)
    order = np.lexsort((vec_id[col], null[col], -held[line, col], line))
    line, col = line[order], col[order]
    place = np.arange(len(line)) - np.searchsorted(line, line, side="left")
    keep = place < k
    return line[keep], col[keep]
