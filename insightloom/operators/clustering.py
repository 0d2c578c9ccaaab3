"""Density clustering of experiment frames and edge weights from clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frames joined by each selector; stand-in for a missing number.
MISSING = -5.0
SELECTORS = {
    "all": ("changed_parameters", "quality", "influences", "changed_parameters_relative", "quality_relative", "influences_relative"),
    "non_relative": ("changed_parameters", "quality", "influences"),
    "all_relative": ("changed_parameters_relative", "quality_relative", "influences_relative"),
    "parameters": ("changed_parameters",), "quality": ("quality",), "influences": ("influences",),
    "parameters_relative": ("changed_parameters_relative",), "quality_relative": ("quality_relative",), "influences_relative": ("influences_relative",),
}


def optics_order(x: np.ndarray, min_samples: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, reachability, core distance) under the Euclidean distance."""
    n = len(x)
    d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T))
    core = np.sort(d, axis=1)[:, min_samples - 1] if n >= min_samples else np.full(n, np.inf)
    reach, done, order = np.full(n, np.inf), np.zeros(n, dtype=bool), []
    for _ in range(n):
        at = int(np.where(done, np.inf, np.where(np.isinf(reach), np.finfo(float).max, reach)).argmin())
        done[at] = True
        order.append(at)
        if np.isfinite(core[at]):
            near = np.maximum(core[at], d[at])
            reach = np.where(done, reach, np.minimum(reach, near))
    return np.array(order), reach, core


def xi_labels(order: np.ndarray, reach: np.ndarray, min_size: int, xi: float = 0.05) -> np.ndarray:
    """Labels from steep drops and rises of the reachability plot: the smallest
    spans that start with a drop and end with a rise of at least xi; -1: none."""
    r = np.append(reach[order], np.inf)
    n = len(order)
    down = [i for i in range(n) if r[i] * (1 - xi) >= r[i + 1]]
    spans = []
    for s in down:
        top = r[s]
        for e in range(s + 1, n):
            if r[e + 1] * (1 - xi) >= max(r[e], np.max(r[s + 1 : e + 1])) and e - s + 1 >= min_size:
                if r[e + 1] >= top * (1 - xi) or np.isinf(r[e + 1]):
                    spans.append((s, e))
                    break
            if r[e + 1] > top:
                break
    label, out = 0, np.full(n, -1)
    for s, e in sorted(spans, key=lambda x: x[1] - x[0]):
        if (out[order[s : e + 1]] == -1).all():
            out[order[s : e + 1]] = label
            label += 1
    return out


def cluster(features: DataFrame, min_samples: int = 5, by: str | None = None, id_col: str = "exp_id") -> DataFrame:
    """(by, id, label): OPTICS within each group ``by`` (one group if None),
    features z-scored.  A group must fit a worker; its distance matrix is
    quadratic, as the algorithm's is."""
    df = features if by else features.withColumn("group_", F.lit(0))
    key = by or "group_"
    kinds = dict(df.dtypes)
    cols = [c for c in df.columns if c not in (id_col, key)]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[cols].to_numpy(dtype=float)
        x = np.where(np.isfinite(x), x, MISSING)
        s = x.std(axis=0)
        x = (x - x.mean(axis=0)) / np.where(s > 0, s, 1)
        order, reach, _ = optics_order(x, min_samples)
        return pd.DataFrame({key: pdf[key], id_col: pdf[id_col], "label": xi_labels(order, reach, min_samples)})

    out = df.groupBy(key).applyInPandas(one, f"`{key}` {kinds[key]}, `{id_col}` {kinds[id_col]}, label int")
    return out if by else out.drop("group_")


def frame_features(frames: DataFrame, selector: str | tuple, keys: list[str] | None = None) -> DataFrame:
    """Wide features of the selected frames, one row per experiment, outer-aligned."""
    names = SELECTORS[selector] if isinstance(selector, str) else selector
    long = frames.where(F.col("frame").isin(*names)).select("exp_id", F.concat_ws(":", "frame", "key").alias("key"), "value")
    p = long.groupBy("exp_id").pivot("key", keys) if keys else long.groupBy("exp_id").pivot("key")
    return p.agg(F.first("value")).na.fill(MISSING)


def double_labels(a: DataFrame, b: DataFrame, compat: bool = False) -> DataFrame:
    """(exp_id, label): clustered (1) where both labellings cluster, else -1.
    ``compat``: the first labelling alone decides where both exist."""
    j = a.select("exp_id", F.col("label").alias("la")).join(b.select("exp_id", F.col("label").alias("lb")), "exp_id", "full")
    both = F.col("la") >= 0 if compat else (F.col("la") >= 0) & (F.col("lb") >= 0)
    return j.select("exp_id", F.when(F.coalesce(both, F.lit(False)), 1).otherwise(-1).alias("label"))


def crosstab(a: DataFrame, b: DataFrame) -> DataFrame:
    """(label_a, label_b, n): experiments per pair of clusters."""
    return a.select("exp_id", F.col("label").alias("label_a")).join(b.select("exp_id", F.col("label").alias("label_b")), "exp_id").groupBy("label_a", "label_b").agg(F.count("*").alias("n"))
