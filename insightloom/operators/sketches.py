"""Thresholds and distinct counts from sketches that can be kept and merged.

A sketch of an edge's or a graph's weights is a few kilobytes, whatever it has
seen; sketches of several runs, days or halves of the data are merged without
going back to the rows.  Quantiles come from KLL sketches: with ``k`` = 4096
the rank of what is returned is within ``RANK_ERROR`` of the rank asked for
(at 99 % confidence), and exact while fewer values than k were seen.  Distinct
counts come from HyperLogLog sketches of 2**lg entries, whose relative standard
error is 1.04 / sqrt(2**lg) or less.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 4096

#: Normalised rank error of a quantile for K, doubled for safety.
RANK_ERROR = 2 * 0.0009

LG = 14

SHARES = {"median": 0.5, "q1": 0.25}


def weight_sketches(edges: DataFrame, by: tuple[str, ...] = ("influence", "parameter"), weight: str = "weight", experiment: str = "exp_id") -> DataFrame:
    """(by, weights, experiments, n, total): state of an edge from one run."""
    w = F.when(~F.isnan(weight), F.col(weight))
    return edges.groupBy(*by).agg(F.kll_sketch_agg_double(w, F.lit(K)).alias("weights"), F.hll_sketch_agg(experiment, F.lit(LG)).alias("experiments"), F.count(w).alias("n"), F.sum(w).alias("total"))


def merge(*states: DataFrame, by: tuple[str, ...] = ("influence", "parameter")) -> DataFrame:
    """The state over all runs."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    return out.groupBy(*by).agg(F.kll_merge_agg_double("weights", F.lit(K)).alias("weights"), F.hll_union_agg("experiments", F.lit(False)).alias("experiments"), F.sum("n").alias("n"), F.sum("total").alias("total"))


def summary(state: DataFrame, by: tuple[str, ...] = ("influence", "parameter"), shares: tuple[float, ...] = (0.25, 0.5)) -> DataFrame:
    """(by, n, mean, q_<percent> ..., n_experiments) read off a state; null
    quantiles where no weight was seen."""
    q = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("weights", F.lit(float(s)))).alias(f"q_{int(100 * s)}") for s in shares]
    return state.select(*by, "n", F.try_divide("total", "n").alias("mean"), *q, F.hll_sketch_estimate("experiments").alias("n_experiments"))


def threshold_state(weights: DataFrame, weight: str = "weight") -> DataFrame:
    """One row: the sketch of all weights."""
    return weights.where(F.col(weight).isNotNull() & ~F.isnan(weight)).agg(F.kll_sketch_agg_double(F.col(weight), F.lit(K)).alias("weights"))


def filter_by_sketch(kg: DataFrame, states: list[DataFrame], how: str = "median") -> DataFrame:
    """Edges whose weight reaches the quantile of the merged states; where no
    weight was seen, none.  Where the states are of this very graph, it has to
    be a table: the quantile is one of its weights, and one that is summed anew,
    in another order, could fall below it by its last bit."""
    all_ = states[0]
    for s in states[1:]:
        all_ = all_.unionByName(s)
    one = all_.agg(F.kll_merge_agg_double("weights", F.lit(K)).alias("s"))
    t = one.select(F.when(F.kll_sketch_get_n_double("s") > 0, F.kll_sketch_get_quantile_double("s", F.lit(SHARES[how]))).alias("t"))
    return kg.crossJoin(F.broadcast(t)).where(F.col("weight") >= F.col("t")).drop("t")  # one row
