"""Sums that are compared with one of themselves: they come in another order each time they are summed, so their last bits differ."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from insightloom.operators import graphs, rules
from insightloom.plans import catalogue


def _unordered(df, seen):
    """``df`` in one task, whose rows come in a new order each time; ``seen`` counts them."""

    def mix(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b.take(random.SystemRandom().sample(range(b.num_rows), b.num_rows))

    return df.coalesce(1).mapInArrow(mix, df.schema)


def _edges(spark, n_edges):
    """Insight edges of a few hundred weights each; their sums lie far apart."""
    rng = random.Random(7)
    rows = [(x, f"i{k}", "qual_influence", "p", k + rng.random()) for k in range(n_edges) for x in range(300)]
    return spark.createDataFrame(rows, "exp_id long, influence string, influence_type string, parameter string, weight double")


def test_a_median_edge_reaches_the_median_by_sketches(spark, monkeypatch):
    """the edge whose weight is the median stays."""
    seen, edges = spark.sparkContext.accumulator(0), _edges(spark, 9)
    monkeypatch.setattr(catalogue.ad, "insight_edges", lambda spark, sf: _unordered(edges, seen))
    for run in range(1, 5):
        got = {r["influence"] for r in catalogue.kg_filter_sketch(spark, "/root/testdata/sf0.001").collect()}
        assert got == {f"i{k}" for k in range(4, 9)} and seen.value == 2700 * run


@pytest.mark.parametrize(("how", "n_edges", "left"), [("median", 9, range(4, 9)), ("q1", 9, range(2, 9)), ("mean", 1, range(1))])
def test_an_edge_that_is_the_threshold_reaches_it(spark, how, n_edges, left):
    """kg_filter_mean, kg_filter_median, kg_filter_q1, graph_diff and kg_methods share the step."""
    seen, edges = spark.sparkContext.accumulator(0), _edges(spark, n_edges)
    for run in range(1, 5):
        got = {r["influence"] for r in graphs.filter_aggregated(graphs.aggregate(_unordered(edges, seen), 10), how).collect()}
        assert got == {f"i{k}" for k in left} and seen.value == 300 * n_edges * run


def test_extreme_steps_stay_in_their_own_bins(spark):
    """the least and the greatest step are the ends of the bins of steps, of the very same sums."""
    rng = random.Random(3)
    base = [[rng.gauss(b, 0.3) for b in range(8)] for _ in range(12)]
    rows = [(x, "q", (b + 0.5) / 8, f"p{p}", rng.random(), base[p][b] + rng.random(), "numeric") for p in range(12) for b in range(8) for x in range(60)]
    pairs = spark.createDataFrame(rows, "exp_id long, influence string, influence_value double, parameter string, value double, relative double, kind string")
    bins = rules.influence_bins(pairs.select("influence", F.col("influence_value").alias("value")), bins=8).localCheckpoint()
    seen = spark.sparkContext.accumulator(0)

    def merged(p):
        return sorted((r["parameter"], round(r["cond_lo"], 6), round(r["cond_hi"], 6), r["action"], round(r["step_size"], 6), r["n_values"]) for r in rules.merged_rules(p, bins).collect())

    want = merged(pairs.coalesce(1))
    for run in range(1, 4):
        assert merged(_unordered(pairs, seen)) == want and seen.value == len(rows) * run
