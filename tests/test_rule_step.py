"""The step that the rule queries share: values beside their predecessors, bins, actions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from insightloom.operators import experiments, fitting, rules
from insightloom.plans import catalogue

PAIRS = "exp_id long, influence string, influence_value double, parameter string, value double, relative double, kind string"


def test_a_step_that_is_a_rest_of_sums_is_none(spark):
    rest = [0.1, 0.2, -0.3]  # adds up to 5.5e-17
    rows = [(i, "q", 0.5, "p", float(i), r, "numeric") for i, r in enumerate(rest)] + [(i, "q", 0.5, "c", 2.0, r, "numeric") for i, r in enumerate(rest)]
    pairs = spark.createDataFrame(rows, PAIRS).coalesce(1)
    bins = rules.influence_bins(pairs.select("influence", F.col("influence_value").alias("value")), bins=2)
    for got in (rules.binned_rules(pairs, bins), rules.merged_rules(pairs, bins)):
        assert {r["parameter"]: r["action"] for r in got.collect()} == {"p": "adjust incrementally", "c": "set"}


def test_values_are_not_exchanged_by_the_few_influences(spark, monkeypatch):
    """Bins that are too large to be broadcast by size alone: nothing with a row per value is exchanged by influence."""
    rows = [(i, f"q{i % 2}", i / 40, f"p{i % 3}", float(i), 1.0, "numeric") for i in range(40)]
    pairs = spark.createDataFrame(rows, PAIRS)
    bins = rules.influence_bins(pairs.select("influence", F.col("influence_value").alias("value")), bins=4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (rules.binned_rules(pairs, bins), fitting.standardised(pairs)):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and re.search("BroadcastHashJoin", plan)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_rule_queries_leave_values_where_they_are(spark):
    """F8 to F11: no query meets its bins by an exchange of all values by influence."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("rule_binned", "rule_equality", "rule_metrics", "rule_text"):
            plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"SortMergeJoin \[influence#", plan) and "BroadcastHashJoin [influence#" in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_rounded_rules_keep_the_sign_of_a_zero(spark):
    """F8: as the SQL's round does, which gives -0.0 for a step of -0.00003."""
    import duckdb

    columns = ["cond_lo", "cond_hi", "mean_value", "range_start", "range_end", "step_size"]
    rows = [tuple(x * (i + 1) for i in range(6)) for x in (-0.000001, 0.000001, 0.0, -0.00003, 1.5)] + [(None,) * 6]
    r = spark.createDataFrame([("q", "p", *row, "set", 1) for row in rows], "condition string, parameter string, " + ", ".join(f"{c} double" for c in columns) + ", action string, n_values long")
    got = [[row[c] for c in columns] for row in catalogue._rule_out(r).collect()]
    want = [[duckdb.execute("SELECT round(?::DOUBLE, 4)", [x]).fetchone()[0] for x in row] for row in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and "-0.0" in repr(got)


def test_modes_hold_categories_only(spark):
    """The buffer of a mode has an entry for each value it saw."""
    rows = [(i, "q", 0.5, "p", float(i), 1.0, "numeric") for i in range(9)] + [(i, "q", 0.5, "c", float(i % 4 == 0), None, "string") for i in range(9)]
    pairs = spark.createDataFrame(rows, PAIRS)
    bins = rules.influence_bins(pairs.select("influence", F.col("influence_value").alias("value")), bins=1)
    df = rules.binned_rules(pairs, bins)
    assert {r["parameter"]: r["quantifier"] for r in df.collect()} == {"p": None, "c": 0.0}
    assert re.search(r"mode\(CASE WHEN \(kind#?\d* = string\)", df._jdf.queryExecution().executedPlan().toString())


def test_values_with_previous_are_as_joined(spark):
    exps = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 20), (2, 21), (3, None), (None, 30), (None, 31)], "series_id long, exp_id long")
    wide = spark.createDataFrame([(10, 1.0, 5.0), (12, 4.0, None), (20, 2.0, 2.0), (21, None, 7.0), (30, 1.0, 1.0), (31, 3.0, 2.0), (99, 0.0, 0.0), (None, 1.0, 1.0)], "exp_id long, a double, b double")
    long = wide.select("exp_id", F.expr("stack(2, 'a', a, 'b', b) as (key, value)"))
    want = experiments.relative(long, experiments.previous(exps), 1).collect()
    got = experiments.with_previous(wide, exps).select("series_id", "exp_id", F.expr("stack(2, 'a', a - before.a, 'b', b - before.b) as (key, value)")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 12


def test_ranks_by_products_count_like_scores():
    """Equal and nearly equal vectors, of whole numbers and of others: a product's rounding doesn't move a count."""
    import numpy as np

    from insightloom.operators import evaluation

    rng = np.random.default_rng(3)
    for e in (rng.integers(-256, 256, (300, 24)).astype(float), rng.normal(size=(300, 24)) * 1e3 + 1e6):
        e[100:200] = e[7]
        e[150] = np.nextafter(e[7], np.inf)
        e[290, 3], e[291, 2] = np.nan, np.inf
        q = np.vstack([e[:40], e[:10] + 1e-9])
        for product in (True, False):
            with np.errstate(invalid="ignore"):
                s = evaluation._scores_of(q, e, product)
                truth = np.array([s[i, (7 * i) % 200] for i in range(len(q))])
                better, equal = evaluation._beaten(q, e, truth, product, 1000)
            assert (better == (s > truth[:, None]).sum(axis=1)).all() and (equal == (s == truth[:, None]).sum(axis=1)).all()
