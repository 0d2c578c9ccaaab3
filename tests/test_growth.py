"""Steps whose cost grew faster than needed: their results are those of the longer way."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F

from insightloom.operators import experiments, fitting, representations, rules
from insightloom.sources import documents, readers, turtle


def test_turtle_is_read_in_bounded_pieces():
    """A batch of few statements with very many triples goes on in pieces, whole."""
    lines = [f"<http://x/s{i}> <http://x/p> " + ", ".join(f'"{j}"' for j in range(7_000)) for i in range(5)]
    got = list(turtle._triples({})([pa.RecordBatch.from_arrays([pa.array(lines)], names=["value"])]))
    assert max(b.num_rows for b in got) <= turtle.READ_AT_ONCE
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == [(f"<http://x/s{i}>", "<http://x/p>", f'"{j}"') for i in range(5) for j in range(7_000)]
    assert sum(b.num_rows for b in turtle._triples({})([pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["value"])])) == 0


EXPS = [(1, 10), (1, 11), (1, 12), (2, 20), (2, 21), (3, None), (None, 30), (None, 31)]
WIDE = [(10, 1.0, 5.0), (12, 4.0, None), (20, 2.0, 2.0), (21, None, 7.0), (30, 1.0, 1.0), (31, 3.0, 2.0), (99, 0.0, 0.0), (None, 1.0, 1.0)]


def _both(spark):
    exps = spark.createDataFrame(EXPS, "series_id long, exp_id long")
    wide = spark.createDataFrame(WIDE, "exp_id long, a double, b double")
    return exps, wide, wide.select("exp_id", F.expr("stack(2, 'a', a, 'b', b) as (key, value)"))


def test_frames_of_columns_are_those_of_long_tables(spark):
    exps, wide, long = _both(spark)
    changes = long.select("exp_id", "key", F.col("value").cast("string").alias("user_value"), F.lit("0.5").alias("original_value"))
    influences = long.select("exp_id", "key", F.lit("qual_influence").alias("type"), (F.col("value") / 2).alias("value"))
    want = experiments.metric_frames(exps, long, changes, influences)
    got = experiments.metric_frames_wide(wide, exps, ["a", "b"], {k: (F.col(k), F.lit("0.5")) for k in "ab"}, {k: F.col(k) / 2 for k in "ab"})
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 60
    plan = got.groupBy("frame", "series_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(frame" not in plan and plan.count("hashpartitioning(series_id") == 1


def test_edge_values_of_columns_are_those_of_long_tables(spark):
    exps, wide, long = _both(spark)
    edges = spark.createDataFrame([(e, i, p) for e in (10, 12, 20, 21, 30, 99) for i in ("a", "b", "c") for p in ("a", "b", "c")], "exp_id long, influence string, parameter string")
    quality = wide.select("exp_id", (F.col("a") + 1).alias("value"))
    want = experiments.ep_values(edges, long.withColumn("original", F.col("value") * 2), long, quality, exps)
    got = experiments.ep_values_wide(edges, wide, exps, {k: (F.col(k), F.col(k) * 2) for k in "ab"}, {k: F.col(k) for k in "ab"}, F.col("a") + 1)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 13
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "hashpartitioning(exp_id" in plan and ", parameter" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)


def _value(d=None, b=None):
    return {"d": d, "b": b, "s": None}


def test_documents_are_aggregated_within_their_row(spark):
    base = {"series_id": "s", "printer": "p", "material": {"type": "PLA", "color": None, "producer": None}}
    docs = [
        {"exp_id": 1, "all_parameters": {"speed": _value(1.0), "fan": _value(b=True)}, "changed_parameters": {"speed": _value(3.0)}, "ratings": [{"blobs": 1.0, "user_id": 7.0}, {"blobs": 4.0, "gaps": None}, {}], "measurements": [{"humidity": 5.0}, {"humidity": 1.0, "temperature": 2.0}]},
        {"exp_id": 2, "all_parameters": None, "ratings": [None, {"gaps": 2.0}], "measurements": []},
        {"exp_id": 3, "all_parameters": {"s": _value()}, "ratings": None, "measurements": [{"humidity": 1.0}, None, {"humidity": 4.0}, {"humidity": 9.0}]},
        {"exp_id": None, "all_parameters": {"speed": _value(9.0)}, "ratings": [{"blobs": 1.0}]},
    ]
    from insightloom import schemas

    df = spark.read.schema(schemas.EXPERIMENT).json(spark.sparkContext.parallelize([json.dumps(base | d) for d in docs]))
    for how in ("mean", "median", "min", "max"):
        got = readers.executed_experiments(df, how, how)
        want = readers.executed_experiments(df, experiments.AGGREGATES[how], experiments.AGGREGATES[how])  # over long tables
        assert set(got.columns) == set(want.columns) >= {"speed", "fan", "blobs", "gaps", "humidity", "temperature", "s"} and "user_id" not in got.columns
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and got.count() == 4
    row = readers.executed_experiments(df).where("exp_id = 1").first()
    assert (row["speed"], row["fan"], row["blobs"], row["gaps"], row["humidity"], row["temperature"]) == (3.0, 1.0, 2.5, None, 3.0, 2.0)
    plan = readers.executed_experiments(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_source_parses_its_lines_once(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"exp_id": 1}\n{"exp_id": "x"}\n{"exp_id": 2, "completion": "much"}\nno\n')
    parsed = []
    real = F.from_json
    monkeypatch.setattr(documents.F, "from_json", lambda *a, **k: parsed.append(1) or real(*a, **k))
    s = documents.ExperimentSource("once", f"file://{tmp_path}/in", f"file://{tmp_path}/cache")
    assert [r["exp_id"] for r in s.documents(spark).collect()] == [1]
    assert sorted(r["text"] for r in s.malformed(spark).collect()) == ['no', '{"exp_id": "x"}', '{"exp_id": 2, "completion": "much"}'] and parsed == [1]
    plan = s._build(spark)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 1


def test_rules_are_hashed_not_sorted(spark):
    """A text in an aggregation's buffer makes Spark sort all values."""
    kinds = {"n": "numeric", "b": "boolean", "c": "string"}
    rows = [(i, f"q{i % 2}", i / 40, p, float(i % 2), 1.0, k) for i in range(40) for p, k in kinds.items()]
    pairs = spark.createDataFrame(rows, "exp_id long, influence string, influence_value double, parameter string, value double, relative double, kind string")
    bins = rules.influence_bins(pairs.select("influence", F.col("influence_value").alias("value")), bins=2)
    of = [representations.relations_from_rules(rules.binned_rules(pairs, bins)).select("parameter", "mean", "bins"), rules.fitted_rules(pairs, bins), rules.edge_rules(pairs, bins), fitting.classified_rules(pairs, bins)]
    for df in of[:3]:
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
    for df in of[1:]:
        assert {(r["parameter"], r["param_type"]) for r in df.collect()} <= set(kinds.items())
    assert {(r["parameter"], r["param_type"]) for r in of[1].collect()} == set(kinds.items())


def test_packing_looks_up_only_the_words_of_a_batch():
    """The table of known words is not gone through for every batch."""
    import public_tokenizers

    from insightloom.llm import packing

    class Table(dict):
        def __iter__(self):
            raise AssertionError("the whole table is gone through")

    cache = packing.WordCache(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["plain words, and more", "你好 other words", None, ""]
    want = [i.tolist() for i in cache.ids_of_texts(texts)]
    cache.new = Table(cache.new)
    assert [i.tolist() for i in cache.ids_of_texts(texts)] == want
    assert cache.ids_of_texts(["new words"])[0].tolist() == cache.tokenizer.encode("new words", add_special_tokens=False).ids
