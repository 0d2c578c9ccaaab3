"""Sources, snapshots, Turtle files, fitted stages, sketches and series over streams."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from insightloom import schemas
from insightloom.operators import graphs, sketches, stages
from insightloom.sources import documents, snapshots, turtle, writers
from insightloom.streaming import series

# ------------------------------------------------------------ snapshots and sources


def test_snapshot_is_built_once_and_survives_half_writes(spark, tmp_path):
    root, calls = f"file://{tmp_path}/cache", []

    def build():
        calls.append(1)
        return {"a": spark.range(5).withColumn("x", F.col("id") * 2), "b": spark.range(1)}

    assert snapshots.cached(spark, root, {"v": 1}, build)["a"].count() == 5
    again = snapshots.cached(spark, root, {"v": 1}, build)
    assert len(calls) == 1 and again["a"].agg(F.sum("x")).first()[0] == 20 and set(again) == {"a", "b"}
    assert "Range" not in again["a"]._jdf.queryExecution().executedPlan().toString()
    snapshots.cached(spark, root, {"v": 2}, build)
    assert len(calls) == 2

    def dies():
        spark.range(3).write.parquet(f"{root}/{folder}/half/a")
        raise RuntimeError("lost")

    before = {p.name for p in (tmp_path / "cache").iterdir()}
    import hashlib

    folder = hashlib.sha256(json.dumps({"v": 3}, sort_keys=True).encode()).hexdigest()[:32]
    with pytest.raises(RuntimeError):
        snapshots.cached(spark, root, {"v": 3}, dies)
    assert not (tmp_path / "cache" / folder / snapshots.MANIFEST).exists()
    assert snapshots.cached(spark, root, {"v": 3}, build)["a"].count() == 5 and len(calls) == 3
    # a second manifest never replaces the first
    snapshots._commit(spark, f"{root}/{folder}", {"attempt": "other", "settings": {}, "tables": {}})
    assert snapshots.cached(spark, root, {"v": 3}, build)["a"].count() == 5
    gone = snapshots.sweep(spark, root)
    assert [g.rsplit("/", 1)[1] for g in gone] == ["half"] and snapshots.cached(spark, root, {"v": 3}, build)["a"].count() == 5
    assert {p.name for p in (tmp_path / "cache").iterdir()} == before | {folder}


def _document(i, **more):
    return {"exp_id": i, "series_id": f"s{i % 3}", "printer": f"p{i % 2}", "oneoff": i % 5 == 0, "completion": 1.0 if i % 4 else 0.5, "material": {"type": "PLA" if i % 2 else "P E T", "color": "Light Blue", "producer": None}, "ratings": [{"blobs": 1.0, "not_labelable": float(i % 7 == 0)}], "insights": {"comment": "x"} if i % 3 else None} | more


def test_named_source(spark, tmp_path):
    docs = [_document(i) for i in range(60)]
    bad = ['{"exp_id": 1, "printer":', "no json", '{"exp_id": "x"}', '{"printer": "p0"}', "[1, 2]"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([*map(json.dumps, docs[:30]), *bad[:2], "", "  "]))
    (tmp_path / "in" / "b.json").write_text("\n".join([*bad[2:], *map(json.dumps, docs[30:])]))
    s = documents.add_source(documents.ExperimentSource("mine", f"file://{tmp_path}/in", f"file://{tmp_path}/cache"))
    assert documents.open_source("mine") is s
    with pytest.raises(ValueError):
        documents.open_source("other")
    ids = lambda **f: sorted(r["exp_id"] for r in s.documents(spark, **f).select("exp_id").collect())
    want = lambda f: [d["exp_id"] for d in docs if f(d)]
    assert ids() == want(lambda d: True) and s.documents(spark).schema == schemas.EXPERIMENT
    assert ids(completed_only=True) == want(lambda d: d["completion"] >= 1)
    assert ids(containing_insights_only=True) == want(lambda d: d["insights"])
    assert ids(include_oneoffs=False) == want(lambda d: not d["oneoff"])
    assert ids(include_oneoffs="only") == want(lambda d: d["oneoff"])
    assert ids(labelable_only=True) == want(lambda d: not d["ratings"][0]["not_labelable"])
    assert ids(printer="p1", material_type="PLA") == want(lambda d: d["exp_id"] % 2)
    assert ids(experiment_series_id="s1", include_oneoffs=False) == want(lambda d: d["series_id"] == "s1" and not d["oneoff"])
    assert len(ids(limit=7)) == 7
    for wrong in ({"experiment_series_id": "s1"}, {"include_oneoffs": "some"}):
        with pytest.raises(ValueError):
            s.documents(spark, **wrong)
    assert sorted(r["text"] for r in s.malformed(spark).collect()) == sorted(bad) and all(r["file"].endswith(".json") for r in s.malformed(spark).collect())
    plan = s.documents(spark, printer="p1", completed_only=True).select("exp_id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(printer,p1)" in plan and "GreaterThanOrEqual(completion,1.0)" in plan and "ratings" not in plan
    assert {(r["kind"], r["name"]) for r in documents.names(s.documents(spark)).collect()} == {("printer", "p0"), ("printer", "p1"), ("material_type", "pla"), ("material_type", "pet"), ("material_color", "lightblue"), ("rating", "blobs"), ("rating", "not_labelable")}
    s.register(spark)
    assert spark.sql("select count(*) from mine_series").first()[0] == 60 and spark.sql("select count(*) from mine_malformed").first()[0] == 5
    # another file is another snapshot
    (tmp_path / "in" / "c.json").write_text(json.dumps(_document(99)))
    assert ids() == [*range(60), 99]


# ------------------------------------------------------------ Turtle

PREFIXES = {"d": writers.BASE, "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "xsd": turtle.XSD}


@pytest.mark.parametrize("most", [1, 3, 500])
def test_turtle_round_trip(spark, tmp_path, most):
    r = random.Random(1)
    iri = lambda x: f"<{writers.BASE}{x}>"
    rows = {(iri(f"s{r.randrange(9)}"), iri(r.choice(["p", "starts%20at", "q-1", "-odd", ""])), r.choice([iri(f"o{r.randrange(9)}"), '"1.5"^^<http://www.w3.org/2001/XMLSchema#float>', '"a \\" b; c . d, e"', '"Wort"@de', "<http://other/x#y>", iri("weird.name")])) for _ in range(200)}
    rows |= {(iri("hot"), iri("p"), iri(f"o{i}")) for i in range(300)} | {(iri("s1"), turtle.RDF_TYPE, '"parameter"'), ("<http://other/s>", "<http://other/p>", '"x\\n."')}
    df = spark.createDataFrame([*rows, *list(rows)[:20], (None, "<a>", "<b>")], "s string, p string, o string")
    path = f"file://{tmp_path}/ttl"
    turtle.write_turtle(df, path, PREFIXES, most=most)
    back = [tuple(x) for x in turtle.read_turtle(spark, path).collect()]
    assert sorted(back) == sorted(rows)
    lines = [x["value"] for x in spark.read.text(path).collect()]
    assert any(" a " in x or "; a " in x for x in lines) and all(x.endswith(" .") for x in lines)
    assert max(x.count(",") + x.count(";") for x in lines if "d:hot" in x.split()[0]) <= most
    assert turtle.read_turtle(spark, f"{path}/*.txt").count() == len(rows)


def test_turtle_of_others_and_faults(spark, tmp_path):
    (tmp_path / "a.ttl").write_text('@prefix x: <http://x/> .\n@prefix : <http://e/> .\nx:a x:p x:b ,\n  :c ;\n  a x:K ;\n  x:n 1, 2.5, -3e2, true, "t"^^x:kind .\nx:b x:p "z"@en .\n')
    got = sorted(tuple(r) for r in turtle.read_turtle(spark, f"file://{tmp_path}/a.ttl").collect())
    a, p = "<http://x/a>", "<http://x/p>"
    number = lambda v, k: f'"{v}"^^<{turtle.XSD}{k}>'
    assert got == sorted([(a, p, "<http://x/b>"), (a, p, "<http://e/c>"), (a, turtle.RDF_TYPE, "<http://x/K>"), *((a, "<http://x/n>", v) for v in (number("1", "integer"), number("2.5", "decimal"), number("-3e2", "double"), number("true", "boolean"), '"t"^^<http://x/kind>')), ("<http://x/b>", p, '"z"@en')])
    for text in ("y:a y:p y:b .\n", "@prefix x: <http://x/> .\n[] x:p x:b .\n"):
        (tmp_path / "b.ttl").write_text(text)
        with pytest.raises(Exception, match="not declared|not understood"):
            turtle.read_turtle(spark, f"file://{tmp_path}/b.ttl").collect()
    empty = spark.createDataFrame([], "s string, p string, o string")
    turtle.write_turtle(empty, f"file://{tmp_path}/none", PREFIXES)
    assert turtle.read_turtle(spark, f"file://{tmp_path}/none").count() == 0


# ------------------------------------------------------------ fitted stages


def test_pipeline_is_fitted_saved_and_applied(spark, tmp_path):
    train = spark.createDataFrame([(1, 1.0, "b", 3.0), (2, 3.0, "a", 9.0), (3, 3.0, None, 5.0), (4, None, "c", 5.0), (5, float("nan"), "a", 1.0)], "id long, x double, k string, y double")
    new = spark.createDataFrame([(7, 2.0, "c", 9.0), (8, None, "z", 1.0), (9, float("inf"), None, 4.0)], "id long, x double, k string, y double")
    for policy in ("remove_row", "impute"):
        for unseen in ("null", "new"):
            s = stages.XySettings(("x",), ("k",), ("y",), policy, unseen, 5.0)
            fitted = stages.XyPipeline.fit(train, s)
            path = f"file://{tmp_path}/{policy}-{unseen}"
            fitted.save(path)
            loaded = stages.XyPipeline.load(spark, path)
            assert loaded.settings == s
            rows = lambda p, d: sorted(map(tuple, p.transform(d).collect()), key=repr)  # noqa: B023, E731
            assert rows(fitted, new) == rows(loaded, new) and rows(fitted, train) == rows(loaded, train)
            kept = [1.0, 3.0, 3.0] + [3.0, 3.0] * (policy == "impute")
            codes = sorted({"b", "a"} | ({"c"} if policy == "impute" else set()))
            m, d = np.mean(kept), np.std(kept)
            other = len(codes) if unseen == "new" else None
            code = lambda k: None if k is None else codes.index(k) if k in codes else other  # noqa: B023, E731
            want = [(7, (2.0 - m) / d, code("c"), 1)] + ([(8, (3.0 - m) / d, code("z"), 0), (9, (3.0 - m) / d, code(None), 0)] if policy == "impute" else [])
            got = sorted(map(tuple, loaded.transform(new).collect()))
            assert [(g[0], g[2], g[3]) for g in got] == [(w[0], w[2], w[3]) for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])
            x, y = loaded.transform_xy(new)
            assert x.columns == ["id", "x", "k"] and y.columns == ["y"]
            back = loaded.decode(loaded.transform(train)).select("id", "k")
            assert {tuple(r) for r in back.collect()} <= {(1, "b"), (2, "a"), (3, None), (4, "c"), (5, "a")}
    strict = stages.XyPipeline.fit(train, stages.XySettings(("x",), ("k",), unseen="error"))
    assert strict.transform(new.where("id = 9")).count() == 0 and strict.transform(train).count() == 3
    with pytest.raises(Exception, match="category not fitted"):
        stages.XyPipeline.fit(train, stages.XySettings((), ("k",), unseen="error")).transform(new).collect()
    for bad in ({"policy": "x"}, {"unseen": "x"}):
        with pytest.raises(ValueError):
            stages.XySettings(("x",), **bad)
    same = stages.XyPipeline.fit(train.withColumn("x", F.lit(4.0)), stages.XySettings(("x",)))
    assert {r["x"] for r in same.transform(train).collect()} == {0.0}


# ------------------------------------------------------------ sketches


def test_sketches_within_their_bounds(spark):
    n = 200_000
    e = spark.range(n).select(F.lit("i").alias("influence"), (F.col("id") % 2).cast("string").alias("parameter"), (F.pmod(F.hash("id"), F.lit(1_000_003)) / 1000.0).alias("weight"), (F.col("id") % 30_000).alias("exp_id"))
    parts = [sketches.weight_sketches(e.where(F.pmod("exp_id", F.lit(3)) == k)) for k in range(3)]
    merged = {r["parameter"]: r for r in sketches.summary(sketches.merge(*parts)).collect()}
    for p in ("0", "1"):
        own = np.sort([r["weight"] for r in e.where(F.col("parameter") == p).select("weight").collect()])
        assert merged[p]["n"] == len(own) and abs(merged[p]["mean"] - own.mean()) < 1e-6
        for q, share in (("q_25", 0.25), ("q_50", 0.5)):
            rank = np.searchsorted(own, merged[p][q], side="right") / len(own)
            assert abs(rank - share) <= sketches.RANK_ERROR
        assert abs(merged[p]["n_experiments"] - 15_000) <= 15_000 * 3 * 1.04 / np.sqrt(2**sketches.LG)
    kg = spark.createDataFrame([(f"i{k}", "p", float(k)) for k in range(101)] + [("n", "p", None), ("m", "p", float("nan"))], "influence string, parameter string, weight double")
    halves = [sketches.threshold_state(kg.where(F.col("weight") < 30)), sketches.threshold_state(kg.where("not weight < 30 or weight is null"))]
    by_sketch = {r["influence"] for r in sketches.filter_by_sketch(kg, halves, "median").where("not isnan(weight)").collect()}
    exact = {r["influence"] for r in graphs.filter_aggregated(kg, "median").where("not isnan(weight)").collect()}
    assert by_sketch == exact == {f"i{k}" for k in range(50, 101)}
    assert sketches.filter_by_sketch(kg.limit(0), [sketches.threshold_state(kg.limit(0))]).count() == 0


# ------------------------------------------------------------ series over a stream

VALUES = "series_id string, key string, exp_id long, at timestamp, value double"


def _feed(spark, tmp_path, batches, late):
    """Each batch is a file that the stream, started anew, finds in its folder."""
    source, out, state = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir(exist_ok=True)
    schema = spark.createDataFrame([], VALUES).schema
    for b in batches:
        spark.createDataFrame(b, VALUES).coalesce(1).write.mode("append").parquet(source)
        series.start_relative(spark.readStream.schema(schema).parquet(source), out, state, late).awaitTermination()
    return spark.read.schema(series.OUT).option("basePath", out).parquet(f"{out}/batch=*")


def test_series_stream_equals_the_batch_after_any_order(spark, tmp_path):
    from datetime import datetime, timedelta

    r = random.Random(6)
    t0 = datetime(2024, 1, 1)
    rows = [(f"s{k % 4}", "q", k, t0 + timedelta(hours=r.randrange(100)), None if k % 11 == 0 else r.uniform(0, 1)) for k in range(90)] + [(None, "q", 1, t0, 1.0), ("s1", "q", None, t0, 1.0)]
    r.shuffle(rows)
    told = _feed(spark, tmp_path, [rows[:30], rows[30:60], rows[60:]], "30 days")
    df = spark.createDataFrame(rows, VALUES)
    key = lambda x: (x["series_id"], x["key"], x["exp_id"])
    got = {key(x): x for x in series.latest(told).collect()}
    want = {key(x): x for x in series.relative_batch(df.where("series_id is not null and exp_id is not null")).collect()}
    assert set(got) == set(want) and len(got) == 90
    for k, w in want.items():
        assert (got[k]["relative"] is None) == (w["relative"] is None) and (w["relative"] is None or abs(got[k]["relative"] - w["relative"]) < 1e-12)
    assert told.where("version = -1").count() == 0


def test_series_stream_with_late_rows_and_restarts(spark, tmp_path):
    from datetime import datetime

    day = lambda d: datetime(2024, 1, d)
    first = [("s", "q", 1, day(1), 5.0), ("s", "q", 3, day(10), 2.0)]
    second = [("s", "q", 2, day(9), 4.0), ("s", "q", 4, day(20), 1.0)]  # 2 comes between 1 and 3
    third = [("s", "q", 9, day(2), 7.0), ("s", "q", 5, day(19), 3.0)]  # day 2 lies behind the watermark
    told = _feed(spark, tmp_path, [first, second, third], "3 days")
    got = {x["exp_id"]: x["relative"] for x in series.latest(told).collect()}
    assert got == {1: None, 2: 1.0, 3: 2.0, 5: -1.0, 4: 2.0}
    assert [x["exp_id"] for x in told.where("version = -1").collect()] == [9]


def test_series_stream_works_on_many_series_at_once():
    """A call takes a bucket of series; each keeps its own predecessor and its own last value behind the watermark."""
    import types

    import pandas as pd

    day = lambda d: pd.Timestamp(2024, 1, d)

    class State:
        exists, get, mark = False, None, 0

        def update(self, x):
            self.exists, self.get = True, x

        def getCurrentWatermarkMs(self):  # noqa: N802
            return self.mark

    state, step = State(), series._step(-1.0)
    frame = lambda rows: pd.DataFrame(rows, columns=["series_id", "key", "exp_id", "at", "value"])
    assert isinstance(step((0,), iter([frame([])]), State()), types.GeneratorType)
    first = pd.concat(step((0,), iter([frame([("a", "q", 1, day(1), 5.0), ("b", "q", 1, day(2), 3.0), ("a", "r", 1, day(1), 1.0), ("a", "q", 2, day(4), 4.0)])]), state))
    assert first.set_index(["series_id", "key", "exp_id"])["relative"].dropna().to_dict() == {("a", "q", 2): 1.0}
    state.mark = day(10).value // 10**6
    second = pd.concat(step((0,), iter([frame([("b", "q", 2, day(11), 1.0), ("a", "q", 3, day(12), 6.0), ("a", "r", 2, day(3), 9.0)])]), state))
    got = second.set_index(["series_id", "key", "exp_id"])
    assert got["relative"].dropna().to_dict() == {("b", "q", 2): 2.0, ("a", "q", 3): -2.0} and got.loc[("a", "r", 2), "version"] == -1
    third = pd.concat(step((0,), iter([frame([("a", "r", 3, day(13), 0.0)])]), state))
    assert third["relative"].tolist() == [1.0]
