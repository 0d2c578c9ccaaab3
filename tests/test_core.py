"""Operators on hand-made tables with known results."""

from __future__ import annotations

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from insightloom.functions import numeric as nm
from insightloom.functions import text as tx
from insightloom.operators import clustering, embeddings, evaluation, experiments, features, graphs, representations, rules, storage, synthesis
from insightloom.plans import catalogue
from insightloom.plans.catalogue import SMALL
from insightloom.sources import adapters as ad
from insightloom.sources import configs, readers, writers
from insightloom.streaming import incremental

SF = "/root/testdata/sf0.001"


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


def test_names(spark):
    r = one(spark, tx.camel_to_snake(F.lit("underExtrusion")), tx.snake_to_camel(F.lit("under_extrusion")), tx.rating_to_snake(F.lit("overall")), tx.normalise(F.lit("A b C")), tx.enum_name(F.lit("adjust hardware")))
    assert list(r) == ["under_extrusion", "underExtrusion", "overall_ok", "abc", "ADJUST_HARDWARE"]
    r = one(spark, tx.material_label(F.lit("PLA"), F.lit("Janbex"), F.lit("Green")), tx.iri("http://x/", F.lit("a b")))
    assert list(r) == ["PLA:Janbex:Green", "http://x/a%20b"]


@pytest.mark.parametrize("text,d,b", [("1.5", 1.5, None), ("on", None, True), ("off", None, False), ("maybe", None, None), (None, None, None), ("NaN", None, None)])
def test_typed_value(spark, text, d, b):
    v = one(spark, tx.typed_value(F.lit(text).cast("string")))[0]
    assert (v["d"], v["b"], v["s"]) == (d, b, text)


def test_rule_round_trip(spark):
    rows = [("stringing", 0.0, 2.5, "decrease incrementally", "speed", None, None, -3.25, None), ("warping", 1.0, 2.0, "set", "fan", None, None, None, 1.0), ("gaps", 1.0, 2.0, "adjust incrementally", "flow", 5.0, 7.5, 0.0, None)]
    df = spark.createDataFrame(rows, "condition string, cond_lo double, cond_hi double, action string, parameter string, range_start double, range_end double, step_size double, quantifier double")
    got = df.select("*", tx.rule_text().alias("t")).select("t", tx.parse_rule("t").alias("p"), "condition", "parameter", "action").collect()
    assert got[0]["t"] == "If you encounter stringing in [0.00, 2.50], try to decrease incrementally the parameter speed by 3.25"
    for r in got:
        assert all(r["p"][c] == r[c] for c in ("condition", "parameter", "action"))
    assert got[0]["p"]["step_size"] == -3.25 and got[1]["p"]["quantifier"] == 1.0 and got[2]["p"]["range_end"] == 7.5
    old = df.select(tx.parse_rule(tx.rule_text_old()).alias("p")).first()["p"]
    assert old["condition"] == "stringing" and old["cond_lo"] is None
    for text, want in (("[1;2.5]", (1.0, 2.5)), ("<3", (None, 3.0)), (">4", (4.0, None)), ("x", (None, None))):
        assert tuple(one(spark, tx.parse_range(F.lit(text)))[0]) == want


def test_numbers(spark):
    v = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 4, 4, 7, 9, 9, 9, 10)], "value double")
    assert v.agg(nm.doane_bins("value").alias("n")).first()["n"] == len(np.histogram_bin_edges([1, 2, 2, 4, 4, 7, 9, 9, 9, 10], "doane")) - 1 == 5
    assert v.limit(1).agg(nm.doane_bins("value").alias("n")).first()["n"] == 1
    edges = F.array(*map(F.lit, (0.0, 1.0, 2.0)))
    assert [one(spark, nm.digitize(F.lit(x), edges))[0] for x in (-1.0, 0.0, 1.0, 2.0, 3.0)] == [0, 1, 2, 2, 3]
    a, b = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(1.0))
    r = one(spark, nm.jaccard_distance(a, b), nm.euclidean_distance(a, b), nm.cosine_distance(a, a), nm.interval_iou(F.lit(0.0), F.lit(2.0), F.lit(1.0), F.lit(3.0)), nm.close(F.lit(1.0), F.lit(1.4)), nm.clip(F.lit(5.0), 0.0, 2.0))
    assert [round(x, 6) if isinstance(x, float) else x for x in r] == [0.5, 1.414214, 0.0, 0.333333, True, 2.0]


@pytest.mark.parametrize("kind,coeffs", [("linear", (1.0, 0.03)), ("quadratic", (9.0, -0.06, 1.5e-4)), ("logarithmic", (1.5, 3.0, -1.0, 0.5))])
def test_pq_functions(spark, kind, coeffs):
    f = nm.FUNCTIONS[kind](coeffs)
    g = synthesis.ScalarFunction(kind, coeffs, (0.0, 255.0), (0.0, 10.0))
    for x in (0.0, 20.0, 100.0, 254.0):
        y, back, dy, dx = one(spark, f(F.lit(x)), f.inverse(f(F.lit(x)), F.lit(x)), f.derivative(F.lit(x)), f.inverse_derivative(f(F.lit(x)), F.lit(x)))
        assert y == pytest.approx(g(x)) and back == pytest.approx(g.inverse(g(x), x), abs=1e-6)
        if 0 < y < 10:
            assert back == pytest.approx(x, abs=1e-5)
            assert dy * dx == pytest.approx(1.0, rel=1e-6)
    with pytest.raises(ValueError):
        nm.FUNCTIONS[kind]((1.0,))


EDGES = [(1, "a", "qual_influence", "p", 0.5), (2, "a", "qual_influence", "p", 0.7), (2, "b", "env_influence", "q", 0.2), (3, "b", "env_influence", "p", None)]


def kg(spark):
    e = spark.createDataFrame(EDGES, "exp_id long, influence string, influence_type string, parameter string, weight double")
    return e, graphs.aggregate(e, 4)


def test_graph_aggregation(spark):
    e, g = kg(spark)
    got = {(r["influence"], r["parameter"]): (r["weight"], r["n_experiments"], r["first_exp"]) for r in g.collect()}
    assert got[("a", "p")] == (pytest.approx(0.3), 2, 1) and got[("b", "q")] == (pytest.approx(0.05), 1, 2) and got[("b", "p")][0] is None
    assert {(r["influence"], r["parameter"]) for r in graphs.filter_aggregated(g, "mean").collect()} == {("a", "p")}
    kept = graphs.filter_insight_graphs(e, "median")
    assert {(r["exp_id"], r["influence"]) for r in kept.collect()} == {(1, "a"), (2, "a"), (3, "b")}
    assert sorted(r["filtered"] for r in graphs.difference(g, graphs.filter_aggregated(g, "mean")).collect()) == [False, True, True]
    labels = spark.createDataFrame([(1, 0), (2, -1)], "exp_id long, label int")
    w = {(r["influence"], r["parameter"]): r["weight"] for r in graphs.cluster_weights(e, labels).collect()}
    assert w == {("a", "p"): 0.5, ("b", "q"): 0.0, ("b", "p"): 0.0}
    freq = {(r["influence"], r["parameter"]): r["frequency"] for r in graphs.edge_frequency(e).collect()}
    assert freq[("a", "p")] == pytest.approx(2 / 3)


def test_series(spark):
    exps = spark.createDataFrame([("s", 1), ("s", 2), ("s", 5), ("t", 3)], "series_id string, exp_id long")
    link = spark.createDataFrame([(5, 1)], "exp_id long, link long")
    prev = experiments.previous(exps, link)
    assert {(r["exp_id"], r["prev_id"]) for r in prev.collect()} == {(1, None), (2, 1), (5, 1), (3, None)}
    q = spark.createDataFrame([(1, "x", 4.0), (2, "x", 3.0), (5, "x", 1.0), (3, "x", 2.0)], "exp_id long, key string, value double")
    rel = {r["exp_id"]: r["value"] for r in experiments.relative(q, prev).collect()}
    assert rel == {1: None, 2: 1.0, 5: 3.0, 3: None}
    best = {r["series_id"]: r["exp_id"] for r in experiments.series_best(exps, q.select("exp_id", "value")).collect()}
    assert best == {"s": 5, "t": 3}
    assert {(r["first"], r["second"]) for r in experiments.adjacent(exps, "exp_id", "exp_id", ["series_id"]).collect()} == {(1, 2), (2, 5)}


def test_registered_settings_are_the_standard_ones(spark):
    data, standard = catalogue.WHOLE, configs.DataSettings()
    assert (data.n_experiments, data.parameters, data.qualities, data.correlating_share) == (500, standard.parameters, standard.qualities, standard.correlating_share)
    rows = catalogue.synth_dataset(spark, "").collect()
    assert len(rows) >= 500 and {(len(json.loads(r["parameters"])), len(json.loads(r["qualities"]))) for r in rows} == {(46, 14)}
    e = representations.encode(ad.relations(spark, SF), "basic")[1]
    t = e.select(F.lit("basic").alias("kg_type"), F.col("src").alias("h"), F.lit("acts on").alias("r"), F.col("dst").alias("t"))
    want = {(r["role"], r["name"]): r["vec"] for r in embeddings.train(t, "TransE", 400, embeddings.TrainSettings(dim=46)).collect()}
    assert {(r["role"], r["name"]): r["vec"] for r in catalogue.train_transe(spark, SF).collect()} == want


def test_merged_rules_have_all_relations(spark):
    keys = [{r["key"] for r in f(spark, SF).select("key").distinct().collect()} for f in (ad.qualities, ad.parameters)]
    got = {(r["condition"], r["parameter"]) for r in catalogue.rule_merged(spark, SF).select("condition", "parameter").distinct().collect()}
    assert (len(keys[0]), len(keys[1])) == (3, 4) and got == {(q, p) for q in keys[0] for p in keys[1]}


def test_closeness_of_long_paths(spark):
    n = 68  # vertex i is reached from all before it, the last over 67 edges
    v = spark.createDataFrame([(f"v{i}",) for i in range(n)] + [("alone",)], "name string").coalesce(1)
    e = spark.createDataFrame([(f"v{i}", f"v{i + 1}") for i in range(n - 1)] + [("v1", "v0")], "src string, dst string").coalesce(1)
    got = {r["name"]: r["closeness"] for r in graphs.closeness(v, e).collect()}
    assert got["alone"] == 0 and got["v0"] == pytest.approx(1 * 1 / (1 * n))
    for i in range(1, n):
        assert got[f"v{i}"] == pytest.approx(i * i / (i * (i + 1) / 2 * n))


def test_documents_to_graph(spark, tmp_path):
    w = synthesis.make_world(SMALL)
    docs = synthesis.to_documents(synthesis.generate(spark, w)).cache()
    path = str(tmp_path / "docs")
    writers.write_documents(docs, path)
    back = readers.source(spark, "json", path=path)
    assert back.count() == docs.count() >= 60
    e = experiments.insight_edges(back)
    assert e.where("influence_type = 'qual_influence'").count() == e.count() > 0
    assert experiments.insight_edges(back, influential_only=False).where("influence_type = 'env_influence'").count() > 0
    wide = readers.executed_experiments(back)
    assert wide.count() == docs.count() and {"p0", "q0", "temperature"} <= set(wide.columns)
    assert readers.source(spark, "json", path=path, with_insights_only=True).where("insights is null").count() == 0
    kinds = {r["key"]: r["kind"] for r in experiments.parameter_kinds(experiments.parameters_long(back)).collect()}
    assert set(kinds.values()) == {"numeric"}
    fixed = experiments.fix_not_labelable(spark.createDataFrame([([{"warping": 1.0, "not_labelable": 1.0}, {"warping": 2.0}],)], "ratings array<map<string,double>>")).first()["ratings"]
    assert fixed[0]["warping"] == 5.0 and fixed[1]["warping"] == 2.0


def test_synthesis_improves(spark):
    w = synthesis.make_world(SMALL)
    assert {q for _, q in w.pairs} == {q.name for q in SMALL.qualities} and w.expert <= set(w.pairs)
    rng = np.random.default_rng(0)
    for make in (synthesis.expert_series, synthesis.trial_series):
        s = make(w, (w.qualities_with_expert_knowledge()[0],), configs.SeriesSettings(kind="trial"), rng)
        assert len(s) >= 2 and (make is synthesis.trial_series or len(s) <= 15)
    a = synthesis.generate(spark, w).collect()
    assert a == synthesis.generate(spark, w).collect()
    spans = {p.name: 255.0 for p in SMALL.parameters} | {q.name: 10.0 for q in SMALL.qualities}
    n = synthesis.add_noise(synthesis.generate(spark, w), configs.NoiseSettings(0.3), spans).collect()
    moved = [(r, s) for r, s in zip(sorted(n), sorted(a)) if r != s]
    assert len(n) == len(a) and len(moved) == int(0.3 * len(a))
    assert all(r["parameters"][k] != s["parameters"][k] for r, s in moved for k in s["parameters"]) and all(r["qualities"][k] != s["qualities"][k] for r, s in moved for k in s["qualities"])


def test_slow_series_raise_and_long_ones_lose_even_places():
    w = synthesis.make_world(SMALL)
    group = (w.qualities_with_expert_knowledge()[0],)
    long = [len(synthesis.expert_series(w, group, configs.SeriesSettings(max_size=10_000, score_threshold=0.0), np.random.default_rng(i))) for i in range(5)]
    assert max(long) > 2
    with pytest.raises(RuntimeError):
        for i in range(5):
            synthesis.expert_series(w, group, configs.SeriesSettings(max_steps=1, score_threshold=0.0), np.random.default_rng(i))
    assert synthesis.trim(list(range(10)), 7) == [1, 2, 3, 5, 6, 7, 9]  # places 0, 4 and 8
    assert synthesis.trim(list(range(5)), 4) == [1, 2, 3, 4] and synthesis.trim([1, 2], 5) == [1, 2]
    learned = set()
    synthesis.trial_series(w, group, configs.SeriesSettings(kind="trial"), np.random.default_rng(1), learned)
    assert learned and learned <= set(w.pairs)


def test_fit_to_size(spark):
    sizes = [9, 7, 7, 3, 2, 2, 1]
    df = spark.createDataFrame([(f"s{i}", k) for i, n in enumerate(sizes) for k in range(n)], "series_id string, pos int")
    assert synthesis.fit_to_size(df, 31).count() == 31 and synthesis.fit_to_size(df, 100).count() == 31
    for how in ("cut_first", "cut_last", "cut_random"):
        got = {}
        for r in synthesis.fit_to_size(df, 20, how, seed=3).collect():
            got.setdefault(r["series_id"], []).append(r["pos"])
        assert sum(map(len, got.values())) == 20
        whole = {k: sizes[int(k[1:])] for k in got}
        cut = {k: len(got[k]) for k in got if len(got[k]) < whole[k]}
        assert not cut or max(map(len, got.values())) - min(cut.values()) <= 1  # only the longest lose
        for k in cut:
            assert how == "cut_random" or sorted(got[k]) == (list(range(whole[k] - cut[k], whole[k])) if how == "cut_first" else list(range(cut[k])))
    whole = synthesis.fit_to_size(df, 15, seed=5).groupBy("series_id").count().collect()
    assert all(r["count"] == sizes[int(r["series_id"][1:])] for r in whole) and sum(r["count"] for r in whole) >= 15


@pytest.mark.parametrize("kind,coeffs", [("linear", (1.0, 0.03)), ("linear", (9.0, -0.03)), ("quadratic", (9.0, -0.06, 1.5e-4)), ("logarithmic", (1.5, 3.0, -1.0, 0.5))])
def test_relations_of_functions(spark, kind, coeffs):
    g = synthesis.ScalarFunction(kind, coeffs, (0.0, 255.0), (0.0, 10.0))
    mean, bins = one(spark, representations.mean_change(g.columns()), representations.sampled_bins(g.columns()))
    assert mean == pytest.approx(g.mean_change(), abs=1e-6)
    assert [tuple(b) for b in bins] == [pytest.approx(b, abs=1e-6) for b in g.bins()]


def test_relation_of_a_line_by_hand():
    """q = 0.1 p on 0..100: from rating 10 down to 0 the parameter falls by 10 a
    step; the three bins end at ratings 10/3 and 20/3 and are sampled at 0, 1, 2,
    3, at 10/3 ... 19/3 and at 20/3 ... 29/3."""
    f = synthesis.ScalarFunction("linear", (0.0, 0.1), (0.0, 100.0), (0.0, 10.0))
    assert f.mean_change() == pytest.approx(-10.0)
    assert f.bins() == [pytest.approx((0.0, 10 / 3, 15.0)), pytest.approx((10 / 3, 20 / 3, 10 * (10 / 3 + 1.5))), pytest.approx((20 / 3, 10.0, 10 * (20 / 3 + 1.5)))]


def test_rules(spark):
    rows = [(i, "x", float(i % 4), "p", 10.0 + i % 4, 1.0, "numeric") for i in range(16)] + [(i, "x", float(i % 4), "on", float(i % 2), None, "boolean") for i in range(16)]
    pairs = spark.createDataFrame(rows, "exp_id long, influence string, influence_value double, parameter string, value double, relative double, kind string")
    bins = rules.influence_bins(pairs.select("influence", F.col("influence_value").alias("value")), bins=2)
    got = {(r["parameter"], r["cond_lo"]): r for r in rules.binned_rules(pairs, bins).collect()}
    assert got[("p", 0.0)]["mean_value"] == 10.5 and got[("p", 0.0)]["action"] == "increase incrementally" and got[("p", 1.5)]["range_end"] == 13.0
    assert got[("on", 0.0)]["action"] == "set" and got[("on", 0.0)]["quantifier"] == 1.0
    merged = {(r["parameter"]): r for r in rules.merged_rules(pairs, bins).collect()}
    assert merged["p"]["cond_lo"] == 0.0 and merged["p"]["cond_hi"] == 3.0 and merged["p"]["n_values"] == 16
    a = rules.binned_rules(pairs, bins)
    m = rules.evaluate(a, a, "low").first()
    assert m["f1"] == 1.0 and m["jaccard"] == 1.0 and m["js_divergence"] == pytest.approx(0.0, abs=1e-12) and m["rule_count"] == 4
    half = rules.evaluate(a, a.where("parameter = 'p'"), "high").first()
    assert half["recall"] == 0.5 or half["precision"] == 1.0


@pytest.mark.parametrize("name", representations.ENCODINGS)
def test_encodings(spark, name):
    rel = spark.createDataFrame([("p", "q", 1.5, [(0.0, 1.0, 2.0), (2.0, 1.0, 3.0)], "increase incrementally")], "parameter string, quality string, mean double, bins array<struct<lo:double,hi:double,value:double>>, action string")
    v, e = representations.encode(rel, name)
    want = {"basic": 1, "unquantified": 1, "quantified_parameters_without_shortcut": 2, "quantified_parameters_with_shortcut": 3, "quantified_parameters_with_literal": 3, "quantified_parameters_w3": 3, "quantified_parameters_w3_with_literal": 3, "quantified_conditions_without_shortcut": 10, "quantified_conditions_with_shortcut": 11, "quantified_conditions_with_literal": 11, "quantified_conditions_w3": 10, "quantified_conditions_w3_with_literal": 10}
    assert e.count() == want[name]
    names = {r["name"] for r in v.collect()}
    assert {x for r in e.collect() for x in (r["src"], r["dst"])} <= names
    entity, literal = representations.triples(v, e, "To")
    assert entity.count() + literal.count() == e.count() and literal.where("value is null").count() == 0


def test_evaluation(spark):
    tr = spark.createDataFrame([("a", "r", "x"), ("a", "r", "y"), ("b", "r", "x"), ("a", "s", "x"), ("b", "s", "x")], "h string, r string, t string")
    te = spark.createDataFrame([("b", "r", "y"), ("c", "u", "x")], "h string, r string, t string")
    b1 = {r["h"]: (r["head_bias"], r["tail_bias"]) for r in evaluation.bias_type1(tr, te).collect()}
    assert b1["b"] == (pytest.approx(1 / 3), pytest.approx(1 / 3)) and b1["c"] == (None, None)
    assert {(r["r"], r["s"]) for r in evaluation.dominating(tr).collect()} == {("r", "s"), ("s", "r")}
    b3 = {r["h"]: r["bias"] for r in evaluation.bias_type3(tr, te).collect()}
    assert b3 == {"b": 0, "c": None}
    keep = spark.createDataFrame([(0.1, 0.1, 0), (None, 0.9, 1), (0.8, 0.1, 0), (0.1, 0.1, 1)], "x double, y double, z int").select(evaluation.keep_unbiased(["x", "y", "z"]).alias("k"))
    assert [r["k"] for r in keep.collect()] == [True, True, False, False]
    ents = spark.createDataFrame([("x",), ("y",), ("z",)], "e string")
    ranks = evaluation.link_ranks(te.limit(1), tr, ents, lambda c: c.withColumn("score", F.when(F.col("t") == "z", 2.0).otherwise(1.0)))
    r = ranks.first()
    assert (r["rank"], r["candidates"]) == (2.0, 2)


def test_training_learns():
    h = np.repeat(np.arange(6), 2)
    t = (h + 6) % 12
    r = np.tile([0, 1], 6)
    numbers = np.linspace(0, 1, 12)[:, None]
    for method in embeddings.METHODS[:-1]:
        s = embeddings.TrainSettings(dim=8, lr=0.02)
        m0, m = embeddings.Model(method, 12, 2, s, numbers), embeddings.train_model(h, r, t, 12, 2, method, 150, s, numbers)
        wrong = (t + 3) % 12
        gap = lambda k: float((k.score(h, r, t)[0] - k.score(h, r, wrong)[0]).mean())
        assert gap(m) > gap(m0)


@pytest.mark.parametrize("method", embeddings.METHODS[:-1])
def test_gradients(method):
    m = embeddings.Model(method, 5, 2, embeddings.TrainSettings(dim=4), np.arange(10.0).reshape(5, 2) / 10)
    h, r, t = np.array([1]), np.array([0]), np.array([3])
    _, gh, gr, gt, extra = m.score_all(h, r, t)
    for name, g in extra.items():
        at, g = (m.extra[name][:1], g) if name == "normal" else (m.extra[name], g)
        for k in np.ndindex(*at.shape):
            at[k] += 1e-6
            up = m.score(h, r, t)[0][0]
            at[k] -= 2e-6
            down = m.score(h, r, t)[0][0]
            at[k] += 1e-6
            assert (up - down) / 2e-6 == pytest.approx(g[k], abs=1e-4), name
    for matrix, row, g in ((m.ent, 1, gh), (m.rel, 0, gr), (m.ent, 3, gt)):
        for k in range(matrix.shape[1]):
            matrix[row, k] += 1e-6
            up = m.score(h, r, t)[0][0]
            matrix[row, k] -= 2e-6
            down = m.score(h, r, t)[0][0]
            matrix[row, k] += 1e-6
            assert (up - down) / 2e-6 == pytest.approx(g[0, k], abs=1e-4)


def test_link_prediction_by_trained_vectors(spark):
    rows = [("g", f"a{i}", r, f"b{(i + k) % 6}") for i in range(6) for k, r in enumerate(("p", "q"))]
    t = spark.createDataFrame(rows, "kg_type string, h string, r string, t string")
    for method, score in evaluation.SCORES.items():
        trained = embeddings.train(t, method, 20, embeddings.TrainSettings(dim=6, lr=0.02)).cache()
        m = {(r["role"], r["name"]): np.array(r["vec"]) for r in trained.collect()}
        model = embeddings.Model(method, 2, 1, embeddings.TrainSettings(dim=6))
        entity, relation = (trained.where(F.col("role") == k).select("name", "vec") for k in ("entity", "relation"))
        for r in score(t.limit(3), entity, relation).collect():
            model.ent, model.rel = np.stack((m["entity", r["h"]], m["entity", r["t"]])), m["relation", r["r"]][None]
            assert r["score"] == pytest.approx(float(model.score(np.array([0]), np.array([0]), np.array([1]))[0][0]))
    got = {r["side"]: r for r in evaluation.link_prediction(trained, method, t.where("h <> 'a0'"), t.where("h = 'a0'")).collect()}
    assert set(got) == {"tail", "head"} and all(-1 <= r["amri"] <= 1 and 0 <= r["hits_at_10"] <= 1 for r in got.values())
    numbers = spark.createDataFrame([("g", "a1", "x", 1.0), ("g", "a2", "x", 3.0), ("g", "zz", "x", 9.0)], "kg_type string, h string, r string, value double")
    for method in embeddings.LITERAL:
        assert embeddings.train(t, method, 2, embeddings.TrainSettings(dim=4), literals=numbers).count() == 14
    words = embeddings.rdf2vec(t.withColumnsRenamed({"h": "src", "r": "rel", "t": "dst"}), dim=5, epochs=2)
    assert {len(r["vec"]) for r in words.collect()} == {5} and words.count() == 14


def test_exact_quantiles(spark):
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=501), np.round(rng.normal(size=400), 1), np.array([3.0]), np.array([1.0, 1.0, 1e9, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "w double")
        for share in (0.25, 0.5, 0.9):
            assert storage.quantile(df, "w", share, 8) == pytest.approx(float(np.quantile(x, share)))
    assert storage.quantile(df.limit(0), "w", 0.5) is None
    n = storage.sample_of(spark.range(1000), 137, ["id"], 5)
    assert n.count() == 137 and sorted(n.collect()) == sorted(storage.sample_of(spark.range(1000).repartition(7), 137, ["id"], 5).collect())


def test_stream_to_a_folder(spark, tmp_path):
    e = spark.createDataFrame(EDGES, "exp_id long, influence string, influence_type string, parameter string, weight double")
    e.write.parquet(str(tmp_path / "in"))
    q = incremental.start(incremental.edge_totals(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))), "to_folder", folder=str(tmp_path / "out"))
    q.awaitTermination()
    got = {(r["influence"], r["parameter"]): (r["weight"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", "p"): (pytest.approx(1.2), 2), ("b", "q"): (0.2, 1), ("b", "p"): (None, 1)}


def test_clustering(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(0, 0.1, (20, 2)), rng.normal(5, 0.1, (20, 2)), rng.uniform(-40, 40, (4, 2))))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "exp_id long, a double, b double")
    got = {r["exp_id"]: r["label"] for r in clustering.cluster(df, 5).collect()}
    assert len(got) == 44
    main = [{got[i] for i in range(k, k + 20) if got[i] >= 0} for k in (0, 20)]
    assert main[0] and main[1] and not main[0] & main[1]
    both = clustering.double_labels(spark.createDataFrame([(1, 0), (2, 0), (3, -1)], "exp_id long, label int"), spark.createDataFrame([(1, 2), (2, -1)], "exp_id long, label int"))
    assert {r["exp_id"]: r["label"] for r in both.collect()} == {1: 1, 2: -1, 3: -1}


def test_features(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 6.0, 1.0, "u"), (10.0, 20.0, 30.0, 15.0, 10.0, "v")], "x double, y double, z double, n double, x2 double, c string")
    m = features.merge_duplicates(df.drop("c"), ["x", "y", "z", "n", "x2"])
    assert m.columns == ["x,y(*2.0),z(*3.0),n(+5),x2"] and [r[0] for r in m.collect()] == [1.0, 10.0]
    s = features.standardise(spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double"), ["a", "b"]).collect()
    assert [tuple(r) for r in s] == [(-1.0, 0.0), (1.0, 0.0)]
    e = features.LabelEncoder.fit(df, ["c"])
    coded = e.transform(df.select("c"), ["c"])
    assert sorted(r["c"] for r in coded.collect()) == [0, 1] and sorted(r["c"] for r in e.inverse(coded, ["c"]).collect()) == ["u", "v"]
    bad = spark.createDataFrame([(1.0,), (math.nan,), (math.inf,), (None,)], "a double")
    assert features.remove_artifacts(bad).count() == 1
    rng = np.random.default_rng(1)
    v = [(float(a), float(b), float(a + b + c * 0.01)) for a, b, c in rng.normal(size=(50, 3))]
    wide = spark.createDataFrame(v, "a double, b double, c double")
    assert len(features.remove_multicollinearity(wide, ["a", "b", "c"]).columns) == 2


def test_settings():
    s = configs.load('{"data": {"n_experiments": 10, "noise": {"share": 0.5}, "series": [{"kind": "trial"}]}}')
    assert s.data.n_experiments == 10 and s.data.series[0].kind == "trial"
    for bad in ('{"data": {}, "stored": "x"}', "{}", '{"data": {"oversize": "never"}}', '{"data": {"unknown": 1}}'):
        with pytest.raises(ValueError):
            configs.load(bad)


def test_sinks(spark, tmp_path):
    emb = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.5])], "vid long, vec array<double>")
    names = spark.createDataFrame([(0, "a b", "quality"), (1, "c", "parameter")], "vid long, name string, type string")
    writers.write_embedding_tsv(emb, str(tmp_path / "emb"), names)
    back = {r["vid"]: (r["vec"], r["name"]) for r in readers.read_embedding_tsv(spark, str(tmp_path / "emb"), str(tmp_path / "emb-names")).collect()}
    assert back == {0: ([1.0, 2.0], "a b"), 1: ([3.0, 4.5], "c")}
    (tmp_path / "rules.csv").write_text("cura_condition;action;parameter_cura;action_quantifier;categorical;range;step_size Cura\ngaps;set;flow;1;no;\"[1;2]\";0.5\n;;x;;;;\nwarp;increase incrementally;temp;;no;>3;\n")
    got = readers.read_rule_csv(spark, str(tmp_path / "rules.csv")).collect()
    assert [(r["condition"], r["range_start"], r["range_end"]) for r in got] == [("gaps", 1.0, 2.0), ("warp", 3.0, None)]
    t = spark.createDataFrame([("a b", "r", "c")], "h string, r string, t string")
    assert writers.relation_lines(t).first()["value"] == "<http://purl.org/pdpk/resource/a%20b> <http://purl.org/pdpk/resource/r> <http://purl.org/pdpk/resource/c> ."
    assert writers.dataset_description(t, "x", "y", "2024-01-01").count() == 5
    v, e = representations.encode(spark.createDataFrame([("p", "q", 1.5, [(0.0, 1.0, 2.0)], "set")], "parameter string, quality string, mean double, bins array<struct<lo:double,hi:double,value:double>>, action string"), "basic")
    writers.write_graph(v.withColumn("kg_type", F.lit("basic")), e.withColumn("kg_type", F.lit("basic")), str(tmp_path / "kg"))
    assert readers.read_graph(spark, str(tmp_path / "kg"), "basic")[1].count() == 1
