"""Fitted and merged rules, matchings, bin rules and range joins against NumPy and plain loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from insightloom.operators import evaluation, fitting, graphs, representations, rules, storage

PAIRS = "exp_id long, influence string, influence_value double, parameter string, value double, relative double, kind string"


def _curve(n, f, seed, noise=0.1, influence="i", parameter="p", start=0):
    r = random.Random(seed)
    return [(start + k, influence, x := r.uniform(-2, 3), parameter, f(x) + r.gauss(0, noise), None if k % 4 == 0 else r.gauss(0, 1), "numeric") for k in range(n)]


def _cross_validated(x, y, fold, folds, fits):
    """Reference: least squares on each set of training rows, mean r2."""
    z = (x - x.mean()) / x.std()
    best = None
    for f in fits:
        scores = []
        for k in range(folds):
            tr, te = fold != k, fold == k
            a = np.vander(z[tr], f.degree + 1, increasing=True)
            pen = f.alpha * np.diag([0.0] + [1.0] * f.degree)
            c = np.linalg.solve(a.T @ a + pen, a.T @ y[tr])
            err = y[te] - np.vander(z[te], f.degree + 1, increasing=True) @ c
            scores.append(1 - (err**2).sum() / ((y[te] - y[te].mean()) ** 2).sum())
        s = round(float(np.mean(scores)), 9)
        if best is None or s > best[0]:
            best = (s, f)
    a = np.vander(z, best[1].degree + 1, increasing=True)
    c = np.linalg.solve(a.T @ a + best[1].alpha * np.diag([0.0] + [1.0] * best[1].degree), a.T @ y)
    return best, c


def test_grid_search_against_numpy(spark):
    data = _curve(90, lambda x: 3 + 2 * x, 1, 0.5, parameter="line") + _curve(90, lambda x: x * x - x, 2, 0.3, parameter="bow") + _curve(80, lambda x: x**3 - 2 * x, 3, 0.2, influence="j", parameter="wave")
    df = spark.createDataFrame(data, PAIRS)
    got = {(r["influence"], r["parameter"]): r for r in fitting.best_fits(df, fitting.RuleMethod("binned_influences_function", fitting.GRID, 3), F.col("exp_id") % 3).collect()}
    for key in {(d[1], d[3]) for d in data}:
        rows = [d for d in data if (d[1], d[3]) == key]
        x, y, fold = (np.array([d[i] for d in rows], dtype=float) for i in (2, 4, 0))
        (score, fit), c = _cross_validated(x, y, fold % 3, 3, fitting.GRID)
        r = got[key]
        assert (r["degree"], r["alpha"]) == (fit.degree, fit.alpha) and abs(r["score"] - score) < 1e-6
        assert np.allclose(r["coef"][: fit.degree + 1], c, rtol=1e-6, atol=1e-8) and not any(r["coef"][fit.degree + 1 :])
    assert got["i", "bow"]["degree"] >= 2 and got["j", "wave"]["degree"] == 3


def test_few_values_and_singular_groups(spark):
    rows = [(1, "i", 1.0, "one", 5.0, None, "numeric"), (1, "i", 1.0, "zeros", 0.0, None, "numeric"), (2, "i", 2.0, "zeros", 0.0, None, "numeric"), (1, "i", 1.0, "same", 3.0, None, "numeric"), (2, "i", 1.0, "same", 5.0, None, "numeric")]
    rows += [(k, "i", float(k), "few", 2.0 * k + 1, None, "numeric") for k in range(1, 5)] + [(9, "i", None, "few", 1.0, None, "numeric"), (9, "i", 1.0, "few", None, None, "numeric")]
    df = spark.createDataFrame(rows, PAIRS)
    for folds in (0, 3):
        got = {r["parameter"]: r for r in fitting.best_fits(df, fitting.RuleMethod("binned_influences_function", (fitting.Fit(1),), folds)).collect()}
        assert [got[p]["degree"] for p in ("one", "zeros", "same", "few")] == [0, 0, 0, 1]
        assert [got[p]["coef"][0] for p in ("one", "zeros", "same")] == [5.0, 0.0, 4.0]
        assert abs(got["few"]["coef"][0] - 6) < 1e-9
    assert fitting.best_fits(df.limit(0), fitting.RuleMethod(folds=2)).count() == 0
    with pytest.raises(ValueError):
        fitting.RuleMethod("other")
    with pytest.raises(ValueError):
        fitting.Fit(4)
    assert str(fitting.RuleMethod("from_edges")) == "from_edges" and str(fitting.RuleMethod("binned_influences_function", name="Poly")) == "binned_influences_function_poly"


def test_classes_against_numpy(spark):
    r = random.Random(4)
    rows = [(k, "i", x := r.uniform(0, 9), "c", float(int(x // 3) + (r.random() < 0.1)), None, "string") for k in range(120)] + [(k, "i", x := r.uniform(0, 9), "b", float(x > 4), None, "boolean") for k in range(60)]
    rows += [(k, "i", float(k), "only", 2.0, None, "string") for k in range(5)]
    df = spark.createDataFrame(rows, PAIRS)
    bins = rules.influence_bins(df.select("influence", F.col("influence_value").alias("value")), bins=5)
    edges = bins.first()["edges"]
    got = {(x["parameter"], x["cond_lo"]): x["quantifier"] for x in fitting.classified_rules(df, bins).collect()}
    assert len(got) == 15
    for p in ("c", "b", "only"):
        own = [d for d in rows if d[3] == p]
        x, y = np.array([d[2] for d in own]), np.array([d[4] for d in own])
        a = np.vander((x - x.mean()) / x.std(), 3, increasing=True)
        w = {c: np.linalg.solve(a.T @ a + np.diag([0.0, 1, 1]), a.T @ np.where(y == c, 1.0, -1.0)) for c in sorted(set(y))}
        for lo, hi in zip(edges, edges[1:]):
            z = ((lo + hi) / 2 - x.mean()) / x.std()
            assert got[p, lo] == max(w, key=lambda c: (round(float(w[c] @ [1, z, z * z]), 9), -c))


def test_every_mode_gives_rules(spark):
    df = spark.createDataFrame(_curve(60, lambda x: 2 * x, 7), PAIRS)
    bins = rules.influence_bins(df.select("influence", F.col("influence_value").alias("value")), bins=4)
    n = {m: fitting.extract(df, bins, fitting.RuleMethod(m, name="x")).count() for m in fitting.MODES}
    assert n["from_edges"] == 1 and n["binned_influences"] == 4 == n["binned_influences_function"] and 1 <= n["binned_influences_merged"] <= 4


def _loop_merge(own, n_bins):
    """One rule after the other: the first takes the first later one that is
    like it, until none is; values kept as lists."""
    out, left = [], own
    while left:
        first = left.pop(0)
        k = next((i for i, r in enumerate(left) if r["action"] == first["action"] and r["like"] == first["like"]), None)
        if k is None:
            out.append(first)
            continue
        other = left.pop(k)
        left.insert(0, first | {"hi": other["hi"], "v": first["v"] + other["v"], "r": first["r"] + other["r"]})
    return out


def test_merging_against_lists_of_values(spark):
    r = random.Random(11)
    rows = []
    for k in range(400):
        x = r.uniform(0, 10)
        rows.append((k, f"i{k % 2}", x, f"p{k % 3}", 10 + r.gauss(0, 3), None if k % 7 == 0 else r.choice((-1, 1)) * r.uniform(0.5, 3) + math.sin(x), "numeric"))
    df = spark.createDataFrame(rows, PAIRS)
    bins = rules.influence_bins(df.select("influence", F.col("influence_value").alias("value")), bins=9)
    plain = rules.binned_rules(df, bins).collect()
    edges = {b["influence"]: b["edges"] for b in bins.collect()}
    got = {(x["condition"], x["parameter"], round(x["cond_lo"], 9), x["action"]): x for x in rules.merged_rules(df, bins, 3).collect()}
    n = 0
    for i in ("i0", "i1"):
        for p in ("p0", "p1", "p2"):
            own = []
            mine = sorted((x for x in plain if (x["condition"], x["parameter"]) == (i, p)), key=lambda x: x["cond_lo"])
            steps = np.linspace(min(x["step_size"] for x in mine), max(x["step_size"] for x in mine), 4)
            for x in mine:
                last = x["cond_hi"] == edges[i][-1]
                inside = [d for d in rows if d[1] == i and d[3] == p and x["cond_lo"] <= d[2] and (d[2] < x["cond_hi"] or last)]
                like = 3 if x["step_size"] == steps[-1] else int(sum(e <= x["step_size"] for e in steps))
                own.append({"lo": x["cond_lo"], "hi": x["cond_hi"], "action": x["action"], "like": like, "v": [d[4] for d in inside], "r": [d[5] for d in inside if d[5] is not None]})
            for m in _loop_merge(own, 3):
                g = got[i, p, round(m["lo"], 9), m["action"]]
                v = np.array(m["v"])
                assert g["n_values"] == len(v) and g["cond_hi"] == m["hi"]
                assert np.allclose([g["mean_value"], g["range_start"], g["range_end"], g["step_size"]], [v.mean(), v.mean() - v.std(), v.mean() + v.std(), np.mean(m["r"]) if m["r"] else 0.0])
                n += 1
    assert n == len(got) < len(plain)


RULE = "condition string, cond_lo double, cond_hi double, action string, parameter string, param_type string, mean_value double, range_start double, range_end double, step_size double, quantifier double"


def _rule(parameter, lo, hi, step=1.0):
    return ("c", lo, hi, "increase incrementally", parameter, "numeric", 5.0, 4.0, 6.0, step, None)


def test_matching_against_the_loop(spark):
    r = random.Random(3)
    base = [_rule(f"p{k % 2}", a := r.randrange(20), a + r.randrange(1, 9)) for k in range(25)]
    pred = [_rule(f"p{k % 3}", a := r.randrange(20), a + r.randrange(1, 9)) for k in range(30)]
    base, pred = sorted(set(base)), sorted(set(pred))
    meet = lambda a, b: a[4] == b[4] and a[1] < b[2] and b[1] < a[2]

    def level(a, b):
        return rules.high_equal(a, b) & (F.col(f"{a}.cond_lo") < F.col(f"{b}.cond_hi")) & (F.col(f"{b}.cond_lo") < F.col(f"{a}.cond_hi"))

    name = F.format_string("%s|%05.1f|%05.1f", "parameter", "cond_lo", "cond_hi")
    key = lambda x: f"{x[4]}|{x[1]:05.1f}|{x[2]:05.1f}"
    b, p = spark.createDataFrame([tuple(map(lambda v: float(v) if isinstance(v, int) else v, x)) for x in base], RULE), spark.createDataFrame([tuple(map(lambda v: float(v) if isinstance(v, int) else v, x)) for x in pred], RULE)
    # each side at most once, in order
    free, want = set(map(key, pred)), set()
    for x in sorted(base, key=key):
        for y in sorted(pred, key=key):
            if key(y) in free and meet(x, y):
                free.discard(key(y))
                want.add((key(x), key(y)))
                break
    assert {tuple(t) for t in rules.one_to_one(b, p, level, name).collect()} == want and want
    # the evaluation: each found prediction once, what matches anything is found
    sets = {x["key"]: (x["truth"], x["pred"]) for x in rules.evaluation_sets(b, p, level).collect()}
    counts = {k: sum(v == k for v in sets.values()) for k in ((1, 1), (0, 1), (1, 0))}
    found, hit = {key(y) for y in pred if any(meet(x, y) for x in base)}, {key(x) for x in base if any(meet(x, y) for y in pred)}
    assert counts == {(1, 1): len(found), (0, 1): len(pred) - len(found), (1, 0): len(base) - len(hit)}
    assert rules.one_to_one(b.limit(0), p, level, name).count() == 0


def test_quantiles_of_groups(spark):
    r = random.Random(8)
    groups = {"many": [r.gauss(0, 100) for _ in range(3000)], "one": [4.5], "same": [7.0] * 50, "two": [-1.0, 1e9], "far": [1e-300, 1.0, 1e300, -1e308, 1.7e308], "ints": [float(k % 13) for k in range(500)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("many", None), (None, 1.0), ("many", float("inf")), ("none", None)]
    got = {(x["g"], x["share"]): x["quantile"] for x in storage.quantiles_by(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", (0.0, 0.25, 0.5, 0.9, 1.0), 16).collect()}
    assert set(got) == {(g, s) for g in groups for s in (0.0, 0.25, 0.5, 0.9, 1.0)}
    for (g, s), v in got.items():
        with np.errstate(over="ignore"):
            want = np.quantile(groups[g], s)
        assert np.isclose(v, want, rtol=1e-12, atol=0) or not np.isfinite(want)


@pytest.mark.parametrize("rule", ["sturges", "rice", "sqrt", "scott", "fd", "doane"])
def test_bin_rules_against_numpy(spark, rule):
    r = np.random.default_rng(5)
    groups = {"a": r.normal(3, 2, 400), "b": r.exponential(4, 90), "c": np.array([1.0, 2.0, 9.0]), "d": np.array([5.0] * 8), "e": np.array([0.0] * 30 + [1.0])}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "influence string, value double")
    for b in rules.influence_bins(df, bins=rule).collect():
        want = np.histogram_bin_edges(groups[b["influence"]], rule)
        assert np.allclose(b["edges"], want), (rule, b["influence"])
    fixed = rules.influence_bins(df, bins=[0, 1.5, 4])
    assert {tuple(b["edges"]) for b in fixed.collect()} == {(0.0, 1.5, 4.0)} and fixed.count() == 5
    for bad in ([1], [2, 1], "other"):
        with pytest.raises(ValueError):
            rules.influence_bins(df, bins=bad)


def test_interval_join_against_every_pair(spark):
    r = random.Random(2)
    ends = [0.0, 1.0, -1.0, 1e-300, 1e300, float("inf"), float("-inf"), 0.5, None]
    ranges = [(k, r.choice("ab"), r.choice(ends) if k % 5 == 0 else r.uniform(-5, 5) * 10 ** r.randrange(-3, 4), r.choice(ends) if k % 7 == 0 else r.uniform(-5, 5) * 10 ** r.randrange(-3, 4)) for k in range(200)] + [(900, None, 0.0, 1.0)]
    values = [(k, r.choice("abc"), r.choice(ends[:7]) if k % 9 == 0 else r.uniform(-5, 5) * 10 ** r.randrange(-3, 4)) for k in range(150)] + [(900, "a", None), (901, None, 0.5)]
    a, b = spark.createDataFrame(ranges, "id long, q string, start double, end double"), spark.createDataFrame(values, "vid long, q string, value double")
    got = sorted((x["id"], x["vid"]) for x in graphs.interval_join(a, b, ["q"]).select("id", "vid").collect())
    want = sorted((i, v) for i, q, s, e in ranges for v, p, x in values if q is not None and q == p and None not in (s, e, x) and min(s, e) < x < max(s, e))
    assert got == want and want
    plan = graphs.interval_join(a, b, ["q"])._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def _subgraph_by_hand(vertices, edges, q, x, ternary, skip):
    number = {v["name"]: v["literal_value"] for v in vertices}
    all_edges = lambda n: [e for e in edges if n in (e[0], e[2])]

    def holds(node):
        s, t = (next(float(number[e[2]]) for e in all_edges(node) if e[1] == k) for k in ("starts at", "ends at"))
        return s < x < t or t < x < s

    out = set()
    if ternary:
        for e in all_edges(q):
            out.add(e)
            for f in [f for f in edges if f[0] == e[2]]:
                if f[1] == "implied parameter":
                    out.add(f)
                elif f[1] == "quantified by" and holds(f[2]):
                    out |= {g for g in all_edges(f[2]) if not skip or g[3] == "None"}
        return out
    for e in all_edges(q):
        if e[1] == "implies":
            out.add(e)
        elif e[1] == "quantified by" and holds(e[2]):
            for m in all_edges(e[2]):
                if m[1] == "quantified by" or not skip:
                    out.add(m)
                if not skip and m[1] == "implies":
                    out |= {n for n in all_edges(m[2]) if n[1] == "quantified by"}
    return out


@pytest.mark.parametrize("name", ["quantified_conditions_w3", "quantified_conditions_with_shortcut", "quantified_conditions_without_shortcut"])
@pytest.mark.parametrize("skip", [False, True])
def test_quantified_subgraphs_by_hand(spark, name, skip):
    bins = [(0.0, 2.0, 5.0), (4.0, 1.5, 6.0)]
    rel = spark.createDataFrame([("p1", "q1", 1.0, bins, "set"), ("p2", "q1", 2.0, bins[:1], "increase incrementally"), ("p1", "q2", 3.0, bins, "adjust incrementally")], "parameter string, quality string, mean double, bins array<struct<lo:double,hi:double,value:double>>, action string")
    v, e = representations.encode(rel, name)
    vs, es = v.collect(), [tuple(x) for x in e.collect()]
    asked = spark.createDataFrame([("q1", 1.0), ("q1", 1.8), ("q1", 2.0), ("q2", 3.0), ("q2", 9.0), ("none", 1.0)], "q string, value double")
    got = {}
    for x in graphs.quantified_subgraph(v, e, asked, "w3" in name, skip).collect():
        got.setdefault((x["q"], x["value"]), set()).add(tuple(x)[2:])
    for a in asked.collect():
        assert got.get(tuple(a), set()) == _subgraph_by_hand(vs, es, a["q"], a["value"], "w3" in name, skip)


@pytest.mark.parametrize("method", ["TransE", "DistMult", "ComplEx", "RotatE"])
def test_ranks_by_vectors_against_every_pair(spark, method):
    r = np.random.default_rng(6)
    ents = {f"e{i}": r.integers(-3, 4, 4).astype(float) for i in range(40)}
    ents["e39"] = ents["e38"]  # ties
    rels = {f"r{i}": r.integers(-2, 3, 2 if method == "RotatE" else 4).astype(float) for i in range(3)}
    trip = sorted({(f"e{r.integers(40)}", f"r{r.integers(3)}", f"e{r.integers(40)}") for _ in range(120)} | {("e1", "r0", "e38"), ("e1", "r0", "e39")})
    test, train = trip[::4] + [("e1", "r0", "e38"), ("unknown", "r0", "e1")], trip

    def score(h, rel, t):
        h, t, w = ents[h], ents[t], rels[rel]
        if method == "TransE":
            return -((h + w - t) ** 2).sum()
        if method == "DistMult":
            return (h * w * t).sum()
        hc, tc = h[:2] + 1j * h[2:], t[:2] + 1j * t[2:]
        if method == "ComplEx":
            return (hc * (w[:2] + 1j * w[2:]) * tc.conj()).sum().real
        return -(np.abs(hc * np.exp(1j * w) - tc) ** 2).sum()

    want = {}
    for h, rel, t in set(test):
        if h in ents and t in ents:
            for side in ("tail", "head"):
                tr = lambda e: (h, rel, e) if side == "tail" else (e, rel, t)
                rivals = [round(score(*tr(e)), 9) for e in ents if tr(e) not in trip and tr(e) != (h, rel, t)]
                s = round(score(h, rel, t), 9)
                want[h, rel, t, side] = (sum(x > s for x in rivals) + 1 + sum(x == s for x in rivals) / 2, len(rivals) + 1)
    frame = lambda rows, kind: spark.createDataFrame([(k, v.tolist()) for k, v in rows.items()], f"{kind} string, vec array<double>")
    df = lambda rows: spark.createDataFrame(rows, "h string, r string, t string")
    out = evaluation.link_ranks_by_vectors(df(test), df(train), frame(ents, "e"), frame(rels, "r"), method, block=7)
    got = {(x["h"], x["r"], x["t"], x["side"]): (x["rank"], x["candidates"]) for x in out.collect()}
    assert set(got) == set(want)
    if method in ("TransE", "DistMult"):  # whole numbers: ties are exact
        assert got == want
    else:
        assert all(abs(got[k][0] - want[k][0]) <= 1 and got[k][1] == want[k][1] for k in want)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
