"""Spreadsheets, result tables, bias counts and the way from documents to an encoding."""

import random
import statistics
import zipfile
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from insightloom.operators import chain, evaluation, fitting, representations, rules
from insightloom.plans import catalogue
from insightloom.sources import workbook

SF = "/root/testdata/sf0.001"


def test_workbook_round_trip(spark, tmp_path):
    rows = [("a & <b>", 1, 2.5, True), ("", None, -0.1, False), (None, 10**12, None, None), ("ünï \n two", 0, 1e-9, True), ("\x07bell", 3, float("inf"), None)]
    df = spark.createDataFrame(rows, "t string, i long, d double, b boolean").coalesce(1)
    path = f"file://{tmp_path}/x.xlsx"
    workbook.write_workbook({"One": df, 'Zwei "2"': df.limit(0)}, path)
    got = sorted((r["sheet"], r["row"], tuple(r["cells"])) for r in workbook.read_workbook(spark, path).collect())
    assert got[0] == ("One", 1, ("t", "i", "d", "b")) and got[-1] == ('Zwei "2"', 1, ("t", "i", "d", "b"))
    assert [g[2] for g in got[1:-1]] == [("a & <b>", "1", "2.5", "1"), ("", None, "-0.1", "0"), (None, "1000000000000"), ("ünï \n two", "0", "1e-09", "1"), ("bell", "3", "inf")]
    with pytest.raises(ValueError):
        workbook.write_workbook({"One": df}, f"file://{tmp_path}/y.xlsx", most_rows=4)
    with pytest.raises(Exception, match="exist"):
        workbook.write_workbook({"One": df}, path)
    # a file of another program: shared strings, no references
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "z.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="q"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="q" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>first</t></si><si><r><t>sec</t></r><r><t>ond</t></r></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {main}><sheetData><row><c t="s"><v>1</v></c><c><v>4</v></c></row><row r="7"><c r="AB7" t="s"><v>0</v></c></row></sheetData></worksheet>')
    other = {r["row"]: r["cells"] for r in workbook.read_workbook(spark, f"file://{tmp_path}/z.xlsx", "S").collect()}
    assert other[1] == ["second", "4"] and other[7][27] == "first" and len(other[7]) == 28
    assert workbook.read_workbook(spark, f"file://{tmp_path}/*.xlsx", "S").count() == 2


def test_survey(spark, tmp_path):
    cols = "condition string, cond_lo double, cond_hi double, action string, parameter string, param_type string, mean_value double, range_start double, range_end double, step_size double, quantifier double"
    r = spark.createDataFrame([("b", 0.0, 1.0, "set", "p", "boolean", None, None, None, None, 1.0), ("a", 1.0, 2.0, "increase incrementally", "q", "numeric", 5.0, 4.0, 6.0, 0.5, None), ("a", 0.0, 1.0, "decrease incrementally", "q", "numeric", 5.0, 4.0, 6.0, -0.5, None)], cols)
    path = f"file://{tmp_path}/s.xlsx"
    workbook.write_survey(r, path, additional="x")
    got = [(x["condition"], x["cond_lo"], x["action"]) for x in workbook.read_survey(spark, path).orderBy("row").collect()]
    assert got == [("a", 0.0, "decrease incrementally"), ("a", 1.0, "increase incrementally"), ("b", 0.0, "set")]
    about = {x["row"]: x["cells"] for x in workbook.read_workbook(spark, path, workbook.METADATA).collect()}
    assert about[1] == ["Version", "Date", "Additional Data"] and (about[2][0], about[2][2]) == ("v3", "x")
    assert workbook.read_survey(spark, path, "Rule Corrected").count() == 0


def test_bias_counts_against_loops(spark):
    r = random.Random(5)
    facts = [(k, f"h{r.randrange(5)}", f"r{r.randrange(3)}", f"t{r.randrange(4)}", r.choice(["train", "train", "test"])) for k in ("one", "two") for _ in range(70)] + [("one", None, "r0", "t0", "test"), ("none", "h0", "r9", "t0", "test")]
    got = {x["kg_type"]: x.asDict() for x in evaluation.bias_counts(spark.createDataFrame(facts, "kg_type string, h string, r string, t string, split string")).collect()}
    for k in ("one", "two", "none"):
        own = {f[1:] for f in facts if f[0] == k and None not in f}
        tr, te = [f[:3] for f in own if f[3] == "train"], [f[:3] for f in own if f[3] == "test"]
        kept = defaultdict(int)
        pairs = defaultdict(set)
        for h, rel, t in tr:
            pairs[rel].add((h, t))
        for h, rel, t in te:
            seen = [x for x in tr if x[1] == rel]
            for side, at, other in (("head", 0, 2), ("tail", 2, 0)):
                mine = (h, rel, t)
                b1 = sum(x[at] == mine[at] for x in seen) / len(seen) if seen else None
                of = defaultdict(set)
                for x in tr + te:
                    if x[1] == rel:
                        of[x[at]].add(x[other])
                many = max(map(len, of.values())) > 1
                b2 = None if not seen else len({x[other] for x in seen if x[at] == mine[at]}) / len({x[other] for x in seen}) if many else 0.0
                dom = any((h, t) in pairs[s] for s in pairs if s != rel and len(pairs[s] & pairs[rel]) / len(pairs[s]) > 0.5)
                b3 = None if not seen else float(dom)
                for n, bs in (("b1", [(b1, 0.75)]), ("b2", [(b2, 0.5)]), ("b3", [(b3, 1.0)]), ("all", [(b1, 0.75), (b2, 0.5), (b3, 1.0)])):
                    stays = True
                    for b, limit in bs:
                        if b is None:
                            break
                        if b >= limit:
                            stays = False
                            break
                    kept[f"{n}_{side}"] += stays
        assert {c: v for c, v in got[k].items() if c != "kg_type"} == {"train": len(tr), "test": len(te), **{f"{n}_{s}": kept[f"{n}_{s}"] for n in ("b1", "b2", "b3", "all") for s in ("head", "tail")}}
    text = spark.createDataFrame([(90, 100), (0, 0)], "k long, n long").select(evaluation.count_text("k", "n").alias("x")).collect()
    assert [x["x"] for x in text] == ["90 (-0.1%)", None]


def test_result_tables(spark):
    rows = [("basic", 1, "euc", m, k, i, v) for m in ("A", "B") for k in (3, 5) for i, v in enumerate((1.0, 2.5, 4.0))] + [("quantified_conditions_with_literal", 1, "euc", "A", 3, 0, 9.0), ("basic", 0, "jac", "A", 3, 0, 7.0), ("basic", 0, "jac", "A", 3, 1, None), ("basic", 0, "jac", "B", 3, 0, float("nan"))]
    res = spark.createDataFrame(rows, "kg_type string, use_head int, distance string, method string, k int, iteration int, value double")
    got = {(r["use_head"], r["distance"]): (r["A"], r["B"]) for r in evaluation.matches_table(res, 3, ["A", "B"]).collect()}
    text = f"2.50 ± {statistics.stdev((1.0, 2.5, 4.0)):.2f}"
    assert got == {(1, "euc"): (text, text), (0, "jac"): ("7.00 ± 0.00", None)}
    assert evaluation.matches_table(res, 5, ["A"], False).first()["A"] == "2.50"
    link = spark.createDataFrame([("basic", "A", s, m, i, float(i)) for s in ("head", "tail") for m in ("amri", "hits_at_1") for i in range(3)], "kg_type string, method string, side string, metric string, iteration int, value double")
    assert [tuple(r) for r in evaluation.link_table(link, "tail", ["amri", "hits_at_1"]).collect()] == [("basic", "A", 1.0, 1.0)]


def test_rule_table(spark):
    p = catalogue._pairs(spark, SF)
    a, b = catalogue._two_rule_sets(p)
    t = {(r["extraction"], r["level"]): r for r in evaluation.rule_table({"same": a, "moved": b}, a).collect()}
    assert len(t) == 6 and t["same", "low"]["f1"] == 1.0 and t["same", "high"]["fn"] == 0 and t["moved", "mid"]["f1"] < 1.0


def test_documents_to_an_encoding(spark):
    docs = catalogue._docs(spark, SF)
    pairs = chain.pairs_of_documents(docs)
    bins = rules.influence_bins(pairs.select("influence", F.col("influence_value").alias("value")), bins=4)
    for mode, encoding in (("binned_influences", "quantified_conditions_without_shortcut"), ("from_edges", "basic"), ("binned_influences_merged", "quantified_parameters_w3"), ("binned_influences_function", "unquantified")):
        method = fitting.RuleMethod(mode)
        v, e = chain.encode_documents(docs, encoding, 4, method)
        n = fitting.extract(pairs, bins, method).count()
        per = {"quantified_conditions_without_shortcut": 5, "basic": 1, "quantified_parameters_w3": 3, "unquantified": 1}[encoding]
        assert e.count() == n * per > 0
        names = {r["name"] for r in v.select("name").collect()}
        assert {x for r in e.select("src", "dst").distinct().collect() for x in r} <= names
    # a threshold leaves fewer relations, each with its own bins
    few = chain.encode_documents(docs, "basic", 4, fitting.RuleMethod("from_edges"), "mean")[1].count()
    assert 0 < few < chain.encode_documents(docs, "basic", 4, fitting.RuleMethod("from_edges"))[1].count()
    r = spark.createDataFrame([("p", "q", "set", 0.0, 1.0, 5.0), ("p", "q", "set", 1.0, 2.0, 6.0)], "parameter string, condition string, action string, cond_lo double, cond_hi double, mean_value double")
    v, e = representations.encode(representations.relations_from_rules(r), "quantified_conditions_w3")
    assert v.where("type = 'my-ny-relation'").count() == 2 and e.where("rel = 'starts at'").count() == 2
