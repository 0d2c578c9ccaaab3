"""The pipeline stage by stage against brute-force versions."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from insightloom.llm import quality_rules

from .test_ngram_join import brute, shingles
from .test_operators import brute_contamination, brute_windows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def rows(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_on_the_smallest_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stage = dict(corpus_pipeline.STAGES)

    kept = stage["quality rules"](spark, docs, SF).cache()
    assert kept.columns == columns
    fine = {d for d, t in rows(docs) if quality_rules.assess(t)["kept"]}
    lines = lambda t: "\n".join(x for x in (t or "").split("\n") if quality_rules.line_fault(x) is None)
    assert Counter(rows(kept)) == Counter((d, lines(t)) for d, t in rows(docs) if d in fine and quality_rules.assess(t)["kept"])
    assert all(r["n_chars"] == len(r["text"]) for r in kept.collect())

    one = stage["n-gram jaccard join"](spark, kept, SF).cache()
    have = rows(kept)
    _, root = brute(have)
    least = {}
    for (d, _), c in zip(have, root):
        least[c] = min(least.get(c, d), d)
    assert one.columns == columns
    assert sorted(d for d, _ in rows(one)) == sorted(least.values())

    cut = stage["substring dedup"](spark, one, SF).cache()
    assert cut.columns == columns
    want = {k[0]: k[1] - k[2] for k in brute_windows(rows(one))}
    assert {r["doc_id"]: len(WORD.findall(r["text"])) for r in cut.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect() if want[r["doc_id"]] != len(WORD.findall(dict(rows(one))[r["doc_id"]])))

    clean = stage["benchmark decontamination"](spark, cut, SF).cache()
    assert clean.columns == columns
    assert sorted(d for d, _ in rows(clean)) == sorted(d for (d, hits) in brute_contamination(rows(cut), items) if not hits)

    by_doc = defaultdict(int)
    packed = stage["packing"](spark, clean, SF).collect()
    for r in packed:
        by_doc[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert {d for d, _ in by_doc} == {d for d, _ in rows(clean)} and all(n == total for (_, n), total in by_doc.items())


@pytest.mark.parametrize("stage", [s for s, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows(spark, stage):
    odd = [(1, None, None, None, None), (None, "", "en", "s", 0), (2, "word " * 20_000, None, None, 7), (2, "word " * 20_000, None, None, 7), (3, "A plain line that ends well. " * 3 + " ".join(f"w{i}" for i in range(80)) + ".", "en", "s", 1), (3, "A plain line that ends well. " * 3 + " ".join(f"w{i}" for i in range(80)) + ".", "en", "s", 1)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in odd], "doc_id long, text string, lang string, source string, n_chars long, item_id string, fp int")
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, SF)
    assert len(out.collect()) > 0
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs.limit(0), SF).count() == 0
    if stage != "packing":
        assert out.columns == list(corpus_pipeline.COLUMNS)
    if stage == "n-gram jaccard join":
        got = Counter(r["doc_id"] for r in out.collect())
        assert got == Counter({1: 1, None: 1, 2: 1, 3: 1}), (got, [len(shingles(t)) for _, t, *_ in odd])


def test_run(spark):
    """run() is its stages one after another; sequences hold their tokens without gaps."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
    out = corpus_pipeline.run(spark, SF).collect()
    total = {r["doc_id"]: r["doc_tokens"] for r in out}
    assert set(total) == {r["doc_id"] for r in docs.select("doc_id").collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts, ends in ((pieces, total), (sequences, None)):
        for key, spans in parts.items():
            at = 0
            for start, length in sorted(spans):
                assert start == at
                at += length
            assert at == ends[key] if ends else at <= 2048
