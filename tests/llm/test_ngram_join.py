"""N-gram Jaccard join and components against brute force."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from insightloom.llm import ngram_join, queries
from insightloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, k=5):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    kk = min(k, len(w))
    return frozenset(tuple(w[i : i + kk]) for i in range(len(w) - kk + 1)) if w else frozenset()


def union_find(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[find(a)] = find(b)
    return [find(i) for i in range(n)]


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    index = defaultdict(list)
    first = {}
    links = []
    for i, s in enumerate(sets):
        if not s:
            continue
        if s in first:
            links.append((i, first[s]))
            continue
        first[s] = i
        near = Counter(j for g in s for j in index[g])
        links += [(i, j) for j, c in near.items() if 100 * c >= 75 * (len(s) + len(sets[j]) - c)]
        for g in s:
            index[g].append(i)
    root = union_find(len(rows), links)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(least.get(root[i], d), d)
    return Counter((d, len(sets[i]), least.get(root[i])) for i, (d, _) in enumerate(rows)), root


def fixture(seed=1, n=400):
    rng = np.random.default_rng(seed)
    vocab = np.array([f"W{i}" for i in range(300)])
    base = [list(rng.choice(vocab, int(rng.integers(3, 90)))) for _ in range(12)]
    common = list(rng.choice(vocab, 25))
    rows = [(100_000, None), (100_001, ""), (100_002, " \n"), (None, "lonely words only here now"), (100_003, "one two"), (100_004, "ONE  two"), (100_005, "two one")]
    for i in range(n):
        w = list(base[int(rng.integers(len(base)))]) if rng.random() < 0.8 else list(rng.choice(vocab, int(rng.integers(1, 60))))
        for _ in range(int(rng.integers(0, 3 + len(w) // 25))):
            w[int(rng.integers(len(w)))] = str(rng.choice(vocab))
        if rng.random() < 0.3:
            w = w[: len(w) // 2] + common + w[len(w) // 2 :]
        rows.append((int(rng.integers(0, 5000)) if i % 50 else 7, " ".join(w)))
    return rows + rows[20:30] + [(None, rows[40][1])]


def make(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC)


@pytest.mark.parametrize("seed,local", [(1, 8), (2, 1), (3, 10_000)])
def test_classes_match_brute_force(spark, seed, local):
    rows = fixture(seed)
    got = ngram_join.jaccard_classes(make(spark, rows).repartition(3), local=local).collect()
    want, _ = brute(rows)
    least = {}
    for r in got:
        if r["component"] is not None and r["doc_id"] is not None:
            c = bytes(r["component"])
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    found = Counter((r["doc_id"], r["n"], least.get(bytes(r["component"])) if r["component"] is not None else r["doc_id"]) for r in got)
    assert found == want


@pytest.mark.parametrize("rounds", [0, 1])
def test_remaining_pairs_after_few_rounds(spark, rounds):
    rows = [r for r in fixture(7, 150) if r[0] is not None]
    got = ngram_join.jaccard_classes(make(spark, rows), rounds=rounds).collect()
    least = {}
    for r in got:
        if r["component"] is not None:
            c = bytes(r["component"])
            least[c] = min(least.get(c, r["doc_id"]), r["doc_id"])
    assert Counter((r["doc_id"], r["n"], least[bytes(r["component"])] if r["component"] is not None else r["doc_id"]) for r in got) == brute(rows)[0]


def test_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op2_ngram_join(spark, sf).collect())
    assert got == brute(rows)[0]


def test_keep_one(spark):
    rows = fixture(4)
    kept = [(r["doc_id"], r["text"]) for r in ngram_join.keep_one(make(spark, rows)).collect()]
    _, root = brute(rows)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root[i] if shingles(r[1]) else ("none", i)].append(r)
    assert len(kept) == len(groups)
    have = Counter(kept)
    for g in groups.values():
        least = min(x[0] if x[0] is not None else 1 << 62 for x in g)
        assert any(have[x] for x in g if (x[0] if x[0] is not None else 1 << 62) == least)
    assert ngram_join.keep_one(make(spark, [])).count() == 0


def test_keep_one_carries_any_column(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, "mine", 1, "x", "p"), (6, text, "mine", 2, "y", "q"), (None, None, "no id", 3, "z", "r"), (None, None, "no id", 4, "z", "r"), (None, " ", "blank", 5, "z", "r"), (5, text, "mine", 1, "x", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, r_ string, d_ int, place_d string, Place_R string")
    got = Counter(tuple(r) for r in ngram_join.keep_one(docs).collect())
    assert got == Counter([rows[0], *rows[2:5]])


def test_many_short_documents_in_one_batch(spark):
    """Pairs far apart in an Arrow batch of more than 65,536 rows."""
    n, half = 70_000, 35_000
    words = F.concat_ws(" ", *(F.concat(F.lit(x), (F.col("id") % half).cast("string")) for x in "abcdef"))
    docs = spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") % half < 2_000, F.concat(words, F.lit(" "), F.when(F.col("id") < half, "one").otherwise("one"))).otherwise(F.concat_ws(" ", words, F.col("id").cast("string"), F.lit("x y z q"))).alias("text"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")
    try:
        linked = ngram_join.jaccard_join(docs).where("doc_id <> component_id").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {r["doc_id"]: r["component_id"] for r in linked} == {half + i: i for i in range(2_000)}


def test_bounds():
    rng = np.random.default_rng(0)
    for _ in range(300):
        pool = rng.integers(-(1 << 63), 1 << 63, 60)
        x, y = (np.unique(pool[rng.integers(0, 60, int(rng.integers(1, 50)))]) for _ in range(2))
        away = len(set(x.tolist()) ^ set(y.tolist()))
        assert np.abs(ngram_join.part_sizes(x) - ngram_join.part_sizes(y)).sum() <= away
        bits = np.bitwise_count((ngram_join.parity_sketch(x) ^ ngram_join.parity_sketch(y)).view(np.uint64)).sum()
        assert bits <= away


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = union_find(600, links)
    least = {}
    for i, r in enumerate(root):
        least[r] = min(least.get(r, i), i)
    for i in range(600):
        assert got.get(i, i) == least[root[i]]


def test_words_that_collide_in_polynomial_hashes(spark):
    """Thue-Morse words of any length are different words."""
    for n in (1024, 2048, 4096):
        t = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
        u = t.translate(str.maketrans("ab", "ba"))
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_join(spark.createDataFrame([(1, t), (2, u), (3, u)], "doc_id long, text string")).collect()}
        assert got == {1: 1, 2: 2, 3: 2}


def test_word_hashes_tell_words_apart():
    from itertools import product

    from insightloom.llm.common import Words

    words = ["".join(p) for n in range(1, 6) for p in product("ab\x00", repeat=n)] + [w * k for w in ("ab", "ba", "a\x00") for k in range(3, 40)]
    words = sorted(set(words))
    for lower in (False, True):
        h = Words([" ".join(words)], lower).hashes()
        assert len(h) == len(words) == len(set(h.tolist()))
    mixed = Words(["Word LONGERTHANEIGHT word longerthaneight"], True).hashes().tolist()
    assert mixed[:2] == mixed[2:]


def test_chains_stay_whole(spark):
    """Texts that only link with their neighbours: a round's labels may be less than its components, and its links are not looked at again."""
    rows = [(chain * 1000 + i, " ".join(f"c{chain}w{j}" for j in range(5 * i, 5 * i + 44))) for chain in range(30) for i in range(25)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.jaccard_join(make(spark, rows)).collect()}
    assert got == {d: d // 1000 * 1000 for d, _ in rows}


def test_messages_of_short_runs_stay_small():
    """Runs of one n-gram, as many shards make them: little beside the n-grams themselves, fingerprints for copies only."""
    import zlib

    rng = np.random.default_rng(5)
    token, doc = rng.integers(1 << 63, size=900, dtype=np.uint64), np.sort(rng.integers(600, size=900).astype(np.uint32))
    short = rng.integers(1 << 63, size=600, dtype=np.uint64)
    none = np.empty(0, dtype=np.uint64)
    copied = np.arange(600) % 50 == 0
    blob = ngram_join._asked(7 << 32, token, doc, short, copied, none, none.astype(np.uint32))
    assert len(zlib.compress(blob, 1)) < 10.5 * len(token)
    batch, got, d, n, fp, *_ = ngram_join._told(blob)
    assert batch[0] == 7 << 32 and (got == token).all() and (np.repeat(d, n) == doc).all()
    assert (fp[copied[d]] == short[d[copied[d]]]).all() and len(set(fp.tolist())) == len(d)
    other = ngram_join._told(ngram_join._asked(7 << 32 | 1, token, doc, short, copied, none, none.astype(np.uint32)))[4]
    assert ((other == fp) == copied[d]).all()  # of two batches, only copies count as one set
    empty = ngram_join._told(ngram_join._asked(1, none, none.astype(np.uint32), short, copied, token[:2], np.array([3, 4], dtype=np.uint32)))
    assert [len(x) for x in empty[1:]] == [0, 0, 0, 0, 2, 2]


def test_repeated_texts_are_known(spark):
    texts = ["one", "two", None, "two", "", "", None, "three"]
    bits = ngram_join._copies(spark.createDataFrame([(t,) for t in texts], "text string"))
    slot = [xxhash.xxh64_intdigest(t.encode(), seed=42) % ngram_join.SLOTS for t in ("one", "two", "three", "")]
    assert [bool(bits[x >> 3] >> (x & 7) & 1) for x in slot] == [False, True, False, True] and len(bits) == ngram_join.SLOTS // 8
    assert not ngram_join._copies(spark.createDataFrame([], "text string")).any()


def test_settled_ngrams_are_not_met_again(spark, monkeypatch):
    """Once all holders of an n-gram have one label, later rounds leave it out."""
    words = [f"w{i}" for i in range(200)]
    rows = [(g * 100 + i, " ".join(f"{w}g{g}" for w in words) + f" end{i}") for g in range(3) for i in range(12)]
    sizes, real = {}, ngram_join.materialise

    def counted(df, name):
        out = real(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "materialise", counted)
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i // 100 * 100 for i, _ in rows}
    assert sizes["held"][0] > 500 and sizes["held"][-1] < sizes["held"][0] / 10 and max(sizes["member"][1:]) < sizes["held"][0] / 10
