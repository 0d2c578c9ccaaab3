"""Operators against brute-force versions on fixtures and the smallest tables."""

from __future__ import annotations

import hashlib
import re
import time
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from insightloom.llm import chat_snapshots, decontaminate, language_id, license_scan, packing, quality_rules, queries, substring_dedup, token_counts, url_rules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None, "x") for i, t in rows], DOC)


def edge_rows():
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(40)]
    long = " ".join(rng.choice(vocab, 30_000))
    passage = " ".join(rng.choice(vocab, 60))
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, passage), (4, passage), (5, passage), (5, passage), (6, "a b " + passage + " c"), (7, long), (8, long[100:20_000]), (9, "Ünïcödé — ‘quotes’ \u00a0nbsp \u2028sep")]
    rows += [(100 + i, " ".join(rng.choice(vocab, 50)) + "\n" + passage + " " + " ".join(rng.choice(vocab, int(rng.integers(0, 40))))) for i in range(30)]
    return rows


def brute_windows(rows, k=13):
    first = {}
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in words:
        if i is not None:
            for s in range(len(w) - k + 1):
                g = tuple(w[s : s + k])
                first[g] = min(first.get(g, i), i)
    out = Counter()
    for i, w in words:
        gone = [False] * len(w)
        if i is not None:
            for s in range(len(w) - k + 1):
                if first[tuple(w[s : s + k])] < i:
                    gone[s : s + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def as_counter(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("settings", [{}, {"local_copies": 1, "shard_words": 100}, {"local_copies": 1000}])
def test_substring_dedup_edges(spark, settings):
    rows = edge_rows()
    got = substring_dedup.remove_repeats(docs(spark, rows), **settings)
    assert as_counter(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_windows(rows)
    for r in got.collect():
        kept = " ".join(WORD.findall(r["kept_text"] or ""))
        assert hashlib.sha256(kept.encode()).hexdigest() == r["kept_sha256"]


@pytest.mark.parametrize("rows", [[(1, "two words"), (2, "two words")], [(1, "")], [(1, None)], [(1, "a " * 12), (2, "a " * 13), (3, "a " * 13)]])
def test_substring_dedup_of_short_texts_only(spark, rows):
    got = substring_dedup.remove_repeats(docs(spark, rows).coalesce(1))
    assert as_counter(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_windows(rows)


@pytest.mark.parametrize("settings", [{}, {"local_copies": 1, "shard_words": 30}])
def test_substring_dedup_of_repeated_ids(spark, settings):
    """Rows of one id and different texts each lose what smaller ids hold."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(20)) for x in "abc")
    rows = [(1, a), (2, a + " tail"), (2, b + " " + c), (2, "short"), (2, ""), (2, None), (2, "x " + a), (3, b + " end"), (3, "other " + c), (3, c), (3, c)]
    got = substring_dedup.remove_repeats(docs(spark, rows), **settings)
    assert as_counter(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_windows(rows)
    cut = substring_dedup.cut_documents(docs(spark, rows).withColumn("n_chars", F.length("text")))
    assert Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in cut.collect()) == Counter((i, n - k) for (i, n, k, _), m in brute_windows(rows).items() for _ in range(m))


def test_substring_dedup_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = queries.op3_substring_dedup(spark, SF)
    want = brute_windows(rows)
    assert as_counter(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert any(k[2] for k in want)


def test_fm_index_matching():
    rng = np.random.default_rng(1)
    frags = [rng.integers(0, 5, int(rng.integers(1, 30))) for _ in range(40)]
    owner = rng.integers(0, 100, 40)
    index = substring_dedup.FmIndex(np.concatenate(frags), np.array([len(f) for f in frags]), owner)
    for q in range(40):
        f = frags[q]
        last = np.arange(3, len(f))
        low = index.matching(f, last, np.full(len(last), 50), 4)
        for x, e in enumerate(last.tolist()):
            pat = f[e - 3 : e + 1].tolist()
            own = [owner[i] for i, g in enumerate(frags) for s in range(len(g) - 3) if g[s : s + 4].tolist() == pat]
            assert low[x] == (min(own) if min(own) < 50 else substring_dedup.NOBODY)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    rows = edge_rows()[:20] + [(50, "<|endoftext|> x<|startoftext|>y Σας ΑΣ İ é e\u0301 \u0301a it's 12ab Word., Ünï!! don't. ßẞ; K. \u00aa: ...a")]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter((i, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in rows)
    got = packing.pack(docs(spark, rows).coalesce(2), public_tokenizers.path("word_bpe_49k.json"), with_ids=True).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] > 0
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    found = Counter()
    for (d, n), pieces in by_doc.items():
        copies = sum(p["length"] for p in pieces) // n
        pieces.sort(key=lambda r: r["start"])
        ids: list = []
        for p in pieces:
            if p["start"] == len(ids):
                ids += p["ids"]
        assert len(ids) == n
        found[d, tuple(ids)] += copies
    assert found == want
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048


def test_word_cache_over_every_letter():
    """The cache of parts gives the tokenizer's ids for every character below
    U+0250, some beyond, alone, inside words and beside digits."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, cache = Tokenizer.from_file(path), packing.WordCache(path)
    chars = [chr(i) for i in range(0x260)] + list("ΩΣςẞﬁ中\u212a\u212b\u0307\u200d😀")
    rng = np.random.default_rng(2)
    texts = [f for c in chars for f in (c, f"x{c}y", f"{c}Y{c}", f"B{c} {c}b", f"1{c}2", f"'{c}s")] + ["".join(rng.choice(chars, 9)) for _ in range(20_000)]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    got = cache.ids_of_texts(texts)
    assert [t for t, w, g in zip(texts, want, got, strict=True) if w != g.tolist()] == []


def test_packing_pads_little(spark):
    seq = queries.op8_packing(spark, SF).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    used = sum(r["n"] for r in seq)
    padding = sum(0 if r["n"] & (r["n"] - 1) == 0 else 2048 - r["n"] for r in seq)
    assert padding <= 0.01 * used


def greedy(word: bytes, vocab: set) -> int:
    n = i = 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in vocab), None)
        if j is None:
            return -1
        i, n = j, n + 1
    return n


def test_longest_match_counts():
    rng = np.random.default_rng(5)
    for _ in range(60):
        vocab = {bytes(rng.integers(97, 100, int(rng.integers(1, 6)))) for _ in range(int(rng.integers(1, 12)))}
        m = token_counts.LongestMatch(vocab)
        for _ in range(60):
            w = bytes(rng.integers(97, 100, int(rng.integers(0, 12))))
            assert m.count(w) == greedy(w, vocab), (vocab, w)


def test_token_counts_table(spark):
    vocab = set(token_counts.byte_level_pieces(public_tokenizers.path("byte_bpe_50k.json")))
    memo: dict = {}
    for r in queries.op9_token_counts(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        n = [memo.setdefault(w, greedy(b" " + w.encode(), vocab)) for w in WORD.findall(r["text"] or "")]
        assert (r["n_words"], r["n_tokens"], r["max_word_tokens"]) == (len(n), sum(n), max(n, default=0))


def brute_contamination(rows, items, k=5, t=0.75):
    out = Counter()
    low = lambda s: WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or ""))
    for d, text in rows:
        w = low(text)
        hits = []
        for i, it in items:
            v = low(it)
            kk = min(k, len(v))
            if not v or i is None:
                continue
            a = {tuple(v[j : j + kk]) for j in range(len(v) - kk + 1)}
            b = {tuple(w[j : j + kk]) for j in range(len(w) - kk + 1)}
            if len(a & b) >= t * len(a):
                hits.append(i)
        out[d, tuple(sorted(hits))] += 1
    return out


def test_decontaminate_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = Counter((r["doc_id"], tuple(map(int, filter(None, r["item_ids"].split(","))))) for r in queries.op10_decontaminate(spark, SF).collect())
    assert got == brute_contamination(rows, items)
    assert any(k[1] for k in got)


def test_decontaminate_edges(spark):
    rows = edge_rows()
    items = [(1, rows[4][1]), (2, rows[4][1]), (3, None), (4, ""), (5, "w1 w2"), (6, "W3"), (None, "w4"), (7, rows[7][1][:4000]), (8, "never seen words at all here")]
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    for bits in (1 << 26, 64):  # 64: every key passes the filter
        got = Counter((r["doc_id"], tuple(r["item_ids"])) for r in decontaminate.find_contamination(docs(spark, rows), bench, filter_bits=bits).collect())
        assert got == brute_contamination(rows, items)
    named = docs(spark, rows).withColumn("fp", F.lit("mine")).withColumn("item", F.lit(3))
    assert {tuple(r) for r in decontaminate.keep_clean(named, bench).select("fp", "item").collect()} == {("mine", 3)}
    assert decontaminate.keep_clean(named, bench.limit(0)).count() == len(rows) and decontaminate.keep_clean(named.limit(0), bench).count() == 0
    clean = decontaminate.keep_clean(docs(spark, rows).drop("extra"), bench)
    assert Counter(r["doc_id"] for r in clean.collect()) == Counter(d for (d, hits), n in got.items() for _ in range(n) if not hits)


def test_decontaminate_recall_of_scattered_items(spark):
    """Items of which three quarters or a little more are spread over long documents."""
    rng = np.random.default_rng(11)
    vocab = [f"v{i}" for i in range(5000)]
    items, rows = [], []
    for i in range(60):
        n = int(rng.integers(8, 120))
        words = list(rng.choice(vocab, n))
        items.append((i, " ".join(words)))
        grams = [words[j : j + 5] for j in range(n - 4)]
        take = rng.permutation(len(grams))[: -(-3 * len(grams) // 4)]
        out: list = []
        for j in take.tolist():
            out += [*rng.choice(vocab, int(rng.integers(20, 60))), *grams[j]]
        rows.append((i, " ".join(out)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_contamination(rows, items)
    assert sum(len(hits) for _, hits in want) >= 60
    got = Counter((r["doc_id"], tuple(r["item_ids"])) for r in decontaminate.find_contamination(docs(spark, rows), bench).collect())
    assert got == want  # recall 1 here; at least 0.9 is asked for


def plain_language(rows, learn, top=400, most=1000):
    """Out-of-place distance in plain Python.  rows: (id, text, lang)."""

    def counts(text):
        flat = "".join(c if c.isalpha() else " " for c in text.lower())
        flat = " " + " ".join(flat.split(" ")).strip() + " " if flat.strip() else ""
        flat = re.sub(" +", " ", flat)
        return Counter(flat.replace(" ", "")) + Counter(flat[i : i + n] for n in (2, 3) for i in range(len(flat) - n + 1))

    def ranked(c):
        return sorted(c, key=lambda g: (-c[g], [len(g), *map(ord, g)]))[:top]

    return counts, ranked


def test_language_id_against_plain_python(spark):
    """Every prediction and score of the table from profiles of all its training
    rows (fewer than the bound of the sample)."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    counts, ranked = plain_language(rows, held)
    total = defaultdict(Counter)
    for i, text, lang in rows:
        if lang is not None and text and not held(i):
            total[lang].update(counts(text))
    profiles = {lang: {g: r for r, g in enumerate(ranked(c))} for lang, c in total.items()}
    got = {r["doc_id"]: r for r in queries.op1_language_id(spark, SF).collect()}
    assert len(got) == len({r[0] for r in rows})
    for i, text, _ in rows:
        c = counts(text or "")
        assert got[i]["held_out"] == held(i)
        if not c:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        mine = ranked(c)
        away = {lang: sum(abs(p[g] - r) if g in p else 400 for r, g in enumerate(mine)) for lang, p in profiles.items()}
        best = min(sorted(away), key=away.get)
        assert (got[i]["lang_pred"], got[i]["score"]) == (best, pytest.approx(1 - away[best] / (400 * len(mine)))), (i, away)


def test_language_sample_is_the_least_by_hash(spark):
    n = 3000
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") < 2900, "hot").otherwise("rare").alias("lang"))
    low = language_id._lowest(d.select("doc_id", "text", "lang", F.xxhash64("doc_id").alias("h")), 50)
    want = {r["doc_id"] for r in d.where("lang = 'hot'").orderBy(F.xxhash64("doc_id")).limit(50).collect()}
    got = low.where("lang = 'hot'").collect()
    assert want <= {r["doc_id"] for r in got} and len(got) < 400 and low.where("lang = 'rare'").count() >= 50
    same = d.withColumn("doc_id", F.lit(7)).select("doc_id", "text", "lang", F.xxhash64(F.lit(7)).alias("h"))
    assert language_id._lowest(same, 50).where("lang = 'hot'").count() >= 50


def test_language_labels_without_end(spark):
    """Of very many labels the most frequent are learned."""
    rows = [(i, "the plain words of a text " * 3, "en") for i in range(30)] + [(100 + i, "die einfachen Worte eines Textes " * 3, "de") for i in range(30)] + [(1000 + i, f"junk {i} words", f"x{i}") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    p = language_id.train(d, F.lit(True), settings=language_id.ProfileSettings(max_langs=2))
    assert p.langs == ["de", "en"]
    assert len(language_id.train(d, F.lit(True)).langs) == 302


def test_language_id(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    got = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(table, "doc_id").where("held_out").collect()
    assert len(got) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_id_edges(spark):
    d = docs(spark, edge_rows() + [(60, "12 34 !!"), (61, "ß")])
    p = language_id.train(d, F.lit(True))
    got = {r["doc_id"]: r for r in language_id.identify(d, p).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 60)] == ["und"] * 4 and got[61]["lang_pred"] == "en"
    empty = language_id.train(d.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify(d, empty).collect()} == {"und"}
    top = language_id.top_grams(np.array([5, 5, 2, 2, 9, 1], dtype=np.uint64), 3)
    assert top.tolist() == [2, 5, 1]


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    c = Counter(tri)
    rep = {i + k for i, t in enumerate(tri) if c[t] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(rep)


def test_quality_rules(spark):
    rows = edge_rows() + [(70, "a b c a b c\na b c a b c\n# $ %"), (71, "x " * 60), (72, "one two three four five six seven.\n" * 9)]
    rows += [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = quality_rules.quality_rules(docs(spark, rows))
    want = Counter((i, *brute_quality(t)) for i, t in rows)
    assert as_counter(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_clean_documents(spark):
    """Failed lines go, documents that lose too much go, others stay as they are."""
    plain = "A plain sentence with some words that ends as it should."
    rows = [(1, "\n".join([plain] * 2 + ["Home | About | Contact"] + [f"{plain} {i} more words follow here, and then it ends." for i in range(6)] + ["Menu", ""])), (2, "\n".join(f"{plain} {i} and no line is bad." for i in range(9)))]
    rows += [(3, "Menu\n" * 60), (4, None), (5, "")] + [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        good = [x for x in lines if quality_rules.line_fault(x) is None]
        n, rep = brute_quality(t)[0], brute_quality(t)[-1]
        lost = n - len(WORD.findall("\n".join(good)))
        if n >= 50 and 100 * rep <= 50 * n and lost <= 0.5 * n:
            want[i, "\n".join(good), -7 if len(good) == len(lines) else len("\n".join(good))] += 1
    got = quality_rules.clean_documents(docs(spark, rows).withColumn("n_chars", F.lit(-7)))
    assert as_counter(got, "doc_id", "text", "n_chars") == want
    assert any(k[0] == 1 and "Menu" not in k[1] and "Home" not in k[1] for k in want)


def test_quality_line_faults():
    f = quality_rules.line_fault
    assert f("Home | About | Contact | Help") == "navigation"
    assert f("a### b$$$ c%%% d") == "symbols"
    assert f("Click here to read our story.") == "boilerplate"
    assert f("Only a heading") == "punctuation"
    assert f("A plain sentence that ends as it should.") is None
    assert f("") is None


def test_url_rules(spark):
    cases = {
        "https://shop.example.com/en/1": ("shop.example.com", "/en/1", "example.com/en/", "block"),
        "https://WWW.Example.com/en/1?x#y": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://example.com/de/": ("example.com", "/de/", "com/", "allow"),
        "http://badexample.net/es/": ("badexample.net", "/es/", "net/es/", "block"),
        "http://x.net/fr": ("x.net", "/fr", None, "allow"),
        "http://ads-track.example.org/en/1": ("ads-track.example.org", "/en/1", None, "block"),
        "http://a.org/login?next=1": ("a.org", "/login", None, "block"),
        "http://docs.ads-x.org/": ("docs.ads-x.org", "/", None, "allow"),
        "mailto:x": ("", "", None, "allow"),
        "http://com": ("com", "", None, "allow"),
        "x://y://z/": ("y:", "//z/", None, "allow"),
    }
    rows = [(i, u, "h") for i, u in enumerate([*cases, None])]
    got = url_rules.url_filter(spark.createDataFrame(rows, "page_id long, url string, host string")).orderBy("page_id").collect()
    for r, (u, want) in zip(got, [*cases.items(), (None, ("", "", None, "allow"))]):
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == want, u
    # the index finds what running every pattern finds
    urls = [r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()] + list(cases)
    index = url_rules.PatternIndex(frequency={"ads": 5, "1": 9})
    ordered = sorted(url_rules.REGISTERED_RULES, key=lambda r: r.verdict != "allow")
    for u in urls:
        want = next(((r.name, r.verdict) for r in ordered if re.search(r.pattern, u.lower())), None)
        assert index.find(u) == want


def test_url_pattern_alternatives(spark):
    heads = ("ads-x.b.org", "ad-x.b.org", "ads-1.org", "adult-x.org", "casino.org", "casino-1.b.org", "tracker.a.org", "x-tracker.org", "docs.a.org", "a.org", "docs.ad-x.org")
    tails = ("", "/", "/ads/", "/ad/1", "/x/ad/", "/track/pixel.gif", "/track/pixel.png?x", "/login", "/signin", "/signin.html", "/signin.htm?x", "/login/#y", "/cart/checkout", "/cart/checkout2", "/x?print=1", "/x?a&print=10", "/x?print=1x", "/x;phpsessid=1", "/SignIn")
    urls = [f"http://{h}{t}" for h in heads for t in tails]
    ordered = sorted(url_rules.PATTERN_RULES, key=lambda r: r.verdict != "allow")
    want = {u: next(((r.name, r.verdict) for r in ordered if re.search(r.pattern, u.lower())), None) for u in urls}
    assert {w[0] for w in want.values() if w} == {r.name for r in ordered} - {"ad-host-single"}  # ad-host comes first wherever that matches
    tokens = sorted({t for r in ordered for c in r.tokens for t in ([c] if isinstance(c, str) else c)})
    for rare in [None, *tokens]:  # whichever token is rarest
        index = url_rules.PatternIndex(url_rules.PATTERN_RULES, frequency=rare and {t: 9 * (t != rare) for t in tokens})
        for u in urls:
            assert index.find(u) == want[u], (rare, u)
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_rules.url_filter(rows, patterns=url_rules.PATTERN_RULES).collect():
        hit = want[urls[r["page_id"]]]
        assert r["rule"] is None and (r["pattern"], r["verdict"]) == (hit or (None, "allow"))


def test_url_filter_list(spark):
    lines = [
        "! a comment", "[Adblock Plus 2.0]", "example.org##.banner", "||ads.example.org^", "||tracker.net^$third-party,script", "@@||ads.example.org/allowed/", "/banner/*/ad_", "|http://start.org/x|",
        "-popup.", "/regex[0-9]+/", "||only.org^$domain=a.org", "track*pixel", "&utm_source=", "*^*", "||shop.de/cart^", "swf|",
    ]
    rules = url_rules.read_filter_list(lines)
    assert [r.name for r in rules] == [lines[i] for i in (3, 4, 5, 6, 7, 8, 11, 12, 14, 15)]
    assert {r.name: r.tokens for r in rules}["||ads.example.org^"] == ("ads", "example", "org") and {r.name: r.tokens for r in rules}["track*pixel"] == ()
    cases = {
        "https://x.ads.example.org/a": "||ads.example.org^", "http://ads.example.org": "||ads.example.org^", "http://badads.example.org/": None, "http://ads.example.org/allowed/1": "@@||ads.example.org/allowed/",
        "http://ads.example.orgs/": None, "http://a.org/banner/12/ad_x": "/banner/*/ad_", "http://start.org/x": "|http://start.org/x|", "http://start.org/xy": None, "http://a.org/my-popup.js": "-popup.",
        "http://a.org/tracking/1pixel": "track*pixel", "http://a.org/?a=1&UTM_source=b": "&utm_source=", "https://shop.de/cart?x": "||shop.de/cart^", "https://shop.de/carts": None, "http://a.org/m.swf": "swf|", "http://tracker.net:80/": "||tracker.net^$third-party,script",
    }
    urls = [r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect() if r["url"]] + list(cases)
    tokens = sorted({t for r in rules for t in r.tokens})
    for rare in [None, *tokens]:
        index = url_rules.PatternIndex(rules, rare and {t: 9 * (t != rare) for t in tokens})
        for u in urls:
            want = next((r.name for r in sorted(rules, key=lambda r: r.verdict != "allow") if re.search(r.pattern, u.lower())), None)
            hit = index.find(u)
            assert (hit and hit[0]) == want == cases.get(u, want), u
    got = url_rules.url_filter(spark.createDataFrame(list(enumerate(cases)), "page_id long, url string"), sites=(), patterns=rules).orderBy("page_id").collect()
    assert [r["pattern"] for r in got] == list(cases.values())


def test_license_scan(spark):
    rows = [(1, "Hello. Released under the  MIT License.\nBye."), (2, "Licensed under the Apache License, Version 2.0."), (3, "All rights reserved! This work is licensed under the GNU General Public License, version 3."), (4, None), (5, "")]
    rows += [(6, "Redistributions of source code must retain the above copyright notice. X y. Redistributions in binary form must reproduce the above copyright notice."), (7, "Released under the MIT License?"), (8, "not licensed under the apache license version 2 0.")]
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs(spark, rows)).collect()}
    assert [got[i]["license"] for i in range(1, 9)] == ["MIT", "Apache-2.0", "GPL-3.0", None, None, "BSD-2-Clause", "MIT", None]
    assert got[3]["sentence_ids"] == "RESERVED GPL3_GRANT" and got[4]["n_sentences"] == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

%sTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
BSD_NAME = "%s Neither the name of %s nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """%s is free software%s you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation%s either version %s of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
APACHE_IDS = "APACHE2_GRANT APACHE2_COMPLY APACHE2_COPY APACHE2_AS_IS APACHE2_LIMITS"
GPL_IDS = "GPL_HOPE GPL_IMPLIED GPL_DETAILS"
BSD_IDS = "RESERVED BSD_GRANT BSD_SOURCE BSD_BINARY %sBSD_WARRANTY"


def test_license_markers(spark):
    cases = {"// SPDX-License-Identifier: MIT\nint main() {}": "MIT", "/* SPDX-License-Identifier: GPL-2.0-or-later */\ncode": "GPL-2.0", "# spdx-license-identifier: Apache-2.0": "Apache-2.0", "x\n-- SPDX-License-Identifier: BSD-3-Clause\n": "BSD-3-Clause", "SPDX-License-Identifier: (MIT OR Apache-2.0)": None, "the SPDX-License-Identifier: MIT marker": None}
    got = {r["doc_id"]: r["license"] for r in license_scan.license_scan(docs(spark, list(enumerate(cases)))).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_registered_url_list_against_all_rules(spark):
    """The index finds what running every rule finds, whatever tokens are rare."""
    ordered = sorted(url_rules.REGISTERED_RULES, key=lambda r: r.verdict != "allow")
    assert len(ordered) > 200
    compiled = [(r, re.compile(r.pattern)) for r in ordered]
    rng = np.random.default_rng(4)
    words = ["ads", "ad", "login", "track", "pixel", "docs", "org", "com", "a1", "casino", "poker", "cart", "utm_source", "sid", "search", "rss", "js", "png", "x", "archive", "adserver", "stats"]
    urls = [f"https://{'.'.join(rng.choice(words, 3))}/{'/'.join(rng.choice(words, 3))}{rng.choice(['', '/', '.js', '.png', '.html', '?', '?sid=1', '&gclid=2', '-'])}{rng.choice(words)}" for _ in range(3000)]
    urls += [r["url"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect() if r["url"]]
    count = Counter(t for u in urls for t in set(url_rules.TOKEN.findall(u.lower())))
    hits = 0
    for index in (url_rules.PatternIndex(frequency=count), url_rules.PatternIndex(), url_rules.PatternIndex(frequency={t: -n for t, n in count.items()})):
        for u in urls:
            want = next(((r.name, r.verdict) for r, p in compiled if p.search(u.lower())), None)
            assert index.find(u) == want
            hits += want is not None
    assert hits > 1000


def test_license_scan_of_long_punctuation(spark):
    rows = [(1, "." * 1_000_000 + " word\nReleased under the MIT License."), (2, "!?" * 500_000), (3, "\n." * 400_000 + "x"), (4, ". " * 500_000)]
    began = time.time()
    assert {r["doc_id"]: r["license"] for r in license_scan.license_scan(docs(spark, rows)).collect()}[1] == "MIT"
    assert time.time() - began < 60


def test_license_whole_notices(spark):
    own = "Copyright (c) 2020 A Holder\nAll rights reserved.\n\n"
    cases = [
        (MIT, "MIT", "MIT_PERMISSION MIT_NOTICE NO_WARRANTY MIT_LIABILITY"),
        (own + BSD % "", "BSD-2-Clause", BSD_IDS % ""),
        (own + BSD % (BSD_NAME % ("3.", "the copyright holder")), "BSD-3-Clause", BSD_IDS % "BSD_NAME "),
        (own + BSD % (BSD_NAME % ("(3)", "Any Inc. and others")), "BSD-3-Clause", BSD_IDS % "BSD_NAME "),
        (own + BSD % ("3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the Holder.\n\n" + BSD_NAME % ("4.", "the Holder")), "BSD-4-Clause", BSD_IDS % "BSD_ADVERT BSD_NAME "),
        ("Copyright 2020 A Holder\n\n" + APACHE, "Apache-2.0", APACHE_IDS),
        (own + APACHE, "Apache-2.0", "RESERVED " + APACHE_IDS),
        (GPL % ("This program", ":", ",", 3), "GPL-3.0", "GPL3_GRANT " + GPL_IDS),
        (GPL % ("Some Tool", ";", ";", 2), "GPL-2.0", "GPL2_GRANT " + GPL_IDS),
        (GPL % ("This program", ";", ";", 2), "GPL-2.0", "FREE_SOFTWARE GPL2_GRANT " + GPL_IDS),
        (GPL.replace("General", "Lesser General") % ("This library", ";", ";", "2.1"), "LGPL-2.1", "LGPL21_GRANT " + GPL_IDS.replace("GPL_D", "LGPL_D")),
        (GPL.replace("General", "Affero General") % ("This program", ":", ",", 3), "AGPL-3.0", "AGPL3_GRANT " + GPL_IDS.replace("GPL_D", "AGPL_D")),
        (ISC, "ISC", "ISC_PERMISSION ISC_WARRANTY"),
        (MPL, "MPL-2.0", "MPL2_GRANT MPL2_COPY"),
        ("This is free and unencumbered software released into the public domain.\n\nMore text.", "Unlicense", "UNLICENSE_GRANT"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0", "CC_BY_SA4_GRANT"),
        (own + "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "BSD", "RESERVED BSD_STYLE"),
        (own + "A heading\nReleased under the MIT License", "MIT", "RESERVED MIT_GRANT"),
        (own, "Proprietary", "RESERVED"),
        (MIT.partition(", to deal")[0].replace("of this software", "of this hardware"), None, ""),
        (APACHE.replace("Version 2.0", "Version 9.0").partition(";")[0], None, ""),
    ]
    forms = []
    for width, prefix in ((10**6, ""), (72, ""), (79, " * "), (50, "# "), (33, "   // ")):
        for end in ("\n", "\r\n"):
            for text, *_ in cases:
                lines = [w for x in text.split("\n") for w in textwrap.wrap(x, width, break_long_words=False) or [""]]
                forms.append(end.join((prefix + x).rstrip() for x in lines))
    forms += [" ".join(text.split()) for text, *_ in cases[:1]]  # all in one line
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs(spark, list(enumerate(forms)))).collect()}
    for i, form in enumerate(forms[:-1]):
        assert (got[i]["license"], got[i]["sentence_ids"]) == cases[i % len(cases)][1:], form
        assert got[i]["n_sentences"] == len(got[i]["sentence_ids"].split())
    assert got[len(forms) - 1]["license"] == "MIT"


def test_chat_snapshots(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"), (4, 0, "user", "a"), (4, 1, "assistant", "b"), (4, 2, "user", "c"), (5, 0, "user", "a"), (5, 1, "assistant", "x"), (6, 0, None, "a"), (7, 0, "user", None), (8, 0, "user", ""), (None, 0, "user", "z"), (9, 1, "user", "q"), (9, 1, "user", "q"), (10, 5, "user", "q")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, n long")
    got = {r["conv_id"]: r for r in chat_snapshots.collapse_and_render(d).collect()}
    assert sorted(got) == [3, 5, 6, 7, 8, 9]
    assert got[3]["n_equal"] == 2 and got[3]["n_turns"] == 3 and got[9]["n_turns"] == 2
    assert got[5]["rendered"] == "<|user|>\na\n<|end|>\n<|assistant|>\nx\n<|end|>"
    assert "<|unknown|>" in got[6]["rendered"]
    assert chat_snapshots.collapse_and_render(d.limit(0)).count() == 0


def test_empty_tables(spark):
    d = docs(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    for df in (quality_rules.quality_rules(d), license_scan.license_scan(d), packing.pack(d, path), token_counts.token_counts(d, public_tokenizers.path("byte_bpe_50k.json")), decontaminate.find_contamination(d, bench), substring_dedup.remove_repeats(d), url_rules.url_filter(d.withColumnRenamed("text", "url"), id_col="doc_id")):
        assert df.count() == 0
    rows = edge_rows()
    assert decontaminate.keep_clean(docs(spark, rows), bench).count() == len(rows)


CLASHING = ("id_", "text_", "runs", "blobs", "c0_", "c2_", "key", "batch", "blob", "found_", "item", "fp", "h", "lang_pred", "n_words", "sequence_id", "start", "hits", "number", "place_d", "sentence_ids")


def test_clashing_columns_change_nothing(spark):
    """Extra columns with the names that operators use inside, and repeated rows."""
    rows = edge_rows() + edge_rows()[:6]
    plain = docs(spark, rows)
    wide = plain.select("*", *(F.lit(7).alias(c) for c in CLASHING)).withColumn("Runs_", F.lit("x"))
    bench = spark.createDataFrame([(1, rows[4][1], 5)], "item_id long, text string, fp int")
    words, pieces = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    profiles = language_id.train(wide, F.lit(True))
    for f in (
        lambda d: language_id.identify(d, profiles), substring_dedup.remove_repeats, license_scan.license_scan, quality_rules.quality_rules,
        lambda d: token_counts.token_counts(d, pieces), lambda d: decontaminate.find_contamination(d, bench), lambda d: packing.pack(d.coalesce(1), words),
        lambda d: url_rules.url_filter(d.withColumnRenamed("text", "url"), id_col="doc_id"),
    ):
        a, b = f(plain), f(wide)
        assert a.columns == b.columns
        assert Counter(map(str, a.collect())) == Counter(map(str, b.collect()))
    cut = substring_dedup.cut_documents(wide)
    assert cut.columns == wide.columns and {tuple(r) for r in cut.select(*CLASHING).distinct().collect()} == {(7,) * len(CLASHING)}
    for f in (quality_rules.clean_documents, lambda d: decontaminate.keep_clean(d, bench)):
        kept = f(wide)
        assert kept.columns == wide.columns and 0 < kept.count() < len(rows)


def test_long_lines_urls_and_conversations(spark):
    line = "word, " * 40_000 + "end."
    r = quality_rules.quality_rules(docs(spark, [(1, line)])).first()
    assert (r["n_words"], r["n_dup_lines"], r["n_failed_lines"]) == (40_001, 0, 0)
    url = "http://a.org/" + "x/" * 50_000 + "login"
    got = url_rules.url_filter(spark.createDataFrame([(1, url), (1, url)], "page_id long, url string")).collect()
    assert [(r["verdict"], len(r["path"])) for r in got] == [("block", len(url) - 12)] * 2
    turns = [(1, i, "user", f"t{i}") for i in range(3000)] + [(2, i, "user", f"t{i}") for i in range(2999)] + [(3, None, "user", "a")]
    d = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string")
    assert {r["conv_id"]: r["n_turns"] for r in chat_snapshots.collapse_and_render(d).collect()} == {1: 3000, 3: 1}
    license_text = "Some words here. " * 20_000 + "\nAll rights reserved.\nReleased under the MIT License."
    assert license_scan.license_scan(docs(spark, [(1, license_text), (1, license_text)])).collect()[1]["license"] == "MIT"


def test_token_counts_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "word " * 30_000), (4, "word " * 30_000), (None, "one two")]
    got = {r["doc_id"]: r for r in token_counts.token_counts(docs(spark, rows), public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert [got[i]["n_tokens"] for i in (1, 2, 3)] == [0, 0, 0] and got[4]["n_words"] == 30_000 and got[None]["n_words"] == 2


def test_language_id_odd_rows(spark):
    rows = edge_rows() + [(None, "some plain words"), (None, None)]
    d = docs(spark, rows)
    p = language_id.train(d.unionByName(docs(spark, [(None, "not learned from")])), F.lit(True))
    got = language_id.identify(d, p).collect()
    assert len(got) == len(rows) and sum(r["doc_id"] is None for r in got) == 3
    assert language_id.identify(d.limit(0), p).count() == 0
