"""Benchmark decontamination (operator 10): size-partitioned MinHash
containment search with exact verification.

Test items are the query set.  They are partitioned by shingle count into
ranges (each at most twice as wide as its start).  A document is read as
overlapping passages whose length follows the range, so that the Jaccard
similarity of an item and a passage holding it stays high however long the
document is.  Each of ``hashes`` minima is a band of its own: a passage that
agrees with an item in one minimum makes the document a candidate.

1. *Items* become a table: text and the keys (range, band, minimum) of each.
2. *Filter.*  The keys' bits in a Bloom filter of at most ``filter_bits`` bits,
   put together in the cluster, are all that is broadcast; its size never
   follows the items beyond that bound.
3. *Search.*  One pass over the documents computes the passages' minima.  Texts
   with a minimum in the filter go on, equal ones once, with those keys.
4. *Candidates* are joined with the items on the key, and verified with the
   exact set of the item's shingles in the whole document.
5. *Verdicts*, by fingerprint of the text, are joined to all documents.

Shingles are runs of five lower-cased (A-Z) words.  An item with fewer words is
one run of all its words.

The search is probabilistic.  Take an item of s shingles of which a share c is
anywhere in a document, together or scattered.  In each band the item's least
shingle is in the document with probability c, and is the least of a passage
around it, of at most 4 s shingles, with at least 1/5 (an item's range holds
sizes from half the passage step up).  At c = 0.75 all 64 bands miss with less
than 0.85**64 = 3e-5.

Defined cases: null or wordless items are never found, nor are items with a null
id; null or wordless documents hold nothing.  Equal items are all reported.
Without items all documents are clean; without documents the result is empty.
Texts of any length are read whole.  Repeated rows get the same verdict;
further columns are not read, or carried whatever their names are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, by_bytes, discard, materialise, mix, shingle_hashes, unused

PROBES = 4
ITEM = "text string, kk int, part int, keys array<long>"


def _permute(s: np.ndarray, seed: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (s ^ seed) * np.uint64(0xD6E8FEB86659FD93)


def _seeds(hashes: int) -> np.ndarray:
    return mix(np.arange(1, hashes + 1, dtype=np.uint64))


def _salts(kk: int, part: int, hashes: int) -> np.ndarray:
    """For each band a number that also tells shingle length and range."""
    return mix((kk << 32 | part << 16 | np.arange(hashes)).astype(np.uint64))


def _item_rows(k: int, hashes: int):
    """(item, text) -> one row per usable item with its keys."""

    def run(batches):
        seeds = _seeds(hashes)
        for b in by_bytes(batches, "text", 2_000_000):
            words = Words(b.column("text").to_pylist(), lower=True)
            h, at, kks, parts, keys = words.hashes(), [], [], [], []
            for i in range(b.num_rows):
                w = h[words.first[i] : words.first[i + 1]]
                if not len(w):
                    continue
                kk = int(min(k, len(w)))
                s = np.unique(shingle_hashes(w, kk))
                part = (len(s) - 1).bit_length()
                at.append(i)
                kks.append(kk)
                parts.append(part)
                keys.append(mix(np.array([_permute(s, seed).min() for seed in seeds]) ^ _salts(kk, part, hashes)).view(np.int64))
            some = b.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column("item"), some.column("text"), pa.array(kks, pa.int32()), pa.array(parts, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], names=["item", *(x.split()[0] for x in ITEM.split(", "))])

    return run


def _places(key: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return mix(key + np.uint64(probe)) & np.uint64(bits - 1)


def _filter_words(bits: int):
    """Item rows -> (word, mask): the partition's part of the Bloom filter."""

    def run(batches):
        held = np.zeros(bits // 64, dtype=np.uint64)
        for b in batches:
            keys = np.asarray(b.column("keys").flatten()).view(np.uint64)
            for p in range(PROBES):
                at = _places(keys, p, bits)
                np.bitwise_or.at(held, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some].view(np.int64))], names=["word", "mask"])

    return run


def _in_filter(key: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Indexes of the keys that may be an item's."""
    some = np.arange(len(key))
    for p in range(PROBES):
        at = _places(key[some], p, 64 * len(words))
        some = some[(words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
    return some


def _search(shapes: list, hashes: int, words):
    """text -> (fp, text, keys) of the texts with a key in the filter; equal
    texts of a batch once.  shapes: (shingle length, range) of the items."""

    def run(batches):
        seeds, held = _seeds(hashes), words.value
        for b in by_bytes(batches, "text", 4_000_000):
            texts = [t for t in dict.fromkeys(b.column("text").to_pylist()) if t]
            table = Words(texts, lower=True)
            h, first = table.hashes(), table.first
            docs, keys = [], []
            for kk in sorted({s[0] for s in shapes}):
                count = np.maximum(np.diff(first) - kk + 1, 0)
                every, owner = shingle_hashes(h, kk), np.repeat(np.arange(len(count)), count)
                s = every[np.repeat(first[:-1] - np.cumsum(count) + count, count) + np.arange(len(owner))]
                if not len(s):
                    continue
                steps = []
                for part in sorted(p for x, p in shapes if x == kk):
                    step = 1 << part
                    blocks = -(-count // step)
                    doc = np.repeat(np.arange(len(count)), blocks)
                    inside = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    steps.append((_salts(kk, part, hashes), np.repeat(np.cumsum(count) - count, blocks) + inside * step, doc, np.append(doc[1:] == doc[:-1], False)))
                for j, seed in enumerate(seeds):
                    m = _permute(s, seed)
                    for salt, at, doc, joined in steps:
                        low = np.minimum.reduceat(m, at)
                        key = mix(np.where(joined, np.minimum(low, np.roll(low, -1)), low) ^ salt[j])
                        hit = _in_filter(key, held)
                        docs.append(doc[hit])
                        keys.append(key[hit])
            if not docs:
                continue
            doc, key = np.concatenate(docs), np.concatenate(keys)
            pairs = np.unique(np.stack((doc.astype(np.uint64), key)), axis=1)
            doc, key = pairs[0].astype(np.int64), pairs[1].view(np.int64)
            head = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))[: len(doc)]
            found = [texts[i] for i in doc[head].tolist()]
            prints = [hashlib.md5(t.encode("utf-8", "surrogatepass"), usedforsecurity=False).digest() for t in found]
            lists = [key[x:y] for x, y in zip(head, np.append(head[1:], len(doc)))]
            yield pa.RecordBatch.from_arrays([pa.array(prints, pa.binary()), pa.array(found, pa.string()), pa.array(lists, pa.list_(pa.int64()))], names=["fp", "text", "keys"])

    return run


def shingles(text: str, k: int) -> set:
    words = Words([text], lower=True)
    w = [words.buf[s:e].tobytes() for s, e in zip(words.start, words.end, strict=True)]
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def _verify(threshold: float):
    """(fp, text, item, item_text, kk), sorted by fp -> (fp, item, share) of the
    pairs that reach the threshold."""

    def run(batches):
        now, grams = None, {}
        for b in batches:
            share = []
            for fp, text, other, kk in zip(*(b.column(c).to_pylist() for c in ("fp", "text", "item_text", "kk")), strict=True):
                if fp != now:
                    now, grams = fp, {}
                if kk not in grams:
                    grams[kk] = shingles(text, kk)
                want = shingles(other, kk)
                share.append(len(want & grams[kk]) / len(want))
            out = pa.RecordBatch.from_arrays([b.column("fp"), b.column("item"), pa.array(share, pa.float64())], names=["fp", "item", "share"])
            yield out.filter(pa.array([s >= threshold for s in share], pa.bool_()))

    return run


def _print(text_col: str):
    return F.unhex(F.md5(F.col(text_col).cast("string").cast("binary")))


def contaminated_texts(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.75, hashes: int = 64, k: int = 5, filter_bits: int = 1 << 26) -> DataFrame:
    """(fp, item_ids, max_containment) of the texts that hold an item, by md5."""
    spark = docs.sparkSession
    kind = dict(items.select(item_id).dtypes)[item_id]
    named = items.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null and text is not null")
    held = materialise(named.mapInArrow(_item_rows(k, hashes), f"item {kind}, {ITEM}").withColumn("number", F.monotonically_increasing_id()), "items")
    shapes = [(r["kk"], r["part"], r["n"]) for r in held.groupBy("kk", "part").agg(F.count("*").alias("n")).collect()]  # k ranges of sizes at most
    n = sum(s[2] for s in shapes)
    bits = min(filter_bits, max(1 << 12, 1 << (64 * hashes * max(n, 1) - 1).bit_length()))
    bloom = np.zeros(bits // 64, dtype=np.uint64)
    parts = held.select("keys").mapInArrow(_filter_words(bits), "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    bloom[parts.column("word").to_numpy()] = parts.column("mask").to_numpy().view(np.uint64)
    words = spark.sparkContext.broadcast(bloom)  # filter_bits / 8 bytes at most

    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text is not null")
    hits = texts.mapInArrow(_search([s[:2] for s in shapes], hashes, words), "fp binary, text string, keys array<long>").dropDuplicates(["fp"])
    hits = materialise(hits, "hits")
    wanted = held.select("number", F.explode("keys").alias("key"))
    pairs = hits.select("fp", F.explode("keys").alias("key")).join(wanted, "key").select("fp", "number").distinct()
    both = pairs.join(hits.select("fp", "text"), "fp").join(held.select("number", "item", F.col("text").alias("item_text"), "kk"), "number")
    sure = both.select("fp", "text", "item", "item_text", "kk").sortWithinPartitions("fp").mapInArrow(_verify(threshold), f"fp binary, item {kind}, share double")
    found = materialise(sure.groupBy("fp").agg(F.array_sort(F.collect_list("item")).alias("item_ids"), F.max("share").alias("max_containment")), "found")
    discard(held, hits)
    return found


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per input row: id, item_ids (sorted), max_containment."""
    found = contaminated_texts(docs, items, text_col, **settings)
    (fp,) = unused(docs, "fp")
    joined = docs.select(F.col(id_col), _print(text_col).alias(fp)).join(found.withColumnRenamed("fp", fp), fp, "left")
    none = F.array().cast(dict(found.dtypes)["item_ids"])
    return joined.select(F.col(id_col), F.coalesce("item_ids", none).alias("item_ids"), "max_containment")


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns unchanged."""
    found = contaminated_texts(docs, items, text_col, **settings)
    (fp,) = unused(docs, "fp")
    return docs.withColumn(fp, _print(text_col)).join(found.select(F.col("fp").alias(fp)), fp, "left_anti").select(*docs.columns)
