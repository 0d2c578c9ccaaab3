"""N-gram Jaccard join (operator 2): rare-first prefix filtering.

A document's set holds its distinct runs of ``k`` lower-cased (A-Z) words, or,
with fewer words, its whole word sequence.  Two sets link when their Jaccard
similarity is at least ``threshold`` (whole percent).

1. *Frequencies.*  Workers send each n-gram to the shard that owns it and learn
   which of theirs also occur in a different set, and how often.  Which sets are
   copies is told by fingerprints, sent only where a text occurs more than once.
2. *Prefixes.*  N-grams are ordered rare first.  A set of n n-grams can only
   reach the threshold with a set that shares one of its first
   ``n - ceil(threshold * n) + 1``.  Those met in no other set come first and
   match nothing, so most sets end here.
3. *Candidates.*  Sets that share a prefix n-gram and pass the length and
   positional filters.  First every set meets only one set, the hub, of each of
   its n-grams; verified links give sets a common label, and the next round's
   hubs come from the largest label of each n-gram, so that groups of copies
   grow together at a cost that is linear in their postings; n-grams that one
   label holds are left out from then on.  Then the pairs that are left, those
   of different components, follow.  So no link that could
   join two components is left out, and no group emits all its pairs.
4. *Verification.*  A pair that was looked at once is remembered and never
   looked at again: suffix filter, then the exact overlap.

The suffix filter cuts both lists at the same 16 points of the n-grams' hash
range; the differences of the parts' sizes add up to a lower bound of the sets'
difference.  Beside it stands the parity of the n-grams that fall on each of
512 bits, whose differing bits are another such bound.

Equal sets are one node throughout (128-bit fingerprint).  N-grams are told
apart by 64 bits of their hash; for a verdict to be wrong, one n-gram of one
set must collide with another n-gram of the very set it is compared with, which
for sets of a thousand happens once in 10**13 pairs.  A component is named by
its smallest doc_id.

Defined cases: ids are integers (others fail in the cast).  Null, empty and
wordless texts have no set, size 0, and link with nothing; their component is
their own doc_id.  Rows with a null doc_id take part; a component without any
doc_id is null.  Repeated rows are equal sets.  Texts of any length are read
whole.  Further columns are not read, or, in ``keep_one``, carried whatever
their names are; empty tables give empty results.
"""

from __future__ import annotations

import pickle
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, by_bytes, discard, materialise, mix, pack, partitions, shingle_hashes, unpack, unused
from .components import components, merged


def prefix_length(n, percent: int):
    """How many of a set's first n-grams must be looked at."""
    return n - -(-n * percent // 100) + 1


def least_overlap(n: Column, m: Column, percent: int) -> Column:
    """Shared n-grams that sets of n and m need: ceil(t / (1 + t) * (n + m))."""
    return F.ceil((n + m) * percent / (100 + percent))


# ---------------------------------------------------------------- frequencies

EXCHANGED = "key long, batch long, blob binary"
#: What is asked of a shard: batch; n-grams; their documents as runs (distance
#: from the number before and length as planes, fingerprints of those that have
#: copies); n-grams that stand for many documents, with their count.
ASKED = ("<i8", "<u8", "u1", "u1", "<u8", "<u8", "<u4")
#: What it answers: n-grams with document and frequency; the others with frequency.
ANSWERED = ("<u8", "<u4", "<u4", "<u8", "<u4")


def _rows(keys, batches, blobs):
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(batches, pa.int64()), pa.array(blobs, pa.binary())], names=["key", "batch", "blob"])


def _heads(v: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], v[1:] != v[:-1])))[: len(v)]


def _lengths(heads: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(heads, n))


def _planes(v: np.ndarray) -> np.ndarray:
    """Lowest bytes of all numbers, then the next ones: small numbers leave
    planes of zeros, of which the exchange's compression leaves nothing.  The
    more shards, the shorter the runs of one document, down to one n-gram."""
    return v.astype("<u4").view(np.uint8).reshape(-1, 4).T


def _numbers(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel()


def _asked(serial: int, token: np.ndarray, doc: np.ndarray, fingerprint: np.ndarray, copied: np.ndarray, many: np.ndarray, much: np.ndarray) -> bytes:
    """A message to a shard; doc: of each n-gram, in order; fingerprint, copied:
    of each document.  Only documents with copies tell their fingerprint."""
    runs = _heads(doc)
    d = doc[runs]
    c = copied[d]
    return pack(np.array([serial]), token, _planes(np.diff(d, prepend=d[:1] * 0)), _planes(2 * _lengths(runs, len(doc)) + c), fingerprint[d[c]], many, much)


def _told(blob: bytes) -> list[np.ndarray]:
    """batch, n-grams, documents and lengths of runs, fingerprints, frequent
    n-grams, their counts.  Documents without copies get a number of their own."""
    batch, token, d, length, fingerprint, *rest = unpack(blob, *ASKED)
    doc, length = np.cumsum(_numbers(d), dtype=np.uint32), _numbers(length)
    with np.errstate(over="ignore"):
        own = mix(mix(batch.view(np.uint64)) + doc.astype(np.uint64))
    own[(length & 1).astype(bool)] = fingerprint
    return [batch, token, doc, length >> 1, own, *rest]


#: Slots for the hashes of texts that occur more than once, a bit each.
SLOTS = 1 << 24


def _copies(texts: DataFrame) -> np.ndarray:
    """A bit for each slot that the xxhash64 of a repeated text falls on.  Where
    a text only shares the slot, or a set is repeated by different texts, the
    exchange carries more, the results are the same."""
    h = texts.groupBy(F.xxhash64("text").alias("h")).agg(F.count("*").alias("c")).where("c > 1").select(F.pmod("h", F.lit(SLOTS)).alias("slot"))
    words = h.groupBy((F.col("slot") / 64).cast("int").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 64 as int))")).alias("bits")).toPandas()
    bits = np.zeros(SLOTS // 64, dtype=np.int64)
    bits[words["at"].to_numpy()] = words["bits"].to_numpy()
    return bits.view(np.uint8)


def _send(shards: int, k: int, local: int, copies: np.ndarray):
    """docs -> (key, batch, blob).  batch null: n-grams for the shard ``key``;
    otherwise the batch's own documents and its n-grams that need no asking."""

    def run(rows):
        serial = TaskContext.get().partitionId() << 32
        for b in by_bytes(rows, "text", 2_000_000, 1 << 16):
            serial += 1
            texts = b.column("text").to_pylist()
            words = Words(texts, lower=True)
            h = words.hashes()
            sets, of, node, prints = [], {}, [], []
            for i in range(len(texts)):
                w = h[words.first[i] : words.first[i + 1]]
                if not len(w):
                    node.append(-1)
                    continue
                s = np.unique(shingle_hashes(w, min(k, len(w))))
                fp = xxhash.xxh3_128_digest(s.tobytes())
                if fp not in of:
                    of[fp] = len(sets)
                    sets.append(s)
                    prints.append(fp)
                node.append(of[fp])
            raw = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), seed=42) if t is not None else 0 for t in texts], dtype=np.uint64)
            slot = (raw % np.uint64(SLOTS)).astype(np.int64)
            copied = np.zeros(len(sets), dtype=bool)
            copied[np.array(node, dtype=np.int64)[((copies[slot >> 3] >> (slot & 7)) & 1).astype(bool) & (np.array(node) >= 0)]] = True
            size = np.array([len(s) for s in sets], dtype=np.int64)
            home = {"doc": b.column("doc_id").to_pylist(), "node": node, "raw": raw.view(np.int64), "fp": prints, "n": size}
            if sets:
                token, doc = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint32), size)
                sets.clear()
                order = np.argsort(token, kind="stable")
                head = _heads(token[order])
                count = _lengths(head, len(token))
                # frequent n-grams travel once, with their count; who holds them stays here
                many, much = token[order[head[count > local]]], count[count > local].astype(np.uint32)
                hot = np.zeros(len(token), dtype=bool)
                hot[order] = np.repeat(count > local, count)
                home["hot"], home["hot_doc"] = token[hot], doc[hot]
                token, doc = token[~hot], doc[~hot]
                short = np.array([int.from_bytes(p[:8], "little") for p in prints], dtype=np.uint64)
                shard = token % np.uint64(shards)
                order = np.argsort(shard, kind="stable")  # documents stay in order
                token, doc, shard = token[order], doc[order], shard[order]
                hot_shard = many % np.uint64(shards)
                order = np.argsort(hot_shard, kind="stable")
                many, much, hot_shard = many[order], much[order], hot_shard[order]
                to = np.union1d(shard, hot_shard)
                at, hot_at = (np.append(np.searchsorted(x, to), len(x)) for x in (shard, hot_shard))
                blobs = [_asked(serial, token[x:y], doc[x:y], short, copied, many[p:q], much[p:q]) for x, y, p, q in zip(at, at[1:], hot_at, hot_at[1:])]
                yield _rows(to.astype(np.int64), [None] * len(to), blobs)
            yield _rows([serial], [serial], [pickle.dumps(home, protocol=5)])

    return run


def _sorted_rows(batches, column: str):
    """(key, rows) of a partition that is sorted by ``column``, one key at a time."""
    rows = ((k, r) for b in batches for k, *r in zip(*(b.column(c).to_pylist() for c in (column, "key", "batch", "blob")), strict=True))
    return groupby(rows, key=lambda r: r[0])


def _count(batches):
    """Shard partition, sorted by key -> (key, batch, blob): for each batch its
    n-grams that occur in different sets, with their frequency.  One shard is
    held at a time; what a batch told of itself passes through."""
    for key, rows in _sorted_rows(batches, "key"):
        parts = []
        for _, (_, batch, blob) in rows:
            if batch is None:
                parts.append(_told(blob))
            else:
                yield _rows([key], [batch], [blob])
        if not parts:
            continue
        lone, hot = [len(p[1]) for p in parts], [len(p[5]) for p in parts]
        token = np.concatenate([p[1] for p in parts] + [p[5] for p in parts])
        fp = np.concatenate([np.repeat(p[4], p[3]) for p in parts] + [np.zeros(n, dtype=np.uint64) for n in hot])
        weight = np.concatenate([np.ones(sum(lone), dtype=np.uint32)] + [p[6] for p in parts])
        order = np.argsort(token, kind="stable")
        head = _heads(token[order])
        fp, weight = fp[order], weight[order]
        total = np.minimum(np.add.reduceat(weight.astype(np.int64), head), 0xFFFFFFFF).astype(np.uint32)
        apart = (np.minimum.reduceat(fp, head) != np.maximum.reduceat(fp, head)) | (np.maximum.reduceat(weight, head) > 1)
        del fp, weight
        frequency = np.empty(len(token), dtype=np.uint32)  # 0: in one set only
        frequency[order] = np.repeat(np.where(apart, total, 0), _lengths(head, len(token)))
        del order
        at, hot_at = np.cumsum([0, *lone]), sum(lone) + np.cumsum([0, *hot])
        keys, blobs = [], []
        for i, p in enumerate(parts):
            f, g = frequency[at[i] : at[i + 1]], frequency[hot_at[i] : hot_at[i + 1]]
            if f.any() or g.any():
                keys.append(int(p[0][0]))
                blobs.append(pack(p[1][f > 0], np.repeat(p[2], p[3])[f > 0], f[f > 0], p[5][g > 0], g[g > 0]))
        if keys:
            yield _rows([-1] * len(keys), keys, blobs)


# ---------------------------------------------------------------- prefixes

SKETCH, PARTS = 512, 16
OUT = "doc_id long, raw long, n long, fp binary, m int, ids array<long>, parity array<long>, parts array<int>"


def parity_sketch(ids: np.ndarray) -> np.ndarray:
    """Parity of the n-grams that fall on each bit.  The sketches of two sets
    differ in no more bits than the sets do in n-grams."""
    bit = (mix(ids.view(np.uint64)) % np.uint64(SKETCH)).astype(np.int64)
    return np.packbits(np.bincount(bit, minlength=SKETCH).astype(np.uint8) & 1, bitorder="little").view(np.int64)


def part_sizes(ids: np.ndarray) -> np.ndarray:
    """How many n-grams lie in each of equal parts of the hash range."""
    return np.bincount((ids.view(np.uint64) >> np.uint64(60)).astype(np.int64), minlength=PARTS).astype(np.int32)


def _prefixes(percent: int):
    """Partition sorted by batch -> one row per document; ``ids``: the n-grams
    that other sets hold too, rare first (by powers of two, then by value), for
    the first row of each set that stays in question; ``m``: how many of them
    are in its prefix."""

    def run(batches):
        for _, rows in _sorted_rows(batches, "batch"):
            home, answers = None, []
            for _, (key, _, blob) in rows:
                if key < 0:
                    answers.append(unpack(blob, *ANSWERED))
                else:
                    home = pickle.loads(blob)
            token, doc, frequency, hot, hot_frequency = (np.concatenate([a[j] for a in answers] or [np.empty(0, dtype=t)]) for j, t in enumerate(ANSWERED))
            if len(hot):
                order = np.argsort(hot)
                at = order[np.searchsorted(hot, home["hot"], sorter=order)]
                token, doc, frequency = np.concatenate((token, home["hot"])), np.concatenate((doc, home["hot_doc"])), np.concatenate((frequency, hot_frequency[at]))
            order = np.lexsort((token, np.log2(np.maximum(frequency, 1)).astype(np.int64), doc))
            token, doc = token[order].view(np.int64), doc[order]
            size = home["n"].tolist()
            at = np.searchsorted(doc, np.arange(len(size) + 1))
            lists: dict = {}
            for i, n in enumerate(size):
                m = prefix_length(n, percent) - (n - int(at[i + 1] - at[i]))
                if m > 0:
                    lists[i] = (m, token[at[i] : at[i + 1]])
            first = [lists.pop(x, None) for x in home["node"]]
            arrays = [
                pa.array(home["doc"], pa.int64()), pa.array(home["raw"], pa.int64()), pa.array([size[x] if x >= 0 else 0 for x in home["node"]], pa.int64()),
                pa.array([home["fp"][x] if x >= 0 else None for x in home["node"]], pa.binary()), pa.array([f and f[0] for f in first], pa.int32()), pa.array([f and f[1] for f in first], pa.list_(pa.int64())),
                pa.array([f and parity_sketch(f[1]) for f in first], pa.list_(pa.int64())), pa.array([f and part_sizes(f[1]) for f in first], pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in OUT.split(", ")])

    return run


# ---------------------------------------------------------------- candidates


def _may_link(n: str, pos: str, m: str, mpos: str, percent: int) -> Column:
    """Length filter and positional filter at a shared n-gram."""
    a, b = F.col(n), F.col(m)
    length = F.least(a, b) * 100 >= F.greatest(a, b) * percent
    return length & (F.least(a - F.col(pos), b - F.col(mpos)) >= least_overlap(a, b, percent))


def _near_enough(x: str, y: str, percent: int) -> Column:
    """Suffix filter and parity filter; x, y: endings of the two sets' columns."""
    a, b = F.col(f"n{x}"), F.col(f"n{y}")
    alone = F.col(f"alone{x}") + F.col(f"alone{y}")
    most = a + b - 2 * least_overlap(a, b, percent) - alone
    parts = sum((F.abs(F.get(f"parts{x}", F.lit(i)) - F.get(f"parts{y}", F.lit(i))) for i in range(PARTS)), F.lit(0))
    bits = sum((F.bit_count(F.get(f"parity{x}", F.lit(i)).bitwiseXOR(F.get(f"parity{y}", F.lit(i)))) for i in range(SKETCH // 64)), F.lit(0))
    return F.when(parts <= most, bits <= most).otherwise(False)


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) -> (a, b, near), by sizes and sketches, which are small."""
    held = sets.select("fp", "n", (F.col("n") - F.size("ids")).alias("alone"), "parity", "parts")
    both = pairs.join(held.toDF("a", *(f"{c}_a" for c in held.columns[1:])), "a").join(held.toDF("b", *(f"{c}_b" for c in held.columns[1:])), "b")
    return both.select("a", "b", _near_enough("_a", "_b", percent).alias("near"))


def _linked(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, near) -> the linked pairs (a, b), by the exact overlap."""
    held = sets.select("fp", "n", "ids")
    both = near.where("near").select("a", "b").join(held.toDF("a", "n_a", "ids_a"), "a").join(held.toDF("b", "n_b", "ids_b"), "b")
    shared = F.size(F.array_intersect("ids_a", "ids_b"))
    return both.where(100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")


def _hubs(member: DataFrame, seed: int, singles: bool) -> DataFrame:
    """(gram, hub, a, na, pa): for n-grams that several labels hold, the label
    that holds it most often and one of its sets, the least by a hash.

    ``singles``: every set is a label of its own.  Then the hash is alike for
    all n-grams, so that a set meets few different hubs, which join most copies.
    Later it changes with n-gram and round: the sets that are left meet many
    members of the large labels, as they may be similar to some of them only."""
    x = F.xxhash64(F.lit(seed), "fp") if singles else F.xxhash64(F.lit(seed), "gram", "fp")
    first = F.min(F.struct(x.alias("x"), "fp", "n", "pos"))
    if singles:
        hub = member.groupBy("gram").agg(first.alias("p"), F.count("*").alias("labels")).withColumn("label", F.col("p.fp"))
    else:
        each = member.groupBy("gram", "label").agg(F.count("*").alias("c"), first.alias("p"))
        most = F.max(F.struct("c", F.xxhash64(F.lit(seed), "label").alias("x"), "label", "p"))
        hub = each.groupBy("gram").agg(most.alias("h"), F.count("*").alias("labels")).select("gram", "labels", "h.label", "h.p")
    return hub.where("labels > 1").select("gram", F.col("label").alias("hub"), F.col("p.fp").alias("a"), F.col("p.n").alias("na"), F.col("p.pos").alias("pa"))


def _untried(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs if tried is None else pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti")


def _hub_pairs(held: DataFrame, percent: int) -> DataFrame:
    """For each n-gram its hub with every set of another label: as many pairs as
    postings.  held: members beside the hubs of their n-grams."""
    met = held.where((F.col("label") != F.col("hub")) & _may_link("n", "pos", "na", "pa", percent))
    return met.select("a", F.col("fp").alias("b"))


def _remaining_pairs(member: DataFrame, hubs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of different components.  Under each n-gram the sets
    outside its most frequent component meet all sets of other components, so a
    group that is one component meets nothing.  All filters run inside the join."""
    held = sets.select("fp", (F.col("n") - F.size("ids")).alias("alone"), "parity", "parts")
    full = member.join(hubs.select("gram", "hub"), "gram").join(held, "fp")
    names = ("fp", "n", "pos", "label", "alone", "parity", "parts")
    left = full.where(F.col("label") != F.col("hub")).select(F.col("gram").alias("gram_a"), *(F.col(c).alias(f"{c}_a") for c in names))
    right = full.select(F.col("gram").alias("gram_b"), (F.col("label") == F.col("hub")).alias("in_hub"), *(F.col(c).alias(f"{c}_b") for c in names))
    other = (F.col("in_hub") | (F.col("label_a") < F.col("label_b"))) & (F.col("label_a") != F.col("label_b")) & _may_link("n_a", "pos_a", "n_b", "pos_b", percent)
    met = left.join(right, (F.col("gram_a") == F.col("gram_b")) & F.when(other, _near_enough("_a", "_b", percent)).otherwise(False))
    return met.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75, local: int = 8, rounds: int = 3) -> DataFrame:
    """One row per input row: doc_id, raw (xxhash64 of the text), n (set size),
    fp (the set, null without words), component (an fp of its component)."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = partitions(docs, 2)  # a worker holds one shard's n-grams at a time
    asked = d.mapInArrow(_send(parts, k, local, _copies(d)), EXCHANGED).repartition(parts, "key", "batch").sortWithinPartitions("key")
    counted = asked.mapInArrow(_count, EXCHANGED).repartition(parts, "batch").sortWithinPartitions("batch")
    rows = materialise(counted.mapInArrow(_prefixes(percent), OUT), "rows")
    named = rows.select("doc_id", "raw", "n", "fp")

    sets = materialise(rows.where(F.col("ids").isNotNull()).select("fp", "n", "m", "ids", "parity", "parts").dropDuplicates(["fp"]), "sets")
    posted = sets.select("fp", "n", (F.col("n") - F.size("ids")).alias("alone"), F.posexplode(F.slice("ids", F.lit(1), F.col("m"))).alias("j", "gram")).select("gram", "fp", "n", (F.col("alone") + F.col("j")).alias("pos"))

    def labelled(posted: DataFrame, label: DataFrame | None) -> DataFrame:
        if label is None:
            return posted.withColumn("label", F.col("fp"))
        return posted.join(label.toDF("fp", "label"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))

    label, tried, links, last, told, held = None, None, None, False, [], None
    for seed in range(rounds):
        member = labelled(posted, label)
        if label is not None:
            member = materialise(member, "member")
        hubs = materialise(_hubs(member, seed, label is None), "hubs")
        # labels only grow together: an n-gram that one label holds meets nothing from here on
        old, held = held, materialise(member.join(hubs, "gram"), "held")
        posted = held.select("gram", "fp", "n", "pos")
        discard(hubs, old, member)
        near = materialise(_near(_untried(_hub_pairs(held, percent), tried), sets, percent), "near")
        found = materialise(_linked(near, sets, percent), "pairs")
        told += [near, found]
        last = found.isEmpty()
        tried, links = (near, found) if tried is None else (tried.union(near), links.union(found))
        if last:
            break
        # all links so far: labels are less than components, and a pair that was tried isn't found again
        old, edges = label, links if label is None else label.toDF("a", "b").union(links)
        label = components(edges) if seed == rounds - 1 else merged(edges)
        discard(old)

    member = labelled(posted, label)
    if label is not None:
        member = materialise(member, "member")
    hubs = materialise(_hubs(member, rounds, label is None), "hubs")
    near = materialise(_near(_untried(_remaining_pairs(member, hubs, sets, percent), tried), sets, percent), "near")
    more = materialise(_linked(near, sets, percent), "links")
    if not more.isEmpty() or (last and label is not None):
        known = more if label is None else label.toDF("a", "b").union(more)
        # after the last round labels are components; those of an earlier one need the links they were made of
        label = components(known.union(links) if last else known)
    discard(hubs, member, near, more, sets, held, *told)
    if label is None:
        out = named.withColumn("component", F.col("fp"))
    else:
        out = named.join(label.toDF("fp", "component"), "fp", "left").select("doc_id", "raw", "n", "fp", F.coalesce("component", "fp").alias("component"))
    out.tables_ = (rows, label)  # for the caller to discard once the result is written
    return out


# ---------------------------------------------------------------- results


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, component_size."""
    classes = jaccard_classes(docs, id_col, text_col, k, percent)
    found = materialise(classes, "classes")
    discard(*classes.tables_)
    least = found.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"))
    least = materialise(least.where("size > 1"), "least")  # a table of its own, so that a large component's rows can be split
    return found.join(least, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"), F.coalesce("size", F.lit(1)).alias("component_size"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps one: its
    smallest doc_id (nulls last), then smallest text hash; of rows alike in both
    any one.  Wordless rows all stay."""
    far = F.lit((1 << 63) - 1)
    found = jaccard_classes(docs, id_col, text_col, k, percent)
    place = F.struct(F.coalesce("doc_id", far).alias("d"), F.col("raw").alias("r"))
    d, r = unused(docs, "place_d", "place_r")
    best = found.where(F.col("component").isNotNull()).groupBy("component").agg(F.min(place).alias("p")).select(F.col("p.d").alias(d), F.col("p.r").alias(r)).distinct()
    worded = F.coalesce(F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    marked = docs.where(worded).withColumn(d, F.coalesce(F.col(id_col).cast("long"), far)).withColumn(r, F.xxhash64(F.col(text_col).cast("string")))
    one = marked.join(best, [d, r], "left_semi").dropDuplicates([d, r]).select(*docs.columns)
    return one.union(docs.where(~worded))
