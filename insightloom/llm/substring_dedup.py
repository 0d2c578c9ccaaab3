"""Substring dedup (operator 3): FM-index shards over repeated text.

A window is ``window`` consecutive words of one document.  Each word covered by
a window whose word sequence also starts in a document with a smaller id is
removed.

1. *Routing.*  A window's anchor is the run of ``anchor`` words with the least
   hash inside it.  Equal windows have equal anchors, so consecutive windows
   with one anchor form a fragment that is sent, as a whole, to the shard of
   its anchor.  A first exchange of anchor hashes leaves out anchors that only
   one document holds; their windows can't occur in a second one.
2. *Shards.*  A shard sets up a compressed FM-index over its fragments: suffix
   order, Burrows-Wheeler transform, wavelet tree of packed bits with rank
   counts.  All windows of the streamed fragments run backward through it in
   step; a window's match grows word by word while its interval still holds an
   occurrence in a smaller document than some owner of the fragment.  Windows that reach the threshold are reported with the smallest
   document of their interval.
3. *Cutting.*  Reports meet their documents by id, covered words are removed.

Hot text is pre-aggregated: copies of one fragment inside a batch travel as one
fragment, and beyond ``local_copies`` of them only the smallest document's goes
to the shard while the others, which repeat it, are reported on the spot.
Symbols are exact: a shard numbers the words themselves, never their hashes.

Known limit: all fragments of one anchor, copies within a batch counted once,
meet in one shard, so an anchor with very many different surroundings makes that
shard large.

Defined cases: ids are integers (others fail in the cast).  Null and empty texts
have no words; very long texts are read whole, in batches of their own.  Empty
tables give empty results.  A null doc_id is neither
smaller nor larger than another: such rows stay as they are.  Rows with equal
doc_id never remove each other's words; each loses the words of its own text
that documents with a smaller id hold.  Documents shorter than a window stay.
Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import pickle
import struct
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, by_bytes, mix, partitions, shingle_hashes

WINDOW, ANCHOR = 13, 5
NOBODY = np.iinfo(np.int64).max


# ---------------------------------------------------------------- FM-index


class BitVector:
    """Packed bits with rank: 64 bits and one 32-bit count a block."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros(-len(bits) % 64 + 64, dtype=np.uint8)
        self.word = np.packbits(np.concatenate((bits.view(np.uint8), pad)), bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.word), dtype=np.int32)
        np.cumsum(np.bitwise_count(self.word)[:-1], out=self.before[1:], dtype=np.int32)

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.word[block] & mask)


class WaveletTree:
    """Level-wise wavelet tree (matrix layout) over small integers."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.bits = max(1, int(symbols - 1).bit_length())
        self.level, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            one = ((seq >> b) & 1).astype(bool)
            self.level.append(BitVector(one))
            self.zeros.append(int(len(seq) - one.sum()))
            seq = np.concatenate((seq[~one], seq[one]))

        # where each symbol's run starts on the last level
        self.start = np.zeros(1 << self.bits, dtype=np.int64)
        self.start = self._descend(np.arange(1 << self.bits), self.start)

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, (bv, z) in enumerate(zip(self.level, self.zeros, strict=True)):
            r = bv.rank1(i)
            i = np.where((c >> (self.bits - 1 - k)) & 1 == 1, z + r, i - r)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c[x] among the first i[x] symbols."""
        return self._descend(c, i) - self.start[c]


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling."""
    n = len(text)
    rank = text.astype(np.int64)
    step = 1
    while True:
        tail = np.zeros(n, dtype=np.int64)
        tail[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * np.int64(max(n, int(text.max()) + 1) + 2) + tail
        order = np.argsort(key)
        sorted_key = key[order]
        fresh = np.empty(n, dtype=np.int64)
        fresh[0] = 0
        np.cumsum(sorted_key[1:] != sorted_key[:-1], out=fresh[1:])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            return order
        step *= 2


class FmIndex:
    """FM-index over fragments of symbol sequences, with the owner document of
    each suffix and range minima over them."""

    def __init__(self, symbols: np.ndarray, size: np.ndarray, owner: np.ndarray):
        """Symbols 0, 1, ... of all fragments one after another; fragment i has
        size[i] of them and belongs to document owner[i]."""
        k = len(size)
        # separators come first in order and differ from each other, so no match crosses them
        end = np.cumsum(size + 1) - 1
        n = int(end[-1]) + 1
        text = np.empty(n, dtype=np.int64)
        is_end = np.zeros(n, dtype=bool)
        is_end[end] = True
        text[end] = np.arange(k)
        text[~is_end] = symbols.astype(np.int64) + k
        order = suffix_order(text)
        # for the transform all separators are symbol 0; they are never searched for
        plain = np.where(is_end, 0, text - k + 1)
        bwt = plain[order - 1]
        symbols = int(plain.max()) + 1
        self.tree = WaveletTree(bwt, symbols)
        self.less = np.zeros(symbols + 1, dtype=np.int64)
        np.cumsum(np.bincount(plain, minlength=symbols), out=self.less[1:])
        fragment_of = np.repeat(np.arange(k), size + 1)
        self.size = n
        low = owner[fragment_of[order]]
        # sparse table of range minima: row k holds minima over 2**k suffixes
        self.low = np.empty((max(1, n.bit_length()), n), dtype=np.int64)
        self.low[0] = low
        for k in range(1, len(self.low)):
            half = 1 << (k - 1)
            self.low[k] = self.low[k - 1]
            np.minimum(self.low[k - 1][:-half], self.low[k - 1][half:], out=self.low[k][:-half])

    def smallest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest owner in each suffix interval [lo, hi), none empty."""
        k = np.frexp((hi - lo).astype(np.float64))[1].astype(np.int64) - 1
        return np.minimum(self.low[k, lo], self.low[k, hi - (np.int64(1) << k)])

    def matching(self, symbols: np.ndarray, last: np.ndarray, below: np.ndarray, most: int) -> np.ndarray:
        """For each entry of ``last``, a position in ``symbols``: the match that
        ends there is extended to the left, symbol by symbol, as long as the
        index holds it in an owner smaller than ``below`` (looked at every few
        symbols and at the end).  Where it reaches ``most`` symbols, the
        smallest owner of its interval, else NOBODY."""
        lanes = np.arange(len(last))
        c = symbols[last] + 1
        lo, hi = self.less[c], self.less[c + 1]
        found = np.full(len(last), NOBODY, dtype=np.int64)
        for step in range(1, most + 1):
            if step == most or step % 4 == 1:
                some = np.flatnonzero(lo < hi)
                lanes, lo, hi = lanes[some], lo[some], hi[some]
                low = self.smallest(lo, hi)
                some = np.flatnonzero(low < below[lanes])
                lanes, lo, hi, low = lanes[some], lo[some], hi[some], low[some]
                if step == most:
                    found[lanes] = low
            if step == most or not len(lanes):
                break
            c = symbols[last[lanes] - step] + 1
            two = np.concatenate((c, c))
            both = self.less[two] + self.tree.rank(two, np.concatenate((lo, hi)))
            lo, hi = both[: len(c)], both[len(c) :]
        return found


# ---------------------------------------------------------------- fragments


def anchors(h: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fragments of one document's word hashes: (start, windows, anchor hash).

    Fragment x has the windows start[x] .. start[x] + windows[x] - 1, which
    share one anchor occurrence.
    """
    n = len(h) - window + 1
    empty = np.empty(0, dtype=np.int64)
    if n <= 0:
        return empty, empty, np.empty(0, dtype=np.uint64)
    s = shingle_hashes(h, anchor)
    best, at = s[:n].copy(), np.arange(n)
    for k in range(1, window - anchor + 1):
        less = s[k : k + n] < best
        best[less] = s[k : k + n][less]
        at[less] = np.flatnonzero(less) + k
    start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return start, np.diff(np.append(start, n)), best[start]


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _shard(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(n)).astype(np.int64)


def _emit_anchors(shards: int, window: int, anchor: int, local: int):
    """docs -> (key, doc_id, blob): anchor hashes by shard, each held by at most
    two documents of the batch; and, with a null blob key -1 - x, anchors that
    the batch itself knows to be repeated, for the document."""

    def run(batches):
        for b in by_bytes(batches, "text"):
            ids = b.column("doc_id").to_pylist()
            words = Words(b.column("text").to_pylist())
            h = words.hashes()
            hs, docs = [], []
            for i, d in enumerate(ids):
                _, _, a = anchors(h[words.first[i] : words.first[i + 1]], window, anchor)
                a = np.unique(a)
                hs.append(a)
                docs.append(np.full(len(a), d, dtype=np.int64))
            if not hs:
                continue
            a, d = np.concatenate(hs), np.concatenate(docs)
            if not len(a):  # no text of the batch has a window
                continue
            order = np.lexsort((d, a))
            a, d = a[order], d[order]
            again = np.concatenate(([False], (a[1:] == a[:-1]) & (d[1:] == d[:-1])))  # repeated rows
            a, d = a[~again], d[~again]
            head = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            size = np.diff(np.append(head, len(a)))
            hot = np.repeat(size > local, size)
            first = np.zeros(len(a), dtype=bool)
            first[head] = True
            keys, doc_col, blobs = [], [], []
            send = ~hot | first
            shard = _shard(a[send], shards)
            order = np.argsort(shard, kind="stable")
            sa, sd, shard = a[send][order], d[send][order], shard[order]
            cut = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
            for x, y in zip(cut, np.append(cut[1:], len(shard)), strict=True):
                keys.append(int(shard[x]))
                doc_col.append(None)
                blobs.append(_pack(sa[x:y], sd[x:y]))
            ha, hd = a[hot], d[hot]
            order = np.argsort(hd, kind="stable")
            ha, hd = ha[order], hd[order]
            cut = np.flatnonzero(np.concatenate(([True], hd[1:] != hd[:-1])))[: len(hd)]
            for x, y in zip(cut, np.append(cut[1:], len(hd))[: len(cut)], strict=True):
                keys.append(int(hd[x]) % (1 << 40))
                doc_col.append(int(hd[x]))
                blobs.append(_pack(ha[x:y]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(doc_col, pa.int64()), pa.array(blobs, pa.binary())], names=["key", "doc_id", "blob"])

    return run


def _repeated_anchors(batches):
    """Exchange partition -> (doc_id, blob of anchors that two documents hold)."""
    hs, docs = [], []
    for b in batches:
        known_d, known_b = [], []
        for d, blob in zip(b.column("doc_id").to_pylist(), b.column("blob").to_pylist(), strict=True):
            if d is not None:
                known_d.append(d)
                known_b.append(blob)
                continue
            n = len(blob) // 16
            hs.append(np.frombuffer(blob, dtype=np.uint64, count=n))
            docs.append(np.frombuffer(blob, dtype=np.int64, offset=8 * n))
        if known_d:
            yield pa.RecordBatch.from_arrays([pa.array(known_d, pa.int64()), pa.array(known_b, pa.binary())], names=["doc_id", "blob"])
    if not hs:
        return
    h, d = np.concatenate(hs), np.concatenate(docs)
    order = np.argsort(h, kind="stable")
    h, d = h[order], d[order]
    head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    two = np.minimum.reduceat(d, head) < np.maximum.reduceat(d, head)
    keep = np.repeat(two, np.diff(np.append(head, len(h))))
    h, d = h[keep], d[keep]
    order = np.argsort(d, kind="stable")
    h, d = h[order], d[order]
    cut = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1]))) if len(d) else []
    for i in range(0, len(cut), 4096):
        part = cut[i : i + 4096]
        ends = np.append(cut[1:], len(d))[i : i + 4096]
        yield pa.RecordBatch.from_arrays([pa.array(d[part], pa.int64()), pa.array([h[x:y].tobytes() for x, y in zip(part, ends, strict=True)], pa.binary())], names=["doc_id", "blob"])


def _runs_of(runs: np.ndarray) -> bytes:
    """(start, windows, mark) rows as packed 32-bit integers."""
    return runs.astype("<i4").tobytes()


def _runs(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype="<i4").reshape(-1, 4)


def _mark(text: str | bytes) -> tuple[int, int]:
    """64 bits of the text that a run belongs to, so that rows of one id keep
    to their own runs."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return struct.unpack("<ii", xxhash.xxh3_64_digest(raw))


def _emit_fragments(shards: int, window: int, anchor: int, local: int):
    """(doc_id, text, blobs of its repeated anchors) -> (key, doc_id, blob):
    compressed fragments for the shard ``key``, or, with a doc_id, runs of
    windows that are already known to repeat."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in by_bytes(batches, "text"):
            ids = b.column("doc_id").to_pylist()
            text = b.column("text").to_pylist()
            words = Words(text)
            h = words.hashes()
            seen: dict = defaultdict(list)
            for i, (d, blobs) in enumerate(zip(ids, b.column("blobs").to_pylist(), strict=True)):
                if d is None or not blobs:
                    continue
                w0, w1 = words.first[i], words.first[i + 1]
                start, count, a = anchors(h[w0:w1], window, anchor)
                hit = np.flatnonzero(np.isin(a, np.frombuffer(b"".join(blobs), dtype=np.uint64)))
                if not len(hit):
                    continue
                start, count, a = start[hit], count[hit], a[hit]
                mark = _mark(text[i])
                at, to = words.start[w0 + start].tolist(), words.end[w0 + start + count + window - 2].tolist()
                for x, y, s, c, key in zip(at, to, start.tolist(), count.tolist(), a.tolist(), strict=True):
                    seen[b" ".join(words.raw[x:y].split()), key].append((d, s, c, *mark))
            told, shard = defaultdict(list), defaultdict(list)
            for (part, a), owners in seen.items():
                if len(owners) > local and len({o[0] for o in owners}) > local:
                    owners.sort()
                    least = owners[0][0]
                    for o in owners:
                        if o[0] > least:
                            told[o[0]].append(o[1:])
                    owners = [o for o in owners if o[0] == least]
                shard[(a >> 20) % shards].append((part, owners))
            keys, docs, blobs = [], [], []
            for d, runs in told.items():
                keys.append(d % (1 << 40))
                docs.append(d)
                blobs.append(_runs_of(np.array(runs)))
            for key, items in shard.items():
                keys.append(key)
                docs.append(None)
                flat = np.array([o for _, owners in items for o in owners], dtype=np.int64)
                packed = (b"\n".join(t for t, _ in items), np.array([len(o) for _, o in items], dtype=np.int32), flat[:, 0].copy(), flat[:, 1:].astype(np.int32))
                blobs.append(squeeze(pickle.dumps(packed, protocol=5)))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(docs, pa.int64()), pa.array(blobs, pa.binary())], names=["key", "doc_id", "blob"])

    return run


def _search_shard(blobs: list, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The fragments of a shard, searched in an index of themselves.  Returns
    the reports: documents and their (start, windows, mark)."""
    place: dict = {}
    of, docs, spots = [], [], []
    for texts, n_owners, doc, spot in blobs:
        at = np.array([place.setdefault(t, len(place)) for t in texts.split(b"\n")])
        of.append(np.repeat(at, n_owners))
        docs.append(doc)
        spots.append(spot)
    of, docs, spots = np.concatenate(of), np.concatenate(docs), np.concatenate(spots)
    ids: dict = {}
    words = b" ".join(place).split()
    symbols = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.int64)
    size = np.array([t.count(b" ") + 1 for t in place], dtype=np.int64)
    begin = np.cumsum(size) - size
    least, largest = np.full(len(size), NOBODY, dtype=np.int64), np.full(len(size), -NOBODY, dtype=np.int64)
    np.minimum.at(least, of, docs)
    np.maximum.at(largest, of, docs)
    index = FmIndex(symbols, size, least)
    windows = size - window + 1
    first = np.cumsum(windows) - windows
    lane_of = np.repeat(np.arange(len(size)), windows)
    inside = np.arange(len(lane_of)) - first[lane_of]
    low = index.matching(symbols, begin[lane_of] + inside + window - 1, largest[lane_of], window)
    # an owner larger than all its windows' smallest owners loses them all, one not
    # larger than any of them nothing; the rest is cut window by window
    all_below, any_below = np.maximum.reduceat(low, first)[of] < docs, np.minimum.reduceat(low, first)[of] < docs
    out_d, out_s = [docs[all_below]], [spots[all_below]]
    for i in np.flatnonzero(any_below & ~all_below).tolist():
        f, (s, _, *mark) = of[i], spots[i].tolist()
        hit = np.flatnonzero(low[first[f] : first[f] + windows[f]] < docs[i])
        cut = np.flatnonzero(np.diff(hit) > 1)
        x, y = hit[np.concatenate(([0], cut + 1))], hit[np.concatenate((cut, [len(hit) - 1]))]
        out_d.append(np.full(len(x), docs[i]))
        out_s.append(np.column_stack((s + x, y - x + 1, *(np.full(len(x), m) for m in mark))).astype(np.int32))
    return np.concatenate(out_d), np.concatenate(out_s)


def _to_buckets(docs: np.ndarray, runs: np.ndarray, buckets: int):
    """(key, blob): reports packed by a hash of their document."""
    with np.errstate(over="ignore"):
        key = (mix(docs.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    key, docs, runs = key[order], docs[order], runs[order]
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[: len(key)]
    ends = np.append(cut[1:], len(key))
    blobs = [pickle.dumps((docs[x:y], runs[x:y].astype(np.int32)), protocol=5) for x, y in zip(cut.tolist(), ends.tolist(), strict=False)]
    yield pa.RecordBatch.from_arrays([pa.array(key[cut], pa.int64()), pa.array(blobs, pa.binary())], names=["key", "blob"])


def _by_document(batches):
    """Bucket partition -> (doc_id, runs): all runs of a document in one row."""
    parts = [pickle.loads(x) for b in batches for x in b.column("blob").to_pylist()]
    if not parts:
        return
    docs, runs = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(docs, kind="stable")
    docs, runs = docs[order], runs[order]
    cut = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
    ends = np.append(cut[1:], len(docs))
    for i in range(0, len(cut), 4096):
        some = list(zip(cut[i : i + 4096].tolist(), ends[i : i + 4096].tolist(), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(docs[cut[i : i + 4096]], pa.int64()), pa.array([_runs_of(runs[x:y]) for x, y in some], pa.binary())], names=["doc_id", "runs"])


def _report(window: int, shard_words: int, buckets: int):
    """Exchange partition -> (key, blob) of reports, one FM-index for about
    ``shard_words`` words; fragments of one anchor stay together."""

    def run(batches):
        open_ = zstandard.ZstdDecompressor().decompress
        shards: dict = defaultdict(list)
        docs, runs, part, size = [], [], [], 0
        for b in batches:
            for key, doc, blob in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "blob")), strict=True):
                if doc is None:
                    shards[key].append(blob)
                else:
                    told = _runs(blob)
                    docs.append(np.full(len(told), doc, dtype=np.int64))
                    runs.append(told)
        for key in sorted(shards):
            new = [pickle.loads(open_(x)) for x in shards.pop(key)]
            part += new
            size += sum(x[0].count(b" ") + x[0].count(b"\n") for x in new)
            if size >= shard_words or not shards:
                d, r = _search_shard(part, window)
                docs.append(d)
                runs.append(r)
                part, size = [], 0
        if docs:
            yield from _to_buckets(np.concatenate(docs), np.concatenate(runs), buckets)

    return run


# ---------------------------------------------------------------- operator


def repeated_windows(d: DataFrame, parts: int, window: int = WINDOW, anchor: int = ANCHOR, local_copies: int = 4, shard_words: int = 150_000) -> DataFrame:
    """(doc_id, runs): for documents (doc_id, text), packed (start, windows,
    mark of the text): runs of windows, by word position, whose word sequences
    also start in a document with a smaller id.  One row an id that has any."""
    keys = parts * 16  # several shards a partition, so that one index stays small
    sent = d.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(_emit_anchors(keys, window, anchor, local_copies), "key long, doc_id long, blob binary")
    again = sent.repartition(parts, F.pmod("key", F.lit(keys))).mapInArrow(_repeated_anchors, "doc_id long, blob binary")
    per_doc = again.groupBy("doc_id").agg(F.collect_list("blob").alias("blobs"))  # bounded by the document itself
    # a left join, so that its shuffle of the texts serves the last join as well
    held = d.join(per_doc, "doc_id", "left").select("doc_id", F.when(F.col("blobs").isNotNull(), F.col("text")).alias("text"), "blobs")
    fragments = held.mapInArrow(_emit_fragments(keys, window, anchor, local_copies), "key long, doc_id long, blob binary")
    found = fragments.repartition(parts, F.pmod("key", F.lit(keys))).mapInArrow(_report(window, shard_words, parts), "key long, blob binary")
    return found.repartition(parts, "key").mapInArrow(_by_document, "doc_id long, runs binary")


def _with_runs(docs: DataFrame, id_col: str, text_col: str, window: int, settings: dict) -> DataFrame:
    """docs as (doc_id, text, rest) with the repeated runs of each."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"c{i}_") for i, c in enumerate(docs.columns) if c not in (id_col, text_col)))
    runs = repeated_windows(d, partitions(docs, 8), window, **settings)
    return d.join(runs, "doc_id", "left")


def cut_text(text: str | None, runs: bytes | None, window: int = WINDOW, with_text: bool = True) -> tuple[list, np.ndarray, str | None]:
    """Words, removal flags and, asked for, the text without the removed words.
    runs: packed (start, windows, mark); those of other texts don't count."""
    if text is None:
        return [], np.zeros(0, dtype=bool), None
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    gone = np.zeros(len(words), dtype=bool)
    if runs:
        pairs = _runs(runs)
        pairs = pairs[(pairs[:, 2:] == _mark(raw)).all(axis=1)]
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edge, pairs[:, 0], 1)
        np.add.at(edge, pairs[:, 0] + pairs[:, 1] + window - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
    if not with_text or not gone.any():
        return words, gone, text
    w = Words([raw])
    left, at, buf = [], 0, w.buf.tobytes()
    for i in np.flatnonzero(gone).tolist():
        left.append(buf[at : w.start[i]])
        at = int(w.end[i])
    left.append(buf[at : len(raw)])
    return words, gone, b"".join(left).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True, **settings) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256 (of the kept
    words joined by one space) and, asked for, kept_text: the text without the
    removed words, its other characters unchanged."""
    kind = dict(docs.select(id_col).dtypes)[id_col]
    joined = _with_runs(docs.select(id_col, text_col), id_col, text_col, window, settings)

    def run(batches):
        for b in by_bytes(batches, "text", 2_000_000):
            out = []
            for text, rs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                words, gone, left = cut_text(text, rs, window, with_text)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
                out.append((len(words), int(gone.sum()), hashlib.sha256(b" ".join(kept)).hexdigest(), left))
            cols = list(zip(*out, strict=True))
            arrays = [b.column("doc_id").cast(id_type), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(cols[3], pa.string())] * with_text], names=[id_col, "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

    id_type = pa.int32() if kind == "int" else pa.int64()
    return joined.mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars", window: int = WINDOW, **settings) -> DataFrame:
    """The rows of ``docs`` with the repeated words cut from their text and the
    text's length in ``size_col``; other columns unchanged."""
    names = docs.columns
    joined = _with_runs(docs, id_col, text_col, window, settings)
    source = ["doc_id" if c == id_col else "text" if c == text_col else f"c{i}_" for i, c in enumerate(names)]
    at, size_at = names.index(text_col), names.index(size_col)

    def run(batches):
        for b in by_bytes(batches, "text", 2_000_000):
            cols = [b.column(c) for c in source]
            text, size = cols[at].to_pylist(), cols[size_at].to_pylist()
            for i, rs in enumerate(b.column("runs").to_pylist()):
                if rs and text[i] is not None:
                    text[i] = cut_text(text[i], rs, window)[2]
                    size[i] = len(text[i])
            cols[at], cols[size_at] = pa.array(text, pa.string()), pa.array(size, cols[size_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = docs.withColumns({id_col: F.col(id_col).cast("long"), text_col: F.col(text_col).cast("string")}).schema
    return joined.mapInArrow(run, schema)
