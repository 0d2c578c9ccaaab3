"""Packing (operator 8): harmonic packing into fixed-size sequences.

Lengths are sorted into reciprocal-capacity classes: class k holds pieces of
``capacity // k`` tokens and fills a bin with exactly k of them.  Documents may
be cut, so each is taken apart greedily: whole capacities first, then the
largest class size that fits what is left, over classes that waste at most
``max_waste`` of a bin.  Every worker fills the bins of its own partition, with
no shuffle.  What remains in its half-filled bins at the end of the partition
is joined, cut into whole bins, and the last rest into power-of-two sequences,
which need no padding.

``sequence_id`` is the worker's partition number in the upper bits and a count
in the lower 40.  Workers see a scan's rows in file order, so a repeated task
packs alike.

Documents are cut to class sizes rather than padded: a piece of its own for every
rest costs a few rows more, and saves the padding of classes that are not full.

Defined cases: empty tables give empty results; of equally long rests the one
that came last is placed first.  A null or empty text is its closing id alone.  Very long texts
are cut over as many sequences as they need.  Repeated rows are packed one by
one; a null doc_id is carried.  Extra columns are not read.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import by_bytes


def _class(test) -> str:
    """Characters below U+0250 for which ``test`` holds, for a regular expression."""
    return "".join(re.escape(chr(i)) for i in range(0x250) if test(unicodedata.category(chr(i))))


_LETTERS = _class(lambda k: k[0] == "L")
_NUMBERS = _class(lambda k: k[0] == "N")
#: Pieces that the word tokenizer handles one by one, in lower-cased Latin text.
PIECE = re.compile(rf"'(?:[stmd]|re|ve|ll)|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
#: Letters whose small form lies beyond these (23 capitals such as U+0181).
_LEAVING = {i for i in range(0x250) if any(ord(c) >= 0x250 for c in chr(i).lower())}
#: Anything whose case, spacing or form might be read in another way.
UNSURE = re.compile("[^" + "".join(re.escape(chr(i)) for i in [9, 10, 13, *range(0x20, 0x7F), *range(0xA0, 0x250)] if i not in _LEAVING) + "]")


class WordCache:
    """Packed ids of texts, from ids of their parts.

    Plain Latin text is cut into the pieces that the tokenizer itself keeps
    apart; other text at ASCII white space, which it never looks across.  Parts
    are encoded once and kept in two tables, of which the older goes when the
    newer is full; what is met again moves on.  A tokenizer that joins parts
    (found out by a probe) gets whole texts.
    """

    MOST = 200_000  # parts of a table, some 50 MB

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.old: dict = {}
        self.new: dict = {}
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        probe = "The Cat's don't,, (we'll) \u00e9t\u00e9 12a.b  x\ny '' 's! \u00bd%%%"
        whole = self._ids([probe])[0]
        self.by_piece = whole == b"".join(self._ids(PIECE.findall(probe.lower())))
        # an added token that holds white space would reach across chunks
        self.by_chunk = whole == b"".join(self._ids(probe.split())) and not any(len(s.split()) != 1 or s != s.strip() for s in special)

    def _ids(self, texts: list) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> bool:
        return self.by_piece and "<|" not in text and not UNSURE.search(text)

    def _cut(self, text: str | None) -> tuple[bool, list]:
        if not text:
            return False, []
        if self._plain(text):
            return True, PIECE.findall(text.lower())
        return False, [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]

    def _ids_of_pieces(self, pieces: list) -> list[bytes]:
        """The same ids as of each piece alone, by one call: pieces with blanks
        between them are the tokenizer's words, which it numbers."""
        found = self.tokenizer.encode(" ".join(pieces), add_special_tokens=False)
        word = np.array([-1 if w is None else w for w in found.word_ids], dtype=np.int64)
        if not len(word) or word[-1] != len(pieces) - 1 or (np.diff(word) < 0).any():
            return self._ids(pieces)
        raw, at = np.array(found.ids, dtype="<u4").tobytes(), 4 * np.searchsorted(word, np.arange(len(pieces) + 1))
        return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def _learn(self, parts: list, ids_of) -> None:
        for i in range(0, len(parts), 5000):
            self.new.update(zip(parts[i : i + 5000], ids_of(parts[i : i + 5000]), strict=True))

    def ids_of_texts(self, texts: list) -> list[np.ndarray]:
        if not self.by_chunk:
            return [np.frombuffer(i, dtype="<u4") for i in self._ids([t or "" for t in texts])]
        cut = [self._cut(t) for t in texts]
        if len(self.new) > self.MOST:
            self.old, self.new = self.new, {}
        pieces, words = set(), set()
        for plain, parts in cut:
            (pieces if plain else words).update(parts)
        self._learn(self._unknown(pieces), self._ids_of_pieces)
        self._learn(self._unknown(words), self._ids)
        get = self.new.__getitem__
        return [np.frombuffer(b"".join(map(get, parts)), dtype="<u4") for _, parts in cut]

    def _unknown(self, parts: set) -> list:
        """Parts that are to be learned; what only the old table has goes over
        to the new one."""
        left = []
        for p in parts:
            if p in self.new:
                continue
            if (ids := self.old.get(p)) is None:
                left.append(p)
            else:
                self.new[p] = ids
        return left


_CACHES: dict[str, WordCache] = {}


def word_cache(tokenizer_path: str) -> WordCache:
    """A worker's cache, kept from task to task."""
    if tokenizer_path not in _CACHES:
        _CACHES[tokenizer_path] = WordCache(tokenizer_path)
    return _CACHES[tokenizer_path]


def class_sizes(capacity: int, max_waste: float) -> list[tuple[int, int]]:
    """(size, count) of the classes, largest first; size 1 is always one."""
    out = []
    for k in range(1, capacity + 1):
        size = capacity // k
        if (not out or size < out[-1][0]) and (capacity - (capacity // size) * size <= max_waste * capacity or size == 1):
            out.append((size, capacity // size))
    return out


class Packer:
    """Bins of one worker.  Pieces are (document row, start, length)."""

    def __init__(self, capacity: int = 2048, max_waste: float = 0.01, base: int = 0):
        self.capacity, self.base, self.next = capacity, base, 0
        self.sizes = class_sizes(capacity, max_waste)
        self.fit = [0] * (capacity + 1)  # length -> class index of the largest size that fits
        k = len(self.sizes) - 1
        for n in range(1, capacity + 1):
            while k and self.sizes[k - 1][0] <= n:
                k -= 1
            self.fit[n] = k
        self.open: list[list] = [[] for _ in self.sizes]

    def _close(self, pieces: list) -> list[tuple]:
        out, at = [], 0
        for p in pieces:
            out.append((*p, self.base + self.next, at))
            at += p[2]
        self.next += 1
        return out

    def add(self, row, length: int) -> list[tuple]:
        """Takes a document apart; returns the pieces of bins that it filled:
        (row, start, length, sequence_id, offset)."""
        out, start = [], 0
        while length:
            k = 0 if length >= self.capacity else self.fit[length]
            size, count = self.sizes[k]
            self.open[k].append((row, start, size))
            if len(self.open[k]) == count:
                out += self._close(self.open[k])
                self.open[k] = []
            start, length = start + size, length - size
        return out

    def finish(self) -> list[tuple]:
        """Joins the half-filled bins: whole bins, then powers of two."""
        rest = [p for bin_ in self.open for p in bin_]
        self.open = [[] for _ in self.sizes]
        left, out = sum(p[2] for p in rest), []
        rest.reverse()
        while left:
            room = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= room
            pieces = []
            while room:
                row, start, n = rest.pop()
                take = min(n, room)
                pieces.append((row, start, take))
                if take < n:
                    rest.append((row, start + take, n - take))
                room -= take
            out += self._close(pieces)
        return out


def _only(pieces: list, held: dict) -> dict:
    """Of the held ids, copies of those that the pieces need."""
    out: dict = {}
    for row, start, n in pieces:
        at, ids = next((a, i) for a, i in held[row] if a <= start and start + n <= a + len(i))
        out.setdefault(row, []).append((start, ids[start - at : start - at + n].copy()))
    return out


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, max_waste: float = 0.01, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the piece's ids as an array.

    Only the ids of pieces in open bins stay in memory between batches: less
    than ``capacity`` tokens for each class.
    """
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches):
        cache = word_cache(tokenizer_path)
        packer = Packer(capacity, max_waste, TaskContext.get().partitionId() << 40)
        held: dict = {}
        end = np.array([end_id], dtype="<u4")
        serial = 0

        def ids_of(row, start, length):
            at, ids = next((a, i) for a, i in held[row] if a <= start and start + length <= a + len(i))
            return ids[start - at : start - at + length].tobytes()

        def rows(pieces, id_type):
            cols = list(zip(*pieces, strict=True)) or [[]] * 5
            row, start, length, seq, off = cols
            ids = [ids_of(r, s, n) for r, s, n in zip(row, start, length, strict=True)]
            arrays = [pa.array([names[r][0] for r in row], id_type), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()), pa.array([names[r][1] for r in row], pa.int64()), pa.array(seq, pa.int64()), pa.array(off, pa.int64())]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(i, dtype="<u4").astype(np.int64) for i in ids], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, names=[id_col, *(x.split()[0] for x in SCHEMA.split(", ")), *["ids"] * with_ids])

        names: dict = {}
        id_type = pa.int64()
        for b in by_bytes(batches, "text_", 1_000_000):
            id_type = b.column("id_").type
            pieces: list = []
            for name, ids in zip(b.column("id_").to_pylist(), cache.ids_of_texts(b.column("text_").to_pylist()), strict=True):
                ids = np.concatenate((ids, end))
                names[serial] = (name, len(ids))
                held[serial] = [(0, ids)]
                pieces += packer.add(serial, len(ids))
                serial += 1
            if pieces:
                yield rows(pieces, id_type)
            waiting = {p[0] for bin_ in packer.open for p in bin_}
            held = _only([p for bin_ in packer.open for p in bin_], held)
            names = {k: v for k, v in names.items() if k in waiting}
        if pieces := packer.finish():
            yield rows(pieces, id_type)

    schema = f"`{id_col}` {kind}, {SCHEMA}" + ", ids array<long>" * with_ids
    return docs.selectExpr(f"`{id_col}` as id_", f"cast(`{text_col}` as string) as text_").mapInArrow(run, schema)
