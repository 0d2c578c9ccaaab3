"""Token counts (operator 9): linear longest-match automaton.

Greedy longest-match word pieces are counted without being built.  The
vocabulary is a trie; each node knows, for the case that the next byte has no
child, where to go on (its failure link) and how many pieces that closes (its
popped count), both precomputed.  One step a byte, no backing up.

A word is scored as the vocabulary's word-start marker followed by its bytes.
A word that no sequence of pieces covers counts as one unknown token.

Defined cases: null and empty texts have no words and no tokens.  Texts of any
length are read whole; repeated rows are counted one by one; only the id and
text columns are read, whatever others are called.  Counts have no ties.  Empty
tables give empty results.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes


class LongestMatch:
    """Counts greedy longest-match pieces of a byte string."""

    def __init__(self, pieces: Iterable[bytes]):
        self.next: list[dict] = [{}]
        token = [False]
        for p in pieces:
            v = 0
            for c in p:
                if c not in self.next[v]:
                    self.next[v][c] = len(self.next)
                    self.next.append({})
                    token.append(False)
                v = self.next[v][c]
            token[v] = token[v] or v != 0
        # fail[v]: node of the rest once the pieces that greedy matching is sure of
        # are popped from the node's string; popped[v]: their number; -1: none
        self.fail, self.popped = [-1] * len(self.next), [0] * len(self.next)
        queue = deque([0])
        while queue:
            v = queue.popleft()
            for c, u in self.next[v].items():
                queue.append(u)
                if token[u]:
                    self.fail[u], self.popped[u] = 0, 1
                    continue
                z, n = self.fail[v], self.popped[v]
                while z >= 0 and c not in self.next[z]:
                    n += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[u], self.popped[u] = self.next[z][c], n

    def count(self, word: bytes) -> int:
        """Number of pieces; -1 if the word can't be covered."""
        v, n, go, fail, popped = 0, 0, self.next, self.fail, self.popped
        for c in word:
            u = go[v].get(c)
            while u is None:
                n += popped[v]
                v = fail[v]
                if v < 0:
                    return -1
                u = go[v].get(c)
            v = u
        while v:
            n += popped[v]
            v = fail[v]
            if v < 0:
                return -1
        return n


def byte_level_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others follow from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def byte_level_pieces(path: str) -> list[bytes]:
    """Vocabulary of a byte-level tokenizer file, special tokens left out."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"] for t in data.get("added_tokens", ())}
    alphabet = byte_level_alphabet()
    return [bytes(map(alphabet.__getitem__, p)) for p in data["model"]["vocab"] if p not in special]


class WordCounts(dict):
    """Piece counts by word; starts anew at ``MOST`` entries."""

    MOST = 1_000_000

    def __init__(self, automaton: LongestMatch, marker: bytes):
        self.automaton, self.marker = automaton, marker

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        n = self.automaton.count(self.marker + word)
        self[word] = n = 1 if n < 0 else n
        return n


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", marker: bytes = b" ") -> DataFrame:
    """One row per input row: id, n_words, n_tokens, max_word_tokens.  No shuffle."""
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches):
        counts = None
        for b in by_bytes(batches, "text_"):
            counts = counts if counts is not None else WordCounts(LongestMatch(byte_level_pieces(vocabulary_path)), marker)
            get, out = counts.__getitem__, []
            for t in b.column("text_").to_pylist():
                n = list(map(get, t.encode("utf-8", "surrogatepass").split())) if t else []
                out.append((len(n), sum(n), max(n, default=0)))
            yield pa.RecordBatch.from_arrays([b.column("id_"), *(pa.array(c, pa.int64()) for c in zip(*out, strict=True))], names=[id_col, "n_words", "n_tokens", "max_word_tokens"])

    return docs.selectExpr(f"`{id_col}` as id_", f"cast(`{text_col}` as string) as text_").mapInArrow(run, f"`{id_col}` {kind}, n_words long, n_tokens long, max_word_tokens long")
