"""Line-first quality rules (operator 6).

Each line of a text is judged on its own: navigation rows, boilerplate phrases,
symbol litter and fragments without closing punctuation fail.  Failing lines
are taken out and the document is rejected if too much of its text went with
them.  Base figures (length, symbols, repeated lines, repeated word windows)
are computed over the whole text beside it.

Defined cases: a null or empty text has no words, so ``base_failed`` is true
and ``kept`` false, ``clean_text`` is empty.  Texts of any length are read
whole, whatever the length of their lines.  A line that breaks several rules
counts once; of equal lines the first is not a repeat.  Repeated rows are judged one by one.  Only the id and text columns are
read; further columns never matter.  Empty tables give empty results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_bytes

SYMBOLS = re.compile(r"[#*$%&|<>]")

#: Phrases that mark a short line as site furniture.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript",
    "log in", "privacy policy", "read more", "share on", "sign in", "sign up", "skip to content",
    "subscribe to our newsletter", "terms of service", "terms of use",
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds; defaults are the production values."""

    closing: str = ".!?:;…\"')]}»”’。！？"
    nav_separators: str = "|›»•·"
    nav_share: float = 0.25  # separators per word that make a line navigation
    symbol_share: float = 0.3  # symbols per word that make a line litter
    fragment_words: int = 8  # unclosed lines below this many words are fragments
    boilerplate_words: int = 12  # boilerplate phrases count in lines up to this length
    most_lost: float = 0.5  # share of words whose loss rejects the document
    min_words: int = 50
    boilerplate: tuple = field(default=BOILERPLATE)


def line_fault(line: str, rules: LineRules = LineRules()) -> str | None:
    """The first rule that the line breaks, or None.  Blank lines pass."""
    n = len(line.encode("utf-8", "surrogatepass").split())
    if not n:
        return None
    if sum(line.count(c) for c in rules.nav_separators) >= max(1, rules.nav_share * n):
        return "navigation"
    if len(SYMBOLS.findall(line)) > rules.symbol_share * n:
        return "symbols"
    if n <= rules.boilerplate_words:
        low = line.lower()
        if any(p in low for p in rules.boilerplate):
            return "boilerplate"
    if n < rules.fragment_words and line.rstrip(" \t\r\v\f")[-1:] not in rules.closing:
        return "punctuation"
    return None


def repeated_words(words: list) -> int:
    """Words inside 3-word windows that occur twice or more; exact."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), dtype=np.int64, count=n)
    if len(ids) < 1 << 21:
        key = (w[:-2] << 42) | (w[1:-1] << 21) | w[2:]
    else:  # two steps keep the key within 63 bits
        _, pair = np.unique(w[:-1] * np.int64(len(ids)) + w[1:], return_inverse=True)
        key = pair[:-1] * np.int64(len(ids)) + w[2:]
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    twice = count[inverse] > 1
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def assess(text: str | None, rules: LineRules = LineRules()) -> dict:
    """All figures of one text, with the cleaned text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    seen: set = set()
    dup = lost = failed = 0
    left = []
    for line in text.split("\n"):
        size = len(line.encode("utf-8", "surrogatepass").split())
        if size:
            if line in seen:
                dup += 1
            seen.add(line)
            if line_fault(line, rules):
                lost += size
                failed += 1
                continue
        left.append(line)
    joined = b"".join(words)
    repeat = repeated_words(words)
    base_failed = n < rules.min_words or 100 * repeat > 50 * n
    return {
        "n_words": n,
        "word_chars": len(joined) - sum(map(joined.count, _CONTINUED)) if not joined.isascii() else len(joined),
        "n_symbols": len(SYMBOLS.findall(text)),
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
        "n_lost_words": lost,
        "n_failed_lines": failed,
        "base_failed": base_failed,
        "kept": not base_failed and lost <= rules.most_lost * n,
        "clean_text": "\n".join(left),
    }


_CONTINUED = [bytes([b]) for b in range(0x80, 0xC0)]  # bytes that go on a code point

FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lost_words long, n_failed_lines long, base_failed boolean, kept boolean, clean_text string"


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """One row per input row: id, figures, verdict and the cleaned text.

    One narrow pass over Arrow batches; no shuffle.
    """
    drop = () if with_text else ("clean_text",)
    figures = [f for f in FIGURES.split(", ") if f.split()[0] not in drop]
    kind = dict(docs.select(id_col).dtypes)[id_col]
    names = [f.split()[0] for f in figures]
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    types = [kinds[f.split()[1]] for f in figures]

    def run(batches):
        for b in by_bytes(batches, "text_"):
            found = [assess(t, rules) for t in b.column("text_").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id_"), *(pa.array([f[n] for f in found], t) for n, t in zip(names, types, strict=True))], names=[id_col, *names])

    return docs.selectExpr(f"`{id_col}` as id_", f"cast(`{text_col}` as string) as text_").mapInArrow(run, f"`{id_col}` {kind}, {', '.join(figures)}")


def clean_documents(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars", rules: LineRules = LineRules()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, without their failed lines; the
    text's length in ``size_col`` where lines went, other columns unchanged."""
    names = docs.columns
    at, size_at = names.index(text_col), names.index(size_col)

    def run(batches):
        for b in by_bytes(batches, text_col, 2_000_000):
            found = [assess(t, rules) for t in b.column(text_col).to_pylist()]
            kept = [f for f in found if f["kept"]]
            b = b.filter(pa.array([f["kept"] for f in found], pa.bool_()))
            cols = list(b.columns)
            size = cols[size_at].to_pylist()
            for i, f in enumerate(kept):
                if f["n_failed_lines"]:
                    size[i] = len(f["clean_text"])
            cols[at] = pa.array([f["clean_text"] for f in kept], cols[at].type)
            cols[size_at] = pa.array(size, cols[size_at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, docs.schema)
