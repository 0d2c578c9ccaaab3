"""Language identification (operator 1): rank-order n-gram profiles.

A profile is the list of a language's most frequent character n-grams (n = 1 to
3, within and across word borders).  A document's own most frequent n-grams are
compared to each profile by the out-of-place distance: the sum of rank
differences, with a fixed penalty for n-grams that the profile lacks.

Training reads a bounded sample: at most ``max_docs`` labelled documents a
language, those with the smallest hash of their id.  A first count by language
tells below which hash they lie, so that no more than a few times the sample is
ever moved, however large a language is.  n-gram counts of the sample are summed
in the cluster; only ``profile_size`` n-grams a language come to the driver,
of the ``max_langs`` languages that label most rows.
Predictions read every whole text.

Defined cases: a null text, or one without a letter, is ``und`` with score 0,
as is every text if nothing was learned.  Ties in distance go to the
alphabetically first language, ties in frequency to the smaller n-gram.  Rows
with a null label, id or text are not learned from.  Texts of any length are
read whole, in batches of bounded size.  Repeated rows are judged one by one;
only the named columns are read, whatever others are called.  Empty tables give
empty results and, as training tables, no language.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes

_LETTER: list[np.ndarray] = []


@dataclass(frozen=True)
class ProfileSettings:
    profile_size: int = 400
    max_docs: int = 1000  # bound of the training sample, per language
    max_langs: int = 1000  # languages learned, those that label most rows
    max_n: int = 3


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1))
    return _LETTER[0]


def grams(text: str | None, max_n: int = 3) -> np.ndarray | None:
    """All n-grams as exact integers (21 bits a character); None without a letter.

    Letters are lower-cased, every run of other characters is one blank.
    """
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(32))
    blank = ~letter
    keep = np.ones(len(c), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    c = c[keep]
    c = np.concatenate(([32] if c[0] != 32 else [], c, [32] if c[-1] != 32 else [])).astype(np.uint64)
    out, g = [c[c != 32]], c
    for n in range(2, max_n + 1):
        g = (g[:-1] << np.uint64(21)) | c[n - 1 :]
        out.append(g)
    return np.concatenate(out)


def top_grams(all_grams: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by value."""
    g = np.sort(all_grams)
    at = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    count = np.diff(np.append(at, len(g)))
    if len(at) > size:
        least = np.partition(count, len(count) - size)[len(count) - size]
        at, count = at[count >= least], count[count >= least]
    return g[at[np.argsort(-count, kind="stable")][:size]]


class Profiles:
    """Language profiles and their out-of-place distances."""

    def __init__(self, ranked: dict, settings: ProfileSettings = ProfileSettings()):
        """ranked: language -> n-grams, most frequent first."""
        self.settings = settings
        self.langs = sorted(ranked)
        self.gram = np.unique(np.concatenate([np.asarray(ranked[k], dtype=np.uint64) for k in self.langs])) if ranked else np.empty(0, np.uint64)
        self.rank = np.full((len(self.langs), len(self.gram) + 1), -1, dtype=np.int64)
        for i, k in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.gram, np.asarray(ranked[k], dtype=np.uint64))] = np.arange(len(ranked[k]))

    def predict(self, text: str | None) -> tuple[str, float]:
        found = grams(text, self.settings.max_n)
        if found is None or not self.langs:
            return "und", 0.0
        mine = top_grams(found, self.settings.profile_size)
        at = np.searchsorted(self.gram, mine)
        at[at == len(self.gram)] = 0
        at = np.where(self.gram[at] == mine, at, len(self.gram))
        rank, penalty = self.rank[:, at], self.settings.profile_size
        away = np.where(rank < 0, penalty, np.abs(rank - np.arange(len(mine)))).sum(axis=1)
        best = int(away.argmin())
        return self.langs[best], float(1 - away[best] / (penalty * len(mine)))


def _lowest(named: DataFrame, most: int, most_langs: int = 1000) -> DataFrame:
    """Rows among which are the ``most`` of least hash ``h`` of each language,
    of the ``most_langs`` languages that label most rows (ties by name).
    Hashes are spread evenly, so about four times as many are asked for; where
    repeated ids leave too few, more are."""
    have = {r["lang"]: r["n"] for r in named.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs + 1).collect()}
    if len(have) > most_langs:
        have = dict(list(have.items())[:most_langs])
        named = named.where(F.col("lang").isin(*have))
    share = {lang: 4 * most / n for lang, n in have.items()}
    while True:
        wide = sorted(lang for lang in have if share[lang] < 1)
        if not wide:
            return named
        bound = F.create_map(*(F.lit(x) for lang in wide for x in (lang, int(share[lang] * 2**64) - 2**63)))
        low = named.where(F.coalesce(F.col("h") < F.try_element_at(bound, F.col("lang")), F.lit(True)))
        got = {r["lang"]: r["n"] for r in low.where(F.col("lang").isin(wide)).groupBy("lang").agg(F.count("*").alias("n")).collect()}
        few = [lang for lang in wide if got.get(lang, 0) < most]
        if not few:
            return low
        share |= {lang: 8 * share[lang] for lang in few}


def train(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", settings: ProfileSettings = ProfileSettings()) -> Profiles:
    """Profiles from the rows where ``learn_from`` holds."""
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), learn_from.alias("ok"))
    named = named.where(F.col("ok") & F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    order = Window.partitionBy("lang").orderBy("h", "id", F.xxhash64("text"))
    # the rank filter is applied before the shuffle as well (window group limit)
    sample = _lowest(named.withColumn("h", F.xxhash64("id")), settings.max_docs, settings.max_langs).withColumn("r", F.row_number().over(order)).where(F.col("r") <= settings.max_docs).select("lang", "text")

    def count(batches):
        for b in by_bytes(batches, "text"):
            per: dict = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                g = grams(text, settings.max_n)
                if g is not None:
                    per.setdefault(lang, []).append(g)
            for lang, gs in per.items():
                g, n = np.unique(np.concatenate(gs), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "g", "n"])

    counts = sample.mapInArrow(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "g")
    rows = counts.withColumn("r", F.row_number().over(best)).where(F.col("r") <= settings.profile_size).select("lang", "g", "r").collect()
    ranked: dict = {}
    for row in sorted(rows, key=lambda x: (x["lang"], x["r"])):
        ranked.setdefault(row["lang"], []).append(row["g"])
    return Profiles(ranked, settings)


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score.  One narrow pass; ids are carried, never read."""
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def run(batches):
        for b in by_bytes(batches, "text_"):
            found = [profiles.predict(t) for t in b.column("text_").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id_"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[id_col, "lang_pred", "score"])

    return docs.selectExpr(f"`{id_col}` as id_", f"cast(`{text_col}` as string) as text_").mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
