"""Synthetic experiment data: which parameters act on which qualities, by what
function, and series of experiments that improve the qualities."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import FUNCTIONS, TINY, Range, random_coefficients
from ..sources.configs import DataSettings, Named, NoiseSettings, SeriesSettings
from .storage import first_until, sample_of


@dataclass(frozen=True)
class ScalarFunction:
    """Driver- and worker-side twin of the column functions, on numbers."""

    kind: str
    coeffs: tuple
    p: tuple
    q: tuple

    def __call__(self, x: float) -> float:
        x = min(max(x, self.p[0]), self.p[1])
        if self.kind == "linear":
            y = self.coeffs[0] + self.coeffs[1] * x
        elif self.kind == "quadratic":
            a, b, c = self.coeffs
            y = a + b * x + c * x * x
        else:
            a, b, c, d = self.coeffs
            y = a * np.log(max(x - c, TINY)) / np.log(b) + d
        return float(min(max(y, self.q[0]), self.q[1]))

    def inverse(self, y: float, last: float | None = None) -> float:
        y = min(max(y, self.q[0]), self.q[1])
        if self.kind == "linear":
            x = (y - self.coeffs[0]) / self.coeffs[1]
        elif self.kind == "quadratic":
            a, b, c = self.coeffs
            root = np.sqrt(max(0.0, b * b - 4 * c * (a - y)))
            both = [(-b + root) / (2 * c), (-b - root) / (2 * c)]
            inside = [v for v in both if self.p[0] <= v <= self.p[1]] or both
            x = min(inside, key=lambda v: abs(v - last)) if last is not None else max(inside)
        else:
            a, b, c, d = self.coeffs
            x = b ** min((y - d) / a, 300.0) + c
        return float(min(max(x, self.p[0]), self.p[1]))

    def slope(self, y: float, last: float | None = None) -> float:
        """Change of the inverse per unit of rating, not clipped."""
        y = min(max(y, self.q[0]), self.q[1])
        if self.kind == "linear":
            return 1.0 / self.coeffs[1]
        if self.kind == "quadratic":
            a, b, c = self.coeffs
            root = float(np.sqrt(max(0.0, b * b - 4 * c * (a - y))))
            side = 1.0 if (self.inverse(y, last) + b / (2 * c)) * c >= 0 else -1.0
            return side / root if root else 0.0
        a, b, c, d = self.coeffs
        return float(b ** min((y - d) / a, 300.0) * np.log(b) / a)

    def mean_change(self) -> float:
        """As ``representations.mean_change``."""
        ratings = np.arange(self.q[1], self.q[0] - 1, -1)
        walk = [self.inverse(ratings[0])]
        for y in ratings[1:]:
            walk.append(self.inverse(y, walk[-1]))
        return float(np.mean(np.diff(walk)))

    def bins(self, n: int = 3) -> list[tuple]:
        """As ``representations.sampled_bins``."""
        edges = np.histogram_bin_edges([self.inverse(y) for y in np.arange(self.q[0], self.q[1] + 1)], n)
        ends = [self(x) for x in edges]
        out = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            steps = a + np.sign(b - a) * np.arange(int(abs(b - a)) + 1)
            out.append((a, b, float(np.mean([self.inverse(y) for y in steps]))))
        return out

    def columns(self):
        return FUNCTIONS[self.kind](self.coeffs, Range(*self.p), Range(*self.q))


@dataclass
class World:
    """The relations behind a data set."""

    settings: DataSettings
    pairs: list = field(default_factory=list)  # (parameter, quality)
    expert: set = field(default_factory=set)
    functions: dict = field(default_factory=dict)

    def affecting(self, quality: str, expert_only: bool = False) -> list:
        return sorted(p for p, q in self.pairs if q == quality and (not expert_only or (p, q) in self.expert))

    def affected(self, parameter: str) -> list:
        return sorted(q for p, q in self.pairs if p == parameter)

    def qualities_with_expert_knowledge(self) -> list:
        return sorted({q for _, q in self.expert})

    def parameters_with_expert_knowledge(self) -> list:
        return sorted({p for p, _ in self.expert})

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(p, q, (p, q) in self.expert, self.functions[p, q].kind, [float(c) for c in self.functions[p, q].coeffs]) for p, q in self.pairs]
        return spark.createDataFrame(rows, "parameter string, quality string, is_expert boolean, fn_type string, coeffs array<double>")

    def relations(self, spark: SparkSession, bins: int = 3) -> DataFrame:
        """Relations of the expert pairs, ready for the encodings."""
        rows = [(p, q, self.functions[p, q].mean_change(), self.functions[p, q].bins(bins), "set") for p, q in sorted(self.expert)]
        return spark.createDataFrame(rows, "parameter string, quality string, mean double, bins array<struct<lo:double,hi:double,value:double>>, action string")


def make_world(s: DataSettings) -> World:
    """Chooses correlating pairs (every quality has one), expert pairs, functions."""
    rng = np.random.default_rng(s.seed)
    n = max(len(s.qualities), int(len(s.parameters) * len(s.qualities) * s.correlating_share))
    chosen = {(s.parameters[int(rng.integers(len(s.parameters)))].name, q.name) for q in s.qualities}
    every = [(p.name, q.name) for p in s.parameters for q in s.qualities]
    for i in rng.permutation(len(every)):
        if len(chosen) >= n:
            break
        chosen.add(every[i])
    w = World(s, sorted(chosen))
    w.expert = {w.pairs[i] for i in rng.permutation(len(w.pairs))[: max(1, int(len(w.pairs) * s.expert_share))]}
    P, Q = {p.name: p for p in s.parameters}, {q.name: q for q in s.qualities}
    for p, q in w.pairs:
        kind = s.function_kinds[int(rng.integers(len(s.function_kinds)))]
        pr, qr = Range(P[p].lo, P[p].hi), Range(Q[q].lo, Q[q].hi)
        w.functions[p, q] = ScalarFunction(kind, tuple(map(float, random_coefficients(kind, rng, pr, qr, bool(rng.integers(2))))), (pr.lo, pr.hi), (qr.lo, qr.hi))
    return w


COMBINE = {"mean": np.mean, "median": np.median, "best": np.max, "worst": np.min}


def ratings(w: World, params: dict, how: str = "mean") -> dict:
    out = {}
    for q in w.settings.qualities:
        each = [w.functions[p, q.name](params[p]) for p in w.affecting(q.name)]
        if each:
            out[q.name] = float(min(max(COMBINE[how](each), q.lo), q.hi))
    return out


def score(w: World, rated: dict, group: tuple) -> float:
    """Mean rating of the group scaled to 0 (best) .. 1 (worst)."""
    Q = {q.name: q for q in w.settings.qualities}
    return float(np.mean([(rated[q] - Q[q].lo) / (Q[q].hi - Q[q].lo) for q in group]))


def first_experiment(w: World, s: SeriesSettings, rng) -> dict:
    """Parameters from the inverse functions at the initial ratings, averaged."""
    start = {q.name: q.lo + (q.hi - q.lo) * (rng.uniform(0.9, 1.0) if s.initial == "worst" else rng.random()) for q in w.settings.qualities}
    out = {}
    for p in w.settings.parameters:
        each = [w.functions[p.name, q].inverse(start[q]) for q in w.affected(p.name)]
        out[p.name] = float(np.mean(each)) if each else float(rng.uniform(p.lo, p.hi))
    return out


def expert_series(w: World, group: tuple, s: SeriesSettings, rng) -> list[tuple[dict, dict]]:
    """Steps along the inverse slopes of the group's expert pairs until the
    score is good enough or no longer improves; the first step is always made.
    A series of more than ``max_steps`` raises."""
    P = {p.name: p for p in w.settings.parameters}
    params = first_experiment(w, s, rng)
    out = [(params, ratings(w, params, s.rating_from))]
    moved = sorted({p for q in group for p in w.affecting(q, True)})
    while len(out) <= s.max_steps:
        params, rated = out[-1]
        nxt = dict(params)
        for p in moved:
            qs = [q for q in w.affected(p) if q in group and (p, q) in w.expert]
            delta = sum(w.functions[p, q].slope(rated[q], params[p]) for q in qs if score(w, rated, (q,)) > s.score_threshold)
            nxt[p] = float(min(max(params[p] - delta / len(qs), P[p].lo), P[p].hi))
        got = ratings(w, nxt, s.rating_from)
        reached = score(w, got, group)
        if len(out) > 1 and reached >= score(w, rated, group):
            return trim(out, s.max_size)
        out.append((nxt, got))
        if reached <= s.score_threshold:
            return trim(out, s.max_size)
    raise RuntimeError(f"the series for {group} still improves after {s.max_steps} steps")


def _stepped(p: Named, x: float, sign: int, s: SeriesSettings) -> float:
    """The parameter's next value in a direction."""
    far = x + (p.hi - p.lo) * s.step_share * sign
    by_range = s.step_of == "definition_range" or (s.step_of != "current_value" and p.lo <= far <= p.hi)
    return float(min(max(far if by_range else x * (1 + s.step_share * sign), p.lo), p.hi))


def trial_series(w: World, group: tuple, s: SeriesSettings, rng, learned: set | None = None) -> list[tuple[dict, dict]]:
    """Parameters in random order, each from the best experiment so far: one
    direction after the other in random order, as long as the score improves.
    A direction that improved, or changed nothing, ends the parameter.  Pairs
    (parameter, quality) whose rating changed are added to ``learned``."""
    start = first_experiment(w, s, rng)
    out = [(start, ratings(w, start, s.rating_from))]
    best, best_score = out[0], score(w, out[0][1], group)
    for i in rng.permutation(len(w.settings.parameters)):
        p, base = w.settings.parameters[i], best
        for sign in rng.permutation([1, -1]):
            last, last_score = base, score(w, base[1], group)
            now, made = last_score, 0
            while (x := _stepped(p, last[0][p.name], int(sign), s)) != last[0][p.name]:
                params = last[0] | {p.name: x}
                new = (params, ratings(w, params, s.rating_from))
                out.append(new)
                made += 1
                if learned is not None:
                    learned |= {(p.name, q) for q, y in new[1].items() if y != last[1][q]}
                now = score(w, new[1], group)
                if now >= last_score:
                    break
                if now < best_score:
                    best, best_score = new, now
                if now <= s.score_threshold:
                    break
                last, last_score = new, now
            if (made > 1 and s.one_direction) or (made <= 1 and now == last_score):
                break
        if len(out) >= s.max_trial_length:
            break
    return out


def trim(series: list, most: int) -> list:
    """Long series lose experiments at even places, the first included; places
    that fall together are lost once."""
    extra = len(series) - most
    if extra <= 0:
        return series
    step = 0 if extra == 1 else (len(series) - 2) // (extra - 1)
    gone = {i * step for i in range(extra)}
    return [x for i, x in enumerate(series) if i not in gone]


def quality_groups(w: World, rng, overlapping: bool = False, size: int = 1, expert_only: bool = True) -> list[tuple]:
    """Groups of qualities to improve together: random, or sharing a parameter."""
    qs = w.qualities_with_expert_knowledge() if expert_only else sorted(q.name for q in w.settings.qualities)
    if overlapping:
        pairs = sorted({tuple(sorted((a, b))) for p in w.parameters_with_expert_knowledge() for a in w.affected(p) for b in w.affected(p) if a < b and a in qs and b in qs})
        return pairs or [(q,) for q in qs]
    order = [qs[i] for i in rng.permutation(len(qs))]
    return [tuple(order[i : i + size]) for i in range(0, len(order), size)]


ROWS = "series_id string, pos int, parameters map<string,double>, qualities map<string,double>, optimised array<string>"


def generate(spark: SparkSession, w: World, n_series: int | None = None) -> DataFrame:
    """Experiments of as many series as the settings need: series are made side
    by side on the workers, each from its own seed, so any of them can be made
    again alone.  Without ``n_series`` the data set is cut to its size."""
    s = w.settings
    count = n_series or s.n_experiments // 2 + 1
    weights = np.cumsum([x.share for x in s.series]) / sum(x.share for x in s.series)

    def make(batches):
        for pdf in batches:
            rows = []
            for sid in pdf["id"]:
                rng = np.random.default_rng((s.seed, int(sid)))
                kind = s.series[int(np.searchsorted(weights, rng.random()))]
                groups = quality_groups(w, rng, kind.overlapping, kind.group_size, kind.kind == "expert")
                group = groups[int(rng.integers(len(groups)))]
                made = (expert_series if kind.kind == "expert" else trial_series)(w, group, kind, rng)
                rows += [(f"s{sid}", i, p, q, list(group)) for i, (p, q) in enumerate(made)]
            yield pd.DataFrame(rows, columns=["series_id", "pos", "parameters", "qualities", "optimised"])

    df = spark.range(count).mapInPandas(make, ROWS)
    return df if n_series else fit_to_size(df, s.n_experiments, s.oversize)


def fit_to_size(df: DataFrame, n: int, oversize: str = "ignore", seed: int = 0) -> DataFrame:
    """Whole series, in seeded random order, until ``n`` experiments are reached.
    What exceeds ``n`` stays (ignore), or the longest series lose first, last or
    random experiments, one at a time, until it is gone."""
    size = first_until(df.groupBy("series_id").agg(F.count("*").alias("size")), "size", n, ["series_id"], seed)
    out = df.join(size, "series_id")
    if oversize == "ignore":
        return out.drop("size")
    lengths = {r["size"]: r["c"] for r in size.groupBy("size").agg(F.count("*").alias("c")).collect()}  # as many rows as lengths
    level = max(lengths, default=0)
    left = lambda k: sum(min(x, k) * c for x, c in lengths.items())
    while level > 0 and left(level - 1) >= n:
        level -= 1
    more = sample_of(size.where(F.col("size") >= level), max(0, left(level) - n), ["series_id"], seed + 1).select("series_id", F.lit(1).alias("more"))
    out = out.join(more, "series_id", "left").withColumn("cut", F.greatest(F.col("size") - level, F.lit(0)) + F.coalesce("more", F.lit(0)))
    if oversize == "cut_last":
        out = out.where(F.col("pos") < F.col("size") - F.col("cut"))
    elif oversize == "cut_first":
        out = out.where(F.col("pos") >= F.col("cut"))
    else:
        w = Window.partitionBy("series_id").orderBy(F.xxhash64(F.lit(seed), "series_id", "pos"))
        out = out.withColumn("r", F.row_number().over(w)).where(F.col("r") > F.col("cut")).drop("r")
    return out.drop("size", "more", "cut")


def add_noise(df: DataFrame, noise: NoiseSettings, spans: dict, seed: int = 0) -> DataFrame:
    """Gaussian noise on all parameters and qualities of int(n * share)
    experiments, deviation = span * std_share, not clipped."""
    span = F.create_map(*(F.lit(x) for kv in spans.items() for x in (kv[0], float(kv[1]))))
    unit = lambda k, n: (F.pmod(F.xxhash64(F.lit(seed + n), "series_id", "pos", k), F.lit(1 << 30)).cast("double") + 1) / ((1 << 30) + 1)
    normal = lambda k: F.sqrt(-2 * F.ln(unit(k, 1))) * F.cos(2 * float(np.pi) * unit(k, 2))
    hit = sample_of(df.select("series_id", "pos"), int(df.count() * noise.share), ["series_id", "pos"], seed).withColumn("hit", F.lit(True))
    noisy = lambda c: F.when(F.col("hit"), F.transform_values(c, lambda k, v: v + noise.mean + normal(k) * span[k] * noise.std_share)).otherwise(F.col(c))
    return df.join(hit, ["series_id", "pos"], "left").select(*(noisy(c).alias(c) if c in ("parameters", "qualities") else c for c in df.columns))


def with_noisy_copy(df: DataFrame, noise: NoiseSettings, spans: dict, seed: int = 0) -> DataFrame:
    return df.unionByName(add_noise(df, noise, spans, seed).withColumn("series_id", F.concat("series_id", F.lit("-noisy"))))


def to_documents(df: DataFrame, temperature: float = 42.0, humidity: float = 42.0) -> DataFrame:
    """Experiment documents: material and surroundings fixed, all parameters
    changed from "-1"; the previous experiment's ratings of the optimised
    qualities are the influential influences; the first of a series has none."""
    w = Window.partitionBy("series_id").orderBy("pos")
    sid = F.expr("cast(regexp_extract(series_id, '([0-9]+)', 1) as long)")
    d = df.withColumn("exp_id", sid * 1000 + F.col("pos") + F.when(F.col("series_id").contains("noisy"), 1 << 40).otherwise(0))
    d = d.withColumn("prev_id", F.lag("exp_id").over(w)).withColumn("prev_q", F.lag("qualities").over(w))
    value = lambda v: F.struct(v.alias("d"), F.lit(None).cast("boolean").alias("b"), F.lit(None).cast("string").alias("s"))
    last = F.when(F.col("prev_id").isNotNull(), F.array(F.struct(F.col("prev_id").alias("experiment_id"), F.transform_values("prev_q", lambda k, v: F.struct(v.alias("value"), F.array_contains("optimised", k).alias("influential"))).alias("items"))))
    ui = F.transform(F.map_entries("parameters"), lambda e: F.struct(e["key"].alias("label"), e["value"].cast("string").alias("user_value"), e["key"].alias("key"), F.lit("-1").alias("original_value"), F.lit(None).cast("string").alias("extruder"), F.lit(None).cast("string").alias("category")))
    infl = F.array(F.create_map(F.lit("temperature"), F.struct(value(F.lit(temperature)).alias("value"), F.lit(False).alias("influential")), F.lit("humidity"), F.struct(value(F.lit(humidity)).alias("value"), F.lit(False).alias("influential"))))
    insights = F.struct(F.lit(None).cast("string").alias("comment"), F.lit("synthetic").alias("user_id"), F.lit(None).cast("double").alias("uncertainty"), infl.alias("influences"), ui.alias("changed_ui_parameters"), last.alias("last_rating_influences"))
    typed = F.transform_values("parameters", lambda k, v: value(v))
    return d.select(
        "exp_id", "series_id", F.lit("printer").alias("printer"), F.lit(None).cast("string").alias("stl_file_id"), F.lit(False).alias("oneoff"), F.lit(1.0).alias("completion"),
        F.struct(F.lit("white").alias("color"), F.lit("PLA").alias("type"), F.lit("mock").alias("producer")).alias("material"), typed.alias("all_parameters"), typed.alias("changed_parameters"),
        F.array(F.struct(F.lit(humidity).alias("humidity"), F.lit(temperature).alias("temperature"), F.lit(None).cast("timestamp").alias("time"))).alias("measurements"),
        F.array("qualities").alias("ratings"), F.when(F.col("prev_id").isNotNull(), insights).alias("insights"),
    )
