"""Column factories for numbers, bins, vectors and parameter-quality functions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

TINY = float(np.finfo(np.float64).tiny)


def clip(x, lo, hi) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(x)))


def clip_all(xs, lo, hi) -> Column:
    return F.transform(col(xs), lambda x: clip(x, lo, hi))


# ---- bins


def doane_bins(values) -> Column:
    """Aggregate: number of equal-width bins by Doane's rule; 1 where the
    spread or the number of values gives no skewness."""
    x = col(values)
    n = F.count(x).cast("double")
    sigma = F.sqrt(6.0 * (n - 2) / ((n + 1) * (n + 3)))
    raw = 1 + F.log2(n) + F.log2(1 + F.abs(F.skewness(x)) / sigma)
    return F.when((n > 2) & (F.max(x) > F.min(x)), F.ceil(F.round(raw, 9)).cast("int")).otherwise(F.lit(1))


def bin_edges(lo, hi, n) -> Column:
    """n + 1 equally spaced edges; the last is ``hi`` itself, not what rounding
    makes of it."""
    lo, hi, n = col(lo), col(hi), col(n)
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i == n, hi).otherwise(lo + (hi - lo) * i / n))


def digitize(x, edges) -> Column:
    """1-based bin; the last bin holds its right edge; 0 below, len(edges) above."""
    x, edges = col(x), col(edges)
    top = F.element_at(edges, -1)
    at = F.size(F.filter(edges, lambda e: e <= x))
    return F.when(x == top, F.size(edges) - 1).otherwise(at)


# ---- comparisons


def interval_iou(lo1, hi1, lo2, hi2) -> Column:
    """Intersection over union of two intervals; negative when apart, NULL
    where the union has no length."""
    inter = F.least(col(hi1), col(hi2)) - F.greatest(col(lo1), col(lo2))
    union = (col(hi1) - col(lo1)) + (col(hi2) - col(lo2)) - inter
    return F.try_divide(inter, F.nullif(union, F.lit(0.0)))


def close(a, b, rel: float = 0.3) -> Column:
    return F.abs(col(a) - col(b)) <= rel * F.greatest(F.abs(col(a)), F.abs(col(b)))


# ---- vectors (arrays of doubles)


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def jaccard_distance(x, y) -> Column:
    """1 - sum(min) / sum(max)."""
    low = total(F.zip_with(col(x), col(y), lambda a, b: F.least(a, b)))
    high = total(F.zip_with(col(x), col(y), lambda a, b: F.greatest(a, b)))
    return 1 - F.try_divide(low, high)


def euclidean_distance(x, y) -> Column:
    return F.sqrt(total(F.zip_with(col(x), col(y), lambda a, b: (a - b) * (a - b))))


def cosine_distance(x, y) -> Column:
    dot = total(F.zip_with(col(x), col(y), lambda a, b: a * b))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda a: a * a)))
    return 1 - F.try_divide(dot, norm(col(x)) * norm(col(y)))


DISTANCES = {"jaccard": jaccard_distance, "euclidean": euclidean_distance, "cosine": cosine_distance}


# ---- edge weights: confidence, frequency, improvement

WEIGHTS = {
    "confidence": lambda c, f, i: c,
    "frequency": lambda c, f, i: f,
    "improvement": lambda c, f, i: i,
    "confidence_frequency": lambda c, f, i: 0.5 * f + c * f,
    "confidence_improvement": lambda c, f, i: 0.5 * i + c * i,
    "confidence_improvement_frequency": lambda c, f, i: (0.5 * i + c * i) * f,
    "frequency_improvement": lambda c, f, i: f * i,
}

#: Thresholds over a column of weights, as aggregates.
THRESHOLDS = {
    "mean": lambda w: F.avg(w),
    "median": lambda w: F.percentile(w, F.lit(0.5)),
    "q1": lambda w: F.percentile(w, F.lit(0.25)),
}


def rule_bins(rule: str) -> Column:
    """Number of equal-width bins by a named rule, from columns n, lo, hi, dev
    (population) and iqr; 1 where all values are equal or a width is zero."""
    n, span = F.col("n"), F.col("hi") - F.col("lo")
    widths = {
        "sturges": lambda: span / (F.log2(n) + 1), "rice": lambda: span / (2 * F.pow(n, F.lit(1 / 3))), "sqrt": lambda: span / F.sqrt(n),
        "scott": lambda: F.pow(24 * np.sqrt(np.pi) / n, F.lit(1 / 3)) * F.col("dev"), "fd": lambda: 2 * F.col("iqr") / F.pow(n, F.lit(1 / 3)),
    }
    if rule == "auto":
        fd, sturges = widths["fd"](), widths["sturges"]()
        width = F.when(fd > 0, F.least(fd, sturges)).otherwise(sturges)
    elif rule in widths:
        width = widths[rule]()
    else:
        raise ValueError(f"unknown bin rule {rule}")
    return F.when((span > 0) & (width > 0), F.ceil(F.round(span / F.when(width > 0, width), 9)).cast("int")).otherwise(1)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it's named."""
    return F.element_at(F.transform(F.array(value), body), 1)


# ---- parameter-quality functions


@dataclass(frozen=True)
class Range:
    lo: float
    hi: float


@dataclass(frozen=True)
class PqFunction:
    """Quality as a function of one parameter.  Inputs and outputs are clipped
    to their ranges; derivatives have unclipped values.  ``x``, ``y`` are
    columns, so a call works on any number of rows."""

    coeffs: tuple
    parameter: Range = Range(0.0, 255.0)
    rating: Range = Range(0.0, 10.0)

    def __post_init__(self):
        if len(self.coeffs) != self.n_coeffs or not all(np.isfinite(c) for c in self.coeffs):
            raise ValueError(f"{type(self).__name__} takes {self.n_coeffs} finite coefficients")

    def __call__(self, x) -> Column:
        return clip(self._f(clip(x, self.parameter.lo, self.parameter.hi)), self.rating.lo, self.rating.hi)

    def derivative(self, x) -> Column:
        return self._df(clip(x, self.parameter.lo, self.parameter.hi))

    def inverse(self, y, last=None) -> Column:
        return clip(self._inv(clip(y, self.rating.lo, self.rating.hi), last), self.parameter.lo, self.parameter.hi)

    def inverse_derivative(self, y, last=None) -> Column:
        return self._dinv(clip(y, self.rating.lo, self.rating.hi), last)

    def on_array(self, xs) -> Column:
        return F.transform(col(xs), self.__call__)


class Linear(PqFunction):
    """a + b x"""

    n_coeffs = 2

    def _f(self, x):
        return self.coeffs[0] + self.coeffs[1] * x

    def _df(self, x):
        return F.lit(float(self.coeffs[1]))

    def _inv(self, y, last):
        return (y - self.coeffs[0]) / self.coeffs[1]

    def _dinv(self, y, last):
        return F.lit(1.0 / self.coeffs[1])


class Quadratic(PqFunction):
    """a + b x + c x^2; of the roots the one in range, nearest to the last
    parameter, else the larger."""

    n_coeffs = 3

    def _f(self, x):
        a, b, c = self.coeffs
        return a + b * x + c * x * x

    def _df(self, x):
        return self.coeffs[1] + 2 * self.coeffs[2] * x

    def _root(self, y):
        a, b, c = self.coeffs
        return F.sqrt(F.greatest(F.lit(0.0), b * b - 4 * c * (a - y)))

    def _inv(self, y, last):
        _, b, c = self.coeffs
        near = lambda r: F.abs(r - col(last)) if last is not None else -r

        def choose(both):
            roots = both["one"], both["two"]
            inside = [r.between(self.parameter.lo, self.parameter.hi) for r in roots]
            nearer = F.when(near(roots[0]) <= near(roots[1]), roots[0]).otherwise(roots[1])
            return F.when(inside[0] & ~inside[1], roots[0]).when(inside[1] & ~inside[0], roots[1]).otherwise(nearer)

        return let(let(self._root(y), lambda r: F.struct(((-b + r) / (2 * c)).alias("one"), ((-b - r) / (2 * c)).alias("two"))), choose)

    def _dinv(self, y, last):
        _, b, c = self.coeffs
        side = F.signum(self._inv(y, last) + b / (2 * c)) * float(np.sign(c))
        return F.try_divide(side, self._root(y))


class Logarithmic(PqFunction):
    """a log_b(x - c) + d; the smallest positive number guards the logarithm."""

    n_coeffs = 4

    def _f(self, x):
        a, b, c, d = self.coeffs
        return a * F.ln(F.greatest(x - c, F.lit(TINY))) / float(np.log(b)) + d

    def _df(self, x):
        a, b, c, _ = self.coeffs
        return a / (F.greatest(x - c, F.lit(TINY)) * float(np.log(b)))

    def _inv(self, y, last):
        a, b, c, d = self.coeffs
        return F.pow(F.lit(float(b)), (y - d) / a) + c

    def _dinv(self, y, last):
        a, b, _, d = self.coeffs
        return F.pow(F.lit(float(b)), (y - d) / a) * float(np.log(b)) / a


FUNCTIONS = {"linear": Linear, "quadratic": Quadratic, "logarithmic": Logarithmic}


def random_coefficients(kind: str, rng: np.random.Generator, parameter: Range, rating: Range, rising: bool) -> tuple:
    """Coefficients of a function that spans the rating range in the wanted direction."""
    lo, hi = (rating.lo, rating.hi) if rising else (rating.hi, rating.lo)
    width = parameter.hi - parameter.lo
    if kind == "linear":
        slope = (hi - lo) / width * rng.uniform(0.5, 1.0)
        return (lo - slope * parameter.lo, slope)
    if kind == "quadratic":
        vertex = rng.uniform(parameter.lo, parameter.hi)
        far = max(vertex - parameter.lo, parameter.hi - vertex)
        c = (rating.hi - rating.lo) / far**2 * (1 if rising else -1)
        top = rating.lo if rising else rating.hi
        return (top + c * vertex**2, -2 * c * vertex, c)
    base, shift = rng.uniform(2, 10), parameter.lo - 1.0
    a = (hi - lo) / (np.log(width + 1) / np.log(base))
    return (float(a), float(base), shift, lo)
