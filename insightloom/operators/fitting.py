"""FUNCTION rules: curves and classifiers for all (influence, parameter) groups at once.

One pass over the values adds up powers of the standardised influence, by group
and fold.  Everything after that works on these sums alone: the normal equations
of every candidate (degree of the polynomial, ridge penalty), its error on the
fold left out, the choice of the best candidate and its final coefficients.  No
group's values ever meet in one task, and a group is a row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules

#: Highest degree of a polynomial; equations have one more unknown.
MOST_DEGREE = 3

GROUP = ["influence", "parameter"]


@dataclass(frozen=True)
class Fit:
    """A candidate: least squares over powers up to ``degree``, the penalty
    ``alpha`` on all coefficients but the constant."""

    degree: int = 1
    alpha: float = 0.0

    def __post_init__(self):
        if not 0 <= self.degree <= MOST_DEGREE or self.alpha < 0:
            raise ValueError(f"degree 0 to {MOST_DEGREE} and a penalty of 0 or more")


GRID = tuple(Fit(d, a) for d in (1, 2, 3) for a in (0.0, 1.0, 10.0))


@dataclass(frozen=True)
class RuleMethod:
    """How rules are taken from a graph's values.  ``fits`` are the candidates
    of the function mode; with ``folds`` of 2 or more the one with the best mean
    r2 on the folds left out is chosen for each group, else the first is taken."""

    mode: str = "binned_influences"
    fits: tuple[Fit, ...] = (Fit(),)
    folds: int = 0
    name: str | None = None

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        if not self.fits or self.folds == 1:
            raise ValueError("a candidate, and no or at least two folds")

    def __str__(self) -> str:
        return "_".join(filter(None, (self.mode, self.name))).lower()


def solve(df: DataFrame, matrix: Callable[[int, int], Column], right: Callable[[int], Column], size: int, into: str) -> DataFrame:
    """``df`` with the solution of a symmetric positive system as the array
    ``into``, null where the system is singular.  Each elimination step is a
    projection of its own, so expressions stay short."""
    keep = df.columns
    a = {(i, j): f"a{i}{j}_" for i in range(size) for j in range(size)}
    b = {i: f"b{i}_" for i in range(size)}
    df = df.select("*", *(matrix(i, j).cast("double").alias(a[i, j]) for i, j in a), *(right(i).cast("double").alias(b[i]) for i in b))
    for k in range(size):
        pivot = F.when(F.abs(F.col(a[k, k])) > 1e-9, F.col(a[k, k]))
        share = {i: F.col(a[i, k]) / pivot for i in range(size) if i != k}
        cells = [(F.col(a[i, j]) - share[i] * F.col(a[k, j]) if i != k else F.col(a[i, j])).alias(a[i, j]) for i, j in a]
        df = df.select(*keep, *cells, *((F.col(b[i]) - share[i] * F.col(b[k]) if i != k else F.col(b[i])).alias(b[i]) for i in b))
    roots = [F.col(b[i]) / F.when(F.abs(F.col(a[i, i])) > 1e-9, F.col(a[i, i])) for i in range(size)]
    whole = F.array(*roots)
    return df.select(*keep, F.when(F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x)), whole).alias(into))


def _usable(pairs: DataFrame) -> DataFrame:
    return pairs.where("influence_value is not null and value is not null")


def standardised(pairs: DataFrame) -> DataFrame:
    """pairs with ``z``, the influence in standard units of its group.  The
    groups' scales go to the values, as bins do (``rules.in_bins``)."""
    d = _usable(pairs)
    scale = d.groupBy(*GROUP).agg(F.avg("influence_value").alias("mx"), F.stddev_pop("influence_value").alias("sx"))
    return d.join(F.broadcast(scale), GROUP).withColumn("z", F.when(F.col("sx") > 0, (F.col("influence_value") - F.col("mx")) / F.col("sx")).otherwise(0.0))


def moments(z: DataFrame, fold: Column) -> DataFrame:
    """(group, fold, mx, sx, s0.., t0.., yy, n_set): sums of powers of z, of
    their products with the value, of its square; values that aren't zero."""
    power = lambda k: F.pow("z", F.lit(k)) if k else F.lit(1.0)
    s = [F.sum(power(k)).alias(f"s{k}") for k in range(2 * MOST_DEGREE + 1)]
    t = [F.sum(F.col("value") * power(k)).alias(f"t{k}") for k in range(MOST_DEGREE + 1)]
    return z.groupBy(*GROUP, fold.alias("fold")).agg(F.first("mx").alias("mx"), F.first("sx").alias("sx"), *s, *t, F.sum(F.col("value") * F.col("value")).alias("yy"), F.count_if(F.col("value") != 0).alias("n_set"))


_SUMS = [*(f"s{k}" for k in range(2 * MOST_DEGREE + 1)), *(f"t{k}" for k in range(MOST_DEGREE + 1)), "yy"]


def _candidates(fits) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(f.degree).alias("degree"), F.lit(float(f.alpha)).alias("alpha")) for f in fits)))


def _solved(df: DataFrame) -> DataFrame:
    """Coefficients of the candidate (degree, alpha) from the sums s, t."""
    inside = lambda *ks: F.greatest(*(F.lit(k) for k in ks)) <= F.col("degree") if len(ks) > 1 else F.lit(ks[0]) <= F.col("degree")

    def matrix(i: int, j: int) -> Column:
        cell = F.col(f"s{i + j}") + (F.col("alpha") if i == j and i else F.lit(0.0))
        return F.when(inside(i, j), cell).otherwise(float(i == j))

    return solve(df, matrix, lambda i: F.when(inside(i), F.col(f"t{i}")).otherwise(0.0), MOST_DEGREE + 1, "coef")


def scores(by_fold: DataFrame, total: DataFrame, fits) -> DataFrame:
    """(group, degree, alpha, score): mean r2 of each candidate over the folds
    left out; null where a fold has one value only or a system is singular."""
    held = by_fold.select(*GROUP, "fold", *(F.col(c).alias(f"h_{c}") for c in _SUMS))
    train = held.join(total.select(*GROUP, *_SUMS), GROUP).select(*GROUP, "fold", *(f"h_{c}" for c in _SUMS), *((F.col(c) - F.col(f"h_{c}")).alias(c) for c in _SUMS))
    fit = _solved(train.select("*", _candidates(fits).alias("c")).select("*", "c.degree", "c.alpha").drop("c"))
    c = [F.col("coef")[i] for i in range(MOST_DEGREE + 1)]
    off = F.col("h_yy") - 2 * sum((c[i] * F.col(f"h_t{i}") for i in range(MOST_DEGREE + 1)), F.lit(0.0)) + sum((c[i] * c[j] * F.col(f"h_s{i + j}") for i in range(MOST_DEGREE + 1) for j in range(MOST_DEGREE + 1)), F.lit(0.0))
    spread = F.col("h_yy") - F.col("h_t0") * F.col("h_t0") / F.col("h_s0")
    r2 = F.when(F.col("h_s0") >= 2, F.when(spread > 0, 1 - off / F.when(spread > 0, spread)).otherwise(F.when(F.abs(off) < 1e-12, 1.0).otherwise(0.0)))
    return fit.withColumn("r2", r2).groupBy(*GROUP, "degree", "alpha").agg(F.when(F.count("r2") == F.count("*"), F.avg("r2")).alias("score"))


def best_fits(pairs: DataFrame, method: RuleMethod, fold: Column | None = None) -> DataFrame:
    """(group, degree, alpha, score, mx, sx, coef): each group's chosen curve.
    Fewer than two values other than zero: the mean (degree 0); fewer than two a
    fold: a straight line; candidates whose scores agree to nine digits count
    as equal, and of them the lowest degree and penalty is taken.  A curve that
    the values don't determine falls back to the mean."""
    fold = F.lit(0) if method.folds < 2 else fold if fold is not None else F.pmod(F.hash("exp_id"), F.lit(method.folds))
    by_fold = moments(standardised(pairs), fold)
    total = by_fold.groupBy(*GROUP).agg(F.first("mx").alias("mx"), F.first("sx").alias("sx"), *(F.sum(c).alias(c) for c in _SUMS), F.sum("n_set").alias("n_set"))
    if method.folds < 2:
        first = method.fits[0]
        chosen = total.withColumns({"degree": F.lit(first.degree), "alpha": F.lit(float(first.alpha)), "score": F.lit(None).cast("double")})
        line = F.col("n_set") < 2
    else:
        s = scores(by_fold, total, method.fits)
        top = s.where("score is not null").groupBy(*GROUP).agg(F.max_by(F.struct("degree", "alpha", "score"), F.struct(F.round("score", 9), -F.col("degree"), -F.col("alpha"))).alias("c"))
        chosen = total.join(top, GROUP, "left").select(*total.columns, "c.degree", "c.alpha", "c.score")
        few = F.col("n_set") < 2 * method.folds
        chosen = chosen.withColumns({"degree": F.when(few | F.col("degree").isNull(), 1).otherwise(F.col("degree")), "alpha": F.when(few | F.col("degree").isNull(), 0.0).otherwise(F.col("alpha")), "score": F.when(~few, F.col("score"))})
        line = F.col("n_set") < 2
    chosen = chosen.withColumns({"degree": F.when(line, 0).otherwise(F.col("degree")), "alpha": F.when(line, 0.0).otherwise(F.col("alpha")), "score": F.when(~line, F.col("score"))})
    out = _solved(chosen)
    mean = F.array(F.col("t0") / F.col("s0"), *(F.lit(0.0) for _ in range(MOST_DEGREE)))
    lost = F.col("coef").isNull()
    return out.select(*GROUP, F.when(lost, 0).otherwise(F.col("degree")).alias("degree"), F.when(lost, 0.0).otherwise(F.col("alpha")).alias("alpha"), "score", "mx", "sx", F.coalesce("coef", mean).alias("coef"))


def at_bins(fits: DataFrame, bins: DataFrame) -> DataFrame:
    """A row per group and bin with its centre in standard units."""
    each = fits.join(bins, "influence").select(fits["*"], F.posexplode(F.slice("edges", F.lit(1), F.col("n_bins"))).alias("i", "cond_lo"), "edges").withColumn("cond_hi", F.element_at("edges", F.col("i") + 2)).drop("edges")
    centre = (F.col("cond_lo") + F.col("cond_hi")) / 2
    return each.withColumn("z", F.when(F.col("sx") > 0, (centre - F.col("mx")) / F.col("sx")).otherwise(0.0))


def classes(pairs: DataFrame, penalty: float = 1.0, degree: int = 2) -> DataFrame:
    """(group, mx, sx, class, n, coef): a least-squares support vector machine,
    each class against the rest, over powers of the standardised influence.
    Codes of categories are rounded, truth values are 0 and 1.  Groups with one
    class have one row."""
    d = standardised(pairs).withColumn("class", F.when(F.col("kind") == "boolean", (F.col("value") >= 0.5).cast("double")).otherwise(F.bround("value", 0)))
    power = lambda k: F.pow("z", F.lit(k)) if k else F.lit(1.0)
    own = d.groupBy(*GROUP, "class").agg(F.first("mx").alias("mx"), F.first("sx").alias("sx"), F.count("*").alias("n"), *(F.sum(power(k)).alias(f"u{k}") for k in range(2 * degree + 1)))
    total = own.groupBy(*GROUP).agg(*(F.sum(f"u{k}").alias(f"s{k}") for k in range(2 * degree + 1)))
    both = own.join(total, GROUP)
    return solve(both, lambda i, j: F.col(f"s{i + j}") + (penalty if i == j and i else 0.0), lambda i: 2 * F.col(f"u{i}") - F.col(f"s{i}"), degree + 1, "coef").select(*GROUP, "class", "mx", "sx", "n", "coef")


def classified_rules(pairs: DataFrame, bins: DataFrame, penalty: float = 1.0, degree: int = 2) -> DataFrame:
    """A rule per influence bin and parameter of truth values or categories: the
    class with the highest score at the bin's centre (equal to nine digits: the
    least code); the most frequent where the system is singular."""
    d = pairs.where("kind <> 'numeric'")
    each = at_bins(classes(d, penalty, degree), bins)
    score = F.aggregate("coef", F.lit(0.0), lambda a, c: a * 1.0 + c) if degree == 0 else sum((F.col("coef")[k] * F.pow("z", F.lit(k)) if k else F.col("coef")[0] for k in range(degree + 1)), F.lit(0.0))
    top = each.groupBy(*GROUP, "i").agg(F.first("cond_lo").alias("cond_lo"), F.first("cond_hi").alias("cond_hi"), F.max_by("class", F.struct(F.coalesce(F.round(score, 9), F.lit(-1e300)), F.when(F.col("coef").isNull(), F.col("n")).otherwise(0), -F.col("class"))).alias("quantifier"), F.sum("n").alias("n_values"))
    kinds = _usable(d).groupBy(*GROUP).agg(rules.first_kind().alias("param_type"))
    none = F.lit(None).cast("double")
    out = top.join(kinds, GROUP).select(F.col("influence").alias("condition"), "cond_lo", "cond_hi", F.lit("set").alias("action"), "parameter", "param_type", none.alias("mean_value"), none.alias("range_start"), none.alias("range_end"), none.alias("step_size"), "quantifier", "n_values")
    return out.select(*rules.RULE_COLUMNS, "n_values")


def curve_rules(pairs: DataFrame, bins: DataFrame, method: RuleMethod, fold: Column | None = None) -> DataFrame:
    """A rule per influence bin and numeric parameter, read off the chosen curve
    at the bin's centre."""
    d = pairs.where("kind = 'numeric'")
    y = sum((F.col("coef")[k] * F.pow("z", F.lit(k)) if k else F.col("coef")[0] for k in range(MOST_DEGREE + 1)), F.lit(0.0))
    steps = _usable(d).groupBy(*GROUP).agg(F.coalesce(F.avg("relative"), F.lit(0.0)).alias("step_size"), F.count("*").alias("n_values"))
    each = at_bins(best_fits(d, method, fold), bins).withColumn("mean_value", y).join(steps, GROUP)
    shaped = each.select(F.col("influence").alias("condition"), "cond_lo", "cond_hi", "parameter", F.lit("numeric").alias("param_type"), "mean_value", F.col("mean_value").alias("range_start"), F.col("mean_value").alias("range_end"), "step_size", F.lit(None).cast("double").alias("quantifier"), "n_values")
    return rules.finish(shaped)


def function_rules(pairs: DataFrame, bins: DataFrame, method: RuleMethod, fold: Column | None = None) -> DataFrame:
    """Curves for numeric parameters, classes for the others."""
    return curve_rules(pairs, bins, method, fold).unionByName(classified_rules(pairs, bins))


MODES: dict[str, Callable] = {
    "from_edges": lambda pairs, bins, method: rules.edge_rules(pairs, bins),
    "binned_influences": lambda pairs, bins, method: rules.binned_rules(pairs, bins),
    "binned_influences_merged": lambda pairs, bins, method: rules.merged_rules(pairs, bins),
    "binned_influences_function": lambda pairs, bins, method: function_rules(pairs, bins, method),
}


def extract(pairs: DataFrame, bins: DataFrame, method: RuleMethod = RuleMethod()) -> DataFrame:
    """The rules of a graph's values by any of the four modes."""
    return MODES[method.mode](pairs, bins, method)
