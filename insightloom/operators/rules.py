"""Improvement rules: extraction from frames, comparison, merging, evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..functions import text as tx
from ..functions.metrics import counts, metric_columns
from .storage import materialise, quantiles_by

# When two rules count as equal, and when experts agree.
IOU_EQUAL, STEP_EQUAL, AGREEMENT = 0.9, 0.30, 0.6

# ------------------------------------------------------------ bins


def influence_bins(values: DataFrame, by: str | list = "influence", value: str = "value", bins: int | str | list | None = None) -> DataFrame:
    """(by, n_bins, edges): equal-width bins by a named rule (doane, unless
    given), a fixed number of them, or the given edges for every group."""
    by = [by] if isinstance(by, str) else list(by)
    d = values.where(F.col(value).isNotNull())
    if isinstance(bins, (list, tuple)):
        if len(bins) < 2 or list(bins) != sorted(bins):
            raise ValueError("two edges or more, in order")
        return d.select(*by).distinct().select(*by, F.lit(len(bins) - 1).alias("n_bins"), F.array(*(F.lit(float(e)) for e in bins)).alias("edges"))
    lo, hi, n = F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).cast("double").alias("n")
    if isinstance(bins, int):
        b = d.groupBy(*by).agg(lo, hi).withColumn("n_bins", F.lit(bins))
    elif bins in (None, "doane"):
        b = d.groupBy(*by).agg(lo, hi, nm.doane_bins(value).cast("int").alias("n_bins"))
    else:
        b = d.groupBy(*by).agg(lo, hi, n, F.stddev_pop(value).alias("dev"))
        if bins in ("fd", "auto"):
            q = quantiles_by(d, by, value, (0.25, 0.75)).groupBy(*by).agg((F.max("quantile") - F.min("quantile")).alias("iqr"))
            b = b.join(q, by)
        b = b.withColumn("n_bins", nm.rule_bins(bins))
    low = F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo"))
    high = F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))
    return b.select(*by, "n_bins", nm.bin_edges(low, high, F.col("n_bins")).alias("edges"))


def histogram(values: DataFrame, bins: DataFrame, by: str = "influence", value: str = "value") -> DataFrame:
    """(by, bin, lo, hi, n): counts per bin, empty bins included."""
    each = values.where(F.col(value).isNotNull()).join(bins, by)
    n = each.groupBy(by, nm.digitize(value, "edges").alias("bin")).agg(F.count("*").alias("n"))
    grid = bins.select(by, "edges", F.explode(F.sequence(F.lit(1), F.col("n_bins"))).alias("bin"))
    return grid.join(n, [by, "bin"], "left").select(by, "bin", F.element_at("edges", F.col("bin")).alias("lo"), F.element_at("edges", F.col("bin") + 1).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


# ------------------------------------------------------------ rules from values


KINDS = ("numeric", "boolean", "string")


def first_kind(kind: str = "kind") -> Column:
    """A group's kind, aggregated as a number: where an aggregation's buffer
    holds a text, Spark sorts all rows instead of hashing them."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.get(kinds, F.first(F.array_position(kinds, F.col(kind))).cast("int") - 1)


def rule_fields(value: str = "value", relative: str = "relative", kind: str = "kind") -> list[Column]:
    """Aggregates that make a rule of a group's parameter values: mean, mean
    +- population deviation, mean relative change; for truth values the
    majority, for categories the most frequent rounded code (least on ties)."""
    v, k = F.col(value), first_kind(kind)
    code = F.when(F.col(kind) == "string", F.bround(v, 0))  # a mode counts every value it sees, so it sees categories only
    mean, dev = F.avg(v), F.stddev_pop(v)
    numeric = k == "numeric"
    return [
        k.alias("param_type"), F.when(numeric, mean).alias("mean_value"), F.when(numeric, mean - dev).alias("range_start"), F.when(numeric, mean + dev).alias("range_end"),
        F.when(numeric, F.coalesce(F.avg(relative), F.lit(0.0))).alias("step_size"),
        F.when(k == "boolean", (mean >= 0.5).cast("double")).when(k == "string", F.mode(code, True)).alias("quantifier"),
        F.count(v).alias("n_values"),
    ]


def action() -> Column:
    """From the fields: by the step's sign; without a step (to nine digits, as
    sums in any order leave a rest), set for quantified and for collapsed ranges
    (ends alike to nine digits)."""
    step = F.round("step_size", 9)
    return (
        F.when(step > 0, "increase incrementally").when(step < 0, "decrease incrementally")
        .when(nm.close(F.col("range_start"), F.col("range_end"), 1e-9) | F.col("quantifier").isNotNull(), "set").otherwise("adjust incrementally")
    )


RULE_COLUMNS = ["condition", "cond_lo", "cond_hi", "action", "parameter", "param_type", "mean_value", "range_start", "range_end", "step_size", "quantifier"]


def finish(df: DataFrame) -> DataFrame:
    return df.withColumn("action", action()).withColumn("quantifier", F.when((F.col("action") == "set") & F.col("quantifier").isNull(), F.col("mean_value")).otherwise(F.col("quantifier"))).select(*RULE_COLUMNS, "n_values")


def in_bins(pairs: DataFrame, bins: DataFrame) -> DataFrame:
    """Usable pairs with the edges and the bin of their influence.  Bins go to
    the values: there are as many as influences, of which a few hold all values,
    so an exchange by influence would fill a few tasks."""
    d = pairs.where("influence_value is not null and value is not null")
    return d.join(F.broadcast(bins), "influence").withColumn("bin", nm.digitize("influence_value", "edges"))


def binned_rules(pairs: DataFrame, bins: DataFrame) -> DataFrame:
    """A rule per influence, bin and parameter.  pairs(exp_id, influence,
    influence_value, parameter, value, relative, kind)."""
    d = in_bins(pairs, bins)
    g = d.groupBy(F.col("influence").alias("condition"), "bin", "parameter").agg(F.first(F.element_at("edges", F.col("bin"))).alias("cond_lo"), F.first(F.element_at("edges", F.col("bin") + 1)).alias("cond_hi"), *rule_fields())
    return finish(g)


def edge_rules(pairs: DataFrame, bins: DataFrame) -> DataFrame:
    """A rule per influence and parameter; its condition is the bin that holds
    the mean influence, or mean +- sample deviation where none does."""
    d = pairs.where("influence_value is not null and value is not null")
    g = d.groupBy(F.col("influence").alias("condition"), "parameter").agg(F.avg("influence_value").alias("m"), F.stddev("influence_value").alias("s"), *rule_fields())
    g = g.join(bins.withColumnRenamed("influence", "condition"), "condition").withColumn("bin", nm.digitize("m", "edges"))
    inside = F.col("bin").between(1, F.col("n_bins"))
    g = g.withColumn("cond_lo", F.when(inside, F.try_element_at("edges", F.col("bin"))).otherwise(F.col("m") - F.col("s"))).withColumn("cond_hi", F.when(inside, F.try_element_at("edges", F.col("bin") + 1)).otherwise(F.col("m") + F.col("s")))
    return finish(g)


def fitted_rules(pairs: DataFrame, bins: DataFrame) -> DataFrame:
    """A rule per influence bin and parameter from a straight line fitted over
    all values (the mean where the line is undefined), read at bin centres."""
    d = pairs.where("influence_value is not null and value is not null")
    fit = d.groupBy("influence", "parameter").agg(F.regr_slope("value", "influence_value").alias("slope"), F.regr_intercept("value", "influence_value").alias("icept"), F.avg("value").alias("mean"), F.coalesce(F.avg("relative"), F.lit(0.0)).alias("step_size"), first_kind().alias("param_type"), F.count("*").alias("n_values"))
    centre = (F.col("cond_lo") + F.col("cond_hi")) / 2
    at = fit.join(bins, "influence").select("*", F.posexplode(F.slice("edges", F.lit(1), F.col("n_bins"))).alias("i", "cond_lo")).withColumn("cond_hi", F.element_at("edges", F.col("i") + 2))
    y = F.coalesce(F.col("slope") * centre + F.col("icept"), F.col("mean"))
    out = at.select(F.col("influence").alias("condition"), "cond_lo", "cond_hi", "parameter", "param_type", y.alias("mean_value"), y.alias("range_start"), y.alias("range_end"), "step_size", F.when(F.col("param_type") == "boolean", (y >= 0.5).cast("double")).when(F.col("param_type") == "string", F.bround(y, 0)).alias("quantifier"), "n_values")
    return finish(out)


def merged_rules(pairs: DataFrame, bins: DataFrame, step_bins: int | str | list | None = None) -> DataFrame:
    """Binned rules of one influence and parameter, those with one action and
    one bin of the step size (or one quantifier) merged into one.

    The first such rule takes in every later one, neighbours or not: a merged
    step lies between the steps that it's made of, so it stays in their bin, and
    all rules of a bin end up in one.  The condition reaches from the first
    rule's start to the last one's end.  Values are merged as counts, means and
    second moments, so no row grows with the data.  A merged rule keeps its
    rules' action, also where it was set for a range that was one value.

    The binned rules are kept as a table first: the least and the greatest step
    are the ends of the bins of steps, and steps that are averaged anew, in
    another order, could fall outside by their last bits."""
    d = in_bins(pairs, bins)
    g = d.groupBy(F.col("influence").alias("condition"), "bin", "parameter").agg(
        F.first(F.element_at("edges", F.col("bin"))).alias("cond_lo"), F.first(F.element_at("edges", F.col("bin") + 1)).alias("cond_hi"), *rule_fields(),
        F.avg("value").alias("m"), F.var_pop("value").alias("v"), F.count("relative").alias("rel_n"), F.sum("relative").alias("rel_sum"),
    ).withColumn("action", action())
    g = materialise(g, "binned")
    steps = influence_bins(g.where("step_size is not null"), ["condition", "parameter"], "step_size", step_bins).withColumnRenamed("edges", "step_edges").drop("n_bins")
    group = ["condition", "parameter", "action", "param_type", "like"]
    like = F.when(F.col("param_type") == "numeric", F.coalesce(nm.digitize("step_size", "step_edges"), F.lit(0)).cast("double")).otherwise(F.col("quantifier"))
    g = g.join(steps, ["condition", "parameter"], "left").withColumn("like", like)
    mean = F.sum(F.col("n_values") * F.col("m")).over(Window.partitionBy(*group)) / F.sum("n_values").over(Window.partitionBy(*group))
    g = g.withColumn("mean_", mean)
    place = F.struct("cond_lo", "cond_hi")
    out = g.groupBy(*group).agg(
        F.min_by("cond_lo", place).alias("cond_lo"), F.max_by("cond_hi", place).alias("cond_hi"), F.first("mean_").alias("mean_value"),
        F.sqrt(F.sum(F.col("n_values") * (F.col("v") + F.pow(F.col("m") - F.col("mean_"), F.lit(2)))) / F.sum("n_values")).alias("dev"),
        F.coalesce(F.sum("rel_sum") / F.sum("rel_n"), F.lit(0.0)).alias("step_size"), F.min_by("quantifier", place).alias("quantifier"), F.sum("n_values").alias("n_values"),
    )
    numeric = F.col("param_type") == "numeric"
    return out.select("condition", "cond_lo", "cond_hi", "action", "parameter", "param_type", F.when(numeric, F.col("mean_value")).alias("mean_value"), F.when(numeric, F.col("mean_value") - F.col("dev")).alias("range_start"), F.when(numeric, F.col("mean_value") + F.col("dev")).alias("range_end"), F.when(numeric, F.col("step_size")).alias("step_size"), "quantifier", "n_values")


# ------------------------------------------------------------ comparison


def high_equal(a: str = "a", b: str = "b") -> Column:
    return (F.col(f"{a}.parameter") == F.col(f"{b}.parameter")) & (F.col(f"{a}.condition") == F.col(f"{b}.condition"))


def mid_equal(a: str = "a", b: str = "b") -> Column:
    return high_equal(a, b) & (F.col(f"{a}.action") == F.col(f"{b}.action"))


def low_equal(a: str = "a", b: str = "b") -> Column:
    """Mid level, condition ranges that nearly coincide (or are undefined), and
    a mean inside the other's range, a close step or the same quantifier.
    Zero means and steps count as unset."""
    c = lambda t, n: F.col(f"{t}.{n}")
    iou = nm.interval_iou(c(a, "cond_lo"), c(a, "cond_hi"), c(b, "cond_lo"), c(b, "cond_hi"))
    given = lambda x: F.coalesce(x, F.lit(0.0)) != 0
    inside = lambda x, y: given(c(x, "mean_value")) & c(x, "mean_value").between(c(y, "range_start"), c(y, "range_end"))
    step = given(c(a, "step_size")) & given(c(b, "step_size")) & nm.close(c(a, "step_size"), c(b, "step_size"), STEP_EQUAL)
    same = c(a, "quantifier") == c(b, "quantifier")
    any_of = F.coalesce(inside(a, b), F.lit(False)) | F.coalesce(inside(b, a), F.lit(False)) | F.coalesce(step, F.lit(False)) | F.coalesce(same, F.lit(False))
    return mid_equal(a, b) & (iou.isNull() | (iou > IOU_EQUAL)) & any_of


LEVELS: dict[str, Callable[..., Column]] = {"high": high_equal, "mid": mid_equal, "low": low_equal}


def matching_pairs(base: DataFrame, pred: DataFrame, level: str | Callable = "high") -> DataFrame:
    """All equal pairs (columns a, b: rule structs).  Every level implies equal
    parameter and condition, which is the join's key."""
    equal = LEVELS[level] if isinstance(level, str) else level
    left = base.select(F.struct("*").alias("a"), F.col("parameter").alias("p"), F.col("condition").alias("c"))
    right = pred.select(F.struct("*").alias("b"), F.col("parameter").alias("p"), F.col("condition").alias("c"))
    return left.join(right, ["p", "c"]).where(equal("a", "b")).select("a", "b")


def level_flags(base: DataFrame, pred: DataFrame) -> DataFrame:
    """All pairs that are equal at the high level, with a flag for each level:
    one join for the three of them."""
    pairs = matching_pairs(base, pred, "high")
    return pairs.select("a", "b", *(F.coalesce(equal("a", "b"), F.lit(False)).alias(name) for name, equal in LEVELS.items()))


def _keyed(rules: DataFrame, key: Column | None = None) -> DataFrame:
    return rules.withColumn("key", tx.rule_key() if key is None else key).dropDuplicates(["key"])


def evaluation_sets(base: DataFrame, pred: DataFrame, level: str | Callable = "high") -> DataFrame:
    """(key, truth, pred): all rules that either set holds, by text.  A
    predicted rule that equals a baseline rule counts once, as found, however
    many it equals; every baseline rule that equals a predicted one is taken for
    found with it and drops out."""
    b, p = _keyed(base), _keyed(pred)
    hit = matching_pairs(b, p, level).select(F.col("a.key").alias("bk"), F.col("b.key").alias("pk"))
    shared, missed = hit.select(F.col("pk").alias("key")).distinct(), hit.select(F.col("bk").alias("key")).distinct()
    predicted = p.select("key").join(shared.withColumn("truth", F.lit(1)), "key", "left").select("key", F.coalesce("truth", F.lit(0)).alias("truth"), F.lit(1).alias("pred"))
    return predicted.unionByName(b.select("key").join(missed, "key", "left_anti").select("key", F.lit(1).alias("truth"), F.lit(0).alias("pred")))


def one_to_one(base: DataFrame, pred: DataFrame, level: str | Callable = "high", key: Column | None = None) -> DataFrame:
    """(base_key, pred_key): baseline rules in the order of their keys (texts,
    unless given), each with the first equal predicted rule that no earlier one
    has taken.

    Of all pairs still free, those that come first for both their rules are
    taken at once; that is what the loop over one rule after the other would
    take.  Rounds go on until no pair is free."""
    free = materialise(matching_pairs(_keyed(base, key), _keyed(pred, key), level).select(F.col("a.key").alias("base_key"), F.col("b.key").alias("pred_key")), "pairs")
    taken = None
    while not free.isEmpty():
        first = free.groupBy("base_key").agg(F.min("pred_key").alias("pred_key"))
        mine = free.groupBy("pred_key").agg(F.min("base_key").alias("base_key"))
        new = materialise(first.join(mine, ["base_key", "pred_key"]).select("base_key", "pred_key"), "taken")
        taken = new if taken is None else taken.unionByName(new)
        free = materialise(free.join(new.select("base_key"), "base_key", "left_anti").join(new.select("pred_key"), "pred_key", "left_anti"), "pairs")
    return taken if taken is not None else free


def evaluate(base: DataFrame, pred: DataFrame, level: str | Callable = "high") -> DataFrame:
    """One row with all metrics of a predicted rule set."""
    sets = evaluation_sets(base, pred, level)
    n = pred.agg(F.count("*").alias("n_rules"))
    return sets.agg(*counts()).crossJoin(n).select("tp", "fp", "fn", "tn", *metric_columns())


# ------------------------------------------------------------ experts


def expert_consensus(rules: DataFrame, n_experts: int, agreement: float = AGREEMENT) -> DataFrame:
    """Rules (with columns expert, pos) that enough experts gave, merged:
    means of the numbers, truth values by mean, texts by majority (first seen
    on ties)."""
    group = ["condition", "parameter"]
    votes = rules.groupBy(*group, "action").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    chosen = votes.groupBy(*group).agg(F.max_by("action", F.struct("n", -F.col("first"))).alias("action"))
    numbers = [c for c in RULE_COLUMNS if c not in (*group, "action", "param_type")]
    merged = rules.groupBy(*group).agg(F.countDistinct("expert").alias("n_experts"), F.first("param_type").alias("param_type"), *(F.avg(c).alias(c) for c in numbers)).where(F.col("n_experts") / n_experts >= agreement)
    merged = merged.withColumn("quantifier", F.when(F.col("param_type") == "boolean", (F.col("quantifier") >= 0.5).cast("double")).otherwise(F.col("quantifier")))
    return merged.join(chosen, group).select(*RULE_COLUMNS, "n_experts")
