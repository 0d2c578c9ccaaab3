"""Rule-set metrics from the counts of a 0/1 comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = 0.6931471805599453
CLIP = 2.220446049250313e-16  # hard predictions are kept this far from 0 and 1


def counts(truth: str = "truth", pred: str = "pred") -> list[Column]:
    t, p = F.col(truth), F.col(pred)
    one = lambda c: F.sum(c.cast("long"))
    return [one((t == 1) & (p == 1)).alias("tp"), one((t == 0) & (p == 1)).alias("fp"), one((t == 1) & (p == 0)).alias("fn"), one((t == 0) & (p == 0)).alias("tn")]


def _js() -> Column:
    """Squared Jensen-Shannon distance (natural log) of the two indicator
    vectors scaled to sum 1: from the counts alone."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    p, q = F.try_divide(F.lit(1.0), tp + fn), F.try_divide(F.lit(1.0), tp + fp)
    both = (p + q) / 2
    term = lambda x, m: x * F.ln(x / m)
    shared = F.when(tp > 0, tp * (term(p, both) + term(q, both))).otherwise(0.0)
    return F.when((tp + fn > 0) & (tp + fp > 0), (shared + (fn * p + fp * q) * LN2) / 2)


def metric_columns(n_rules: str = "n_rules") -> list[Column]:
    """The twelve metrics over columns tp, fp, fn, tn and a rule count."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    wrong, n = fp + fn, F.col(n_rules)
    f1 = F.try_divide(2.0 * tp, 2 * tp + fp + fn)
    precision, recall = F.try_divide(1.0 * tp, tp + fp), F.try_divide(1.0 * tp, tp + fn)
    js = _js()
    loss = F.try_divide(-(wrong * F.ln(F.lit(CLIP)) + (tp + tn) * F.ln(F.lit(1 - CLIP))), wrong + tp + tn)
    per = lambda x: F.try_divide(x, wrong)
    return [
        F.try_divide(1.0 * tp, tp + wrong).alias("jaccard"), js.alias("js_divergence"), loss.alias("cross_entropy"), f1.alias("f1"),
        F.try_divide(f1, n).alias("f1_by_length"), per(f1).alias("f1_by_false"), per(js).alias("js_by_false"),
        precision.alias("precision"), per(precision).alias("precision_by_false"), recall.alias("recall"), per(recall).alias("recall_by_false"), n.alias("rule_count"),
    ]
