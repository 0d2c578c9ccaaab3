"""Experiment tables: from nested documents to long frames and series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as nm
from ..functions import text as tx

# Rating keys that are never aggregated; categories of the summed rating.
META_KEYS = ("user_id", "rating_date", "time", "comment")
RATING_CATEGORIES = ("blobs", "gaps", "layer_misalignment", "layer_separation", "over_extrusion", "line_misalignment", "stringing", "under_extrusion", "warping", "poor_bridging")
AGGREGATES: dict[str, Callable[[Column], Column]] = {"mean": F.avg, "median": F.median, "min": F.min, "max": F.max}


def _mean_of(xs: Column) -> Column:
    return F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs))


def _median_of(xs: Column) -> Column:
    at = lambda s, n: F.get(s, F.floor(n / 2).cast("int")) * 0.5
    return nm.let(F.sort_array(xs), lambda s: at(s, F.size(s) - 1) + at(s, F.size(s)))


#: The same over an array without nulls.
ROW_AGGREGATES: dict[str, Callable[[Column], Column]] = {"mean": _mean_of, "median": _median_of, "min": F.array_min, "max": F.array_max}

# ------------------------------------------------------------ documents -> long tables


def filter_experiments(docs: DataFrame, completed_only: bool = False, with_insights_only: bool = False, series_id: str | None = None, include_oneoffs: bool = True, printers: list[str] | None = None, exp_ids: list[int] | None = None, limit: int | None = None) -> DataFrame:
    """The source's filters, as predicates that reach the scan."""
    if completed_only:
        docs = docs.where(F.col("completion") >= 1.0)
    if with_insights_only:
        docs = docs.where(F.col("insights").isNotNull())
    if series_id is not None:
        docs = docs.where(F.col("series_id") == series_id)
    if not include_oneoffs:
        docs = docs.where(~F.coalesce("oneoff", F.lit(False)))
    if printers:
        docs = docs.where(F.col("printer").isin(*printers))
    if exp_ids is not None:
        docs = docs.where(F.col("exp_id").isin(*exp_ids))
    return docs.limit(limit) if limit else docs


def fix_not_labelable(docs: DataFrame, worst: float = 5.0) -> DataFrame:
    """Ratings of parts that can't be labelled count as fully warped."""
    fixed = F.transform("ratings", lambda r: F.when(F.coalesce(F.try_element_at(r, F.lit("not_labelable")), F.lit(0.0)) > 0, F.map_concat(F.map_filter(r, lambda k, _: k != "warping"), F.create_map(F.lit("warping"), F.lit(worst)))).otherwise(r))
    return docs.withColumn("ratings", fixed)


def ratings_long(docs: DataFrame, how: str | Callable = "mean") -> DataFrame:
    """(exp_id, key, value): ratings of several raters aggregated per key."""
    agg = AGGREGATES[how] if isinstance(how, str) else how
    each = docs.select("exp_id", F.explode("ratings").alias("r")).select("exp_id", F.explode("r").alias("key", "value"))
    return each.where(~F.col("key").isin(*META_KEYS)).groupBy("exp_id", "key").agg(agg(F.col("value")).alias("value"))


def measurements_long(docs: DataFrame, how: str | Callable = "median") -> DataFrame:
    agg = AGGREGATES[how] if isinstance(how, str) else how
    m = docs.select("exp_id", F.explode("measurements").alias("m")).select("exp_id", F.expr("stack(2, 'humidity', m.humidity, 'temperature', m.temperature) as (key, value)"))
    return m.groupBy("exp_id", "key").agg(agg(F.col("value")).alias("value"))


def parameters_long(docs: DataFrame) -> DataFrame:
    """(exp_id, key, value): a changed value wins over the stored one."""
    merged = F.map_zip_with(F.coalesce("all_parameters", F.expr("cast(map() as map<string,struct<d:double,b:boolean,s:string>>)")), F.coalesce("changed_parameters", F.expr("cast(map() as map<string,struct<d:double,b:boolean,s:string>>)")), lambda k, a, c: F.coalesce(c, a))
    return docs.select("exp_id", F.explode(merged).alias("key", "value"))


def values_of(rating_how: str = "mean", measurement_how: str = "median") -> Column:
    """A document's parameters, aggregated ratings and measurements as one map:
    what the long tables hold of it, without an exchange."""
    none = F.expr("cast(map() as map<string,double>)")
    typed = F.expr("cast(map() as map<string,struct<d:double,b:boolean,s:string>>)")
    params = F.map_zip_with(F.coalesce("all_parameters", typed), F.coalesce("changed_parameters", typed), lambda k, a, c: tx.as_number(F.coalesce(c, a)))
    rated = F.filter("ratings", lambda r: r.isNotNull())
    keys = F.filter(F.array_distinct(F.flatten(F.transform(rated, F.map_keys))), lambda k: ~k.isin(*META_KEYS))
    over = lambda how, xs: nm.let(F.array_compact(xs), ROW_AGGREGATES[how])
    ratings = F.map_from_arrays(keys, F.transform(keys, lambda k: over(rating_how, F.transform(rated, lambda r: F.try_element_at(r, k)))))
    measured = F.when(F.size("measurements") > 0, F.create_map(*(x for c in ("humidity", "temperature") for x in (F.lit(c), over(measurement_how, F.col("measurements")[c])))))
    both = lambda a, b: F.map_zip_with(F.coalesce(a, none), F.coalesce(b, none), lambda k, x, y: F.coalesce(x, y))
    return both(both(params, ratings), measured)


def parameter_kinds(params: DataFrame) -> DataFrame:
    """(key, kind): numeric, boolean or string, by all of a key's values."""
    v = F.col("value")
    kinds = params.groupBy("key").agg(F.bool_and(v["d"].isNotNull()).alias("num"), F.bool_and(v["d"].isNotNull() | v["b"].isNotNull()).alias("logical"))
    return kinds.select("key", F.when(F.col("num"), "numeric").when(F.col("logical"), "boolean").otherwise("string").alias("kind"))


def changed_ui(docs: DataFrame) -> DataFrame:
    """(exp_id, key, user_value, original_value): changes that change something."""
    real = F.filter("insights.changed_ui_parameters", lambda u: u["original_value"] != u["user_value"])
    return docs.select("exp_id", F.explode(real).alias("u")).select("exp_id", "u.key", "u.user_value", F.coalesce("u.original_value", F.lit("-1")).alias("original_value"))


def influences_long(docs: DataFrame, influential_only: bool = True) -> DataFrame:
    """(exp_id, key, type, value): environment and previous-quality influences.

    Previous-quality influences of zero or false are left out.
    """
    env = docs.select("exp_id", F.explode("insights.influences").alias("m")).select("exp_id", F.explode("m").alias("key", "v")).select("exp_id", "key", F.lit("env_influence").alias("type"), tx.as_number(F.col("v.value")).alias("value"), F.col("v.value.s").alias("label"), F.col("v.influential").alias("influential"))
    last = docs.select("exp_id", F.explode(F.try_element_at("insights.last_rating_influences", F.lit(1))["items"]).alias("key", "v"))
    qual = last.where(~F.col("key").isin("experiment_id", "comment") & F.col("key").try_cast("int").isNull() & (F.col("v.value") != 0)).select("exp_id", tx.rating_to_snake("key").alias("key"), F.lit("qual_influence").alias("type"), F.col("v.value").alias("value"), F.lit(None).cast("string").alias("label"), F.col("v.influential").alias("influential"))
    both = env.unionByName(qual)
    return both.where("influential") if influential_only else both


def insight_edges(docs: DataFrame, influential_only: bool = True, default_weight: float = 0.5) -> DataFrame:
    """Insight graphs of all experiments: influences x changed parameters of
    each, joined on the experiment."""
    weight = docs.select("exp_id", F.coalesce("insights.uncertainty", F.lit(default_weight)).alias("weight"))
    inf = influences_long(docs, influential_only).select("exp_id", F.col("key").alias("influence"), F.col("type").alias("influence_type"))
    par = changed_ui(docs).select("exp_id", F.col("key").alias("parameter"))
    return inf.join(par, "exp_id").join(weight, "exp_id").select("exp_id", "influence", "influence_type", "parameter", "weight")


def quarantine(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, unusable): rows without id or without ratings go to the second."""
    ok = F.col("exp_id").isNotNull() & (F.size(F.coalesce("ratings", F.array())) > 0)
    return docs.where(ok), docs.where(~ok)


def wide(long: DataFrame, keys: list[str] | None = None, by: str = "exp_id") -> DataFrame:
    """Pivot at the edge of the API; without ``keys`` one distinct aggregation finds them."""
    if keys is None:
        keys = sorted(r["key"] for r in long.select("key").distinct().collect())  # column names of the result
    return long.groupBy(by).pivot("key", keys).agg(F.first("value"))


# ------------------------------------------------------------ series


def previous(exps: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """(series_id, exp_id, prev_id): the linked experiment, else the one before."""
    w = Window.partitionBy("series_id").orderBy("exp_id")
    out = exps.select("series_id", "exp_id", F.lag("exp_id").over(w).alias("prev_id"))
    if linked is None:
        return out
    return out.join(linked.toDF("exp_id", "link"), "exp_id", "left").select("series_id", "exp_id", F.coalesce("link", "prev_id").alias("prev_id"))


def positions(exps: DataFrame) -> DataFrame:
    return exps.withColumn("pos", F.row_number().over(Window.partitionBy("series_id").orderBy("exp_id")) - 1)


def linked_pairs(docs: DataFrame) -> DataFrame:
    """(prev_id, exp_id) of the documents' own links."""
    link = F.try_element_at("insights.last_rating_influences", F.lit(1))["experiment_id"]
    return docs.select(link.alias("prev_id"), "exp_id").where("prev_id is not null")


def complete_pairs(pairs: DataFrame, params: DataFrame, ratings: DataFrame) -> DataFrame:
    """Pairs whose earlier side has ratings and whose later side has parameters."""
    return pairs.join(ratings.select(F.col("exp_id").alias("prev_id")).distinct(), "prev_id", "left_semi").join(params.select("exp_id").distinct(), "exp_id", "left_semi")


def relative(long: DataFrame, prev: DataFrame, sign: int = -1) -> DataFrame:
    """sign * (value - value of the previous experiment); NULL without one."""
    old = long.select(F.col("exp_id").alias("prev_id"), "key", F.col("value").alias("old"))
    return long.join(prev, "exp_id").join(old, ["prev_id", "key"], "left").select("series_id", "exp_id", "key", (F.lit(sign) * (F.col("value") - F.col("old"))).alias("value"))


def with_previous(values: DataFrame, exps: DataFrame) -> DataFrame:
    """(series_id, exp_id, the columns of ``values``, before): one row per
    experiment with its values, and those of the one before it in its series as
    a struct, its fields NULL where that has none.  One window gives what
    ``relative`` joins, so experiments without a predecessor meet nowhere."""
    names = [c for c in values.columns if c != "exp_id"]
    both = exps.select("series_id", "exp_id").join(values.withColumn("has_", F.lit(True)), "exp_id", "left")
    w = Window.partitionBy("series_id").orderBy("exp_id")
    return both.withColumn("before", F.lag(F.struct(*names)).over(w)).where("has_").select("series_id", "exp_id", *names, "before")


def relative_to_default(changes: DataFrame) -> DataFrame:
    """user value - original value, where both are numbers."""
    diff = F.col("user_value").try_cast("double") - F.col("original_value").try_cast("double")
    return changes.select("exp_id", "key", diff.alias("value")).where("value is not null")


def relative_influence(influences: DataFrame, ratings: DataFrame) -> DataFrame:
    """-(rating - influence value) of previous-quality influences."""
    r = ratings.select("exp_id", "key", F.col("value").alias("rating"))
    return influences.where("type = 'qual_influence'").join(r, ["exp_id", "key"], "left").select("exp_id", "key", (-(F.col("rating") - F.col("value"))).alias("value"))


def metric_frames(exps: DataFrame, ratings: DataFrame, changes: DataFrame, influences: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """The six frames in one long table (frame, series_id, exp_id, key, value)."""
    prev = previous(exps, linked)
    series = exps.select("series_id", "exp_id")
    number = changes.select("exp_id", "key", F.col("user_value").try_cast("double").alias("value"))
    parts = {
        "quality": ratings.join(series, "exp_id"),
        "quality_relative": relative(ratings, prev),
        "changed_parameters": number.join(series, "exp_id"),
        "changed_parameters_relative": relative_to_default(changes).join(series, "exp_id"),
        "influences": influences.where("value is not null").join(series, "exp_id"),
        "influences_relative": relative_influence(influences, ratings).join(series, "exp_id"),
    }
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("frame"), "series_id", "exp_id", "key", "value")
        out = df if out is None else out.unionByName(df)
    return out


def metric_frames_wide(values: DataFrame, exps: DataFrame, ratings: list[str], changes: dict[str, tuple[Column, Column]], influences: dict[str, Column]) -> DataFrame:
    """``metric_frames`` of experiments whose values are columns of one row:
    ratings are columns of ``values``; changes (key: user value, original value)
    and previous-quality influences (by the rating's name) are expressions over
    it.  A row per experiment is exchanged by series, nothing else is: values
    are unfolded in the result, which stands by series."""
    c = F.col
    number = {k: (user.try_cast("double"), original.try_cast("double")) for k, (user, original) in changes.items()}
    parts = {
        "quality": {k: c(k) for k in ratings},
        "quality_relative": {k: F.lit(-1) * (c(k) - c("before")[k]) for k in ratings},
        "changed_parameters": {k: user for k, (user, _) in number.items()},
        "changed_parameters_relative": {k: user - original for k, (user, original) in number.items()},
        "influences": influences,
        "influences_relative": {k: -((c(k) if k in ratings else F.lit(None).cast("double")) - x) for k, x in influences.items()},
    }
    cell = lambda frame, k, x: F.struct(F.lit(frame).alias("frame"), F.lit(k).alias("key"), x.cast("double").alias("value"))
    cells = F.array(*(cell(frame, k, x) for frame, of in parts.items() for k, x in of.items()))
    out = with_previous(values, exps).select("series_id", "exp_id", F.explode(cells).alias("x")).select("x.frame", "series_id", "exp_id", "x.key", "x.value")
    return out.where("value is not null or frame not in ('changed_parameters_relative', 'influences')")


def fill_from_series(frame: DataFrame, lookup: DataFrame, exps: DataFrame) -> DataFrame:
    """Adds, for every key used anywhere in a series, the looked-up value of the
    series' experiments that lack it."""
    have = frame.join(exps.select("series_id", "exp_id"), "exp_id").select("series_id", "key").distinct()
    grid = exps.select("series_id", "exp_id").join(have, "series_id")
    return grid.join(frame.select("exp_id", "key", F.col("value").alias("own")), ["exp_id", "key"], "left").join(lookup.select("exp_id", "key", F.col("value").alias("looked")), ["exp_id", "key"], "left").select("exp_id", "key", F.coalesce("own", "looked").alias("value"))


def ep_values(edges: DataFrame, params: DataFrame, influences: DataFrame, quality: DataFrame, exps: DataFrame) -> DataFrame:
    """One row per edge and experiment with all values present: (parameter,
    influence, series_id, exp_id, param_value, param_original, influence_value,
    quality_aggregated)."""
    p = params.select("exp_id", F.col("key").alias("parameter"), F.col("value").alias("param_value"), F.col("original").alias("param_original"))
    i = influences.select("exp_id", F.col("key").alias("influence"), F.col("value").alias("influence_value"))
    q = quality.select("exp_id", F.col("value").alias("quality_aggregated"))
    out = edges.select("exp_id", "influence", "parameter").join(p, ["exp_id", "parameter"]).join(i, ["exp_id", "influence"]).join(q, "exp_id").join(exps.select("series_id", "exp_id"), "exp_id")
    return out.select("parameter", "influence", "series_id", "exp_id", "param_value", "param_original", "influence_value", "quality_aggregated").dropna(subset=["param_value", "influence_value", "quality_aggregated"])


def ep_values_wide(edges: DataFrame, values: DataFrame, exps: DataFrame, parameters: dict[str, tuple[Column, Column]], influences: dict[str, Column], quality: Column) -> DataFrame:
    """``ep_values`` of experiments whose values are columns of one row:
    parameters (name: value, original value), influences and the quality are
    expressions over ``values``.  Everything is exchanged by experiment, once."""

    def named(by: str, columns: dict[str, Column]) -> Column:
        return F.coalesce(*(F.when(F.col(by) == k, x) for k, x in columns.items()))

    each = edges.select("exp_id", "influence", "parameter").join(values.join(exps.select("series_id", "exp_id"), "exp_id"), "exp_id")
    value, original = ({k: x[i] for k, x in parameters.items()} for i in (0, 1))
    out = each.select("parameter", "influence", "series_id", "exp_id", named("parameter", value).alias("param_value"), named("parameter", original).alias("param_original"), named("influence", influences).alias("influence_value"), quality.alias("quality_aggregated"))
    return out.dropna(subset=["param_value", "influence_value", "quality_aggregated"])


def summed_rating(ratings: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(exp_id, value): weighted sum over the rating categories, weight 1 by default."""
    w = F.create_map(*(F.lit(x) for k in RATING_CATEGORIES for x in (k, float((weights or {}).get(k, 1.0)))))
    return ratings.groupBy("exp_id").agg(F.coalesce(F.sum(F.col("value") * F.try_element_at(w, F.col("key"))), F.lit(0.0)).alias("value"))


def series_keys(edges: DataFrame, exps: DataFrame) -> DataFrame:
    """(series_id, parameters, influences): sorted sets of names ever used."""
    return edges.join(exps.select("series_id", "exp_id"), "exp_id").groupBy("series_id").agg(F.array_sort(F.collect_set("parameter")).alias("parameters"), F.array_sort(F.collect_set("influence")).alias("influences"))


def series_best(exps: DataFrame, quality: DataFrame) -> DataFrame:
    """(series_id, exp_id, value): the experiment with the least rating; ties to
    the smaller id."""
    best = exps.join(quality, "exp_id").groupBy("series_id").agg(F.min(F.struct("value", "exp_id")).alias("m"))
    return best.select("series_id", F.col("m.exp_id").alias("exp_id"), F.col("m.value").alias("value"))


def restrict_series(exps: DataFrame, keep: DataFrame) -> DataFrame:
    """(series_id, exp_ids) of experiments in ``keep``; empty series vanish."""
    return exps.join(keep.select("exp_id").distinct(), "exp_id", "left_semi").groupBy("series_id").agg(F.array_sort(F.collect_list("exp_id")).alias("exp_ids"))


def thin_out(exps: DataFrame, most: int) -> DataFrame:
    """Series longer than ``most`` lose experiments at even intervals."""
    n = F.count("*").over(Window.partitionBy("series_id"))
    out = positions(exps).withColumn("n_", n).withColumn("drop_", F.greatest(F.col("n_") - most, F.lit(0)))
    step = F.when(F.col("drop_") > 1, F.floor((F.col("n_") - 1) / F.greatest(F.col("drop_") - 1, F.lit(1)))).otherwise(F.lit(0))
    gone = (F.col("drop_") > 0) & F.when(step > 0, (F.col("pos") % step == 0) & (F.col("pos") / step < F.col("drop_"))).otherwise(F.col("pos") == 0)
    return out.where(~gone).drop("pos", "n_", "drop_")


def adjacent(df: DataFrame, order: str, value: str, by: list[str] | None = None) -> DataFrame:
    """(first, second): neighbouring values of a sequence."""
    w = Window.partitionBy(*(by or [])).orderBy(order)
    return df.select(*(by or []), F.col(value).alias("first"), F.lead(value).over(w).alias("second")).where("second is not null")


def chunks(df: DataFrame, order: str, size: int, by: list[str]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("chunk", F.floor((F.row_number().over(w) - 1) / size))
