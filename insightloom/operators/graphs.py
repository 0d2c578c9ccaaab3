"""Knowledge graphs as edge and vertex tables."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import THRESHOLDS, WEIGHTS
from .representations import ENDS_AT, IMPLIED_PARAMETER, IMPLIES, QUANTIFIED_BY, STARTS_AT
from .storage import materialise, quantile

# ------------------------------------------------------------ aggregation


def aggregate(edges: DataFrame, n_graphs: DataFrame | int) -> DataFrame:
    """Insight edges -> (influence, parameter, influence_type, weight,
    n_experiments, first_exp): weights summed over experiments, divided by the
    number of graphs, those without edges included.  Which experiments an edge
    has stays in the edge table; no row grows with their number.

    ``n_graphs``: a number, or a one-row table with column n.
    """
    g = edges.groupBy("influence", "parameter").agg(F.min("influence_type").alias("influence_type"), F.sum("weight").alias("w"), F.count("exp_id").alias("n_experiments"), F.min("exp_id").alias("first_exp"))
    if isinstance(n_graphs, int):
        g = g.withColumn("n", F.lit(n_graphs))
    else:
        g = g.crossJoin(F.broadcast(n_graphs.select("n")))  # one row
    return g.select("influence", "parameter", "influence_type", (F.col("w") / F.col("n")).alias("weight"), "n_experiments", "first_exp")


def complete_edges(influences: DataFrame, parameters: DataFrame) -> DataFrame:
    """All influences x all parameters, without weights: the graph in which
    everything may act on everything.  Both tables hold names, not data."""
    i, p = influences.groupBy("influence").agg(F.min("influence_type").alias("influence_type")), parameters.select("parameter").distinct()
    return i.crossJoin(p).select("influence", "parameter", "influence_type", F.lit(None).cast("double").alias("weight"))


def vertex_values(values: DataFrame) -> DataFrame:
    """(exp_id, key, type, value) -> (key, type, exp_id, value): one value for
    each vertex and experiment, the largest of several."""
    return values.groupBy("key", "exp_id").agg(F.min("type").alias("type"), F.max("value").alias("value")).select("key", "type", "exp_id", "value")


def edge_frequency(edges: DataFrame) -> DataFrame:
    """(influence, parameter, n, frequency): count over the number of distinct edges."""
    n = edges.groupBy("influence", "parameter").agg(F.count("*").alias("n"))
    total = n.agg(F.count("*").alias("edges"))
    return n.crossJoin(F.broadcast(total)).select("influence", "parameter", "n", (F.col("n") / F.col("edges")).alias("frequency"))


def improvement(ep: DataFrame, ratings: DataFrame) -> DataFrame:
    """(exp_id, improvement): sum over an experiment's distinct influences of
    -(rating - influence value)."""
    once = ep.select("exp_id", "influence", "influence_value").dropDuplicates(["exp_id", "influence"])
    r = ratings.select("exp_id", F.col("key").alias("influence"), F.col("value").alias("rating"))
    return once.join(r, ["exp_id", "influence"]).groupBy("exp_id").agg(F.sum(-(F.col("rating") - F.col("influence_value"))).alias("improvement"))


def weight_edges(edges: DataFrame, how: str | Callable[[Column, Column, Column], Column], frequency: DataFrame | None = None, gain: DataFrame | None = None) -> DataFrame:
    """Insight edges with a combined weight; unknown improvement gives NULL."""
    combine = WEIGHTS[how] if isinstance(how, str) else how
    out = edges
    out = out.join((frequency if frequency is not None else edge_frequency(edges)).select("influence", "parameter", "frequency"), ["influence", "parameter"], "left")
    out = out.join(gain.select("exp_id", "improvement"), "exp_id", "left") if gain is not None else out.withColumn("improvement", F.lit(None).cast("double"))
    return out.select(*edges.columns, combine(F.col("weight"), F.col("frequency"), F.col("improvement")).alias("combined")).drop("weight").withColumnRenamed("combined", "weight")


def weight_totals(edges: DataFrame, gain: DataFrame) -> DataFrame:
    """(influence, parameter, a column for each weighting): weights summed over
    an edge's experiments.  The edge table is read once: every combiner is
    linear in confidence c and improvement i, with the edge's frequency f the
    same for all its rows, so sums of c, i and c * i are enough."""
    g = edges.join(gain.select("exp_id", "improvement"), "exp_id", "left").groupBy("influence", "parameter")
    c, i = F.col("weight"), F.col("improvement")
    per = g.agg(F.count("*").alias("n"), F.count(c).alias("nc"), F.sum(c).alias("c"), F.sum(i).alias("i"), F.sum(F.when(c.isNotNull(), i)).alias("i_of_c"), F.sum(c * i).alias("ci"))
    per = per.crossJoin(F.broadcast(per.agg(F.count("*").alias("edges")))).withColumn("f", F.col("n") / F.col("edges"))  # one row
    f, half = F.col("f"), 0.5 * F.col("i_of_c") + F.col("ci")
    totals = {
        "confidence": F.col("c"), "frequency": f * F.col("n"), "improvement": F.col("i"), "confidence_frequency": 0.5 * f * F.col("nc") + F.col("c") * f,
        "confidence_improvement": half, "confidence_improvement_frequency": half * f, "frequency_improvement": f * F.col("i"),
    }
    return per.select("influence", "parameter", *(v.alias(k) for k, v in totals.items()))


def cluster_weights(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edge weight = share of its experiments (rows of the insight edges) with a
    cluster (label >= 0); unknown experiments count in the denominator only."""
    each = edges.select("influence", "parameter", "exp_id").join(labels.select("exp_id", "label"), "exp_id", "left")
    return each.groupBy("influence", "parameter").agg(F.avg(F.coalesce((F.col("label") >= 0).cast("double"), F.lit(0.0))).alias("weight"))


def influence_validity(edges: DataFrame, influence_sum: DataFrame, quality_sum: DataFrame) -> DataFrame:
    """Edge weight = mean over its experiments of influence sum / quality sum;
    undefined ratios count as 0."""
    each = edges.select("influence", "parameter", "exp_id")
    each = each.join(influence_sum.select("exp_id", F.col("value").alias("i")), "exp_id", "left").join(quality_sum.select("exp_id", F.col("value").alias("q")), "exp_id", "left")
    return each.groupBy("influence", "parameter").agg(F.avg(F.coalesce(F.try_divide("i", F.nullif("q", F.lit(0.0))), F.lit(0.0))).alias("weight"))


# ------------------------------------------------------------ filters


QUANTILES = {"median": 0.5, "q1": 0.25}


def threshold(weights: DataFrame, how: str | Callable[[Column], Column]) -> DataFrame:
    """One row with column t; NULL and NaN weights are left out."""
    agg = THRESHOLDS[how] if isinstance(how, str) else how
    return weights.where(F.col("weight").isNotNull() & ~F.isnan("weight")).agg(agg(F.col("weight")).alias("t"))


def filter_aggregated(kg: DataFrame, how: str | Callable[[Column], Column]) -> DataFrame:
    """Edges whose weight reaches the threshold; NULL weights go.  The graph is
    kept as a table first: summed anew, in another order, a weight that is the
    threshold itself could fall below it by its last bit."""
    return _reaching(materialise(kg, "kg"), how)


def _reaching(kg: DataFrame, how: str | Callable[[Column], Column]) -> DataFrame:
    return kg.crossJoin(F.broadcast(threshold(kg, how))).where(F.col("weight") >= F.col("t")).drop("t")


def filter_insight_graphs(edges: DataFrame, how: str | Callable[[Column], Column]) -> DataFrame:
    """Edges of the insight graphs below the threshold go; NULL weights stay.
    There are as many weights as rows, so quantiles are found by counting."""
    if how in QUANTILES:
        t = quantile(edges.where(~F.isnan("weight")), "weight", QUANTILES[how])
        return edges.where(F.col("weight").isNull() | (F.col("weight") >= F.lit(t)))
    return edges.crossJoin(F.broadcast(threshold(edges, how))).where(F.col("weight").isNull() | (F.col("weight") >= F.col("t"))).drop("t")


def connected_vertices(vertices: DataFrame, edges: DataFrame, src: str = "influence", dst: str = "parameter", key: str = "key") -> DataFrame:
    """Vertices that an edge touches."""
    ends = edges.select(F.col(src).alias(key)).union(edges.select(F.col(dst).alias(key))).distinct()
    return vertices.join(ends, key, "left_semi")


def methods(edges: DataFrame, n_graphs: DataFrame | int, weightings: list[str], thresholds: list[str], gain: DataFrame | None = None) -> DataFrame:
    """All combinations of weighting and threshold: aggregated, filtered edges
    with their ``weighting#threshold``."""
    out = None
    freq = edge_frequency(edges)
    for w in weightings:
        weighted = weight_edges(edges, w, freq, gain)
        kg = materialise(aggregate(weighted, n_graphs), "kg")
        for t in thresholds:
            one = _reaching(kg, t).withColumn("method", F.lit(f"{w}#{t}"))
            out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------ subgraphs and differences


def difference(full: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges of ``full`` with a flag: no longer in ``kept``."""
    mark = kept.select("influence", "parameter", F.lit(False).alias("filtered"))
    return full.join(mark, ["influence", "parameter"], "left").withColumn("filtered", F.coalesce("filtered", F.lit(True)))


def ego(edges: DataFrame, name: str) -> DataFrame:
    """Edges among a vertex and its neighbours, directions ignored."""
    near = edges.where(F.col("src") == name).select(F.col("dst").alias("v")).union(edges.where(F.col("dst") == name).select(F.col("src").alias("v")))
    near = near.union(near.sparkSession.createDataFrame([(name,)], "v string")).distinct()
    return edges.join(near.withColumnRenamed("v", "src"), "src", "left_semi").join(near.withColumnRenamed("v", "dst"), "dst", "left_semi")


HOPS = {"unquantified": 1, "basic": 1, "quantified_parameters_with_literal": 1, "quantified_conditions_with_literal": 1, "quantified_conditions_without_shortcut": 3, "quantified_conditions_with_shortcut": 3}


def hops(kg_type: str) -> int:
    """How far a quality's subgraph reaches in an encoding."""
    return HOPS.get(kg_type, 2)


def reach(vertices: DataFrame, edges: DataFrame, starts: DataFrame, n_hops: int, skip_values: bool = False) -> DataFrame:
    """(q, v): vertices within n hops of each start, directions ignored; paths
    don't go on past parameters and, asked for, never enter value vertices.

    vertices(name, type), edges(src, dst), starts(q).
    """
    kinds = vertices.select("name", "type")
    both = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    front = starts.select("q", F.col("q").alias("v"), F.lit("start").alias("type")).distinct()
    seen = front.select("q", "v")
    for _ in range(n_hops):
        # a vertex met again only repeats what it led to before; one distinct at the end drops it
        front = front.where("type <> 'parameter'").select("q", F.col("v").alias("src")).join(both, "src").select("q", F.col("dst").alias("v")).distinct().join(kinds, F.col("v") == F.col("name")).select("q", "v", "type")
        if skip_values:
            front = front.where("type <> 'value'")
        seen = seen.union(front.select("q", "v"))
    return seen.distinct()


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(q, edge columns): edges with both ends in a start's reach."""
    head = members.select("q", F.col("v").alias("src"))
    tail = members.select("q", F.col("v").alias("dst"))
    return edges.join(head, "src").join(tail, ["q", "dst"])


def parameters_hit(members: DataFrame, vertices: DataFrame) -> DataFrame:
    p = vertices.where("type = 'parameter'").select(F.col("name").alias("v"))
    return members.join(p, "v", "left_semi").select("q", F.col("v").alias("parameter")).distinct()


def interval_join(ranges: DataFrame, values: DataFrame, by: list[str], start: str = "start", end: str = "end", value: str = "value") -> DataFrame:
    """Pairs of a range and a value with equal ``by`` where the value lies
    strictly inside, whichever end comes first.

    A range of length up to 2**k lies in two or three cells of width 2**k; it is
    kept there, whatever its length.  A value is looked up in its cell of each
    width that its key's ranges have.  Both are equal-key joins, and what meets
    in a cell is of the order of what's found, so neither long nor many ranges
    make a product.  Ranges and values with nulls match nothing, infinite ends
    are ends like others."""
    lo, hi = F.least(F.col(start), F.col(end)).cast("double"), F.greatest(F.col(start), F.col(end)).cast("double")
    given = ranges.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumns({"lo_": lo, "hi_": hi}).where("lo_ < hi_")
    length = F.col("hi_") - F.col("lo_")
    level = F.when(length < float("inf"), F.ceil(F.log2(length)).cast("int")).otherwise(1100)
    cell = lambda x, k: F.when(k >= 1024, F.lit(0).cast("long")).otherwise(F.floor(x / F.pow(F.lit(2.0), k)))
    given = given.withColumn("level_", level)
    placed = given.withColumn("cell_", F.explode(F.sequence(cell(F.col("lo_"), F.col("level_")), cell(F.col("hi_"), F.col("level_")))))
    levels = given.select(*by, "level_").distinct()  # a few widths a key, at most as many as doubles have exponents
    looked = values.join(levels, by).withColumn("cell_", cell(F.col(value).cast("double"), F.col("level_")))
    found = placed.join(looked, [*by, "level_", "cell_"])
    return found.where((F.col("lo_") < F.col(value)) & (F.col(value) < F.col("hi_"))).drop("lo_", "hi_", "level_", "cell_")


def conditions_holding(ranges: DataFrame, values: DataFrame) -> DataFrame:
    """(range columns, value) where the value lies strictly inside.
    ranges(quality, start, end, ...), values(quality, value)."""
    return interval_join(ranges, values, ["quality"])


def quantified_subgraph(vertices: DataFrame, edges: DataFrame, asked: DataFrame, ternary: bool, skip_values: bool = False) -> DataFrame:
    """(q, value, edge columns): for each quality and value asked, the edges of
    an encoding of quantified conditions that hold there; ``skip_values`` leaves
    out edges to literals.

    Plain encodings: the quality's direct edges, and of each condition whose
    range holds the value its edges and those of its conclusion.  Ternary ones:
    the quality's relations with their parameters, and the edges of each part
    whose range holds the value.  asked(q, value)."""
    touching = edges.select(F.col("src").alias("node"), *edges.columns).union(edges.where("src <> dst").select(F.col("dst").alias("node"), *edges.columns))
    number = vertices.select(F.col("name").alias("dst"), F.col("literal_value").try_cast("double").alias("n")).dropDuplicates(["dst"])
    ends = edges.where(F.col("rel").isin(STARTS_AT, ENDS_AT)).join(number, "dst").groupBy(F.col("src").alias("node"))
    ends = ends.agg(F.min(F.when(F.col("rel") == STARTS_AT, F.col("n"))).alias("start"), F.min(F.when(F.col("rel") == ENDS_AT, F.col("n"))).alias("end"))
    cols = edges.columns
    start = asked.select("q", "value").distinct()
    first = touching.join(start.select(F.col("q").alias("node")).distinct(), "node").withColumnRenamed("node", "q")
    if ternary:
        always = first.join(edges.where(F.col("rel") == IMPLIED_PARAMETER).select(*(F.col(c).alias(f"{c}_2") for c in cols)), F.col("dst") == F.col("src_2")).select("q", *(F.col(f"{c}_2").alias(c) for c in cols)).unionByName(first.select("q", *cols)).distinct()
        parts = first.select("q", F.col("dst").alias("src")).join(edges.where(F.col("rel") == QUANTIFIED_BY).select("src", F.col("dst").alias("node")), "src").select("q", "node").distinct()
    else:
        always = first.where(F.col("rel") == IMPLIES).select("q", *cols).distinct()
        parts = first.where(F.col("rel") == QUANTIFIED_BY).select("q", F.col("dst").alias("node")).distinct()
    holding = interval_join(parts.join(ends, "node"), start, ["q"]).select("q", "value", "node")
    own = holding.join(touching, "node")
    if ternary:
        chosen = own.where(F.col("literal_included") == "None") if skip_values else own
        chosen = chosen.select("q", "value", *cols)
    elif skip_values:
        chosen = own.where(F.col("rel") == QUANTIFIED_BY).select("q", "value", *cols)
    else:
        conclusion = own.where(F.col("rel") == IMPLIES).select("q", "value", F.col("dst").alias("node"))
        chosen = own.select("q", "value", *cols).unionByName(conclusion.join(touching.where(F.col("rel") == QUANTIFIED_BY), "node").select("q", "value", *cols))
    return start.join(always, "q").select("q", "value", *cols).unionByName(chosen).distinct()


# ------------------------------------------------------------ statistics


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, in_degree, out_degree, degree), parallel edges counted."""
    outs = edges.groupBy(F.col("src").alias("name")).agg(F.count("*").alias("out_degree"))
    ins = edges.groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("in_degree"))
    d = vertices.select("name").join(outs, "name", "left").join(ins, "name", "left").na.fill(0, ["in_degree", "out_degree"])
    return d.select("name", "in_degree", "out_degree", (F.col("in_degree") + F.col("out_degree")).alias("degree"))


def neighbour_degree(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, neighbour_degree): mean degree of the distinct neighbours; 0 without any."""
    d = degrees(vertices, edges)
    both = edges.select(F.col("src").alias("name"), F.col("dst").alias("n")).union(edges.select(F.col("dst").alias("name"), F.col("src").alias("n"))).distinct()
    mean = both.join(d.select(F.col("name").alias("n"), "degree"), "n").groupBy("name").agg(F.avg("degree").alias("neighbour_degree"))
    return vertices.select("name").join(mean, "name", "left").na.fill(0.0, ["neighbour_degree"])


def closeness(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, closeness): over incoming distances, scaled by the share of
    vertices that reach it.  Paths of any length are followed."""
    step = materialise(edges.select(F.col("src").alias("mid"), "dst").distinct(), "steps")
    seen = front = vertices.select(F.col("name").alias("src"), F.col("name").alias("dst"), F.lit(0).alias("d"))
    for k in itertools.count(1):
        reached = front.select("src", F.col("dst").alias("mid")).join(step, "mid").select("src", "dst").distinct()
        front = materialise(reached.join(seen.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("d", F.lit(k)), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        seen = materialise(seen, "seen") if k % 16 == 0 else seen  # a short plan on long paths
    n = vertices.agg(F.count("*").alias("n"))
    far = seen.where("d > 0").groupBy(F.col("dst").alias("name")).agg(F.sum("d").alias("total"), F.count("*").alias("r"))
    c = F.coalesce(F.try_divide(F.col("r") * F.col("r"), F.col("total") * (F.col("n") - 1)), F.lit(0.0))
    return vertices.select("name").join(far, "name", "left").crossJoin(F.broadcast(n)).select("name", c.alias("closeness"))


def statistics(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: edges, nodes without literals, literals, relations, mean and
    deviation of degree."""
    counts = edges.agg(F.count("*").alias("edges"), F.countDistinct("rel").alias("relations"))
    kinds = vertices.agg(F.count_if(F.col("type") != "value").alias("nodes"), F.count_if(F.col("type") == "value").alias("literals"))
    deg = degrees(vertices, edges).agg(F.round(F.avg("degree"), 2).alias("degree_mean"), F.round(F.stddev("degree"), 2).alias("degree_std"))
    return counts.crossJoin(kinds).crossJoin(deg)
