"""Point lookups, small predicates and display attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Display colours by vertex type.
COLOURS = {"parameter": "lightblue", "qual_influence": "orange", "env_influence": "lightgreen", "value": "lightgrey"}


def by_experiment(frame: DataFrame, exp_id: int) -> DataFrame:
    return frame.where(F.col("exp_id") == exp_id)


def info_columns(df: DataFrame, tag: str) -> DataFrame:
    """Process parameters (numbers only) or ratings (but the overall one), in
    order of name; the schema decides."""
    numeric = sorted(c for c, t in df.dtypes if t in ("double", "float", "int", "bigint") and c not in ("exp_id", "overall_ok"))
    prefix = {"parameters": "param_", "ratings": "rating_"}[tag]
    return df.select("exp_id", *(c for c in numeric if c.startswith(prefix)))


def matching_triples(t: DataFrame, h: str | None = None, r: str | None = None, tail: str | None = None) -> DataFrame:
    for name, value in (("h", h), ("r", r), ("t", tail)):
        if value is not None:
            t = t.where(F.col(name) == value)
    return t


def within(values: Column, lo: float, hi: float) -> Column:
    """Elements of an array inside a range."""
    return F.filter(values, lambda x: x.between(lo, hi))


def is_relation(influence: str, parameter: str) -> Column:
    return (F.col("condition") == influence) & (F.col("parameter") == parameter)


def series_optimising(exps: DataFrame, quality: str) -> DataFrame:
    """Series whose experiments optimise a quality."""
    return exps.where(F.array_contains("optimised", quality)).select("series_id").distinct()


def restrict_experiments(exps: DataFrame, ids: DataFrame) -> DataFrame:
    return exps.join(ids.select("exp_id").distinct(), "exp_id", "left_semi")


def key_occurrence(ratings: DataFrame) -> DataFrame:
    """(key, n): experiments that have a rating above zero."""
    return ratings.where("value > 0").groupBy("key").agg(F.countDistinct("exp_id").alias("n"))


def combination_occurrence(ratings: DataFrame) -> DataFrame:
    """(keys, n): experiments by the set of their ratings above zero."""
    each = ratings.where("value > 0").groupBy("exp_id").agg(F.array_join(F.array_sort(F.collect_set("key")), ",").alias("keys"))
    return each.groupBy("keys").agg(F.count("*").alias("n"))


def edge_parameter_stats(edges: DataFrame, params: DataFrame) -> DataFrame:
    """(influence, parameter, mean, median) of a parameter over the experiments of an edge."""
    j = edges.select("influence", "parameter", "exp_id").join(params.select("exp_id", F.col("key").alias("parameter"), "value"), ["exp_id", "parameter"])
    return j.groupBy("influence", "parameter").agg(F.avg("value").alias("mean"), F.median("value").alias("median"))


def vertex_display(vertices: DataFrame) -> DataFrame:
    c = F.create_map(*(F.lit(x) for kv in COLOURS.items() for x in kv))
    return vertices.withColumn("colour", F.coalesce(F.try_element_at(c, F.col("type")), F.lit("white")))


def edge_display(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges with the texts of their rules."""
    said = rules.groupBy(F.col("condition").alias("influence"), "parameter").agg(F.array_join(F.array_sort(F.collect_list(tx.rule_text())), "\n").alias("rules"))
    return edges.join(said, ["influence", "parameter"], "left")


def renamed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("from"), F.col("dst").alias("to"), "rel", "literal_included")


def lookup_embedding(names: DataFrame, emb: DataFrame, dim: int) -> DataFrame:
    """Vectors by name; zeros for unknown names."""
    return names.join(emb, "name", "left").withColumn("vec", F.coalesce("vec", F.array_repeat(F.lit(0.0), dim)))
