"""From experiments to an encoded graph in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import experiments as ex
from . import fitting, graphs, representations, rules


def rules_of_graph(edges: DataFrame, pairs: DataFrame, bins: DataFrame, n_graphs: DataFrame | int, method: fitting.RuleMethod = fitting.RuleMethod(), threshold: str | None = None) -> DataFrame:
    """Rules for the influences and parameters that the aggregated graph links,
    from the values of all experiments; with a ``threshold`` only for edges that
    reach it."""
    kg = graphs.aggregate(edges, n_graphs)
    kg = graphs.filter_aggregated(kg, threshold) if threshold else kg
    linked = kg.select("influence", "parameter").distinct()
    return fitting.extract(pairs.join(linked, ["influence", "parameter"], "left_semi"), bins, method)


def encode_graph(edges: DataFrame, pairs: DataFrame, bins: DataFrame, n_graphs: DataFrame | int, encoding: str, method: fitting.RuleMethod = fitting.RuleMethod(), threshold: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges): insight graphs -> aggregated graph -> rules ->
    relations -> encoding."""
    return representations.encode(representations.relations_from_rules(rules_of_graph(edges, pairs, bins, n_graphs, method, threshold)), encoding)


def pairs_of_documents(docs: DataFrame, influential_only: bool = True) -> DataFrame:
    """(exp_id, influence, influence_value, parameter, value, relative, kind):
    what each insight edge's ends were worth in its experiment; a parameter's
    relative value is what the user set it to less what it was."""
    inf = ex.influences_long(docs, influential_only).select("exp_id", F.col("key").alias("influence"), F.col("value").alias("influence_value"))
    user, was = F.col("user_value").try_cast("double"), F.col("original_value").try_cast("double")
    par = ex.changed_ui(docs).select("exp_id", F.col("key").alias("parameter"), user.alias("value"), (user - was).alias("relative"))
    return inf.join(par, "exp_id").withColumn("kind", F.lit("numeric"))


def encode_documents(docs: DataFrame, encoding: str, n_bins: int | str = "doane", method: fitting.RuleMethod = fitting.RuleMethod(), threshold: str | None = None, influential_only: bool = True) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of an encoding, from nested experiment documents."""
    edges, pairs = ex.insight_edges(docs, influential_only), pairs_of_documents(docs, influential_only)
    bins = rules.influence_bins(pairs.select("influence", F.col("influence_value").alias("value")), bins=n_bins)
    return encode_graph(edges, pairs, bins, docs.agg(F.count("*").alias("n")), encoding, method, threshold)
