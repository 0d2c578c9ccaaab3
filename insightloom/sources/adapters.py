"""Views of the driver's tables in the engine's schemas.

Orders are experiments of a customer's series, line items give parameters,
ratings and insight edges.  ``SQL`` holds the same views as common table
expressions for the SQL counterparts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARAMS = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax", "price": "l_extendedprice"}
QUALITIES = {"returned": "l_returnflag = 'R'", "accepted": "l_returnflag = 'A'", "open_status": "l_linestatus = 'O'"}

SQL = {
    "exps": "exps AS (SELECT o_orderkey AS exp_id, o_custkey AS series_id, o_orderpriority AS printer FROM orders)",
    "params": "params AS (" + " UNION ALL ".join(f"SELECT l_orderkey AS exp_id, '{k}' AS key, avg({c}) AS value FROM lineitem GROUP BY l_orderkey" for k, c in PARAMS.items()) + ")",
    "quality": "quality AS (" + " UNION ALL ".join(f"SELECT l_orderkey AS exp_id, '{k}' AS key, avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS value FROM lineitem GROUP BY l_orderkey" for k, c in QUALITIES.items()) + ")",
    "edges": "edges AS (SELECT l_orderkey AS exp_id, l_returnflag || l_linestatus AS influence, 'qual_influence' AS influence_type, p_brand AS parameter, round(l_discount, 8) AS weight FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "prev": "prev AS (SELECT series_id, exp_id, lag(exp_id) OVER (PARTITION BY series_id ORDER BY exp_id) AS prev_id FROM exps)",
    "triples": "triples AS (SELECT DISTINCT 's' || l_suppkey AS h, p_type AS r, p_brand AS t, CASE WHEN (l_suppkey * 7 + p_partkey) % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "relations": """relations AS (SELECT parameter, quality, avg(d) AS mean, list(struct_pack(lo := lo, hi := hi, value := v) ORDER BY k) AS bins,
        CASE WHEN avg(d) > 0.05 THEN 'increase incrementally' WHEN avg(d) > 0.0499 THEN 'set' ELSE 'decrease incrementally' END AS action
        FROM (SELECT p_brand AS parameter, l_returnflag || l_linestatus AS quality, l_linenumber % 3 AS k, avg(l_discount) AS d, min(l_tax) AS lo, max(l_tax) AS hi, avg(l_discount) AS v
              FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3) GROUP BY parameter, quality)""",
}


def cte(*names: str) -> str:
    """Each view is evaluated once, however often it is named."""
    return "WITH " + ",\n".join(SQL[n].replace(" AS (", " AS MATERIALIZED (", 1) for n in names) + "\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("exp_id"), F.col("o_custkey").alias("series_id"), F.col("o_orderpriority").alias("printer"))


def _wide(spark: SparkSession, sf_dir: str, exprs: dict) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("exp_id")).agg(*(F.avg(F.expr(e)).alias(k) for k, e in exprs.items()))


def _long(spark: SparkSession, sf_dir: str, exprs: dict) -> DataFrame:
    wide = _wide(spark, sf_dir, exprs)
    stack = ", ".join(f"'{k}', `{k}`" for k in exprs)
    return wide.select("exp_id", F.expr(f"stack({len(exprs)}, {stack}) as (key, value)"))


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir, PARAMS)


def _shares() -> dict:
    return {k: f"case when {e} then 1.0D else 0.0D end" for k, e in QUALITIES.items()}


def qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _long(spark, sf_dir, _shares())


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parameters and qualities of an order as one row."""
    return _wide(spark, sf_dir, PARAMS | _shares())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested experiment documents: line items are its raters,
    measurements, influences and changed settings (a few per order)."""
    fields = ("l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("lines"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("lines", F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)))
    none = lambda t: F.lit(None).cast(t)
    value = lambda d=None, b=None, t=None: F.struct((none("double") if d is None else d).alias("d"), (none("boolean") if b is None else b).alias("b"), (none("string") if t is None else t).alias("s"))
    status = F.col("o_orderstatus")
    whole = lambda c: c.cast("int").cast("string")
    infl = F.transform("lines", lambda x: F.create_map(F.concat(F.lit("env_"), x["l_returnflag"]), F.struct(value(x["l_quantity"]).alias("value"), (x["l_linestatus"] == "O").alias("influential"))))
    ui = F.transform("lines", lambda x: F.struct(none("string").alias("label"), whole(x["l_quantity"]).alias("user_value"), F.concat(F.lit("ui_"), x["l_linenumber"].cast("string")).alias("key"), whole(F.round(x["l_discount"] * 100)).alias("original_value"), none("string").alias("extruder"), none("string").alias("category")))
    rated = lambda v: F.struct(v.alias("value"), F.lit(True).alias("influential"))
    last = F.array(F.struct((F.col("o_orderkey") - 1).cast("long").alias("experiment_id"), F.create_map(F.lit("overall"), rated(F.col("o_totalprice")), F.lit("layerSeparation"), rated(F.coalesce(F.get("lines", F.lit(0))["l_tax"], F.lit(0.0)))).alias("items")))
    insights = F.struct(none("string").alias("comment"), none("string").alias("user_id"), F.when(status == "F", 0.25).alias("uncertainty"), infl.alias("influences"), ui.alias("changed_ui_parameters"), last.alias("last_rating_influences"))
    return o.select(
        F.col("o_orderkey").cast("long").alias("exp_id"), F.col("o_custkey").cast("string").alias("series_id"), F.col("o_orderpriority").alias("printer"), none("string").alias("stl_file_id"), (status == "P").alias("oneoff"),
        F.when(status == "O", 0.5).otherwise(1.0).alias("completion"), F.struct(F.lit("light blue").alias("color"), status.alias("type"), F.lit("Some Maker").alias("producer")).alias("material"),
        F.create_map(F.lit("speed"), value(F.col("o_totalprice")), F.lit("fan"), value(b=status == "O")).alias("all_parameters"), F.when(status == "F", F.create_map(F.lit("speed"), value(F.col("o_totalprice") / 2))).alias("changed_parameters"),
        F.transform("lines", lambda x: F.struct((x["l_discount"] * 100).alias("humidity"), (x["l_tax"] * 100).alias("temperature"), none("timestamp").alias("time"))).alias("measurements"),
        F.transform("lines", lambda x: F.create_map(F.lit("blobs"), x["l_quantity"] / 10, F.lit("warping"), x["l_tax"] * 10, F.lit("not_labelable"), (x["l_returnflag"] == "N").cast("double"), F.lit("user_id"), x["l_suppkey"].cast("double"))).alias("ratings"),
        F.when(status != "P", insights).alias("insights"),
    )


def _line_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))


def insight_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_part(spark, sf_dir).select(F.col("l_orderkey").alias("exp_id"), F.concat("l_returnflag", "l_linestatus").alias("influence"), F.lit("qual_influence").alias("influence_type"), F.col("p_brand").alias("parameter"), F.round("l_discount", 8).alias("weight"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = (F.col("l_suppkey") * 7 + F.col("p_partkey")) % 5 == 0
    return _line_part(spark, sf_dir).select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("h"), F.col("p_type").alias("r"), F.col("p_brand").alias("t"), F.when(test, "test").otherwise("train").alias("split")).distinct()


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _line_part(spark, sf_dir).groupBy(F.col("p_brand").alias("parameter"), F.concat("l_returnflag", "l_linestatus").alias("quality"), (F.col("l_linenumber") % 3).alias("k"))
    g = g.agg(F.avg("l_discount").alias("d"), F.min("l_tax").alias("lo"), F.max("l_tax").alias("hi"))
    r = g.groupBy("parameter", "quality").agg(F.avg("d").alias("mean"), F.array_sort(F.collect_list(F.struct("k", "lo", "hi", F.col("d").alias("value")))).alias("b"))
    act = F.when(F.col("mean") > 0.05, "increase incrementally").when(F.col("mean") > 0.0499, "set").otherwise("decrease incrementally")
    return r.select("parameter", "quality", "mean", F.transform("b", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi"), x["value"].alias("value"))).alias("bins"), act.alias("action"))
