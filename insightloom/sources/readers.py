"""Readers of experiment documents, rules, graphs, embeddings and results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx
from ..operators import experiments as ex
from ..operators.storage import materialise

READERS: dict[str, Callable[..., DataFrame]] = {}


def reader(name: str):
    """Registers a document source under a name."""

    def add(f):
        READERS[name] = f
        return f

    return add


def source(spark: SparkSession, name: str, **options) -> DataFrame:
    """Documents of a registered source."""
    if name not in READERS:
        raise ValueError(f"unknown source {name}; there are {sorted(READERS)}")
    return READERS[name](spark, **options)


@reader("json")
def read_json(spark: SparkSession, path: str, strict: bool = True, **filters) -> DataFrame:
    """Nested documents with the fixed schema; ``strict`` fails on bad records."""
    docs = spark.read.schema(schemas.EXPERIMENT).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    return ex.filter_experiments(docs, **filters)


@reader("parquet")
def read_parquet(spark: SparkSession, path: str, **filters) -> DataFrame:
    return ex.filter_experiments(spark.read.parquet(path), **filters)


@reader("orc")
def read_orc(spark: SparkSession, path: str, **filters) -> DataFrame:
    return ex.filter_experiments(spark.read.orc(path), **filters)


@reader("text_json")
def read_text_column(spark: SparkSession, df: DataFrame | None = None, column: str = "json", **filters) -> DataFrame:
    """Documents held as JSON text in a column."""
    docs = df.select(F.from_json(column, schemas.EXPERIMENT, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    return ex.filter_experiments(docs, **filters)


def executed_experiments(docs: DataFrame, rating_how="mean", measurement_how="median") -> DataFrame:
    """One wide row per experiment: parameters, ratings, measurements, material.

    Aggregates given by name are taken within the document, whose values go to a
    table between, in which the names of the columns are found; aggregates of
    one's own go over long tables."""
    base = ["exp_id", "series_id", "printer", "oneoff", "completion", "material_type", "material_producer", "material_color"]
    named = docs.withColumns({"material_type": tx.normalise(F.upper("material.type")), "material_producer": tx.normalise(F.upper("material.producer")), "material_color": tx.normalise("material.color")})
    if callable(rating_how) or callable(measurement_how):
        params = ex.parameters_long(docs).select("exp_id", "key", tx.as_number(F.col("value")).alias("value"))
        long = params.unionByName(ex.ratings_long(docs, rating_how)).unionByName(ex.measurements_long(docs, measurement_how))
        return named.select(*base).join(ex.wide(long), "exp_id", "left")
    rows = materialise(named.select(*base, F.when(F.col("exp_id").isNotNull(), ex.values_of(rating_how, measurement_how)).alias("values_")), "experiments")
    keys = sorted(r["key"] for r in rows.select(F.explode(F.map_keys("values_")).alias("key")).distinct().collect())  # column names of the result
    return rows.select(*base, *(F.try_element_at("values_", F.lit(k)).alias(k) for k in keys))


def read_rule_csv(spark: SparkSession, path: str, categorical: bool | None = None) -> DataFrame:
    """``;``-separated rules; rows without action or parameter are left out;
    ranges are ``[a;b]``, ``<x`` or ``>x``."""
    schema = "cura_condition string, action string, parameter_cura string, action_quantifier string, categorical string, `range` string, `step_size Cura` string"
    raw = spark.read.csv(path, header=True, sep=";", schema=schema, quote='"')
    raw = raw.where("action is not null and trim(action) <> '' and parameter_cura is not null and trim(parameter_cura) <> ''")
    if categorical is not None:
        raw = raw.where(F.coalesce(tx.truth("categorical"), F.lit(False)) == categorical)
    r = tx.parse_range("range")
    return raw.select(
        F.col("cura_condition").alias("condition"), F.lower(F.trim("action")).alias("action"), F.col("parameter_cura").alias("parameter"),
        F.when(F.coalesce(tx.truth("categorical"), F.lit(False)), "string").otherwise("numeric").alias("param_type"),
        r["lo"].alias("range_start"), r["hi"].alias("range_end"), F.col("`step_size Cura`").try_cast("double").alias("step_size"), F.col("action_quantifier").try_cast("double").alias("quantifier"),
    )


def read_rule_text(spark: SparkSession, path: str) -> DataFrame:
    """Rule sentences of either format, one a line."""
    return spark.read.text(path).where("trim(value) <> ''").select(tx.parse_rule("value").alias("r")).select("r.*")


def read_survey(spark: SparkSession, path: str) -> DataFrame:
    """Survey sheet as CSV: the corrected rule where there is one, else the candidate."""
    raw = spark.read.csv(path, header=True, schema="`Rule Candidate` string, `Rule Corrected` string")
    return raw.select(tx.parse_rule(F.coalesce(F.nullif(F.trim("Rule Corrected"), F.lit("")), F.col("Rule Candidate"))).alias("r")).select("r.*")


def read_embedding_tsv(spark: SparkSession, path: str, names_path: str | None = None) -> DataFrame:
    """(vid, vec [, name]): one vector a line, first field its vertex number."""
    rows = spark.read.text(path).select(F.split("value", "\t").alias("x"))
    emb = rows.select(F.element_at("x", 1).cast("long").alias("vid"), F.transform(F.slice("x", F.lit(2), F.size("x") - 1), lambda v: v.cast("double")).alias("vec"))
    if names_path is None:
        return emb
    return emb.join(spark.read.csv(names_path, sep="\t", schema="vid long, name string, type string"), "vid")


def read_graph(spark: SparkSession, path: str, kg_type: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) written by ``writers.write_graph``; the encoding prunes partitions."""
    v, e = spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")
    if kg_type is None:
        return v, e
    return v.where(F.col("kg_type") == kg_type), e.where(F.col("kg_type") == kg_type)
