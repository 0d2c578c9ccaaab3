"""Named sources of experiment documents.

A source reads JSON documents, one a line, with the whole schema once and keeps
them as a columnar snapshot, records that don't fit set aside with their file
and text.  Later reads go to the snapshot: filters reach its scan as pushed
filters, only the columns asked for are read, and Spark cuts its files into
partitions by size.  A changed source makes another snapshot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from . import snapshots

_BROKEN = "broken_"


@dataclass(frozen=True)
class ExperimentSource:
    """JSON documents under ``path`` by a name; ``root`` holds the snapshots."""

    name: str
    path: str
    root: str

    def _tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        settings = {"source": self.name, "files": snapshots.fingerprint(spark, self.path), "schema": schemas.EXPERIMENT.jsonValue(), "tables": ["records"]}
        records = snapshots.cached(spark, self.root, settings, lambda: {"records": self._build(spark)})["records"]
        # null nearly everywhere: of no use among the filters that reach the scan
        return {"documents": records.where("coalesce(file_, '') = ''").select(*schemas.EXPERIMENT.names), "malformed": records.where("file_ is not null").select(F.col("file_").alias("file"), F.col("text_").alias("text"))}

    def _build(self, spark: SparkSession) -> DataFrame:
        """One table, so that every line is parsed once: documents, or file_ and
        text_ of what is set aside."""
        whole = T.StructType([*schemas.EXPERIMENT.fields, T.StructField(_BROKEN, T.StringType())])
        lines = spark.read.text(self.path).select("value", F.col("_metadata.file_path").alias("file")).where("trim(value) <> ''")
        read = lines.withColumn("d", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}))
        # a document without an id can't be told from another
        fits = F.col("d").isNotNull() & F.col(f"d.{_BROKEN}").isNull() & F.col("d.exp_id").isNotNull()
        kept = read.withColumn("fits", fits)
        return kept.select(*(F.when(F.col("fits"), F.col(f"d.{c}")).alias(c) for c in schemas.EXPERIMENT.names), F.when(~F.col("fits"), F.col("file")).alias("file_"), F.when(~F.col("fits"), F.col("value")).alias("text_"))

    def documents(self, spark: SparkSession, **filters) -> DataFrame:
        return prepare(self._tables(spark)["documents"], **filters)

    def malformed(self, spark: SparkSession) -> DataFrame:
        """(file, text) of the records set aside."""
        return self._tables(spark)["malformed"]

    def series(self, spark: SparkSession, **filters) -> DataFrame:
        """(series_id, exp_id): which experiments a series has."""
        return self.documents(spark, **filters).where("series_id is not null").select("series_id", "exp_id")

    def register(self, spark: SparkSession) -> None:
        """Views <name>, <name>_malformed and <name>_series."""
        self.documents(spark).createOrReplaceTempView(self.name)
        self.malformed(spark).createOrReplaceTempView(f"{self.name}_malformed")
        self.series(spark).createOrReplaceTempView(f"{self.name}_series")


def prepare(docs: DataFrame, completed_only: bool = False, containing_insights_only: bool = False, experiment_series_id: str | None = None, include_oneoffs: bool | str = True, labelable_only: bool = False, limit: int | None = None, material_type: str | None = None, printer: str | None = None) -> DataFrame:
    """The eight filters of a source.  ``include_oneoffs``: True, False or
    "only"; a series is asked for only where oneoffs are left out.  Labelable is
    a document none of whose ratings says that it can't be labelled."""
    if experiment_series_id is not None:
        if include_oneoffs is not False:
            raise ValueError("a series has no oneoffs: leave them out")
        docs = docs.where(F.col("series_id") == experiment_series_id)
    if include_oneoffs is False:
        docs = docs.where(F.col("oneoff").isNull() | ~F.col("oneoff"))
    elif include_oneoffs == "only":
        docs = docs.where(F.col("oneoff"))
    elif include_oneoffs is not True:
        raise ValueError("include_oneoffs is True, False or 'only'")
    if completed_only:
        docs = docs.where(F.col("completion") >= 1.0)
    if containing_insights_only:
        docs = docs.where(F.col("insights").isNotNull())
    if printer is not None:
        docs = docs.where(F.col("printer") == printer)
    if material_type is not None:
        docs = docs.where(F.col("material.type") == material_type)
    if labelable_only:
        docs = docs.where(~F.exists(F.coalesce("ratings", F.array().cast(schemas.EXPERIMENT["ratings"].dataType)), lambda r: F.coalesce(F.try_element_at(r, F.lit("not_labelable")), F.lit(0.0)) > 0))
    return docs if limit is None else docs.limit(limit)


def names(docs: DataFrame) -> DataFrame:
    """(kind, name): the distinct names of ratings, printers, material types,
    producers and colours; materials in small letters without blanks."""
    plain = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("")))
    of = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("name"))
    material = [of(k, plain(F.col(f"material.{c}"))) for k, c in (("material_type", "type"), ("material_producer", "producer"), ("material_color", "color"))]
    one = docs.select(F.explode(F.array(of("printer", F.col("printer")), *material)).alias("x")).select("x.*")
    rated = docs.select(F.explode("ratings").alias("r")).select(F.explode(F.map_keys("r")).alias("name")).where(~F.col("name").isin("user_id", "rating_date", "comment")).select(F.lit("rating").alias("kind"), "name")
    return one.unionByName(rated).where("name is not null").distinct()


SOURCES: dict[str, ExperimentSource] = {}


def add_source(source: ExperimentSource) -> ExperimentSource:
    SOURCES[source.name] = source
    return source


def open_source(name: str) -> ExperimentSource:
    if name not in SOURCES:
        raise ValueError(f"unknown source {name}; there are {sorted(SOURCES)}")
    return SOURCES[name]
