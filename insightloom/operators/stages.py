"""Fitted preparation stages that are saved, loaded and applied to other rows.

What a stage learns is a table: means and deviations, most frequent values,
codes of categories.  Codes are joined on the category, so a column may have
any number of them; numbers of the few columns come as one broadcast row.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UNSEEN = ("null", "error", "new")


@dataclass(frozen=True)
class XySettings:
    """``numbers`` are scaled, ``texts`` encoded, ``target`` split off (and, with
    ``true_threshold``, made 0/1).  ``policy``: remove_row drops rows with a
    missing or infinite number, impute fills in the fitted most frequent value.
    ``unseen``: a category that wasn't fitted is null, an error, or one code
    beyond the fitted ones.  Null categories have the code null."""

    numbers: tuple[str, ...]
    texts: tuple[str, ...] = ()
    target: tuple[str, ...] = ()
    policy: str = "remove_row"
    unseen: str = "null"
    true_threshold: float | None = None

    def __post_init__(self):
        for name in ("numbers", "texts", "target"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
        if self.policy not in ("remove_row", "impute"):
            raise ValueError(f"unknown policy {self.policy}")
        if self.unseen not in UNSEEN:
            raise ValueError(f"unseen is one of {', '.join(UNSEEN)}")


def _finite(c: str):
    x = F.col(c).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


class XyPipeline:
    """numbers: table (column, mode, mean, dev); codes: table (column, category,
    code), categories in order."""

    def __init__(self, settings: XySettings, numbers: DataFrame, codes: DataFrame):
        self.settings, self.numbers, self.codes = settings, numbers, codes

    @classmethod
    def fit(cls, df: DataFrame, settings: XySettings) -> XyPipeline:
        s = settings
        d = df.select(*(_finite(c).alias(c) for c in s.numbers), *(F.col(c).cast("string").alias(c) for c in s.texts))
        if s.policy == "remove_row" and s.numbers:
            d = d.na.drop(subset=list(s.numbers))
        spark = df.sparkSession
        numbers = spark.createDataFrame([], "column string, mode double, mean double, dev double")
        if s.numbers:
            long = d.select(F.expr(f"stack({len(s.numbers)}, {', '.join(f'{chr(39)}{c}{chr(39)}, `{c}`' for c in s.numbers)}) as (column, x)"))
            # values are counted first, so no state holds them
            count = long.where("x is not null").groupBy("column", "x").agg(F.count("*").alias("n"))
            mode = count.groupBy("column").agg(F.max_by("x", F.struct("n", -F.col("x"))).alias("mode"))
            held = long.join(mode, "column").withColumn("x", F.coalesce("x", "mode"))
            numbers = held.groupBy("column").agg(F.first("mode").alias("mode"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("dev"))
        codes = spark.createDataFrame([], "column string, category string, code long")
        if s.texts:
            seen = d.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("category")) for c in s.texts))).alias("x")).select("x.*").where("category is not null").distinct()
            codes = seen.withColumn("code", (F.row_number().over(Window.partitionBy("column").orderBy("category")) - 1).cast("long"))
        return cls(s, numbers, codes)

    def transform(self, df: DataFrame) -> DataFrame:
        """df with its numbers scaled (a constant column is 0), its texts
        encoded and its target made 0/1; other columns unchanged."""
        s = self.settings
        order = df.columns
        if s.numbers:
            stats = self.numbers.groupBy().agg(*(F.max(F.when(F.col("column") == c, F.col(k))).alias(f"{k}_{i}_") for i, c in enumerate(s.numbers) for k in ("mode", "mean", "dev")))
            df = df.withColumns({c: _finite(c) for c in s.numbers}).crossJoin(F.broadcast(stats))  # one row
            if s.policy == "remove_row":
                df = df.where(" and ".join(f"`{c}` is not null" for c in s.numbers))
            filled = {c: F.coalesce(F.col(c), F.col(f"mode_{i}_")) for i, c in enumerate(s.numbers)}
            df = df.withColumns({c: F.when(F.col(f"dev_{i}_") > 0, (filled[c] - F.col(f"mean_{i}_")) / F.col(f"dev_{i}_")).when(filled[c].isNotNull(), 0.0) for i, c in enumerate(s.numbers)}).select(*order)
        for c in s.texts:
            own = self.codes.where(F.col("column") == c).select(F.col("category").alias("category_"), F.col("code").alias("code_"))
            df = df.join(own, F.col(c).cast("string") == F.col("category_"), "left")
            code = F.col("code_")
            if s.unseen != "null":
                size = own.agg(F.count("*").alias("size_"))
                df = df.crossJoin(F.broadcast(size))  # one row
                other = F.col("size_") if s.unseen == "new" else F.raise_error(F.concat(F.lit(f"{c}: category not fitted: "), F.col(c).cast("string"))).cast("long")
                code = F.when(F.col(c).isNotNull(), F.coalesce(code, other))
            df = df.withColumn(c, code).select(*order)
        if s.true_threshold is not None:
            df = df.withColumns({c: F.when(F.col(c) >= s.true_threshold, 1).otherwise(0) for c in s.target})
        return df

    def transform_xy(self, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(features, target)"""
        whole = self.transform(df)
        return whole.drop(*self.settings.target), whole.select(*self.settings.target)

    def decode(self, df: DataFrame) -> DataFrame:
        """Codes back to categories; codes that aren't fitted are null."""
        for c in self.settings.texts:
            own = self.codes.where(F.col("column") == c).select(F.col("category").alias("category_"), F.col("code").alias("code_"))
            df = df.join(own, F.col(c) == F.col("code_"), "left").withColumn(c, F.col("category_")).select(*df.columns)
        return df

    def save(self, path: str, mode: str = "error") -> None:
        self.numbers.write.mode(mode).parquet(f"{path}/numbers")
        self.codes.write.mode(mode).parquet(f"{path}/codes")
        spark = self.numbers.sparkSession
        spark.createDataFrame([(json.dumps(asdict(self.settings)),)], "value string").coalesce(1).write.mode(mode).text(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> XyPipeline:
        text = "\n".join(r["value"] for r in spark.read.text(f"{path}/settings").collect())  # one line
        return cls(XySettings(**json.loads(text)), spark.read.parquet(f"{path}/numbers"), spark.read.parquet(f"{path}/codes"))
