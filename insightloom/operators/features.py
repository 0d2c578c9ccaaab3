"""Preprocessing of wide feature tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import material_label


def numeric_columns(df: DataFrame, *but: str) -> list[str]:
    return [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") and c not in but]


def remove_artifacts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Rows with NULL, NaN or infinite numbers go."""
    for c in cols or numeric_columns(df):
        x = F.col(c).cast("double")
        df = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return df


def missing_policy(df: DataFrame, policy: str, cols: list[str], value=None) -> DataFrame:
    """impute: most frequent value (least on ties); replace: ``value``;
    remove_row; remove_col: columns with a missing value."""
    if policy == "replace":
        return df.na.fill(value, cols)
    if policy == "remove_row":
        return df.na.drop(subset=cols)
    if policy == "remove_col":
        n = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in cols)).first()
        return df.drop(*(c for c in cols if n[c]))
    if policy == "impute":
        modes = df.agg(*(F.mode(c, True).alias(f"{c}__m") for c in cols))
        out = df.crossJoin(F.broadcast(modes))
        return out.select(*(F.coalesce(c, f"{c}__m").alias(c) if c in cols else F.col(c) for c in df.columns))
    raise ValueError(f"unknown policy {policy}")


def split_target(df: DataFrame, target: list[str]) -> tuple[DataFrame, DataFrame]:
    """(features, target); ids and completion belong to neither."""
    return df.drop(*target, "ID", "completion"), df.select(*(c for c in target if c in df.columns))


def concat_material(df: DataFrame, kind: str = "material_type", producer: str = "material_producer", color: str = "material_color", name: str = "material") -> DataFrame:
    return df.withColumn(name, material_label(kind, producer, color)).drop(kind, producer, color)


def binary(df: DataFrame, cols: list[str], least: float) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) >= least, 1).otherwise(0) for c in cols})


def booleans(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("boolean") for c in cols})


def _over_all(df: DataFrame, cols: list[str], stats: dict, expr) -> DataFrame:
    row = df.agg(*(f(F.col(c)).alias(f"{c}__{n}") for c in cols for n, f in stats.items()))
    out = df.crossJoin(F.broadcast(row))  # one row
    return out.select(*(expr(c).alias(c) if c in cols else F.col(c) for c in df.columns))


def standardise(df: DataFrame, cols: list[str]) -> DataFrame:
    """z-scores with the population deviation; constant columns become 0."""
    return _over_all(df, cols, {"m": F.avg, "s": F.stddev_pop}, lambda c: F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}__m"), F.nullif(F.col(f"{c}__s"), F.lit(0.0))), F.lit(0.0))))


def min_max(df: DataFrame, cols: list[str]) -> DataFrame:
    """Scaled to 0..1; constant columns become 0."""
    return _over_all(df, cols, {"lo": F.min, "hi": F.max}, lambda c: F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}__lo"), F.nullif(F.col(f"{c}__hi") - F.col(f"{c}__lo"), F.lit(0.0))), F.lit(0.0))))


class LabelEncoder:
    """Ordinal codes of categories, sorted, as a dictionary table
    (column, category, code)."""

    def __init__(self, table: DataFrame):
        self.table = table

    @classmethod
    def fit(cls, df: DataFrame, cols: list[str]) -> LabelEncoder:
        long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("category")) for c in cols))).alias("x")).select("x.*")
        known = long.where("category is not null").distinct()  # categories only, not rows, meet in the window
        return cls(known.withColumn("code", F.row_number().over(Window.partitionBy("column").orderBy("category")) - 1))

    def transform(self, df: DataFrame, cols: list[str]) -> DataFrame:
        for c in cols:
            code = self.table.where(F.col("column") == c).select(F.col("category").alias(c), F.col("code").alias(f"{c}__code"))
            df = df.withColumn(c, F.col(c).cast("string")).join(code, c, "left").drop(c).withColumnRenamed(f"{c}__code", c)
        return df

    def inverse(self, df: DataFrame, cols: list[str]) -> DataFrame:
        for c in cols:
            code = self.table.where(F.col("column") == c).select(F.col("code").alias(c), F.col("category").alias(f"{c}__cat"))
            df = df.join(code, c, "left").drop(c).withColumnRenamed(f"{c}__cat", c)
        return df

    def code(self, column: str, category: str) -> Column:
        row = self.table.where((F.col("column") == column) & (F.col("category") == category)).first()
        return F.lit(row["code"] if row else None)


def one_hot(df: DataFrame, column: str, categories: list[str] | None = None) -> DataFrame:
    """One 0/1 column per category; the original goes."""
    if categories is None:
        categories = sorted(r[0] for r in df.select(F.col(column).cast("string")).where(F.col(column).isNotNull()).distinct().collect())  # become columns
    return df.select("*", *(F.when(F.col(column).cast("string") == c, 1).otherwise(0).alias(c) for c in categories)).drop(column)


def gram(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Sums of products of all column pairs: one aggregate, a square matrix."""
    k = len(cols)
    row = df.agg(*(F.sum(F.col(a).cast("double") * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if i <= j)).first()
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"{i}_{j}"] or 0.0
    return g


def _vif(g: np.ndarray) -> np.ndarray:
    return np.diag(g) * np.diag(np.linalg.pinv(g))


def vif(df: DataFrame, cols: list[str]) -> list[tuple[str, float]]:
    """Variance inflation factors (uncentred), largest first, two decimals."""
    v = _vif(gram(df, cols))
    return sorted(((c, round(float(x), 2)) for c, x in zip(cols, v, strict=True)), key=lambda x: (-x[1], x[0]))


def remove_multicollinearity(df: DataFrame, cols: list[str], most: float = 5.0) -> DataFrame:
    """Drops the column with the largest factor while it exceeds ``most``; the
    data are read once."""
    g, left = gram(df, cols), list(cols)
    while len(left) > 1:
        v = _vif(g)
        worst = int(v.argmax())
        if v[worst] <= most:
            break
        left.pop(worst)
        g = np.delete(np.delete(g, worst, 0), worst, 1)
    return df.drop(*(c for c in cols if c not in left))


def merge_duplicates(df: DataFrame, cols: list[str], digits: int = 9) -> DataFrame:
    """Columns that equal, scale or shift an earlier one are merged into it; its
    new name lists them: ``x,y(*2.0),z(+5)``."""
    aggs = []
    for i, a in enumerate(cols):
        for j in range(i + 1, len(cols)):
            x, y = F.col(a).cast("double"), F.col(cols[j]).cast("double")
            ratio = F.when((x == 0) & (y == 0), None).when(x == 0, float("inf")).otherwise(F.try_divide(y, x))
            aggs += [F.min(F.round(ratio, digits)).alias(f"rl{i}_{j}"), F.max(F.round(ratio, digits)).alias(f"rh{i}_{j}"), F.min(F.round(y - x, digits)).alias(f"dl{i}_{j}"), F.max(F.round(y - x, digits)).alias(f"dh{i}_{j}")]
    row = df.agg(*aggs).first() if aggs else None
    gone, names = set(), {}
    for i, a in enumerate(cols):
        if i in gone:
            continue
        name = a
        for j in range(i + 1, len(cols)):
            if j in gone:
                continue
            get = lambda k: row[f"{k}{i}_{j}"]  # noqa: B023, E731
            if get("dl") is not None and get("dl") == get("dh") == 0:
                name += f",{cols[j]}"
            elif get("rl") is not None and get("rl") == get("rh") and np.isfinite(get("rl")):
                name += f",{cols[j]}(*{get('rl')})"
            elif get("dl") is not None and get("dl") == get("dh"):
                name += f",{cols[j]}({get('dl'):+g})"
            else:
                continue
            gone.add(j)
        names[a] = name
    return df.select(*(F.col(c).alias(names.get(c, c)) for c in df.columns if c not in {cols[j] for j in gone}))


def previous_to_next(pairs: DataFrame, ratings_wide: DataFrame, params_wide: DataFrame) -> DataFrame:
    """(exp_id, features ARRAY, target ARRAY): ratings of an experiment and the
    parameters of the one that followed."""
    vec = lambda df, key, name: df.select(F.col("exp_id").alias(key), F.array(*(F.col(c).cast("double") for c in sorted(df.columns) if c != "exp_id")).alias(name))
    return pairs.join(vec(ratings_wide, "prev_id", "features"), "prev_id").join(vec(params_wide, "exp_id", "target"), "exp_id").select("prev_id", "exp_id", "features", "target")


def prepare_xy(df: DataFrame, target: list[str], policy: str = "remove_row", true_threshold: float | None = None, scale: bool = True, most_vif: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The whole preparation: missing values, artifacts, one frame for X and Y,
    scaling, encoding, collinearity, binary target."""
    nums = numeric_columns(df, "ID", "completion")
    df = remove_artifacts(missing_policy(df, policy, nums), nums)
    if true_threshold is not None:
        df = binary(df, target, true_threshold)
    x, y = split_target(df, target)
    nums = numeric_columns(x)
    texts = [c for c, t in x.dtypes if t == "string"]
    if scale and nums:
        x = standardise(x, nums)
    if texts:
        x = LabelEncoder.fit(x, texts).transform(x, texts)
    if most_vif is not None and len(nums) > 1:
        x = remove_multicollinearity(x, nums, most_vif)
    return x, y
