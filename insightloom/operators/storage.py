"""Tables between steps, and exact samples by hash, without a global sort."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 1 << 12


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, which only a local master
    allows, a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: the executors need a shared folder")
        root = "file://" + tempfile.mkdtemp(prefix="loom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared root."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: a short plan that
    survives the loss of executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _place(df: DataFrame, keys: list, seed: int) -> DataFrame:
    h = F.xxhash64(F.lit(seed), *keys)
    return df.withColumn("hash_", h).withColumn("bucket_", F.pmod("hash_", F.lit(BUCKETS)))


def first_until(df: DataFrame, amount: str, total: float, keys: list, seed: int = 0) -> DataFrame:
    """Rows in seeded hash order until their ``amount`` adds up to ``total``; the
    last may exceed it.  Only sums of a fixed number of buckets come to the
    driver, and only the bucket in which the total is reached is ordered."""
    rows = _place(df, keys, seed)
    have, cut, below = 0.0, BUCKETS, 0.0
    for r in sorted(rows.groupBy("bucket_").agg(F.sum(amount).alias("s")).collect()):
        if have < total <= have + r["s"]:
            cut, below = r["bucket_"], have
        have += r["s"]
    before = F.coalesce(F.sum(amount).over(Window.partitionBy("bucket_").orderBy("hash_", *keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = rows.where(F.col("bucket_") == cut).withColumn("before_", before).where(F.col("before_") + below < total).drop("before_")
    return rows.where(F.col("bucket_") < cut).unionByName(last).drop("hash_", "bucket_")


def quantile(df: DataFrame, column: str, share: float, buckets: int = 4096) -> float | None:
    """The exact, interpolated quantile.  Each pass counts a fixed number of
    buckets and goes on with the one that holds the place looked for, so no task
    ever holds all values."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null")
    n = x.count()
    if not n:
        return None

    def at(place: int) -> float:
        low, high, below = *x.agg(F.min("x"), F.max("x")).first(), 0
        while low < high:
            b = F.least(F.floor((F.col("x") - low) / (high - low) * buckets), F.lit(buckets - 1))
            inside = x.where(F.col("x").between(low, high))
            for r in sorted(inside.groupBy(b.alias("b")).agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()):
                if below + r["c"] > place:
                    low, high = r["lo"], r["hi"]
                    break
                below += r["c"]
        return low

    first = int(share * (n - 1))
    part = share * (n - 1) - first
    return at(first) if not part else at(first) * (1 - part) + at(first + 1) * part


def sample_of(df: DataFrame, n: int, keys: list, seed: int = 0) -> DataFrame:
    """``n`` rows, those that come first in seeded hash order (all, if fewer)."""
    if n <= 0:
        return df.limit(0)
    return first_until(df.withColumn("one_", F.lit(1)), "one_", n, keys, seed).drop("one_")


def quantiles_by(df: DataFrame, by: list[str], column: str, shares: tuple[float, ...], buckets: int = 1024) -> DataFrame:
    """(by, share, quantile): exact, interpolated quantiles of every group.

    Each pass counts, for all groups at once, a fixed number of buckets between
    the values that enclose a place looked for, and goes on with the bucket that
    holds it, until both ends are one value.  The places are a table, like the
    groups; no task holds a group's values, and a pass counts only values inside
    the enclosing ranges.  Null keys are no group, and only finite values count."""
    x = df.select(*by, F.col(column).cast("double").alias("x_")).where(" and ".join(f"`{c}` is not null" for c in by)).where(F.abs("x_") < float("inf"))
    ends = x.groupBy(*by).agg(F.count("*").alias("n_"), F.min("x_").alias("low_"), F.max("x_").alias("high_"))
    wanted = F.array(*(F.struct(F.lit(float(s)).alias("share"), F.lit(k).alias("end")) for s in shares for k in (0, 1)))
    at = F.col("w_.share") * (F.col("n_") - 1)
    places = ends.select(*by, "n_", "low_", "high_", F.explode(wanted).alias("w_"))
    places = places.select(*by, F.col("w_.share").alias("share"), F.col("w_.end").alias("end_"), (at - F.floor(at)).alias("part_"), F.least(F.floor(at) + F.col("w_.end"), F.col("n_") - 1).alias("place_"), "low_", "high_", F.lit(0).cast("long").alias("below_"))
    places = materialise(places, "places")
    while not places.where("low_ < high_").isEmpty():
        open_ = places.where("low_ < high_").select(*by, "place_", "low_", "high_", "below_").distinct()
        inside = x.join(open_, by).where(F.col("x_").between(F.col("low_"), F.col("high_")))
        # halves keep the difference of any two doubles finite
        width = F.col("high_") / 2 - F.col("low_") / 2
        even = F.least(F.floor((F.col("x_") / 2 - F.col("low_") / 2) / F.when(width > 0, width) * buckets), F.lit(buckets - 1))
        bucket = F.coalesce(even, F.when(F.col("x_") > F.col("low_"), F.lit(buckets - 1)).otherwise(0))
        count = inside.groupBy(*by, "place_", bucket.alias("b_")).agg(F.count("*").alias("c_"), F.min("x_").alias("lo_"), F.max("x_").alias("hi_"), F.first("below_").alias("below_"))
        upto = F.sum("c_").over(Window.partitionBy(*by, "place_").orderBy("b_")) + F.col("below_")
        found = count.withColumn("upto_", upto).where((F.col("upto_") > F.col("place_")) & (F.col("upto_") - F.col("c_") <= F.col("place_"))).select(*by, "place_", "lo_", "hi_", (F.col("upto_") - F.col("c_")).alias("new_"))
        joined = places.join(found, [*by, "place_"], "left")
        places = materialise(joined.select(*by, "share", "end_", "part_", "place_", F.coalesce("lo_", "low_").alias("low_"), F.coalesce("hi_", "high_").alias("high_"), F.coalesce("new_", "below_").alias("below_")), "places")
    low, high = F.max(F.when(F.col("end_") == 0, F.col("low_"))), F.max(F.when(F.col("end_") == 1, F.col("low_")))
    return places.groupBy(*by, "share").agg((low + (high - low) * F.first("part_")).alias("quantile"))
