"""Relative values of a series over a stream.

A value's predecessor is the one before it in its series, by time and then by
experiment.  Rows come in any order within the watermark: a row that arrives
between two others gives its own relative value and a new one for its
successor, with a higher version.  Series go through the operator in buckets by
hash, so that a call works on many of them at once.  State holds the values that
may still get a new neighbour, those younger than the watermark, and the last
one before it of each series and key; it lies in the stream's checkpoint, so a
restarted query goes on where it stood.  Rows older than the watermark come too late: they are
left out, and counted in the output as version -1.
"""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.storage import shared_folder

OUT = "series_id string, key string, exp_id long, at timestamp, value double, relative double, version long"
STATE = "held binary, version long"

#: Groups of series that are worked on at once; a group's state is one row of
#: the store and should stay at a few MB.
BUCKETS = 512
_PLACE = ["series_id", "key", "us", "exp_id"]


def _step(sign: float):
    def run(_, frames, state: GroupState):
        held, version = (bytes(state.get[0]), state.get[1] + 1) if state.exists else (None, 1)
        mark = state.getCurrentWatermarkMs() * 1000
        part = pd.concat(list(frames), ignore_index=True)
        part["us"] = part["at"].astype("datetime64[us]").astype("int64")
        part = part[[*_PLACE, "value"]].assign(fresh=True)
        late, new = part[part["us"] < mark], part[part["us"] >= mark]
        kept = [pd.read_feather(io.BytesIO(held)).assign(fresh=False)] if held else []
        # told again: the later value holds
        d = pd.concat([*kept, new], ignore_index=True).drop_duplicates(_PLACE, keep="last").sort_values(_PLACE, ignore_index=True)
        follows = (d["series_id"] == d["series_id"].shift()) & (d["key"] == d["key"].shift())
        d["relative"] = sign * (d["value"] - d["value"].shift()).where(follows)
        touched = d["fresh"] | (follows & d["fresh"].shift(fill_value=False))
        # what lies behind the watermark gets no new neighbour, but its last value is one
        settled = (d["us"] < mark) & follows.shift(-1, fill_value=False) & (d["us"].shift(-1, fill_value=mark) < mark)
        blob = io.BytesIO()
        d.loc[~settled, [*_PLACE, "value"]].reset_index(drop=True).to_feather(blob, compression="zstd")
        state.update((blob.getvalue(), version))
        out = pd.concat([d[touched].assign(version=version), late.assign(relative=float("nan"), version=-1)], ignore_index=True)
        out["at"] = out["us"].astype("datetime64[us]")
        yield out[[c.split()[0] for c in OUT.split(", ")]].astype({"exp_id": "int64", "version": "int64", "value": "float64", "relative": "float64"})

    return run


def relative_stream(values: DataFrame, late: str = "1 day", sign: float = -1.0, buckets: int = BUCKETS) -> DataFrame:
    """values(series_id, key, exp_id, at, value), a stream -> relative values:
    the change from the predecessor times ``sign`` (-1: a fall is a gain), null
    for the first.  Rows without series, key, experiment or time are left out."""
    given = values.where("series_id is not null and key is not null and exp_id is not null and at is not null").withWatermark("at", late)
    return given.withColumn("bucket", F.pmod(F.xxhash64("series_id", "key"), F.lit(buckets))).groupBy("bucket").applyInPandasWithState(_step(sign), OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def start_relative(values: DataFrame, folder: str, checkpoint: str, late: str = "1 day", sign: float = -1.0) -> StreamingQuery:
    """Runs to the end of what is there; every batch is a folder of its own,
    replaced where a restart repeats it."""
    return (
        relative_stream(values, late, sign).writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{folder}/batch={n}")).start()
    )


def latest(told: DataFrame) -> DataFrame:
    """The last word on every value."""
    keys = ["series_id", "key", "exp_id", "at"]
    return told.where("version >= 0").groupBy(*keys).agg(F.max_by(F.struct("value", "relative"), "version").alias("x")).select(*keys, "x.*")


def relative_batch(values: DataFrame, sign: float = -1.0) -> DataFrame:
    """The same over a finished table."""
    w = Window.partitionBy("series_id", "key").orderBy("at", "exp_id")
    return values.select("series_id", "key", "exp_id", "at", "value", (sign * (F.col("value") - F.lag("value").over(w))).alias("relative"))


def replay(values: DataFrame, parts: int, seed: int = 0) -> str:
    """Writes a finished table as ``parts`` files dealt by a hash, for a stream
    that reads one file a batch: every batch holds rows of all times."""
    path = shared_folder(values.sparkSession, "replay")
    n = F.pmod(F.xxhash64(F.lit(seed), "exp_id", "key"), F.lit(parts))
    values.withColumn("n_", n).repartition(parts, "n_").drop("n_").write.parquet(path)
    return path
