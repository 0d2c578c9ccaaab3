"""Knowledge-graph aggregation over a stream of insight edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.storage import shared_folder


def edge_totals(edges: DataFrame, time: str | None = None, late: str = "1 hour", window: str | None = None) -> DataFrame:
    """Running (influence, parameter, weight, n), or per event-time window with
    a watermark that bounds the state."""
    keys = ["influence", "parameter"]
    if time and window:
        edges = edges.withWatermark(time, late)
        return edges.groupBy(F.window(time, window), *keys).agg(F.sum("weight").alias("weight"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "weight", "n")
    return edges.groupBy(*keys).agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))


def start(totals: DataFrame, name: str, checkpoint: str | None = None, mode: str = "complete", folder: str | None = None) -> StreamingQuery:
    """Runs to the end of what is there.  With a ``folder`` each batch replaces
    (complete) or adds to (append, update) the Parquet table there; without one
    the totals go to an in-memory table ``name`` in the driver, which is for
    small results.  The state lies under ``checkpoint``, or in the shared folder."""
    w = totals.writeStream.queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or shared_folder(totals.sparkSession, name))
    if folder is None:
        return w.format("memory").start()
    how = "overwrite" if mode == "complete" else "append"
    return w.foreachBatch(lambda df, _: df.write.mode(how).parquet(folder)).start()
