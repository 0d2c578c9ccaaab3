"""Chat formatting (operator 4): cumulative-snapshot collapse, native.

Logs often hold a conversation several times, each time one turn longer.  Every
turn gets a hash of its place, role and text; a running XOR over the ordered
turns is the rolling hash of each prefix (two independent 64-bit halves).  A
conversation whose full hash is a proper prefix hash of another is a snapshot;
an anti-join drops it.  Both halves and the number of turns must agree; texts
themselves are not compared again.  Of equal conversations the smallest id stays.  Only
then are conversations rendered.

Defined cases: turns are ordered by (turn, role, text), nulls first, and
numbered by that order, so ties and repeated rows count as turns of their own.
A null role renders as ``unknown``, a null text as the empty string; both differ
from their rendered value for the comparison.  Rows with a null conv_id belong
to no conversation and are left out.  Conversations of any length are ordered by
windows that spill; only the rendering holds one as a whole.  Extra columns are dropped; empty tables
give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, n, h1, h2): rolling hash of each turn prefix, with the
    conversation's number of turns; one window partitioning serves all."""
    at = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    sofar = at.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text")
    t = t.withColumn("pos", F.row_number().over(at))
    parts = [F.col("pos"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    return t.select(
        "conv_id", "pos", F.count("*").over(Window.partitionBy("conv_id")).alias("n"),
        F.bit_xor(F.xxhash64(F.lit(1), *parts)).over(sofar).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit("second"), *reversed(parts))).over(sofar).alias("h2"),
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal): one row per maximal conversation."""
    h = prefix_hashes(turns)
    whole = h.where("pos = n").groupBy("n", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_equal"))
    proper = h.where("pos < n").select(F.col("pos").cast("long").alias("n"), "h1", "h2").distinct()
    return whole.join(proper, ["n", "h1", "h2"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), F.col("n_equal").cast("long").alias("n_equal"))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, rendered): turns in order, ``<|role|>`` lines before texts."""
    one = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    ordered = F.array_sort(F.collect_list(one), _by_place)
    said = F.transform(ordered, lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("\n<|end|>")))
    return turns.where(F.col("conv_id").isNotNull()).groupBy("conv_id").agg(F.array_join(said, "\n").alias("rendered"))


def _by_place(a, b):
    def less(x, y, then):
        return (
            F.when(x.isNull() & y.isNotNull(), -1).when(x.isNotNull() & y.isNull(), 1)
            .when(x < y, -1).when(x > y, 1).otherwise(then)
        )

    return less(a["turn"], b["turn"], less(a["role"], b["role"], less(a["text"], b["text"], F.lit(0))))


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal, rendered) of maximal conversations."""
    kept = maximal_conversations(turns)
    return render(turns.join(kept.select("conv_id"), "conv_id", "left_semi")).join(kept, "conv_id").select("conv_id", "n_turns", "n_equal", "rendered")
