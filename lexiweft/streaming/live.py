"""Streaming twins: savings by tool as a running aggregate, and change feeds applied by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.stats import savings_by_tool


def savings_stream(calls: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """A running savings_by_tool in memory table `name`; state is one row a tool."""
    return savings_by_tool(calls).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def windowed_calls(calls: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Calls and bytes by tool and window of event time (ts); state older than the watermark is dropped."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "tool").agg(F.count("*").alias("calls"), F.sum("raw_bytes").alias("raw_bytes")).select(F.col("w.start").alias("start"), "tool", "calls", "raw_bytes")


def change_feed(listing: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Give each micro-batch of a listing stream to apply(batch, epoch), which detects and applies the changes."""
    return listing.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
