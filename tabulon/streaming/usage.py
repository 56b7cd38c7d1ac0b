"""Usage accounting over an append-only log, as a stream with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.functions.exprs import jround

#: Events later than this are left out of their window.
LATE = "10 minutes"
#: How far behind an event its batch marker may lie.
REACH = "7 days"


def usage_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The log's files as a stream, a bounded number a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(folder)


def windowed_usage(events: DataFrame, every: str = "1 hour", late: str = LATE) -> DataFrame:
    """(event_type, start, calls, tokens) for each window; works on a stream or a table."""
    tokens = F.get_json_object("props", "$.k").try_cast("double")
    g = events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum(tokens).alias("tokens"))
    return g.select("event_type", F.col("window.start").alias("start"), "calls", "tokens")


def own_batches(markers: DataFrame, usage: DataFrame, key: str, reach: str = REACH, late: str = LATE) -> DataFrame:
    """(key, event_id, at, tokens, batch_at): each usage event with the last marker of its key at or before it, no more than ``reach`` earlier.

    markers (key, at) and usage (key, event_id, at, tokens) are streams or
    tables.  As streams they are joined by an interval of event time, so markers
    are kept for ``reach`` and usage for ``late`` beyond the watermark, and an
    event comes out once no marker before it can arrive any more.  Events without
    a marker in reach don't come out; what is later than ``late`` is dropped.
    """
    m = markers.select(F.col(key).alias("marker_key"), F.col("at").alias("mark")).withWatermark("mark", late)
    u = usage.select(key, "event_id", "at", F.col("tokens").cast("double").alias("tokens")).withWatermark("at", late)
    both = u.join(m, F.expr(f"{key} = marker_key AND mark <= at AND mark >= at - INTERVAL {reach}"))
    return both.groupBy(key, "event_id", "at", "tokens").agg(F.max("mark").alias("batch_at"))


def batch_totals(markers: DataFrame, owned: DataFrame, key: str) -> DataFrame:
    """(key, batch_at, events, tokens) of each marker from ``own_batches`` as a table; markers without usage count none."""
    g = owned.groupBy(key, "batch_at").agg(F.count(F.lit(1)).alias("events"), F.sum("tokens").alias("tokens"))
    each = markers.select(key, F.col("at").alias("batch_at")).distinct().join(g, [key, "batch_at"], "left")
    return each.select(key, "batch_at", F.coalesce("events", F.lit(0)).alias("events"), jround(F.coalesce("tokens", F.lit(0.0)), 2).alias("tokens"))
