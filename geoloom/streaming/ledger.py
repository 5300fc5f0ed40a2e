"""The ledger as a stream: running spend, latest status, counts by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.manifest import spend


def _timed(stream: DataFrame) -> DataFrame:
    """With an event time that watermarks accept, whether or not it came with a time zone."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def running_spend(stream: DataFrame, by: list[str], *, endpoint: str = "layers") -> DataFrame:
    """Calls and cost so far, by group; for output mode complete or update. State: a row per group."""
    counts = (F.col("endpoint") == endpoint) & (F.col("status") == "ok") & ~F.coalesce("cache_hit", F.lit(False))
    calls = stream.groupBy(*by).agg(F.count("*").alias("entries"), F.coalesce(F.sum(counts.cast("int")), F.lit(0)).alias("calls"))
    return calls.withColumns(spend(F.col("calls")))


def latest_status(stream: DataFrame, key: str = "tile_id") -> DataFrame:
    """The latest non-null status of each key; ties to the greater status. State: a row per key."""
    best = F.max(F.when(F.col("status").isNotNull(), F.struct("ts", "status")))
    return stream.groupBy(key).agg(best.alias("last")).select(key, F.col("last.status").alias("status"), F.col("last.ts").alias("ts"))


def counts_by_time(stream: DataFrame, width: str, late: str, by: list[str]) -> DataFrame:
    """Entries per window of event time; windows are final, and their state goes, once the watermark passes them."""
    return _timed(stream).withWatermark("ts", late).groupBy(F.window("ts", width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def once_per_key(stream: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Without repeated entries that come within the allowed lateness."""
    return _timed(stream).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def drain(df: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a streaming query over what is there and return its result table; for small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
