"""Bars of a stream of trades, by Structured Streaming: late and repeated events up to a watermark, closed bars only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.sources.bars import epoch
from barlight.sources.shared import scratch
from barlight.streaming.schedule import current, merging


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def closed_bars(stream: DataFrame, seconds: int = 3600, late: str = "1 hour") -> DataFrame:
    """A bar of each symbol and window once the watermark has passed its end; an event id counts once."""
    s = stream.withColumn("at", F.timestamp_seconds(epoch(F.col("ts")))).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])
    k = F.struct("ts", "event_id")
    g = s.groupBy(F.window("at", f"{seconds} seconds").alias("w"), F.col("event_type").alias("symbol"))
    out = g.agg(F.min_by("value", k).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", k).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return out.select("symbol", F.unix_seconds("w.start").alias("time"), "open", "high", "low", "close", "volume")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all that is there now, as a table."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession)
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def upserted_bars(stream: DataFrame, seconds: int = 3600) -> DataFrame:
    """Forming bars too: each micro-batch is merged into a table with a row for each bar."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession)
    bar = (F.floor(epoch(F.col("ts")) / seconds) * seconds).cast("long")

    def part(batch: DataFrame) -> DataFrame:
        last = F.struct(F.struct("ts", "event_id").alias("k"), F.col("value").cast("double").alias("value"))
        return batch.groupBy(F.col("event_type").alias("symbol"), bar.alias("time")).agg(F.max(last).alias("last"), F.count(F.lit(1)).alias("volume"))

    def merged(old: DataFrame, new: DataFrame) -> DataFrame:
        return old.unionByName(new).groupBy("symbol", "time").agg(F.max("last").alias("last"), F.sum("volume").alias("volume"))

    types = {f.name: f.dataType.simpleString() for f in stream.schema}
    schema = f"symbol string, time long, last struct<k: struct<ts: {types['ts']}, event_id: {types['event_id']}>, value: double>, volume long"
    stream.writeStream.foreachBatch(merging(f"{path}/bars", schema, part, merged)).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return current(spark, f"{path}/bars", schema).select("symbol", "time", F.col("last.value").alias("close"), "volume")
