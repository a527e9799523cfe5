"""Tables that a stream keeps up to date: each micro-batch is merged into a bounded state table, written as a new version.

Versions are folders named after the batch. A batch that runs again merges into the version before it, so it counts once; older
versions than that one are removed. The table has a row for each key, however many rows have come.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlight.sources.shared import scratch

#: Seconds after a boundary at which a refresh is due, and how long a failed one waits at least, and as a part of its timeframe.
BUFFER, WAIT, PART = 5, 300, 4


def _versions(spark: SparkSession, path: str) -> dict[int, str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(folder):
        return {}
    names = [f.getPath().getName() for f in fs.listStatus(folder)]
    # Only versions that were written to their end count.
    return {int(n[2:]): f"{path}/{n}" for n in names if re.fullmatch(r"v=\d+", n) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))}


def current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last version of a table, empty before there is one."""
    found = _versions(spark, path)
    return spark.read.schema(schema).parquet(found[max(found)]) if found else spark.createDataFrame([], schema)


def merging(path: str, schema: str, part: Callable[[DataFrame], DataFrame], merged: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch. part: what a batch says by key; merged: the table after it, from the table before and a part."""

    def put(batch: DataFrame, n: int) -> None:
        spark, found = batch.sparkSession, _versions(batch.sparkSession, path)
        before = max((k for k in found if k < n), default=None)
        old = spark.createDataFrame([], schema) if before is None else spark.read.schema(schema).parquet(found[before])
        merged(old, part(batch)).write.mode("overwrite").parquet(f"{path}/v={n}")
        for k, folder in found.items():
            if k < n and k != before:
                gone = spark._jvm.org.apache.hadoop.fs.Path(folder)
                gone.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(gone, True)

    return put


def next_refresh(at: Column, seconds: Column, ok: Column) -> Column:
    """When a refresh is due after one at a time: after the timeframe's next boundary, or, if it failed, after a wait of a part of it."""
    return F.when(ok, (F.floor(at / seconds) + 1) * seconds + BUFFER).otherwise(at + F.greatest(F.lit(WAIT), F.floor(seconds / PART))).cast("long")


SCHEDULE = "symbol string, timeframe string, seconds long, last_at long, ok_at long, failures long, next_refresh_at long"
KEY = ["symbol", "timeframe"]


def _outcomes(batch: DataFrame) -> DataFrame:
    """Of each key: the last outcome, the last good one, and how many have failed since."""
    good = batch.where("ok").groupBy(*KEY).agg(F.max("at").alias("ok_at"))
    rows = batch.join(good, KEY, "left")
    failed = F.count(F.when(~F.col("ok") & (F.col("at") > F.coalesce("ok_at", F.lit(-1))), 1))
    return rows.groupBy(*KEY).agg(F.max("seconds").alias("seconds"), F.max("at").alias("last_at"), F.max("ok_at").alias("ok_at"), failed.alias("failures"))


def _scheduled(old: DataFrame, part: DataFrame) -> DataFrame:
    """Failures add up until a refresh succeeds. Outcomes that are older than the table's are taken as they come."""
    both = old.select(*[F.col(c).alias(f"{c}_0" if c not in KEY else c) for c in old.columns]).join(part, KEY, "full_outer")
    failures = F.when(F.col("ok_at").isNotNull(), F.col("failures")).otherwise(F.coalesce("failures_0", F.lit(0)) + F.coalesce("failures", F.lit(0)))
    out = both.select(*KEY, F.coalesce("seconds", "seconds_0").alias("seconds"), F.greatest("last_at", "last_at_0").alias("last_at"), F.greatest("ok_at", "ok_at_0").alias("ok_at"), failures.alias("failures"))
    return out.withColumn("next_refresh_at", next_refresh(F.col("last_at"), F.col("seconds"), F.col("failures") == 0))


def refresh_schedule(outcomes: DataFrame, slices: list) -> DataFrame:
    """The schedule after all outcomes (symbol, timeframe, seconds, at, ok) have come in slices, each drained by a stream's query."""
    return in_slices(outcomes, slices, SCHEDULE, _outcomes, _scheduled)


def in_slices(rows: DataFrame, slices: list, schema: str, part, merged) -> DataFrame:
    """The table that a stream leaves when rows arrive in slices (conditions on them)."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    for condition in slices:
        rows.where(condition).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        stream.writeStream.foreachBatch(merging(f"{path}/table", schema, part, merged)).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return current(spark, f"{path}/table", schema)


def due(schedule: DataFrame, now: int, n: int) -> DataFrame:
    """The first n keys whose refresh is due."""
    return schedule.where(F.col("next_refresh_at") <= now).orderBy("next_refresh_at", *KEY).limit(n)
