"""State machines on a stream: averages and a trailing stop of each symbol, carried from micro-batch to micro-batch in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barlight.sources.shared import scratch

OUT = "symbol string, seen long, late long, time long, ema double, rma double, stop double, up boolean, expired boolean"
#: seen, late; time in microseconds and id of the last tick; ema, rma, mean range, last value; high, low, stop and side of the stop.
STATE = "seen long, late long, time long, id long, ema double, rma double, spread double, last double, hi double, lo double, stop double, up boolean"


def advanced(s: tuple | None, time: int, key: int, x: float, n: int, factor: float) -> tuple:
    """The state after one tick. The stop trails the extreme since the last turn by factor times the mean range, and turns when the
    value is beyond it; ranges are the distances between ticks."""
    if s is None:
        return (1, 0, time, key, x, x, 0.0, x, x, x, x, True)
    seen, late, _, _, ema, rma, spread, last, hi, lo, stop, up = s
    ema, rma, spread = ema + (x - ema) * 2 / (n + 1), rma + (x - rma) / n, spread + (abs(x - last) - spread) / n
    d, hi, lo = factor * spread, max(hi, x), min(lo, x)
    stop = max(stop, hi - d) if up else min(stop, lo + d)
    now = x >= stop
    if now != up:
        hi = lo = x
        stop = x - d if now else x + d
    return (seen + 1, late, time, key, ema, rma, spread, x, hi, lo, stop, now)


def machines(ticks: DataFrame, n: int = 14, factor: float = 2.0, idle: str = "6 hours", wait: str = "1 hour") -> DataFrame:
    """ticks: a stream of symbol, ts (a timestamp), id and value. After each micro-batch a row for each of its symbols: how many ticks
    were seen in order and how many came after later ones (those change nothing), the time of the last in microseconds, EMA, RMA and stop.
    A symbol without ticks for idle gives a last row, expired, and its state goes. A micro-batch's ticks are put in order of time and id;
    what a symbol has in one batch must fit into a task."""
    quiet = int(pd.Timedelta(idle).total_seconds() * 1000)
    rows = ticks.withWatermark("ts", wait).withColumn("micros", F.unix_micros("ts"))

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
        else:
            batch = pd.concat(list(parts)).sort_values(["micros", "id"])
            late = 0
            for time, k, x in zip(batch["micros"].tolist(), batch["id"].tolist(), batch["value"].tolist(), strict=True):
                if s is not None and (time, k) <= (s[2], s[3]):
                    late += 1
                else:
                    s = advanced(s, time, k, x, n, factor)
            s = (s[0], s[1] + late, *s[2:])
            state.update(s)
            state.setTimeoutTimestamp(max(s[2] // 1000, state.getCurrentWatermarkMs()) + quiet)
        yield pd.DataFrame([(key[0], s[0], s[1], s[2], s[4], s[5], s[10], s[11], state.hasTimedOut)], columns=[c.split()[0] for c in OUT.split(", ")])

    return rows.groupBy("symbol").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def in_batches(ticks: DataFrame, slices: list, n: int = 14, factor: float = 2.0, idle: str = "6 hours", wait: str = "1 hour", partitions: int | None = None) -> DataFrame:
    """All rows of machines() when ticks arrive in slices (conditions on ticks): each slice is added to the stream's folder and drained
    by a query that takes up its state where the one before left off. partitions: over how many the state is dealt, which holds for
    the life of a stream; by default the session's number."""
    spark, path = ticks.sparkSession, scratch(ticks.sparkSession)
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, partitions or before)
        for part in slices:
            ticks.where(part).write.mode("append").parquet(f"{path}/in")
            stream = spark.readStream.schema(ticks.schema).parquet(f"{path}/in")
            out = machines(stream, n, factor, idle, wait)
            out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(OUT).parquet(f"{path}/out")
