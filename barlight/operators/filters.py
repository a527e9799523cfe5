"""Filters whose length differs by bar, and the regression channel over calendar intervals.

A frame can't differ by row, but its sum is a difference of two running sums: a symbol's running sums (at most MAX_BARS of them)
come to each of its bars as one array, which is read at the bar's own offset. Averages with a memory are running sums too,
scaled by the product of what each bar forgets; where a bar forgets all (a length of 1), the sum starts anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.functions import series as S

KINDS = ["sma", "lwma", "vwma", "alma", "ema", "rma"]


def _sums(b: DataFrame, terms: dict[str, Column]) -> DataFrame:
    """b with an array for each term: its sums over the first 0, 1, 2, .. bars of the symbol."""
    running = S.by().rowsBetween(Window.unboundedPreceding, 0)
    whole = S.by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    b = b.withColumns({f"_{k}_sum": F.sum(x).over(running) for k, x in terms.items()})
    b = b.withColumns({f"_{k}_sums": F.collect_list(f"_{k}_sum").over(whole) for k in terms})
    return b


def _of_last(k: str, n: Column) -> Column:
    """The sum of the last n bars' terms, of those there are."""
    before = F.col("i") - n
    return F.col(f"_{k}_sum") - F.when(before > 0, F.element_at(f"_{k}_sums", F.greatest(before, F.lit(1)).cast("int"))).otherwise(0.0)


def by_period(bars: DataFrame, x: Column, n: Column, kind: str = "sma", name: str = "filtered", volume: Column | None = None) -> DataFrame:
    """bars with a filter of x over the last n bars, n at least 1 and another at each bar; bars before the first count as the current
    one, and so do missing values. sma; lwma: weights fall with age; vwma: by volume; alma: a bell near the newest; ema and rma carry
    on from the bar before with the current bar's length."""
    if kind not in KINDS:
        raise ValueError(f"{kind} is none of {KINDS}")
    kept = bars.columns
    b = bars.withColumns({"_x": x.cast("double"), "_n": F.greatest(n.cast("int"), F.lit(1)), "_v": F.coalesce(volume if volume is not None else F.col("volume"), F.lit(1.0)).cast("double")})
    x, n, v, i = F.col("_x"), F.col("_n"), F.col("_v"), F.col("i")
    missing = F.greatest(n - i, F.lit(0))
    if kind in ("ema", "rma"):
        a = 2.0 / (n + 1.0) if kind == "ema" else 1.0 / n.cast("double")
        running = S.by().rowsBetween(Window.unboundedPreceding, 0)
        b = b.withColumn("_part", F.sum((n == 1).cast("int")).over(running))
        part = Window.partitionBy("symbol", "_part").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
        first = F.row_number().over(Window.partitionBy("symbol", "_part").orderBy("time")) == 1
        b = b.withColumn("_first", first)
        b = b.withColumn("_left", F.sum(F.when(F.col("_first"), 0.0).otherwise(F.log(1.0 - a))).over(part))
        term = F.when(F.col("_first"), x).otherwise(a * x * F.exp(-F.col("_left")))
        out = b.withColumn("_out", F.exp(F.col("_left")) * F.sum(term).over(part))
    elif kind == "alma":
        whole = S.by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        b = b.withColumn("_xs", F.collect_list(x).over(whole))
        weight = lambda k: F.exp(-F.pow(k - 0.85 * (n - 1), F.lit(2.0)) / (2.0 * F.pow(n / 6.0, F.lit(2.0))))

        def add(s: Column, k: Column) -> Column:
            at = i - (n - 1 - k)
            y = F.when(at >= 1, F.element_at("_xs", F.greatest(at, F.lit(1)).cast("int"))).otherwise(x)
            return F.struct((s["a"] + weight(k) * y).alias("a"), (s["w"] + weight(k)).alias("w"))

        out = b.withColumn("_out", F.aggregate(F.sequence(F.lit(0), n - 1), F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("w")), add, lambda s: s["a"] / s["w"]))
    elif kind == "lwma":
        b = _sums(b, {"x": x, "jx": i * x})
        total = (n - i) * _of_last("x", n) + _of_last("jx", n) + missing * (missing + 1) / 2 * x
        out = b.withColumn("_out", total / (n * (n + 1) / 2))
    elif kind == "vwma":
        b = _sums(b, {"xv": x * v, "v": v})
        out = b.withColumn("_out", F.try_divide(_of_last("xv", n) + missing * x * v, _of_last("v", n) + missing * v))
    else:
        b = _sums(b, {"x": x})
        out = b.withColumn("_out", (_of_last("x", n) + missing * x) / n)
    return out.select(*kept, F.col("_out").alias(name))


def regression_series(bars: DataFrame, n: Column, width: float = 1.0, kind: str = "sma", index: Column | None = None) -> DataFrame:
    """The filtered regression at every bar, over n bars, another number at each: filtered, deviation (the filtered size of the
    distances from it, times width), correlation, slope and middle. index: the bar's place on the axis, by default counted from 0."""
    kept = bars.columns
    b = bars.withColumns({"_p": F.greatest(n.cast("int"), F.lit(1)), "_at": (index if index is not None else F.col("i") - 1).cast("double")})
    p = F.col("_p")
    b = by_period(b, F.col("close"), p, kind, "filtered").withColumn("_d", F.col("close") - F.col("filtered"))
    b = b.withColumn("_dd", F.col("_d") * F.col("_d"))
    b = by_period(b, F.col("_dd"), p, kind, "_size")
    b = by_period(by_period(b, F.col("_d"), p, "sma", "_mean"), F.col("_dd"), p, "sma", "_square")
    half = F.floor((p + 1) / 2).cast("int")
    whole = S.by().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    b = b.withColumns({"deviation": width * F.sqrt(F.greatest(F.col("_size"), F.lit(0.0))), "_places": F.collect_list("_at").over(whole), "correlation": F.coalesce(F.try_divide("_mean", F.sqrt(F.greatest(F.col("_square"), F.lit(0.0)))), F.lit(0.0))})
    b = b.withColumn("slope", F.when(p == 1, 0.0).otherwise(F.col("correlation") * F.col("deviation") / half))
    mean_at = F.when(F.col("i") - half >= 1, F.element_at("_places", F.greatest(F.col("i") - half, F.lit(1)).cast("int"))).otherwise(0.0)
    return b.withColumn("middle", F.col("filtered") + F.col("slope") * (F.col("_at") - mean_at)).select(*kept, "filtered", "deviation", "correlation", "slope", "middle")


def bar_of_day(bars: DataFrame) -> DataFrame:
    """bars with bar_of_day, counted from 1 within the UTC day."""
    return bars.withColumn("bar_of_day", F.row_number().over(Window.partitionBy("symbol", F.floor(F.col("time") / 86400)).orderBy("time")))


def day_channel(bars: DataFrame, width: float = 1.0, kind: str = "sma", step: int = 1) -> DataFrame:
    """The bars of each symbol's last UTC day with the channel over windows that begin with each day: tracer (the middle at each bar),
    and middle, upper, lower, q1, q3: the line of the last bar's middle and slope, drawn back. With a step, only the first bar of a
    day and every step-th after it count, and bars between carry what the one before them says."""
    b = bar_of_day(bars).withColumn("_day", F.floor(F.col("time") / 86400))
    if step > 1:
        # Bars that count are numbered anew, on the axis of all bars.
        counted = b.where((F.col("bar_of_day") - 1) % step == 0).withColumn("_i", F.col("i") - 1)
        counted = counted.withColumns({"i": F.row_number().over(S.by()), "_n": F.row_number().over(Window.partitionBy("symbol", "_day").orderBy("time"))})
        found = regression_series(counted, F.col("_n"), width, kind, F.col("_i")).select("symbol", "time", "middle", "slope", "deviation")
        b = b.join(found, ["symbol", "time"], "left")
        seen = S.by().rowsBetween(Window.unboundedPreceding, 0)
        b = b.withColumns({k: F.last(k, ignorenulls=True).over(seen) for k in ("middle", "slope", "deviation")})
    else:
        b = regression_series(b, F.col("bar_of_day"), width, kind)
    last = F.max(F.when(F.col("back") == 1, F.struct("middle", "slope", "deviation", "_day"))).over(Window.partitionBy("symbol"))
    b = b.withColumn("_end", last).where(F.col("_day") == F.col("_end._day")).withColumn("tracer", F.col("middle"))
    middle, d = F.col("_end.middle") - F.col("_end.slope") * (F.col("back") - 1), F.col("_end.deviation")
    return b.select("symbol", "time", "back", "tracer", middle.alias("middle"), (middle + d).alias("upper"), (middle - d).alias("lower"), (middle - d / 2).alias("q1"), (middle + d / 2).alias("q3"))
