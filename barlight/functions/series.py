"""Series over the bars of a symbol, as window functions on one partitioning by symbol. A missing value is null; a frame with
one, or a short frame, gives null.

Recursive averages are running sums of values scaled up by their age: a state s = b * s before + a * x is b ** i times the
running sum of a * x / b ** i. So they are windows as the others are, without arrays and without a loop; with at most
MAX_BARS = 500 bars and lengths of 2 or more, b ** -i stays below 1e239. They count bars by column i, from 1."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by():
    return Window.partitionBy("symbol").orderBy("time")


def frame(a: int, b: int):
    return by().rowsBetween(a, b)


def back(x: Column, k: int = 1) -> Column:
    return F.lag(x, k).over(by())


def full(x: Column, n: int, out: Column, ago: int = 0) -> Column:
    return F.when(F.count(x).over(frame(1 - n - ago, -ago)) == n, out)


def sma(x: Column, n: int, ago: int = 0) -> Column:
    return full(x, n, F.avg(x).over(frame(1 - n - ago, -ago)), ago)


def stdev(x: Column, n: int) -> Column:
    return full(x, n, F.stddev_pop(x).over(frame(1 - n, 0)))


def weighted(x: Column, weights: list[float]) -> Column:
    """The weighted mean of the last bars; weights[0] is the current bar's."""
    total = sum((back(x, k) if k else x) * w for k, w in enumerate(weights)) / sum(weights)
    return full(x, len(weights), total)


def wma(x: Column, n: int) -> Column:
    return weighted(x, list(range(n, 0, -1)))


def lwma(x: Column, n: int) -> Column:
    """Weights fall from the oldest bar to the newest."""
    return weighted(x, list(range(1, n + 1)))


def alma_weights(n: int) -> list[float]:
    m, s = 0.85 * (n - 1), n / 6.0
    return [math.exp(-((j - m) ** 2) / (2 * s * s)) for j in range(n)]


def alma(x: Column, n: int) -> Column:
    return weighted(x, alma_weights(n))


def average(x: Column, n: int, kind: str = "sma", volume: Column | None = None) -> Column:
    """An average by name."""
    if kind == "vwma":
        return vwma(x, volume if volume is not None else F.col("volume"), n)
    return {"sma": sma, "ema": ema, "rma": seeded_rma, "lwma": lwma, "wma": wma, "alma": alma}[kind](x, n)


def vwma(x: Column, volume: Column, n: int) -> Column:
    v = F.when(volume > 0, volume).otherwise(0.0)
    total = F.sum(v).over(frame(1 - n, 0))
    return full(x, n, F.when(total > 0, F.sum(x * v).over(frame(1 - n, 0)) / total))


def linreg(x: Column, n: int, offset: int = 0) -> Column:
    f = frame(1 - n, 0)
    i = F.col("i").cast("double")
    return full(x, n, F.regr_intercept(x, i).over(f) + F.regr_slope(x, i).over(f) * (i - offset))


def linreg_of_whole(x: Column, n: int) -> Column:
    """linreg() of whole numbers, from sums of whole numbers: an end that is exactly 0 is 0, whatever the order of its bars."""
    f = frame(1 - n, 0)
    ages = F.col("i") * F.sum(x).over(f) - F.sum(x * F.col("i")).over(f)
    return full(x, n, ((2 * n - 1) * F.sum(x).over(f) - 3 * ages) * 2 / (n * (n + 1)))


def _fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c, rounded once. a has few bits, so that its products with half of b's bits are exact; all have similar magnitudes."""
    p, k = a * b, b * 134217729.0
    upper = k - (k - b)
    rest = (upper * a - p) + (b - upper) * a
    s = p + c
    v = s - p
    return s + ((p - (s - v)) + (c - v) + rest)


def linreg_rounded(x: Column, n: int) -> Column:
    """linreg() of n whole numbers that are all there, with the rest of rounding that DuckDB's regr_intercept + regr_slope * i leaves: running
    means, oldest bar first, products fused with the sum that follows. For lines whose SQL compares them with a value that they meet."""
    i, total = F.col("i").cast("double"), F.sum(x).over(frame(1 - n, 0))
    values = F.array(*[(back(x, k) if k else x).cast("double") for k in range(n - 1, -1, -1)])

    def step(s: Column, y: Column) -> Column:
        j = s["j"] + 1.0
        mean = s["mean"] + (y - s["mean"]) / j
        # Bar j is j / 2 after the mean of the bars before it.
        return F.struct(j.alias("j"), mean.alias("mean"), _fused(j / 2, y - mean, s["moment"]).alias("moment"))

    def end(s: Column) -> Column:
        slope = s["moment"] / n / ((n * (n * n - 1) / 12) / n)
        return _fused(i - (n - 1) / 2, -slope, total / n) + slope * i

    return F.aggregate(values, F.struct(*[F.lit(0.0).alias(k) for k in ("j", "mean", "moment")]), step, end)


def pearson(x: Column, n: int) -> Column:
    """Correlation with the position counted back from the current bar: a rise is negative."""
    f = frame(1 - n, 0)
    return full(x, n, F.when(F.var_pop(x).over(f) > 0, -F.corr(x, F.col("i").cast("double")).over(f)))


def true_range() -> Column:
    before = back(F.col("close"))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def source(name: str) -> Column:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return {"open": o, "high": h, "low": l, "close": c, "hl2": (h + l) / 2, "hlc3": (h + l + c) / 3, "ohlc4": (o + h + l + c) / 4, "hlcc4": (h + l + c + c) / 4}[name]


def crossed_above(a: Column, b: Column) -> Column:
    return (back(a) <= back(b)) & (a > b)


def crossed(a: Column, b: Column, strict: bool = False) -> Column:
    """Whether a crosses b, up or down; strictly, from beyond it and not from on it."""
    if strict:
        return ((back(a) < back(b)) & (a > b)) | ((back(a) > back(b)) & (a < b))
    return crossed_above(a, b) | crossed_above(b, a)


def direction(x: Column, kind: str, eps: float = 1e-9) -> Column:
    now, before = x - back(x), back(x) - back(x, 2)
    return {"rising": now > eps, "falling": now < -eps, "turning_up": (before <= eps) & (now > eps), "turning_down": (before >= -eps) & (now < -eps)}[kind]


# Recursive series.


def running(x: Column) -> Column:
    return F.sum(x).over(by().rowsBetween(Window.unboundedPreceding, 0))


def _since(start: Column | int) -> Column:
    return F.col("i") - (F.lit(start) if isinstance(start, int) else start)


def _power(b: float, k: Column) -> Column:
    return F.pow(F.lit(b), k.cast("double"))


def ema(x: Column, n: int, start: Column | int = 1) -> Column:
    """From bar start on, where it is x itself; null before."""
    a, j = 2.0 / (n + 1), _since(start)
    if n == 1:
        return F.when(j >= 0, x)
    scaled = F.when(j == 0, x).when(j > 0, a * x * _power(1 / (1 - a), j))
    return F.when(j >= 0, _power(1 - a, j) * running(scaled))


def rma(x: Column, n: int, start: Column | int = 1) -> Column:
    """Wilder's average: the running mean for the first n values."""
    a, j = 1.0 / n, _since(start)
    if n == 1:
        return F.when(j >= 0, x)
    scaled = F.when(j < 0, None).when(j < n, x * a).otherwise(a * x * _power(1 / (1 - a), j - n + 1))
    mean = running(F.when(j >= 0, x)) / (j + 1)
    return F.when(j < 0, None).when(j < n, mean).otherwise(_power(1 - a, j - n + 1) * running(scaled))


def seeded_rma(x: Column, n: int) -> Column:
    """Wilder's average that starts with the mean of the first n values, null before."""
    return F.when(F.col("i") >= n, rma(x, n))


def recursive_sum(x: Column, n: int) -> Column:
    """s - s / n + x, from the first value on."""
    if n == 1:
        return x
    j, b = _since(1), 1 - 1.0 / n
    return _power(b, j) * running(x * _power(1 / b, j))


def first_position(x: Column) -> Column:
    """The position of the first bar with a value up to the current one."""
    return F.min(F.when(x.isNotNull(), F.col("i"))).over(by().rowsBetween(Window.unboundedPreceding, 0))


# Folds over a symbol's sorted array of at most MAX_BARS bars, for state machines.


def scan(values: Column, step: Callable[[Column, Column, Column], Column], of: str = "double") -> Column:
    """All states of a fold. step(state before, value, position from 0); the state before the first value is null."""
    return F.aggregate(values, F.array().cast(f"array<{of}>"), lambda out, v: F.concat(out, F.array(step(F.try_element_at(out, F.lit(-1)), v, F.size(out)).cast(of))))


def first_from(values: Column, at: Column, ok: Callable[[Column], Column]) -> Column:
    """The first of an array from a position (counted from 1) on for which ok holds, null without one. Longer and longer stretches are
    tried, as the next only counts where those before have none."""
    first = lambda start, n: F.try_element_at(F.filter(F.slice(values, start, n), ok), F.lit(1))
    return F.coalesce(first(at, F.lit(8)), first(at + 8, F.lit(56)), first(at + 64, F.size(values)))


def arrays(bars: DataFrame, **columns: Column) -> DataFrame:
    """A row for each symbol: the columns as arrays in the order of time. Bars must be bounded by latest() before."""
    names = list(columns)
    packed = F.array_sort(F.collect_list(F.struct("time", *[c.alias(k) for k, c in columns.items()])))
    return bars.groupBy("symbol").agg(packed.alias("bars")).select("symbol", F.col("bars.time").alias("time"), *[F.col(f"bars.{k}").alias(k) for k in names])


def rows(series: DataFrame, *names: str) -> DataFrame:
    """A row for each bar again, of arrays of equal length; i counts from 1."""
    return series.select("symbol", F.posexplode(F.arrays_zip("time", *names)).alias("at", "bar")).select("symbol", (F.col("at") + 1).alias("i"), "bar.*")


# The same in DuckDB SQL.


def fold_sql(name: str, src: str, first: dict[str, str], later: dict[str, str]) -> str:
    """A table name(symbol, i, states): first and later are SQL of the states, of the bar b and the state before, s."""
    return f"""{name} AS (
  SELECT symbol, i, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in first.items())} FROM {src} b WHERE i = 1
  UNION ALL
  SELECT b.symbol, b.i, {', '.join(later[k] for k in first)} FROM {name} s JOIN {src} b ON b.symbol = s.symbol AND b.i = s.i + 1)"""


def ema_sql(name: str, src: str, of: dict[str, tuple[str, int]]) -> str:
    """of: state -> (column of src, length)."""
    later = {k: f"CASE WHEN s.{k} IS NULL THEN b.{x} ELSE {2.0 / (n + 1)!r}::DOUBLE * b.{x} + {1 - 2.0 / (n + 1)!r}::DOUBLE * s.{k} END" for k, (x, n) in of.items()}
    return fold_sql(name, src, {k: f"b.{x}" for k, (x, n) in of.items()}, later)


def rma_sql(name: str, src: str, of: dict[str, tuple[str, int]]) -> str:
    later = {k: f"CASE WHEN b.i <= {n} THEN (s.{k} * (b.i - 1) + b.{x}) / b.i ELSE (s.{k} * {n - 1} + b.{x}) / {n} END" for k, (x, n) in of.items()}
    return fold_sql(name, src, {k: f"b.{x}" for k, (x, n) in of.items()}, later)


W = "PARTITION BY symbol ORDER BY time"


def sma_sql(x: str, n: int, ago: int = 0) -> str:
    f = f"OVER (PARTITION BY symbol ORDER BY i ROWS BETWEEN {n - 1 + ago} PRECEDING AND {f'{ago} PRECEDING' if ago else 'CURRENT ROW'})"
    return f"CASE WHEN count({x}) {f} = {n} THEN avg({x}) {f} END"


def lag_sql(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY i)"
