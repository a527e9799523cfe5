"""Channels: lines over the bars of a symbol, and how long actions on them have held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.functions import series as S
from barlight.functions.candles import touch

ACTIONS = ["touch", "close_above", "close_below", "stay_above", "stay_below"]


def regression_of(bars: DataFrame, within: Column, width: float = 2.0, p: str = "") -> DataFrame:
    """regression() over those bars that within is true for; columns named p_... if p is given."""
    q = f"{p}_" if p else ""
    all_bars = Window.partitionBy("symbol")
    x, i = F.when(within, F.col("close")), F.when(within, F.col("i").cast("double"))
    out = bars.withColumns({f"{q}slope": F.regr_slope(x, i).over(all_bars), f"{q}intercept": F.regr_intercept(x, i).over(all_bars), f"{q}_var": F.var_pop(x).over(all_bars), f"{q}r": F.corr(x, i).over(all_bars)})
    slope, r = F.col(f"{q}slope"), F.col(f"{q}r")
    middle = F.col(f"{q}intercept") + slope * F.col("i")
    dev = F.sqrt(F.greatest(F.col(f"{q}_var") * (1 - r * r), F.lit(0.0)) + slope * slope)
    return out.withColumns({f"{q}middle": middle, f"{q}upper": middle + width * dev, f"{q}lower": middle - width * dev}).drop(f"{q}_var")


def regression(bars: DataFrame, width: float = 2.0) -> DataFrame:
    """The least-squares line over all bars given, with bands. The deviation is taken one bar off the line, which adds one
    squared slope to the residuals' variance. Three aggregates of one window, no second pass."""
    return regression_of(bars, F.lit(True), width)


def _of_last(x: Column, n: int, add=F.sum) -> Column:
    """The sum (or count) over the last n bars as the difference of two running ones, which cost the same whatever n is."""
    before = F.coalesce(add(x).over(S.by().rowsBetween(Window.unboundedPreceding, -n)), F.lit(0))
    return add(x).over(S.by().rowsBetween(Window.unboundedPreceding, 0)) - before


def filled(x: Column, n: int, kind: str = "sma", volume: Column | None = None) -> Column:
    """A filter of the last n bars in which bars before the first count as the current one: a plain mean, one weighted by age
    (lwma: the newest most; alma: a bell near the newest) or by volume (vwma); ema and rma have no frame to fill."""
    if kind in ("ema", "rma"):
        return {"ema": S.ema, "rma": S.rma}[kind](x, n)
    if kind == "sma":
        return (_of_last(x, n) + (n - _of_last(x, n, F.count)) * x) / n
    if kind == "vwma":
        v = F.coalesce(volume if volume is not None else F.col("volume"), F.lit(0.0))
        missing = n - _of_last(x, n, F.count)
        return F.coalesce(F.try_divide(_of_last(x * v, n) + missing * x * v, _of_last(v, n) + missing * v), x)
    weights = [n - k for k in range(n)] if kind == "lwma" else S.alma_weights(n)
    return sum(F.coalesce(S.back(x, k) if k else x, x) * w for k, w in enumerate(weights)) / sum(weights)


def weighted(bars: DataFrame, n: int = 200, width: float = 1.0, kind: str = "sma") -> DataFrame:
    """The channel of filtered deviations, of any filter: the line of the last bar's middle and slope, drawn back. The slope is the
    correlation of the deviations with their age, times their filtered size, over half the length."""
    half = (n + 1) // 2
    b = bars.withColumn("_f", filled(F.col("close"), n, kind)).withColumn("_dev", F.col("close") - F.col("_f"))
    square = F.col("_dev") * F.col("_dev")
    b = b.withColumns({"_s1": filled(F.col("_dev"), n), "_s2": filled(square, n), "_sd": width * F.sqrt(F.greatest(filled(square, n, kind), F.lit(0.0)))})
    pull = F.when(F.col("_s2") > 0, F.col("_s1") / F.sqrt(F.when(F.col("_s2") > 0, F.col("_s2"))) * F.col("_sd")).otherwise(0.0)
    end = F.struct((F.col("_f") + pull).alias("m"), (pull / half).alias("s"), F.col("_sd").alias("d"), F.col("i").alias("n"))
    b = b.withColumn("_end", F.max(F.when(F.col("back") == 1, end)).over(Window.partitionBy("symbol")))
    middle, d = F.col("_end.m") - F.col("_end.s") * (F.col("_end.n") - F.col("i")), F.col("_end.d")
    return b.withColumns({"middle": middle, "upper": middle + d, "lower": middle - d, "q1": middle - d / 2, "q3": middle + d / 2}).drop("_f", "_dev", "_s1", "_s2", "_sd", "_end")


#: What rules may ask of a channel's line and zone.
LINE_RULES = ["touched", "closed_above", "closed_below", "on_line", "breach"]
ZONE_RULES = ["entered", "rejected", "breach"]


def zone_overlap(low: Column, high: Column, kind: str = "wick") -> Column:
    """Whether a bar's whole range (wick), its body, or either meets a zone."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    wick, body = (F.col("low") <= high) & (F.col("high") >= low), (bottom <= high) & (top >= low)
    return {"wick": wick, "body": body, "both": wick | body}[kind]


def breach(line: Column, kind: str = "wick", way: str = "any", below: Column | None = None) -> Column:
    """Whether a bar's wick or body is above a line (up), below it (down), or either (any); of a zone, line is its upper end and
    below its lower one."""
    under = line if below is None else below
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    up, down = {"wick": F.col("high") > line, "body": top > line}, {"wick": F.col("low") < under, "body": bottom < under}
    of = lambda x: x["wick"] | x["body"] if kind == "both" else x[kind]
    return {"up": of(up), "down": of(down), "any": of(up) | of(down)}[way]


def _way(side: str | None, breach_direction: str) -> str:
    return breach_direction if breach_direction in ("up", "down") else side or "any"


def zone_rule(low: Column, high: Column, action: str, side: str | None = None, tolerance: float = 0.0, touch_type: str = "wick", breach_type: str | None = None, breach_direction: str = "any") -> Column:
    """entered: the bar meets the zone, widened by tolerance percent of each end. rejected: it does and closes on the inner side, below a
    zone at the top (side up), above one at the bottom (side down). breach: it is beyond the outer end by more than the tolerance."""
    lo, hi = low - F.abs(low) * tolerance / 100, high + F.abs(high) * tolerance / 100
    if action == "breach":
        return breach(hi, breach_type or touch_type, _way(side, breach_direction), lo)
    inner = {"up": F.col("close") < low, "down": F.col("close") > high, None: F.lit(False)}[side]
    return {"entered": zone_overlap(lo, hi, touch_type), "rejected": zone_overlap(lo, hi, touch_type) & inner}[action]


def line_rule(line: Column, action: str, side: str | None = None, tolerance: float = 0.0, touch_type: str = "wick", breach_type: str | None = None, breach_direction: str = "any") -> Column:
    """touched (from below at a top line, from above at a bottom one), closed_above and closed_below by more than the tolerance,
    on_line: the close is within it. breach: wick or body is beyond the line itself."""
    if action == "breach":
        return breach(line, breach_type or touch_type, _way(side, breach_direction))
    lo, hi = line - F.abs(line) * tolerance / 100, line + F.abs(line) * tolerance / 100
    c = F.col("close")
    return {"touched": touch(lo, hi, touch_type, side), "closed_above": c > hi, "closed_below": c < lo, "on_line": c.between(lo, hi)}[action]


def liquidity_elevated(n: int = 20, volume: float = 1.15, spread: float = 1.2) -> Column:
    """Whether a bar has much more volume than the mean of positive ones before it (three at least), or a much wider range."""
    f = S.frame(-n, -1)
    positive = F.when(F.col("volume") > 0, F.col("volume"))
    wide = F.col("high") - F.col("low")
    much = (F.count(positive).over(f) >= 3) & (F.col("volume") >= volume * F.avg(positive).over(f))
    return F.coalesce(much, F.lit(False)) | F.coalesce((F.count(wide).over(f) >= 3) & (wide >= spread * F.avg(wide).over(f)), F.lit(False))


def line_at(x1: Column, y1: Column, x2: Column, y2: Column, x: Column) -> Column:
    """The value at x of the line through two points; of a line without width its first value."""
    return F.when(x2 == x1, y1).otherwise(y1 + (y2 - y1) * (x - x1) / F.nullif(x2 - x1, F.lit(0)))


def mintick(price: Column, crypto: Column, given: float | None = None) -> Column:
    """The tick that lines are rounded to: as given, else by price for stocks, none for coins."""
    if given:
        return F.lit(given)
    return F.when(~crypto, F.when(price < 1, 0.0001).otherwise(0.01))


def line_to_tick(x: Column, tick: float, line: str) -> Column:
    """Upper lines are rounded up, lower lines down, others to the nearest."""
    up, down = F.ceil(F.round(x / tick, 9)) * tick, F.floor(F.round(x / tick, 9)) * tick
    return up if line in ("upper", "top", "q3") else down if line in ("lower", "bottom", "q1") else to_tick(x, tick)


def to_tick(x: Column, tick: float | None) -> Column:
    return F.floor(x / tick + 0.5) * tick if tick else x


def action(line: str, kind: str, tolerance: float = 0.0, tick: float | None = None) -> Column:
    """Whether a bar does what a rule asks of a line, with a tolerance in percent of the line."""
    m = to_tick(F.col(line), tick)
    low, high = m - F.abs(m) * tolerance / 100, m + F.abs(m) * tolerance / 100
    return {"touch": touch(low, high), "close_above": F.col("close") > high, "close_below": F.col("close") < low, "stay_above": F.col("low") > low, "stay_below": F.col("high") < high}[kind]


def age(match: Column) -> Column:
    """Within groupBy("symbol"): for how many bars up to the last one match has held."""
    return (F.coalesce(F.min(F.when(~F.coalesce(match, F.lit(False)), F.col("back"))), F.max("back") + 1) - 1).cast("long")
