"""Shapes of single bars and of up to four bars in a row, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlight.functions.series import back, frame

# The pattern families by which a confirmation is judged.
FAMILIES = {
    "bullish": ["bullish_engulfing", "hammer", "inverted_hammer", "morning_star", "piercing_line", "three_white_soldiers", "bullish_marubozu", "strong_breakout_candle", "tweezer_bottom", "bullish_pin_bar", "double_bottom"],
    "bearish": ["bearish_engulfing", "shooting_star", "evening_star", "dark_cloud_cover", "three_black_crows", "bearish_marubozu", "strong_breakdown_candle", "tweezer_top", "bearish_pin_bar", "double_top"],
    "strong_bullish": ["three_white_soldiers", "bullish_marubozu", "strong_breakout_candle"],
    "strong_bearish": ["three_black_crows", "bearish_marubozu", "strong_breakdown_candle"],
}


class Bar:
    """Parts of the bar k bars ago."""

    def __init__(self, k: int = 0):
        self.o, self.h, self.l, self.c = (back(F.col(x), k) if k else F.col(x) for x in ("open", "high", "low", "close"))
        self.body = F.abs(self.c - self.o)
        self.range = F.greatest(self.h - self.l, F.lit(1e-9))
        self.upper = self.h - F.greatest(self.o, self.c)
        self.lower = F.least(self.o, self.c) - self.l
        self.mid = (self.o + self.c) / 2
        self.up, self.down = self.c > self.o, self.c < self.o


def patterns() -> dict[str, Column]:
    """Whether the bars up to the current one form each pattern; false where bars are missing."""
    now, one, two, three = (Bar(k) for k in range(4))
    near = F.col("close") * 0.001
    rose = (three.c < two.c) & (two.c < one.c)
    fell = (three.c > two.c) & (two.c > one.c)
    low_pin = (now.lower >= now.body * 2) & (now.upper <= F.greatest(now.body, now.range * 0.15))
    high_pin = (now.upper >= now.body * 2) & (now.lower <= F.greatest(now.body, now.range * 0.15))
    pause = one.body <= one.range * 0.35
    turn_up, turn_down = one.down & now.up, one.up & now.down
    big, strong = now.body / now.range >= 0.85, now.body / now.range >= 0.7
    out = {
        "bullish_engulfing": turn_up & (now.o <= one.c) & (now.c >= one.o),
        "bearish_engulfing": turn_down & (now.o >= one.c) & (now.c <= one.o),
        "piercing_line": turn_up & (now.o < one.l) & (now.c > one.mid) & (now.c < one.o),
        "dark_cloud_cover": turn_down & (now.o > one.h) & (now.c < one.mid) & (now.c > one.o),
        "tweezer_bottom": (F.abs(now.l - one.l) <= near) & now.up,
        "tweezer_top": (F.abs(now.h - one.h) <= near) & now.down,
        "morning_star": two.down & pause & now.up & (now.c > two.mid),
        "evening_star": two.up & pause & now.down & (now.c < two.mid),
        "three_white_soldiers": two.up & one.up & now.up & (two.c < one.c) & (one.c < now.c),
        "three_black_crows": two.down & one.down & now.down & (two.c > one.c) & (one.c > now.c),
        "double_bottom": (F.abs(two.l - now.l) <= near) & (one.h > F.greatest(two.l, now.l) + near),
        "double_top": (F.abs(two.h - now.h) <= near) & (one.l < F.least(two.h, now.h) - near),
        "doji": now.body <= now.range * 0.1,
        "bullish_pin_bar": low_pin,
        "bearish_pin_bar": high_pin,
        "hammer": low_pin & fell,
        "shooting_star": high_pin & rose,
        "inverted_hammer": high_pin & fell,
        "bullish_marubozu": big & now.up,
        "bearish_marubozu": big & now.down,
        "strong_breakout_candle": strong & now.up & (now.upper <= now.range * 0.15),
        "strong_breakdown_candle": strong & now.down & (now.lower <= now.range * 0.15),
    }
    # A comparison with a missing bar is null, and never decides.
    return {k: F.coalesce(v, F.lit(False)) for k, v in out.items()}


def with_patterns(bars: DataFrame) -> DataFrame:
    return bars.withColumns(patterns())


def matches(kind: str) -> Column:
    """Whether a bar of with_patterns() confirms in the way of a type."""
    now = Bar()
    color = now.up if "bullish" in kind else now.down
    if kind.startswith("strong"):
        color = color & (now.body > now.range * 0.6)
    return reduce(lambda a, b: a | b, (F.col(p) for p in FAMILIES[kind]), color)


def with_confirmation(bars: DataFrame, kind: str, ahead: int, name: str, only: list[str] | None = None) -> DataFrame:
    """bars with a column: whether a bar from the current one to the one ahead bars later confirms in the way of a type, by color or
    by one of its family's patterns (of those, the ones named, if any; names of other families don't count)."""
    allowed = [p for p in FAMILIES[kind] if not only or p in only]
    found = patterns()
    now = Bar()
    color = now.up if "bullish" in kind else now.down
    if kind.startswith("strong"):
        color = color & (now.body > now.range * 0.6)
    match = reduce(lambda a, b: a | b, (found[p] for p in allowed), color)
    return bars.withColumn(f"{name}_m", match).withColumn(name, confirmed(F.col(f"{name}_m"), ahead)).drop(f"{name}_m")


def confirmed(match: Column, ahead: int) -> Column:
    """Whether a bar from the current one to the one ahead bars later matches."""
    return F.max(match).over(frame(0, ahead))


def touch(low: Column, high: Column, kind: str = "wick", way: str | None = None) -> Column:
    """Whether the bar's wick or body meets the band from low to high. A body over the band is no touch of a wick."""
    top, bottom = F.greatest("open", "close"), F.least("open", "close")
    mid = (low + high) / 2
    above, below = top <= mid, bottom >= mid
    upper = (F.col("high") > top) & (top <= high) & (F.col("high") >= low)
    lower = (F.col("low") < bottom) & (F.col("low") <= high) & (bottom >= low)
    body = (bottom <= high) & (top >= low)
    wick = {None: upper | lower, "up": upper & above, "down": lower & below}[way]
    body = {None: body, "up": body & above, "down": body & below}[way]
    return {"wick": wick, "body": body, "both": wick | body}[kind]
