"""Filters on structure: how often price respected a channel, whether it swept liquidity, whether its trend is dead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.functions import series as S
from barlight.functions.candles import touch
from barlight.operators import channels, states

SPAN = 5


#: Lines of a channel by what a request asks for; anything else means the middle one.
LINES = {"upper": ["upper"], "lower": ["lower"], "both": ["upper", "lower"], "upper_middle": ["upper", "middle"], "lower_middle": ["lower", "middle"], "all": ["upper", "middle", "lower"]}


def lines_of(name: str) -> list[str]:
    return LINES.get(str(name or "").strip().lower(), ["middle"])


def respects(bars: DataFrame, line: str | list[str], tolerance: float = 1.0, gap: int = 3, name: str = "respects", touch_type: str = "wick") -> DataFrame:
    """A row for each symbol: how many distinct times its bars touched the line, or each of several lines, added up. The first touch
    counts, and later ones more than gap bars after the last touch, if a bar in between stood clear of the line; where a line is null
    it is not touched. One fold over a symbol's bars for each line, side by side in one aggregation."""
    lines = [line] if isinstance(line, str) else list(line)
    marks = {}
    for k, column in enumerate(lines):
        x = F.col(column)
        near = F.abs(x) * abs(tolerance) / 100
        hit = F.coalesce(touch(x - near, x + near, touch_type), F.lit(False))
        clear = F.greatest(near * 2, F.abs(x) * 0.001, F.lit(1e-6))
        away = F.coalesce(~hit & ((F.abs(F.col("close") - x) >= clear) | (F.abs(F.col("open") - x) >= clear) | (F.abs((F.col("high") + F.col("low")) / 2 - x) >= clear)), F.lit(False))
        marks[f"m{k}"] = F.struct(hit.alias("hit"), away.alias("away"))
    a = S.arrays(bars, **marks)
    start = F.struct(F.lit(-1).alias("last"), F.lit(False).alias("apart"), F.lit(0).alias("n"), F.lit(0).alias("i"))

    def step(s, v):
        new = v["hit"] & ((s["last"] < 0) | ((s["i"] - s["last"] > gap) & s["apart"]))
        last = F.when(v["hit"], s["i"]).otherwise(s["last"])
        apart = F.when(v["hit"], F.lit(False)).otherwise(s["apart"] | ((s["last"] >= 0) & v["away"]))
        return F.struct(last.alias("last"), apart.alias("apart"), F.when(new, s["n"] + 1).otherwise(s["n"]).alias("n"), (s["i"] + 1).alias("i"))

    return a.select("symbol", sum(F.aggregate(k, start, step)["n"] for k in marks).cast("long").alias(name))


def liquidity_sweep() -> Column:
    h, l, c = F.col("high"), F.col("low"), F.col("close")
    return F.coalesce(((l < S.back(l)) & (c > S.back(l))) | ((h > S.back(h)) & (c < S.back(h))), F.lit(False))


#: The line of a dead trend by name: the length of an EMA, or none for the least-squares line.
TREND_LINES = {"ema_50": 50, "ema_100": 100, "ema_200": 200, "linear_regression": None}
RECOVERIES = ["disabled", "wick_above_swing_high", "close_above_swing_high", "two_closes_above_swing_high"]


def _runs(swings: Column) -> Column:
    """Of swings (price, recent) in order: run, how many at the end are each below the one before; higher, whether a recent one is
    above the one before; last, the last price."""
    start = F.struct(F.lit(None).cast("double").alias("last"), F.lit(0).alias("run"), F.lit(False).alias("higher"))

    def step(s: Column, v: Column) -> Column:
        lower, higher = F.coalesce(v["price"] < s["last"], F.lit(False)), F.coalesce(v["price"] > s["last"], F.lit(False))
        return F.struct(v["price"].alias("last"), F.when(lower, s["run"] + 1).otherwise(0).alias("run"), (s["higher"] | higher & v["recent"]).alias("higher"))

    return F.aggregate(swings, start, step)


def dead(bars: DataFrame, lookback: int = 200, runs: int = 3, bounce: float = 20.0, window: int = 20, trend: int | str = 200) -> DataFrame:
    """A row for each symbol: the first kind of dead trend that its bars show (strong, slow, failed, flat, or none), and whether the
    last bar recovers it, by each of RECOVERIES (recovered is that by its close). trend: the length of the EMA that prices are held
    against, or a name of TREND_LINES. Symbols of fewer than 12 bars have none. One aggregation of one bar table: swings, runs and
    bounces are found in its array of at most MAX_BARS bars."""
    length = trend if isinstance(trend, int) else TREND_LINES[trend]
    high, low = states.pivots(SPAN)
    b = bars.withColumns({"_tr": S.true_range(), "_ph": high, "_pl": low})
    line = channels.regression_of(b, F.lit(True), p="_line").withColumn("line", F.col("_line_middle")) if length is None else b.withColumn("line", S.ema(F.col("close"), length))
    b = line.withColumn("atr", states.backfilled_atr(F.col("_tr"), 14))
    recent = F.col("back") <= lookback
    mean = lambda x, a, z: F.avg(F.when(F.col("back").between(a, z), F.col(x)))
    at = lambda x, k: F.max(F.when(F.col("back") == k, F.col(x)))
    bar = F.struct("i", "high", "low", F.col("_pl").alias("swing"), F.col("_ph").alias("top"), recent.alias("recent"))
    s = b.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n"), at("line", 1).alias("end"), F.min_by("line", F.when(F.col("back") <= lookback + 1, F.col("i"))).alias("start"), at("close", 1).alias("close"), at("close", 2).alias("close_before"), at("high", 1).alias("last_high"),
        F.avg(F.when(recent, (F.col("close") < F.col("line")).cast("double"))).alias("below"), F.array_sort(F.collect_list(bar)).alias("bars"),
        *[mean(x, a, z).alias(f"{x}_{k}") for x in ("volume", "atr") for k, a, z in (("now", 1, 20), ("long", 1, 100), ("prior", 21, 40))],
    )
    t = F.col("bars")
    swings = lambda flag, price: F.transform(F.filter(t, lambda z: z[flag]), lambda z: F.struct(z[price].alias("price"), z["recent"].alias("recent")))

    def bounced(low_bar: Column) -> Column:
        later = S.first_from(t, low_bar["i"] + 1, lambda z: z["high"] >= low_bar["low"] * (1 + bounce / 100))
        return F.struct(low_bar["low"].alias("p"), later["i"].alias("u"))

    # Each swing low with the first bar that bounced off it; then whether a bar soon after is below the low.
    bounces = F.filter(F.transform(F.filter(t, lambda z: z["swing"] & (z["low"] > 0)), bounced), lambda q: q["u"].isNotNull())
    s = s.withColumns({"bounces": bounces, "tops": _runs(swings("top", "high")), "lows": _runs(swings("swing", "low"))})
    failed = F.exists("bounces", lambda q: F.exists(F.slice(t, q["u"], window + 1), lambda z: z["low"] < q["p"]))
    down = F.col("end") < F.col("start")
    no = lambda c: F.coalesce(c, F.lit(False))
    slow = down & ~F.col("tops.higher") & (F.col("below") >= 0.8)
    strong = slow & (F.col("tops.run") >= runs) & (F.col("lows.run") >= runs)
    weak = no((F.col("volume_long") > 0) & (F.col("volume_now") < 0.5 * F.col("volume_long"))) | no((F.col("volume_prior") > 0) & (F.col("volume_now") <= 0.7 * F.col("volume_prior")))
    still = no((F.col("atr_long") > 0) & (F.col("atr_now") < 0.5 * F.col("atr_long")))
    enough = F.col("n") >= 12
    kind = F.when(enough & strong, "strong").when(enough & slow, "slow").when(enough & no(failed), "failed").when((F.col("n") >= 25) & weak & still, "flat").otherwise("none")
    top = F.col("tops.last")
    ways = {"disabled": F.lit(False), "wick_above_swing_high": F.col("last_high") > top, "close_above_swing_high": F.col("close") > top, "two_closes_above_swing_high": (F.col("close") > top) & (F.col("close_before") > top)}
    return s.select("symbol", kind.alias("kind"), no(ways["close_above_swing_high"]).alias("recovered"), *[no(c).alias(k) for k, c in ways.items() if k != "disabled"])
