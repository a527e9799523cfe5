"""Rules of screens: what each says of every bar of an instrument.

A rule takes numbered bars and gives them back with its series as new columns, a boolean column for each bar, and the column
that is its evidence. Nothing here shuffles: series are windows on the partitioning by symbol that the bars already have. How
bars add up to the rule's answer is the engine's part (screen.py): any of the last bars, or a run of exactly so many.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.functions import candles as K
from barlight.functions import series as S
from barlight.operators import channels, indicators, states

Found = tuple[DataFrame, Column, Column]


def _named(*settings) -> str:
    """A prefix of columns that is the same for the same settings only; as it ends with a bracket, none begins with another."""
    return "_" + re.sub(r"\W", lambda m: f"${ord(m[0])}$", repr(settings))


def _new(bars: DataFrame, make: Callable[[DataFrame], DataFrame], *settings) -> tuple[DataFrame, str]:
    """make(bars) with the columns that it adds named q_..., and q. Rules with the same settings share them: series are made once."""
    q = _named(*settings)
    if any(c.startswith(f"{q}_") for c in bars.columns):
        return bars, q
    out = make(bars)
    return out.withColumnsRenamed({c: f"{q}_{c}" for c in out.columns if c not in bars.columns}), q


def _chosen(name: str, of: dict[str, Column]) -> Column:
    if name not in of:
        raise ValueError(f"{name} is none of {sorted(of)}")
    return of[name]


def _turned(b: DataFrame, x: str, direction: str | None, p: str) -> tuple[DataFrame, Column]:
    """A column for a direction of x, true where none is asked for."""
    if not direction:
        return b, F.lit(True)
    return b.withColumn(f"{p}_turn", S.direction(F.col(x), direction)), F.col(f"{p}_turn")


def rsi(b: DataFrame, p: str, length=14, location=None, direction=None, tolerance=0.0) -> Found:
    b = indicators.rsi(b, length, f"{p}_x")
    x = F.col(f"{p}_x")
    b, turned = _turned(b, f"{p}_x", direction, p)
    return b, (indicators.rsi_location(x, location, tolerance) if location else x.isNotNull()) & turned, x


def stochrsi(b: DataFrame, p: str, length=14, smooth=3, rule="oversold") -> Found:
    b, q = _new(b, lambda d: indicators.stochastic_rsi(d, length, smooth), "stochrsi", length, smooth)
    k, d = F.col(f"{q}_k"), F.col(f"{q}_d")
    b = b.withColumns({f"{p}_up": S.crossed_above(k, d), f"{p}_down": S.crossed_above(d, k)})
    return b, _chosen(rule, {"oversold": k <= 20, "overbought": k >= 80, "bullish_cross": F.col(f"{p}_up"), "bearish_cross": F.col(f"{p}_down")}), k


def aroon(b: DataFrame, p: str, level="above_50", length=14, direction=None, extreme=70.0, tolerance=0.0) -> Found:
    """A turn counts from beyond the extreme on the other side."""
    b = b.withColumn(f"{p}_x", indicators.aroon(length))
    x = F.col(f"{p}_x")
    hit = indicators.aroon_level(x, level, tolerance)
    if direction:
        b, turned = _turned(b, f"{p}_x", direction, p)
        b = b.withColumn(f"{p}_was", S.back(x))
        was = F.col(f"{p}_was")
        hit = hit & turned & {"turning_up": was <= -extreme, "turning_down": was >= extreme}.get(direction, F.lit(True))
    return b, hit, x


def sma(b: DataFrame, p: str, length=20, rule="above", tolerance=0.0, source="close") -> Found:
    return _price_rule(b.withColumn(f"{p}_x", S.sma(S.source(source), length)), p, rule, tolerance, 0.0)


def ema(b: DataFrame, p: str, length=9, rule="above", tolerance=0.0, source="close") -> Found:
    return _price_rule(b.withColumn(f"{p}_s", S.source(source)).withColumn(f"{p}_x", S.ema(F.col(f"{p}_s"), length)), p, rule, tolerance, 0.2)


def _price_rule(b: DataFrame, p: str, rule: str, tolerance: float, least: float) -> Found:
    """Price against a line, with a tolerance in percent of it; a touch has at least so many percent."""
    x, c = F.col(f"{p}_x"), F.col("close")
    near = lambda t: F.abs(x) * t / 100
    strict = tolerance == 0 and least == 0
    return b, _chosen(rule, {"above": c > x if strict else c >= x - near(tolerance), "below": c < x if strict else c <= x + near(tolerance), "touch": F.abs(c - x) <= near(max(least, tolerance))}), x


def ema_wave(b: DataFrame, p: str, lengths=(5, 25, 50), smooth=4, cutoff=10.0, rule="any_spike") -> Found:
    b, q = _new(b, lambda d: indicators.ema_wave(d, lengths, smooth), "ema_wave", *lengths, smooth)
    wa, wb, wc = (F.col(f"{q}_w{k}") for k in "abc")
    one, two = F.coalesce(F.try_divide(wb, wa) > cutoff, F.lit(False)), F.coalesce(F.try_divide(wc, wb) > cutoff, F.lit(False))
    zero = F.lit(0.0)
    b = b.withColumns({f"{p}_up": S.crossed_above(wa, zero), f"{p}_down": S.crossed_above(zero, wa)})
    return b, _chosen(rule, {"any_spike": one | two, "both_spikes": one & two, "wave_b_spike": one, "wave_c_spike": two, "above": (wa > 0) & (wb > 0) & (wc > 0), "below": (wa < 0) & (wb < 0) & (wc < 0), "crossed_up": F.col(f"{p}_up"), "crossed_down": F.col(f"{p}_down")}), wa


def macd(b: DataFrame, p: str, fast=12, slow=26, signal=9, rule="above_signal", tolerance=0.0, source="close") -> Found:
    b, q = _new(b, lambda d: indicators.macd(d, fast, slow, signal, source), "macd", fast, slow, signal, source)
    m, s = F.col(f"{q}_macd"), F.col(f"{q}_signal")
    b = b.withColumn(f"{p}_near", F.greatest(F.abs(m), F.abs(s)) * tolerance / 100)
    near = F.col(f"{p}_near")
    b = b.withColumns({f"{p}_up": (S.back(m) <= S.back(s) + S.back(near)) & (m > s - near), f"{p}_down": (S.back(m) >= S.back(s) - S.back(near)) & (m < s + near), f"{p}_more": m - s > S.back(m - s), f"{p}_less": m - s < S.back(m - s)})
    rules = {"above_signal": m > s, "below_signal": m < s, "above_zero": m > 0, "below_zero": m < 0, "bullish_cross": F.col(f"{p}_up"), "bearish_cross": F.col(f"{p}_down")}
    return b, _chosen(rule, rules | {"histogram_above_zero": rules["above_signal"], "histogram_below_zero": rules["below_signal"], **{f"histogram_{d}_{w}_zero": F.col(f"{p}_{c}") & (m > s if w == "above" else m < s) for d, c in (("rising", "more"), ("falling", "less")) for w in ("above", "below")}}), m - s


#: Conditions on the wave trend by name, as clauses; a zone without a name is that of the setting, or the condition's own.
WAVE_CONDITIONS = {
    "zone_only": [("zone", None)],
    "oversold_watch": [("zone", None)],
    "overbought_watch": [("zone", None)],
    "cross_any": [("cross", "any")],
    "cross_up": [("cross", "up")],
    "cross_down": [("cross", "down")],
    "oversold_cross_up": [("cross", "up"), ("zone", None, "wt2")],
    "overbought_cross_down": [("cross", "down"), ("zone", None, "wt2")],
    "rising": [("direction", "rising")],
    "falling": [("direction", "falling")],
    "turning_up": [("direction", "turning_up")],
    "turning_down": [("direction", "turning_down")],
    "turning_up_from_oversold": [("direction", "turning_up"), ("zone", None)],
    "turning_down_from_overbought": [("direction", "turning_down"), ("zone", None)],
}
#: A condition in a zone means the one that has the zone in its name.
ZONED = {("oversold", "cross_up"): "oversold_cross_up", ("oversold", "turning_up"): "turning_up_from_oversold", ("overbought", "cross_down"): "overbought_cross_down", ("overbought", "turning_down"): "turning_down_from_overbought"}


def wave_zone(condition: str, zone: str | None, level: int = 2) -> str:
    """The zone that a condition looks at: the one set, or that of its name, at a level (1 is further out), or any."""
    side = next((x for x in ("oversold", "overbought") if x in condition), None)
    return zone or (side + ("_level_1" if level == 1 else "") if side else "any")


def wavetrend(b: DataFrame, p: str, clauses=(("zone", "oversold"),), logic="all", outer=60.0, inner=53.0, channel=10, average=21, signal=4, condition=None, zone=None, level=2, tolerance=0.0) -> Found:
    """Clauses on wt1, wt2 and hist (their difference), joined by all or any: zone: a name and a line, widened by tolerance; direction:
    a name and a line; cross: up, down or any of wt1 over wt2; compare: above or below (wt1 and wt2), above_zero or below_zero, or
    line, sign (<, <=, >, >=, near) and a line or number. condition: a name of WAVE_CONDITIONS instead of clauses, in a zone if one is
    set."""
    b, q = _new(b, lambda d: indicators.wavetrend(d, channel, average, signal).withColumn("hist", F.col("wt1") - F.col("wt2")), "wavetrend", channel, average, signal)
    one, two = F.col(f"{q}_wt1"), F.col(f"{q}_wt2")
    b = b.withColumns({f"{p}_up": S.crossed_above(one, two), f"{p}_down": S.crossed_above(two, one)})
    up, down = F.col(f"{p}_up"), F.col(f"{p}_down")
    made = 0

    def line(name: str) -> Column:
        words = {"green": "wt1", "main": "wt1", "red": "wt2", "signal": "wt2", "histogram": "hist", "area": "hist"}
        return _chosen(words.get(name, name), {k: F.col(f"{q}_{k}") for k in ("wt1", "wt2", "hist")})

    def in_zone(name: str, x: Column) -> Column:
        of = {
            "oversold": x <= -inner + tolerance, "oversold_level_1": x <= -outer + tolerance, "overbought": x >= inner - tolerance, "overbought_level_1": x >= outer - tolerance,
            "neutral": x.between(-inner - tolerance, inner + tolerance), "any": F.lit(True),
        }
        words = {"extreme_oversold": "oversold_level_1", "deep_oversold": "oversold_level_1", "os1": "oversold_level_1", "os2": "oversold", "extreme_overbought": "overbought_level_1", "deep_overbought": "overbought_level_1", "ob1": "overbought_level_1", "ob2": "overbought", "middle": "neutral"}
        return _chosen(words.get(name, name), of)

    def clause(kind: str, *args) -> Column:
        nonlocal b, made
        if kind == "zone":
            return in_zone(args[0], line(args[1] if len(args) > 1 else "wt1"))
        if kind == "cross":
            words = {"bullish": "up", "bearish": "down", "crossed_up": "up", "crossed_down": "down", "both": "any"}
            return _chosen(words.get(args[0], args[0]), {"up": up, "down": down, "any": up | down})
        if kind == "direction":
            made += 1
            b = b.withColumn(f"{p}_d{made}", S.direction(line(args[1] if len(args) > 1 else "wt1"), args[0]))
            return F.col(f"{p}_d{made}")
        if kind == "compare":
            if len(args) == 1:
                return _chosen(args[0], {"above": one > two, "below": one < two, "above_zero": one > 0, "below_zero": one < 0})
            x, y = line(args[0]), line(args[2]) if isinstance(args[2], str) else F.lit(float(args[2]))
            return _chosen(args[1], {"<": x < y + tolerance, "<=": x <= y + tolerance, ">": x > y - tolerance, ">=": x >= y - tolerance, "near": F.abs(x - y) <= tolerance})
        raise ValueError(f"unknown clause: {kind}")

    if condition is not None:
        at = wave_zone(condition, zone, level)
        condition = ZONED.get((at.split("_")[0], condition), condition)
        clauses, logic = _chosen(condition, WAVE_CONDITIONS), "all"
        clauses = [(kind, at, *rest) if kind == "zone" and value is None else (kind, value, *rest) for kind, value, *rest in clauses]
    hit = joined([clause(*c) for c in clauses], logic)
    return b, hit, one


def adx(b: DataFrame, p: str, conditions=("bullish",), length=11, threshold=20.0, distance=1.0, bars=3) -> Found:
    """Conditions on the directional lines, all of which must hold. bullish_started and bearish_started: the line has been ahead for
    bars bars at most; ..._active: for so many at least."""
    b, q = _new(b, lambda d: indicators.trend_strength(d, length), "adx", length)
    up, down, x = F.col(f"{q}_di_plus"), F.col(f"{q}_di_minus"), F.col(f"{q}_adx")
    b = b.withColumns({f"{p}_bull": S.crossed_above(up, down), f"{p}_bear": S.crossed_above(down, up), f"{p}_both": S.crossed_above(x, up) & (x > down) | S.crossed_above(x, down) & (x > up), f"{p}_rise": S.direction(x, "rising"), f"{p}_fall": S.direction(x, "falling")})
    state = indicators.trend_state(up - down)
    run = lambda ahead: F.col("i") - F.coalesce(F.max(F.when(~F.coalesce(ahead, F.lit(False)), F.col("i"))).over(S.by().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    b = b.withColumns({f"{p}_run_up": run(up > down), f"{p}_run_down": run(down > up)})
    long = {k: F.col(f"{p}_run_{k}") for k in ("up", "down")}
    of = {
        **{f"{name}_{what}": ok for name, k in (("bullish", "up"), ("bearish", "down")) for what, ok in (("started", long[k].between(1, bars)), ("active", long[k] >= bars))},
        "adx_near_plus": F.abs(x - up) <= distance, "adx_near_minus": F.abs(x - down) <= distance, "background_bullish": state.isin("up", "rising", "top"), "background_bearish": state.isin("down", "falling", "bottom"),
        "bullish": up > down, "bearish": down > up, "bullish_cross": F.col(f"{p}_bull"), "bearish_cross": F.col(f"{p}_bear"), "strong": x >= threshold, "weak": (x < up) & (x < down), "adx_below_threshold": x < threshold,
        "adx_above_both": (x > up) & (x > down), "adx_crossed_above_both": F.col(f"{p}_both"), "adx_rising": F.col(f"{p}_rise"), "adx_falling": F.col(f"{p}_fall"), "adx_above_plus": x > up, "adx_above_minus": x > down, "adx_below_plus": x < up, "adx_below_minus": x < down,
        **{f"state_{s}": state == s for s in ("top", "rising", "up", "neutral", "down", "falling", "bottom")},
    }
    return b, joined([_chosen(c, of) for c in conditions], "all"), x


#: Names of the correlation lines, their zones, crossings by name, and named trees.
LINE_NAMES = {"red": "r1", "green": "r2", "blue": "r3"}
PAIRS = {f"{x}_{way}_{y}": (LINE_NAMES[x], LINE_NAMES[y], way) for x, y in (("red", "green"), ("red", "blue"), ("green", "blue")) for way in ("below", "above")}
EXACT, EARLY = 0.8, 0.7
PRESETS = {
    "bullish_extreme": ("all", [("zone", "red", "positive_extreme"), ("zone", "green", "positive_extreme"), ("zone", "blue", "positive")]),
    "bearish_extreme": ("all", [("zone", "red", "negative_extreme"), ("zone", "green", "negative_extreme"), ("zone", "blue", "negative")]),
    "extreme_watch": ("any", [("preset", "bullish_extreme"), ("preset", "bearish_extreme")]),
    "bullish_order": ("order", "above"),
    "bearish_order": ("order", "below"),
    "order_watch": ("any", [("order", "above"), ("order", "below")]),
    "legacy_reversal": ("any", [("reversal", at, way) for at in ("exact", "early") for way in ("bullish", "bearish")]),
}


def zone_by_name(x: Column, name: str, slack: float = 0.0) -> Column:
    """Whether a correlation line is in a zone, widened by slack."""
    of = {
        "positive_extreme": x >= EXACT - slack, "positive_early": (x >= EARLY - slack) & (x < EXACT + slack), "positive": x > -slack,
        "negative_extreme": x <= -EXACT + slack, "negative_early": (x > -EXACT - slack) & (x <= -EARLY + slack), "negative": x < slack, "neutral": F.abs(x) <= slack,
    }
    words = {"bullish_exact": "positive_extreme", "downtrend_extreme": "positive_extreme", "bullish_early": "positive_early", "bearish_exact": "negative_extreme", "uptrend_extreme": "negative_extreme", "bearish_early": "negative_early", "above_zero": "positive", "below_zero": "negative", "near_zero": "neutral"}
    return _chosen(words.get(name, name), of)


def vlr(b: DataFrame, p: str, tree=("order", "below"), first=12, step=12, source="close", slack=0.0) -> Found:
    """Correlation lines r1 to r3, also called red, green and blue. tree: a clause (kind, ...), or (all | any | not, [trees]).

    order: below or above (r1, r2, r3); reversal: exact or early, bullish or bearish; compare: line, sign, number or line; zone:
    line, and low and high or a name; direction: line, direction; cross: line, line, above or below; pair: a crossing by name, as
    red_below_green or red_above_both; both: line, above or below (it comes to be beyond both others); crossings: how many pairs of
    lines cross at a bar at least; crossed: names of pairs, how many of them at least, and within how many bars; sequence:
    red_first, green_first, blue_first or sequential, bullish (lines that fall through zero) or bearish (that rise through it), and
    within how many bars: by the first crossing of each line in them. preset: a tree by name. within: a number of bars, and a tree
    that holds at any of them. A sign may be "near", within slack."""
    b, q = _new(b, lambda d: d.withColumn("s", S.source(source)).withColumns({f"r{k}": S.pearson(F.col("s"), first + step * (k - 1)) for k in (1, 2, 3)}), "vlr", first, step, source)
    made = 0

    def line(name: str) -> Column:
        return F.col(f"{q}_{LINE_NAMES.get(name, name)}")

    def stored(c: Column) -> Column:
        """c as a column, as windows can't stand in windows."""
        nonlocal b, made
        made += 1
        b = b.withColumn(f"{p}_c{made}", c)
        return F.col(f"{p}_c{made}")

    def shared(make: Callable[[], Column], *what) -> Column:
        """As stored(), of what rules on the same lines may ask as well."""
        nonlocal b
        name = f"{q}{_named(*what)}"
        if name not in b.columns:
            c = make()
            b = b.withColumn(name, c)
        return F.col(name)

    def within(n: int, c: Column) -> Column:
        return F.max(F.coalesce(stored(c), F.lit(False))).over(S.frame(1 - n, 0))

    def crossed(x: Column, y: Column, way: str) -> Column:
        return S.crossed_above(x, y) if way == "above" else S.crossed_above(y, x)

    def beyond_both(name: str, way: str) -> Column:
        x, *others = line(name), *(line(n) for n in LINE_NAMES.values() if n != LINE_NAMES.get(name, name))
        beyond = stored((x > F.greatest(*others)) if way == "above" else (x < F.least(*others)))
        return F.coalesce(beyond, F.lit(False)) & ~F.coalesce(S.back(beyond), F.lit(True))

    def pair(name: str) -> Column:
        if name.endswith("_both"):
            x, way, _ = name.split("_")
            return shared(lambda: beyond_both(x, way), "both", x, way)
        x, y, way = PAIRS[name] if name in PAIRS else _chosen(name, dict.fromkeys([*PAIRS, "red_below_both", "red_above_both"]))
        return shared(lambda: crossed(line(x), line(y), way), "pair", x, y, way)

    def sequence(which: str, way: str, n: int) -> Column:
        at = []
        for name in LINE_NAMES:
            side = "below" if way == "bullish" else "above"
            cross = shared(lambda name=name: crossed(line(name), F.lit(0.0), side), "zero", name, side)
            at.append(shared(lambda cross=cross: F.min(F.when(cross, F.col("i"))).over(S.frame(1 - n, 0)), "first", name, side, n))
        red, green, blue = at
        first = lambda x, *others: x.isNotNull() & reduce(lambda u, v: u & v, [y.isNull() | (x <= y) for y in others])
        of = {"red_first": first(red, green, blue), "green_first": first(green, red, blue), "blue_first": first(blue, red, green), "sequential": (red <= green) & (green <= blue), "any": F.lit(True)}
        return _chosen(which, of)

    def clause(kind: str, *args) -> Column:
        r = [line(f"r{k}") for k in (1, 2, 3)]
        if kind == "order":
            return (r[0] < r[1] + slack) & (r[1] < r[2] + slack) if args[0] == "below" else (r[0] > r[1] - slack) & (r[1] > r[2] - slack)
        if kind == "reversal":
            at, way = args
            low, high = (EXACT, 1.0) if at == "exact" else (EARLY, EXACT)
            was = S.back(r[0])
            inside = (was >= low) & ((was <= high) if at == "exact" else (was < high))
            mirrored = (was <= -low) & ((was >= -high) if at == "exact" else (was > -high))
            return stored(inside & S.direction(r[0], "turning_down") if way == "bullish" else mirrored & S.direction(r[0], "turning_up"))
        if kind == "compare":
            name, sign, other = args
            x, y = line(name), line(other) if isinstance(other, str) else F.lit(float(other))
            return {"<": x < y + slack, "<=": x <= y + slack, ">": x > y - slack, ">=": x >= y - slack, "near": F.abs(x - y) <= slack}[sign]
        if kind == "zone":
            return zone_by_name(line(args[0]), args[1], slack) if isinstance(args[1], str) else line(args[0]).between(args[1], args[2])
        if kind == "direction":
            return stored(S.direction(line(args[0]), args[1]))
        if kind == "cross":
            return stored(crossed(line(args[0]), line(args[1]), args[2]))
        if kind == "pair":
            return pair(args[0])
        if kind == "both":
            return stored(beyond_both(*args))
        if kind == "crossings":
            pairs = [(r[0], r[1]), (r[0], r[2]), (r[1], r[2])]
            return stored(sum(F.coalesce(S.crossed(x, y), F.lit(False)).cast("int") for x, y in pairs) >= args[0])
        if kind == "crossed":
            names, least, n = args
            return stored(sum(within(n, pair(x)).cast("int") for x in names)) >= least
        if kind == "sequence":
            return sequence(*args)
        if kind == "within":
            return stored(within(args[0], hit(args[1])))
        if kind == "preset":
            return hit(_chosen(args[0], PRESETS))
        raise ValueError(f"unknown clause: {kind}")

    def hit(t) -> Column:
        if t[0] in ("all", "any", "not"):
            return joined([hit(x) for x in t[1]], t[0])
        return clause(*t)

    out = hit(tree)
    return b, out, line("r1")


def bars_of(tree) -> int:
    """How many bars a tree of vlr looks back over."""
    kind, *args = tree
    if kind in ("all", "any", "not"):
        return max([1, *(bars_of(x) for x in args[0])])
    return {"within": lambda: args[0] - 1 + bars_of(args[1]), "crossed": lambda: args[2], "sequence": lambda: args[2]}.get(kind, lambda: 1)()


def volume_spikes(b: DataFrame, p: str, rule="either", length=100, times=1.5, **toggles) -> Found:
    """toggles: extremes, hammers, same_color, session and offset of indicators.volume_spikes."""
    b, q = _new(b, lambda d: indicators.volume_spikes(d, length, times, **toggles), "volume", length, times, *sorted(toggles.items()))
    up, down = F.col(f"{q}_bullish"), F.col(f"{q}_bearish")
    words = {"bull": "bullish", "bear": "bearish", "any": "either", "both": "either"}
    return b, _chosen(words.get(rule, rule), {"bullish": up, "bearish": down, "either": up | down}), F.col("volume")


def relative_volume(b: DataFrame, p: str, rule="between", low=0.0, high=1e9, average=30, window=1, lines=("ma2",)) -> Found:
    """entry: one of the regression lines named crosses above 0; ma4, which can end at exactly 0, by the SQL's rounding."""
    b, q = _new(b, lambda d: indicators.relative_volume(d, average), "relative_volume", average)
    x, v = F.col(f"{q}_rvol"), F.col("volume")
    b = b.withColumns({f"{p}_up": S.crossed_above(x, F.lit(float(low))), f"{p}_down": S.crossed_above(F.lit(float(low)), x), f"{p}_entry": joined([S.crossed_above(F.col(f"{q}_{'end4' if m == 'ma4' else m}"), F.lit(0.0)) for m in lines], "any"), f"{p}_top": x >= F.max(x).over(S.frame(1 - max(window, 2), 0)), f"{p}_alert": S.crossed_above(v, F.lit(2e8)), f"{p}_more": v > S.back(v)})
    return b, _chosen(rule, {"between": x.between(low, high), "above": x >= low, "below": x <= high, "crossed_above": F.col(f"{p}_up"), "crossed_below": F.col(f"{p}_down"), "highest": F.col(f"{p}_top"), "anomaly": v - F.col(f"{q}_ma2") > F.col(f"{q}_sd21"), "entry": F.col(f"{p}_entry"), "volume_alert": F.col(f"{p}_alert"), "increased_volume": F.col(f"{p}_more")}), x


def current_volume(b: DataFrame, p: str, rule="above_average", low=0.0, high=1e18, length=30, average="sma") -> Found:
    """average: the kind of mean that volume is held against, a name of series.average."""
    b = b.withColumn(f"{p}_mean", S.average(F.col("volume"), length, average))
    v, m = F.col("volume"), F.col(f"{p}_mean")
    percent = F.floor(F.try_divide(v * 100, m) + 0.5)
    return b, _chosen(rule, {"value": v.between(low, high), "above_average": v > m, "above_average_percent": percent >= low, "below_average_percent": percent <= high, "between_average_percent": percent.between(low, high)}), percent.cast("double")


def volatility(b: DataFrame, p: str, mode="range_avg", low=None, high=None, tolerance=0.0, length=14, returns=20) -> Found:
    b, q = _new(b, lambda d: indicators.volatility(d, length, returns), "volatility", length, returns)
    b = b.withColumn(f"{p}_daily", F.when(F.col("low") != 0, S.true_range() * 100 / F.abs("low")))
    x = _chosen(mode, {"range_avg": F.col(f"{q}_range_avg"), "returns_std": F.col(f"{q}_realised"), "daily": F.col(f"{p}_daily")})
    return b, (F.lit(True) if low is None else x >= low - tolerance) & (F.lit(True) if high is None else x <= high + tolerance) & x.isNotNull(), x


def volatility_stop(b: DataFrame, p: str, rule="uptrend", length=20, factor=2.0, tolerance=0.0) -> Found:
    """The trailing stop; the only rule with a state machine, a fold over the symbol's bars."""
    kept = [c for c in b.columns if c not in ("symbol", "time", "i")]
    v = states.volatility_stop(b, length, factor, kept).withColumnsRenamed({"stop": f"{p}_stop", "up": f"{p}_upward"})
    up, stop, c = F.col(f"{p}_upward"), F.col(f"{p}_stop"), F.col("close")
    v = v.withColumns({f"{p}_was": S.back(up), f"{p}_rise": S.direction(stop, "rising"), f"{p}_fall": S.direction(stop, "falling"), f"{p}_c_up": S.crossed_above(c, stop), f"{p}_c_down": S.crossed_above(stop, c)})
    was, near = F.col(f"{p}_was"), F.abs(c - stop) <= F.abs(stop) * tolerance / 100
    of = {"uptrend": up, "downtrend": ~up, "turned_up": up & ~was, "turned_down": ~up & was, "reversed": up != was, "price_above": c > stop, "price_below": c < stop, "near_stop": near, "stop_rising": F.col(f"{p}_rise"), "stop_falling": F.col(f"{p}_fall"), "price_crossed_above": F.col(f"{p}_c_up"), "price_crossed_below": F.col(f"{p}_c_down")}
    return v, _chosen(rule, of), stop


def regression_candles(b: DataFrame, p: str, position=None, close=None, length=11, smooth=11) -> Found:
    """The virtual bar of regression ends against its signal line."""
    b, q = _new(b, lambda d: indicators.regression_candles(d, length, smooth), "linreg_candles", length, smooth)
    o, h, l, c, s = (F.col(f"{q}_{x}") for x in ("bo", "bh", "bl", "bc", "signal"))
    on = (l <= s) & (h >= s)
    b = b.withColumns({f"{p}_was_above": S.back(l > s), f"{p}_was_below": S.back(h < s)})
    where = {"above": l > s, "below": h < s, "on": on, "piercing_from_below": F.col(f"{p}_was_below") & on, "piercing_from_above": F.col(f"{p}_was_above") & on, "any_signal": s.isNotNull()}
    ends = {"bullish": c - o > 1e-6, "bearish": o - c > 1e-6, "close_above": c > s, "close_below": c < s, "close_on": F.abs(c - s) <= 1e-6}
    return b, (_chosen(position, where) if position else F.lit(True)) & (_chosen(close, ends) if close else F.lit(True)) & s.isNotNull(), s


#: Bounds of the correlation of a regression channel by preset.
STRENGTHS = {"ignore": (0.0, 1.0), "strong": (0.7, 1.0), "balanced": (0.5, 0.8)}


def regression_channel(b: DataFrame, p: str, lines=(("middle", "touch"),), length=100, width=2.0, strength="ignore", tolerance=0.0, tick=None) -> Found:
    """Actions on lines of the regression channel over the last length bars, any of which may hold."""
    within = b.withColumn(f"{p}_in", F.col("back") <= length)
    made = channels.regression_of(within, F.col(f"{p}_in"), width, p)
    low, high = _chosen(strength, STRENGTHS)
    hits = [channels.action(f"{p}_{line}", kind, tolerance, tick) for line, kind in lines]
    return made, joined(hits, "any") & F.abs(f"{p}_r").between(low, high) & F.col(f"{p}_in"), F.col(f"{p}_r")


def weighted_channel(b: DataFrame, p: str, lines=(("middle", "touch"),), length=200, width=1.0, kind="sma", tolerance=0.0, tick=None) -> Found:
    b, q = _new(b, lambda d: channels.weighted(d, length, width, kind), "regression", length, width, kind)
    return b, joined([channels.action(f"{q}_{line}", do, tolerance, tick) for line, do in lines], "any"), F.col(f"{q}_middle")


def pattern(b: DataFrame, p: str, names=("hammer",)) -> Found:
    found = K.patterns()
    b = b.withColumns({f"{p}_{n}": _chosen(n, found) for n in names})
    return b, joined([F.col(f"{p}_{n}") for n in names], "any"), F.col("close")


def joined(columns: list[Column], logic: str) -> Column:
    """all, any, or not (none of them; a group of none passes)."""
    columns = [F.coalesce(c, F.lit(False)) for c in columns]
    if logic == "all":
        return reduce(lambda x, y: x & y, columns, F.lit(True))
    some = reduce(lambda x, y: x | y, columns, F.lit(False))
    return {"any": some, "not": ~some}[logic]


@dataclass(frozen=True)
class Rule:
    """add: the function above; need: bars that it reads before those it judges; exact: whether a run of just window bars is asked for."""

    add: Callable[..., Found]
    need: Callable[..., int]
    exact: bool = False


def _most(x) -> int:
    return max(int(v) for v in x)


#: Rule by name. Needs are the formulas of the survey's Appendix A, of one judged bar.
RULES = {
    "rsi": Rule(rsi, lambda length=14, **_: length + 2),
    "stochrsi": Rule(stochrsi, lambda length=14, smooth=3, **_: 2 * length + 2 * smooth),
    "aroon": Rule(aroon, lambda length=14, **_: length + 2),
    "sma": Rule(sma, lambda length=20, **_: length),
    "ema": Rule(ema, lambda length=9, **_: max(120, 2 * length)),
    "ema_wave": Rule(ema_wave, lambda lengths=(5, 25, 50), smooth=4, **_: max(120, _most(lengths) + smooth + 1)),
    "macd": Rule(macd, lambda fast=12, slow=26, signal=9, **_: max(5 * max(fast, slow) + signal + 1, 200)),
    "wavetrend": Rule(wavetrend, lambda **_: 120),
    "adx": Rule(adx, lambda **_: 200),
    "vlr": Rule(vlr, lambda first=12, step=12, tree=("order", "below"), **_: first + 2 * step + 2 + bars_of(tree)),
    "volume": Rule(volume_spikes, lambda length=100, **_: length + 2),
    "relative_volume": Rule(relative_volume, lambda average=30, **_: max(60, average + 2)),
    "current_volume": Rule(current_volume, lambda length=30, average="sma", **_: max(120, 2 * length) if average in ("ema", "rma") else length),
    "volatility": Rule(volatility, lambda length=14, returns=20, **_: max(length, returns) + 1),
    "vstop": Rule(volatility_stop, lambda length=20, **_: max(120, 3 * length)),
    "linreg_candles": Rule(regression_candles, lambda length=11, smooth=11, **_: length + smooth, True),
    "lrc": Rule(regression_channel, lambda length=100, **_: length, True),
    "regression": Rule(weighted_channel, lambda length=200, **_: 2 * length - 1, True),
    "pattern": Rule(pattern, lambda **_: 4),
}
