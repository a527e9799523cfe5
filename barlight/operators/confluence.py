"""Confluence: whether price meets lines or zones of two channels together on its last bars.

A selection of a channel is an interval at each bar: a line has its value as both ends, a zone has two. A match is a pair of bars,
one at which price meets the second selection and one, the same or up to three before, at which it meets the first, both among
the last four. What holds at a bar, or from it to the last one, is a column of one bar table; the ten pairs there can be are
tried in one array a symbol, latest second bar first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlight.functions import series as S
from barlight.functions.candles import touch
from barlight.operators import channels, postfilters, trend

#: Bars that a match may reach back.
REACH = 4
KINDS = ["bullish", "bearish", "breakout", "any", "role_reversal"]
#: The selections of a channel, and other words for them.
LINES, AREAS = ["upper", "middle", "lower"], ["top_line", "middle_line", "bottom_line", "top_zone", "bottom_zone"]
LINE_WORDS = {"top": "upper", "top_line": "upper", "bottom": "lower", "bottom_line": "lower", "center": "middle", "middle_line": "middle"}
AREA_WORDS = {"top": "top_line", "upper": "top_line", "upper_line": "top_line", "middle": "middle_line", "center": "middle_line", "bottom": "bottom_line", "lower": "bottom_line", "lower_line": "bottom_line"}
#: Bars that a channel's lines are made of where a request doesn't say.
LENGTHS = {"lrc": 100, "regression": 200, "sma": 20, "trend": 8}


def _word(x) -> str:
    return str(x or "").strip().lower()


def kind_of(name) -> str:
    """A kind by its name; unknown ones mean bullish."""
    return _word(name) if _word(name) in KINDS else "bullish"


def default_selection(channel: str, kind: str = "bullish", index: int = 0) -> str:
    """What is looked at of the first or second channel where a request does not say: support for bullish, and for the first channel of
    any and the second of role_reversal; resistance otherwise."""
    kind = kind_of(kind)
    support = kind == "bullish" or (kind == "any" and index == 0) or (kind == "role_reversal" and index == 1)
    names = ("bottom_line", "top_line") if _word(channel) == "trend" else ("lower", "upper")
    return names[0] if support else names[1]


def selection_of(channel: str, selection, kind: str = "bullish", index: int = 0) -> str:
    """A selection by any of its words; unknown ones mean the default."""
    trend = _word(channel) == "trend"
    found = (AREA_WORDS if trend else LINE_WORDS).get(_word(selection), _word(selection))
    return found if found in (AREAS if trend else LINES) else default_selection(channel, kind, index)


def sources_of(sources, kind: str = "bullish", selections=None) -> list[dict]:
    """The two sources of a request, given as names or dicts (name, length, width, span, selection, id), with all settings."""
    out = []
    for k, source in enumerate(sources):
        own = {"name": source} if isinstance(source, str) else dict(source)
        own.setdefault("name", own.get("type", ""))
        chosen = own.get("selection") or (selections[k] if selections else None)
        out.append({"length": LENGTHS.get(own["name"], 0), "width": 2.0, "id": f"{own['name']}_{k}"} | own | {"selection": selection_of(own["name"], chosen, kind, k)})
    return out


def check(sources=("lrc", "regression"), lookback: int = 4, tolerance: float = 0.1, **_) -> None:
    if len(sources) != 2 or any(s["name"] not in LENGTHS for s in sources_of(sources)):
        raise ValueError(f"confluence: two sources of {sorted(LENGTHS)}")
    if not 1 <= lookback <= REACH:
        raise ValueError("confluence: lookback is 1 to 4 bars")
    if tolerance < 0:
        raise ValueError("confluence: tolerance is 0 or more")


def need(sources=("lrc", "regression"), **_) -> int:
    """Bars that the sources' lines need, and those that a match looks back over; a trend channel needs all there are."""
    return max(10**6 if s["name"] == "trend" else s["length"] for s in sources_of(sources)) + REACH + 1


def with_selections(bars: DataFrame, sources: list[dict]) -> DataFrame:
    """bars with low1, high1, low2 and high2: the ends of both selections, null where a channel does not reach."""
    out = bars
    for k, source in enumerate(sources, 1):
        name, line, before = source["name"], source["selection"], list(out.columns)
        if name == "sma":
            out = out.withColumn("_low", S.sma(F.col("close"), source["length"])).withColumn("_high", F.col("_low"))
        elif name == "trend":
            given = trend.states_of(out, source.get("span", source["length"]), mintick=source.get("mintick", trend.by_price()))
            out = trend.lined(out, given, "left")
            side, what = line.split("_")
            out = out.withColumns({"_low": F.col(f"{side}_zone_lower" if what == "zone" else side), "_high": F.col(f"{side}_zone_upper" if what == "zone" else side)})
        elif name == "lrc":
            reached = F.col("back") <= source["length"]
            out = channels.regression_of(out, reached, source["width"], "_c").withColumn("_low", F.when(reached, F.col(f"_c_{line}"))).withColumn("_high", F.col("_low"))
        else:
            out = channels.weighted(out, source["length"], source["width"]).withColumn("_low", F.col(line)).withColumn("_high", F.col(line))
        out = out.select(*before, F.least("_low", "_high").alias(f"low{k}"), F.greatest("_low", "_high").alias(f"high{k}"))
    return out


#: Of each matcher its scenarios in order: what must hold at the second bar s and the first bar f. Columns are those of _tail().
SCENARIOS: dict[str, list[tuple[str, Callable[[Column, Column], Column]]]] = {
    "bullish": [
        ("dual_support", lambda s, f: s["support2"] & s["run2"].between(1, 4) & f["support1"]),
        ("stacked_support", lambda s, f: s["support2"] & s["below"] & s["near2"] & f["support1"] & (f["short1"] == s["short1"]) & s["kept2"]),
    ],
    "bearish": [
        ("stacked_resistance", lambda s, f: s["resistance2"] & s["over"] & f["resistance1"] & s["ends_below1"]),
        ("clustered_resistance", lambda s, f: s["resistance2"] & s["close_by"] & s["run1"].between(1, 4) & s["ends_near1"] & f["resistance1"]),
    ],
    "breakout": [
        ("dual_resistance_break", lambda s, f: s["broke2"] & s["run2"].between(1, 4) & f["broke1"]),
        ("support_then_resistance_break", lambda s, f: s["broke2"] & s["run2"].between(1, 3) & f["support1"]),
        ("resistance_break_then_support", lambda s, f: s["support2"] & s["near2"] & f["broke1"] & f["over1"]),
    ],
    "role_reversal": [("role_reversal", lambda s, f: s["support2"] & s["near2"] & f["broke1"] & f["over1"])],
}


def _tail(bars: DataFrame, tolerance: float) -> DataFrame:
    """A row for each symbol: t, its last REACH bars, latest first, with all that scenarios ask of a bar."""
    no = lambda x: F.coalesce(x, F.lit(False))
    c, lo, hi = F.col("close"), {k: F.col(f"low{k}") for k in (1, 2)}, {k: F.col(f"high{k}") for k in (1, 2)}
    mid = {k: (lo[k] + hi[k]) / 2 for k in (1, 2)}
    slack = {k: F.greatest(F.abs(mid[k]), F.lit(1.0)) * tolerance / 100 for k in (1, 2)}
    held = lambda k, way: no(touch(lo[k] - slack[k], hi[k] + slack[k], "both", way))
    flags = {f"{name}{k}": held(k, way) for k in (1, 2) for name, way in (("support", "down"), ("resistance", "up"))}
    flags |= {f"broke{k}": no((S.back(c) <= S.back(hi[k])) & (c > hi[k])) for k in (1, 2)}
    flags |= {"below": no(mid[2] < mid[1]), "over": no(mid[2] > mid[1])}
    flags["close_by"] = no(F.abs(mid[1] - mid[2]) <= F.greatest(F.greatest(F.abs(mid[1]), F.abs(mid[2]), F.lit(1.0)) * tolerance / 100, F.lit(1e-9)))
    ends = {"near2": no((c >= lo[2]) & (c <= hi[2] + slack[2])), "ends_below1": no(c < lo[1]), "ends_near1": no(c <= hi[1] + slack[1])}
    each = {"above1": no(c > hi[1]), "above2": no(c > hi[2]), "under1": no(c < lo[1]), "floor1": no(c >= lo[1]), "floor2": no(c >= lo[2])}
    b = bars.withColumns(flags | ends | each).where(F.col("back") <= REACH)
    ahead, whole = S.by().rowsBetween(0, Window.unboundedFollowing), Window.partitionBy("symbol")

    def run(flag: str) -> Column:
        """How many bars from here on have the flag, if the last has it and none between its first one and the last is without."""
        hits = F.sum(F.col(flag).cast("int")).over(ahead)
        last = F.coalesce(F.min(F.when(~F.col(flag), F.col("back"))).over(whole) - 1, F.max("back").over(whole))
        return F.when((hits > 0) & (hits == F.least(last, F.col("back"))), hits)

    from_here = {"run1": run("under1"), "run2": run("above2"), "short1": F.sum((~F.col("floor1")).cast("int")).over(ahead), "kept2": F.min("floor2").over(ahead), "over1": F.min("above1").over(ahead)}
    at_end = {k: F.max(F.when(F.col("back") == 1, F.col(k))).over(whole) for k in ends}
    b = b.select("symbol", "back", "time", *flags, *[x.alias(k) for k, x in (from_here | at_end).items()])
    return b.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("back", "time", *flags, *from_here, *ends))).alias("t"))


def _found(kind: str, lookback: int) -> Column:
    """The first match in the order of matchers, second bars from the last, scenarios, and first bars from the earliest."""
    t = F.col("t")
    pairs = F.flatten(F.transform(F.filter(t, lambda s: s["back"] <= lookback), lambda s: F.transform(F.filter(t, lambda f: f["back"] >= s["back"]), lambda f: F.struct(s.alias("s"), f.alias("f")))))
    matchers = ["bullish", "bearish", "breakout"] if kind == "any" else [kind]

    def of(m: int, k: int, name: str, holds) -> Column:
        made = lambda p: F.struct(F.lit(m).alias("m"), p["s"]["back"].alias("second_back"), F.lit(k).alias("k"), (-p["f"]["back"]).alias("f"), F.lit(name).alias("scenario"), p["s"]["time"].alias("second_time"), p["f"]["time"].alias("first_time"))
        return F.transform(F.filter(pairs, lambda p: F.coalesce(holds(p["s"], p["f"]), F.lit(False))), made)

    found = [of(m, k, name, holds) for m, matcher in enumerate(matchers) for k, (name, holds) in enumerate(SCENARIOS[matcher])]
    return F.array_min(F.concat(*found))


def matches(bars: DataFrame, kinds: list[str], lookback: int = 4, tolerance: float = 0.1) -> DataFrame:
    """A row for each symbol of bars with selections (see with_selections) that has any: for each kind a struct of that name, null
    without a match: scenario, second_back and first_back (bars counted back from the last, which is 1), second_time, first_time."""
    tail = _tail(bars, abs(tolerance or 0.1))
    out = tail.select("symbol", *[_found(kind_of(k), min(REACH, max(1, int(lookback)))).alias(k) for k in kinds])
    shown = lambda k: F.when(F.col(k).isNotNull(), F.struct(F.col(k)["scenario"].alias("scenario"), F.col(k)["second_back"].alias("second_back"), (-F.col(k)["f"]).alias("first_back"), F.col(k)["second_time"].alias("second_time"), F.col(k)["first_time"].alias("first_time")))
    return out.select("symbol", *[shown(k).alias(k) for k in kinds])


def matched(bars: DataFrame, kind: str = "bullish", lookback: int = 4, tolerance: float = 0.1, sweep: bool = False) -> DataFrame:
    """A row for each symbol: passed, and scenario, second_back, first_back, second_time and first_time of the match, null without one.
    With sweep the last bar must also sweep liquidity."""
    found = matches(bars, [kind], lookback, tolerance).select("symbol", F.col(kind).alias("m"))
    if sweep:
        last = bars.withColumn("_sweep", postfilters.liquidity_sweep()).where("back = 1").select("symbol", "_sweep")
        found = found.join(last, "symbol").select("symbol", F.when(F.col("_sweep"), F.col("m")).alias("m"))
    return found.select("symbol", F.col("m").isNotNull().alias("passed"), "m.scenario", "m.second_back", "m.first_back", "m.second_time", "m.first_time")


def confluence(bars: DataFrame, sources=("lrc", "regression"), kind: str = "bullish", lookback: int = 4, tolerance: float = 0.1, selections=None, sweep: bool = False) -> DataFrame:
    """matched() on two sources by name."""
    return matched(with_selections(bars, sources_of(sources, kind, selections)), kind, lookback, tolerance, sweep)
