"""Confluence against plain loops over random walks, cases worked out by hand, words for selections, and trend channels as sources."""

import random

import pytest
from pyspark.sql import functions as F

from barlight.operators import confluence as C
from barlight.operators import trend
from barlight.plans import screen
from tests.test_machines import frame, walks


def by_hand(bars, first, second, kind, lookback, tolerance):
    """(scenario, second bar, first bar), counted from 0; bars are (open, high, low, close), selections (low, high) at each bar."""
    n, close = len(bars), [b[3] for b in bars]
    mid = lambda x, i: sum(x[i]) / 2
    slack = lambda x, i: max(abs(mid(x, i)), 1.0) * tolerance / 100

    def held(x, i, support):
        lo, hi = x[i][0] - slack(x, i), x[i][1] + slack(x, i)
        o, h, l, c = bars[i]
        top, bottom, m = max(o, c), min(o, c), (lo + hi) / 2
        meets = bottom <= hi and top >= lo
        if support:
            return bottom >= m and (meets or (l < bottom and l <= hi and bottom >= lo))
        return top <= m and (meets or (h > top and top <= hi and h >= lo))

    broken = lambda x, i: i > 0 and close[i - 1] <= x[i - 1][1] and close[i] > x[i][1]
    near = lambda x: x[-1][0] <= close[-1] <= x[-1][1] + slack(x, n - 1)

    def run(x, i, above):
        on = [close[k] > x[k][1] if above else close[k] < x[k][0] for k in range(i, n)]
        return sum(on) if any(on) and all(on[on.index(True) :]) else None

    def pairs():
        for s in range(n - 1, max(-1, n - 1 - lookback), -1):
            yield s, [f for f in range(max(0, s - 3), s + 1) if n - f <= 4]

    def bullish():
        for s, firsts in pairs():
            if not held(second, s, True):
                continue
            if run(second, s, True) is not None and run(second, s, True) <= 4:
                for f in firsts:
                    if held(first, f, True):
                        return "dual_support", s, f
            if mid(second, s) < mid(first, s) and near(second) and all(close[k] >= second[k][0] for k in range(s, n)):
                for f in firsts:
                    if held(first, f, True) and all(close[k] >= first[k][0] for k in range(f, s)):
                        return "stacked_support", s, f

    def bearish():
        for s, firsts in pairs():
            if not held(second, s, False):
                continue
            if mid(second, s) > mid(first, s) and close[-1] < first[-1][0]:
                for f in firsts:
                    if held(first, f, False):
                        return "stacked_resistance", s, f
            apart = abs(mid(first, s) - mid(second, s))
            if apart <= max(max(abs(mid(first, s)), abs(mid(second, s)), 1.0) * tolerance / 100, 1e-9) and run(first, s, False) in (1, 2, 3, 4) and close[-1] <= first[-1][1] + slack(first, n - 1):
                for f in firsts:
                    if held(first, f, False):
                        return "clustered_resistance", s, f

    def after_break(name):
        for s, firsts in pairs():
            if held(second, s, True) and near(second):
                for f in firsts:
                    if broken(first, f) and all(close[k] > first[k][1] for k in range(f, n)):
                        yield name, s, f

    def breakout():
        for s, firsts in pairs():
            if broken(second, s):
                length = run(second, s, True)
                for f in firsts if length is not None and length <= 4 else []:
                    if broken(first, f):
                        return "dual_resistance_break", s, f
                for f in firsts if length is not None and length <= 3 else []:
                    if held(first, f, True):
                        return "support_then_resistance_break", s, f
            for found in after_break("resistance_break_then_support"):
                if found[1] == s:
                    return found

    if kind == "any":
        return bullish() or bearish() or breakout()
    return {"bullish": bullish, "bearish": bearish, "breakout": breakout, "role_reversal": lambda: next(after_break("role_reversal"), None)}[kind]()


@pytest.mark.parametrize(("lookback", "tolerance"), [(4, 1.5), (2, 0.1), (3, 6.0)])
def test_all_kinds_by_plain_loops(spark, lookback, tolerance):
    rng, found, lines, given = random.Random(lookback), walks(350, 9, 5), {}, []
    for s, bars in found.items():
        near = [min(b[2] for b in bars[-4:]), max(b[1] for b in bars[-4:])]
        a, b = (rng.uniform(near[0] - 1, near[1] + 1) for _ in "ab")
        b = a + rng.uniform(-0.5, 0.5) if rng.random() < 0.3 else b
        slope, wide = rng.choice([0.0, 0.4, -0.4]), rng.choice([0.0, 0.0, 1.5])
        lines[s] = ([(a + slope * (i - 8), a + slope * (i - 8)) for i in range(9)], [(b, b + wide)] * 9)
        given += [(s, i + 1, *lines[s][0][i], *lines[s][1][i]) for i in range(9)]
    selections = spark.createDataFrame(given, "symbol string, i int, low1 double, high1 double, low2 double, high2 double")
    got = {r.symbol: r for r in C.matches(frame(spark, found).join(selections, ["symbol", "i"]), C.KINDS, lookback, tolerance).collect()}
    seen = set()
    for s, bars in found.items():
        for kind in C.KINDS:
            want = by_hand(bars, *lines[s], kind, lookback, tolerance)
            m = got[s][kind]
            assert (None if m is None else (m.scenario, 9 - m.second_back, 9 - m.first_back)) == want, (s, kind)
            if want:
                seen.add(want[0])
                assert (m.second_time, m.first_time) == (86400 * want[1], 86400 * want[2])
    assert len(seen) >= (7 if tolerance > 1 else 4)


def case(spark, closes, one, two, kind, tolerance=1.0, **more):
    bars = [(c + 0.05, c + 0.1, c - 0.1, c) for c in closes]
    b = frame(spark, {"A": bars}).withColumns({k: F.lit(float(v)) for k, v in (("low1", one), ("high1", one), ("low2", two), ("high2", two))})
    return C.matched(b, kind, 4, tolerance, **more).first()


def test_cases_by_hand(spark):
    # The first line is broken upward, the second one held and near the last close.
    r = case(spark, [9.5, 9.5, 9.5, 11.0, 10.55], 10, 10.5, "role_reversal")
    assert (r.passed, r.scenario, r.second_back, r.first_back) == (True, "role_reversal", 1, 2)
    assert case(spark, [9.5, 9.5, 9.5, 11.0, 10.55], 10, 10.5, "breakout").scenario == "resistance_break_then_support"
    assert case(spark, [11.0, 11.0, 10.2, 10.2, 11.6], 10, 11, "breakout", 1.5).scenario == "support_then_resistance_break"
    # A first line far below is neither held nor broken.
    assert case(spark, [9.5, 9.5, 9.5, 9.5, 10.4], 5, 10, "breakout").passed is False
    assert case(spark, [9.5, 9.5, 9.5, 9.5, 10.4], 10.1, 10, "breakout").scenario == "dual_resistance_break"
    # Closes that fall back break the run above the second line.
    assert case(spark, [9.5, 9.5, 10.4, 9.5, 9.5], 10.1, 10, "breakout").passed is False
    # Clustered resistance needs the first line's run of closes below.
    assert case(spark, [9.0, 9.0, 9.0, 9.9], 10, 10.02, "bearish").scenario in ("clustered_resistance", "stacked_resistance")
    assert case(spark, [9.0, 9.0, 9.0, 9.9], 10.02, 10, "bearish").scenario == "clustered_resistance"
    assert case(spark, [9.0, 9.0, 9.0, 9.9], 10.02, 10, "Bearish ").passed and not case(spark, [9.0, 9.0, 9.0, 9.9], 10.02, 10, "bulish").passed


def test_short_series_and_missing_lines(spark):
    assert case(spark, [10.0], 10, 10, "any") is not None
    b = frame(spark, {"A": [(10.0, 10.1, 9.9, 10.0)] * 6}).withColumns({k: F.lit(None).cast("double") for k in ("low1", "high1", "low2", "high2")})
    assert C.matched(b, "any", 4, 5.0).first().passed is False


def test_liquidity_sweep_of_the_last_bar(spark):
    bars = [(9.55, 9.6, 9.4, 9.5)] * 3 + [(11.05, 11.1, 10.9, 11.0), (10.6, 11.2, 10.45, 10.55)]
    b = frame(spark, {"A": bars, "B": [*bars[:-1], (10.6, 10.7, 10.45, 10.55)]}).withColumns({k: F.lit(v) for k, v in (("low1", 10.0), ("high1", 10.0), ("low2", 10.5), ("high2", 10.5))})
    b = b.withColumn("low", F.when((F.col("symbol") == "B") & (F.col("back") == 2), 10.4).otherwise(F.col("low")))
    passed = {r.symbol: r.passed for r in C.matched(b, "role_reversal", 4, 1.0, sweep=True).collect()}
    assert passed == {"A": True, "B": False} and all(r.passed for r in C.matched(b, "role_reversal", 4, 1.0).collect())


def test_words_for_selections():
    assert [C.selection_of("lrc", w) for w in ("Top", "bottom_line", "center", "", None, "odd", "top_zone")] == ["upper", "lower", "middle", "lower", "lower", "lower", "lower"]
    assert [C.selection_of("trend", w, "bearish") for w in ("upper", "lower_line", "center", "bottom_zone", "odd")] == ["top_line", "bottom_line", "middle_line", "bottom_zone", "top_line"]
    want = {"bullish": ("lower", "lower"), "bearish": ("upper", "upper"), "breakout": ("upper", "upper"), "any": ("lower", "upper"), "role_reversal": ("upper", "lower"), "odd": ("lower", "lower")}
    for kind, (a, b) in want.items():
        assert (C.default_selection("lrc", kind, 0), C.default_selection("lrc", kind, 1)) == (a, b)
    assert [s["selection"] for s in C.sources_of(("lrc", {"type": "trend", "selection": "top"}), "any")] == ["lower", "top_line"]
    assert C.kind_of(" BREAKOUT ") == "breakout" and C.kind_of(None) == "bullish"


def test_trend_channels_as_sources(spark):
    """The zone of a trend channel is what the channel's own lines say at each bar."""
    found = walks(12, 240, 4)
    b = frame(spark, found)
    sources = C.sources_of(({"name": "trend", "span": 3, "selection": "bottom_zone", "mintick": None}, {"name": "lrc", "length": 40, "selection": "middle"}))
    got = {(r.symbol, r.i): r for r in C.with_selections(b, sources).collect()}
    lines = {(r.symbol, r.i): r for r in trend.lined(b, trend.states_of(b, 3)).collect()}
    assert len(got) == 12 * 240 and lines
    for key, r in got.items():
        want = lines.get(key)
        if want is None or want.bottom is None:
            assert r.low1 is None and r.high1 is None
        else:
            assert (r.low1, r.high1) == (min(want.bottom, want.bottom_zone_upper), max(want.bottom, want.bottom_zone_upper))
        assert (r.low2 is None) == (r.back > 40)


@pytest.mark.parametrize("config", [{"sources": ("lrc",)}, {"sources": ("lrc", "odd")}, {"lookback": 5}, {"tolerance": -1}])
def test_impossible_settings(config):
    with pytest.raises(ValueError, match="confluence"):
        screen.Request({"confluence": config})


def test_bars_needed():
    assert screen.Request({"confluence": {"sources": ({"name": "regression", "length": 400}, "lrc")}}).depth == 405
    assert screen.Request({"confluence": {"sources": ("lrc", "trend")}}).depth == 500
