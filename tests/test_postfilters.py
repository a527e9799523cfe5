"""Channel respect on several lines and dead trends, against plain loops and by hand."""

import pytest
from pyspark.sql import functions as F

from barlight.operators import postfilters as P
from barlight.plans import screen
from tests.test_machines import frame, walks


def touched(bar, x, tolerance, kind):
    o, h, l, c = bar
    lo, hi, top, bottom = x - abs(x) * tolerance / 100, x + abs(x) * tolerance / 100, max(o, c), min(o, c)
    wick = (h > top and top <= hi and h >= lo) or (l < bottom and l <= hi and bottom >= lo)
    body = bottom <= hi and top >= lo
    return {"wick": wick, "body": body, "both": wick or body}[kind]


def count(bars, line, tolerance, gap, kind):
    n, last, apart = 0, None, False
    for i, (bar, x) in enumerate(zip(bars, line)):
        if x is None:
            continue
        if touched(bar, x, tolerance, kind):
            n += last is None or (i - last > gap and apart)
            last, apart = i, False
        elif last is not None:
            clear = max(2 * abs(x) * tolerance / 100, abs(x) * 0.001, 1e-6)
            apart = apart or any(abs(v - x) >= clear for v in (bar[3], bar[0], (bar[1] + bar[2]) / 2))
    return n


@pytest.mark.parametrize("kind", ["wick", "body", "both"])
def test_respects_of_several_lines(spark, kind):
    found = walks(15, 120, 6)
    lines = {"upper": 104.0, "middle": 100.0, "lower": 95.0}
    b = frame(spark, found).withColumns({k: F.when(F.col("i") > 10, v + 0.02 * F.col("i")) for k, v in lines.items()})
    ask = {"upper": ["upper"], "both": ["upper", "lower"], "lower_middle": ["lower", "middle"], "All ": ["upper", "middle", "lower"], "odd": ["middle"], None: ["middle"]}
    for name, of in ask.items():
        assert P.lines_of(name) == of
        got = {r.symbol: r.respects for r in P.respects(b, P.lines_of(name), 1.0, 4, touch_type=kind).collect()}
        for s, bars in found.items():
            want = sum(count(bars, [lines[k] + 0.02 * (i + 1) if i >= 10 else None for i in range(120)], 1.0, 4, kind) for k in of)
            assert got[s] == want


def runs_by_hand(prices):
    n = 0
    for k in range(len(prices) - 1, 0, -1):
        if prices[k] >= prices[k - 1]:
            break
        n += 1
    return n


def test_runs_of_swings(spark):
    for prices in ([], [3.0], [5.0, 4.0, 3.0], [1.0, 5.0, 4.0], [5.0, 4.0, 4.0], [3.0, 2.0, 6.0]):
        df = spark.createDataFrame([([(p, True) for p in prices],)], "s array<struct<price: double, recent: boolean>>")
        r = df.select(P._runs(F.col("s")).alias("r")).first().r
        assert r.run == runs_by_hand(prices) and r.higher == any(b > a for a, b in zip(prices, prices[1:])) and r["last"] == (prices[-1] if prices else None)


def test_ways_of_recovering(spark):
    rise = [100.0 - k for k in range(20)] + [80.0 + 2 * k for k in range(8)] + [96.0 - 2 * k for k in range(9)]
    bar = lambda c, up=0.4: (c, c + up, c - 0.4, c)
    top = max(c + 0.4 for c in rise[20:30])
    tails = {"none": [bar(90.0), bar(91.0)], "wick": [bar(90.0), bar(91.0, 12.0)], "close": [bar(90.0), bar(top + 1)], "twice": [bar(top + 1), bar(top + 2)]}
    found = P.dead(frame(spark, {k: [*map(bar, rise), *v] for k, v in tails.items()}))
    got = {r.symbol: (r.wick_above_swing_high, r.close_above_swing_high, r.two_closes_above_swing_high) for r in found.collect()}
    assert got == {"none": (False, False, False), "wick": (True, False, False), "close": (True, True, False), "twice": (True, True, True)}


def test_lines_of_dead_trends(spark):
    """A fall that ends in a jump: below the least-squares line to the last but one bar."""
    fall = {"A": [(c, c + 0.5, c - 0.5, c) for c in [300.0 - k for k in range(150)]]}
    kinds = {t: P.dead(frame(spark, fall), trend=t).first().kind for t in P.TREND_LINES}
    assert kinds["ema_50"] == kinds["ema_100"] == kinds["ema_200"] == "slow" and kinds["linear_regression"] in ("none", "flat", "slow")


@pytest.mark.parametrize("rules", [{"dead_assets": {"recovery": "odd"}}, {"dead_assets": {"trend": "sma_9"}}, {"channel_respect": {"channel": "odd"}}, {"channel_respect": {"touch_type": "odd"}}, {"x": {"rule_of": "sma"}, "logic": 1}])
def test_impossible_settings(rules):
    logic = ("xor", ["x"]) if rules.pop("logic", None) else None
    with pytest.raises(ValueError):
        screen.Request(rules, logic=logic)
    for wrong in (("all", []), ("all",), 7, ("any", ["x", ("not", "x")])):
        with pytest.raises(ValueError, match="logic"):
            screen.check_logic(wrong)
