"""Conditions on the wave trend, toggles of volume spikes, labels and the as-of lookup, against plain loops and by hand."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from barlight.operators import indicators
from barlight.plans import relations, rules, screen
from tests.test_machines import frame, walks


def test_condition_names():
    assert rules.wave_zone("oversold_watch", None) == "oversold" and rules.wave_zone("turning_down_from_overbought", None, 1) == "overbought_level_1"
    assert rules.wave_zone("cross_up", "os1") == "os1" and rules.wave_zone("cross_any", None) == "any"


@pytest.mark.parametrize(("condition", "zone"), [("cross_up", "oversold"), ("oversold_cross_up", None), ("turning_down", "overbought"), ("overbought_watch", None), ("rising", None), ("cross_any", None), ("zone_only", "neutral")])
def test_conditions(spark, condition, zone):
    found = walks(20, 90, 31)
    b = frame(spark, found)
    b, hit, _ = rules.wavetrend(b, "w", condition=condition, zone=zone, inner=12.0)
    rows = b.withColumn("hit", hit).orderBy("symbol", "i").collect()
    seen = set()
    for k in range(2, len(rows)):
        r, p, q = rows[k], rows[k - 1], rows[k - 2]
        if r.i < 40:
            continue
        up, down = p.w_wt1 <= p.w_wt2 and r.w_wt1 > r.w_wt2, p.w_wt1 >= p.w_wt2 and r.w_wt1 < r.w_wt2
        turned = p.w_wt1 - q.w_wt1 >= -1e-9 and r.w_wt1 - p.w_wt1 < -1e-9
        want = {"cross_up": up and r.w_wt2 <= -12, "oversold_cross_up": up and r.w_wt2 <= -12, "turning_down": turned and r.w_wt1 >= 12, "overbought_watch": r.w_wt1 >= 12, "rising": r.w_wt1 - p.w_wt1 > 1e-9, "cross_any": up or down, "zone_only": abs(r.w_wt1) <= 12}[condition]
        assert r.hit == want
        seen.add(want)
    assert seen == {True, False}


def spikes(bars, times, n, extremes, hammers, colors, allowed):
    out = []
    for i in range(len(bars)):
        k, both = i - 1, [False, False]
        if k >= 1 and k + 1 >= n:
            (o, h, l, c, v), before, after = bars[k], bars[k - 1], bars[k + 1]
            if v > times * sum(x[4] for x in bars[k - n + 1 : k + 1]) / n and allowed(k):
                mid = l + (h - l) / 2
                top = (not extremes or (h > before[1] and h > after[1])) and (not hammers or (o < mid and c < mid)) and (not colors or c < o)
                low = (not extremes or (l < before[2] and l < after[2])) and (not hammers or (o > mid and c > mid)) and (not colors or c > o)
                both = [low, top]
        out.append(tuple(both))
    return out


@pytest.mark.parametrize(("extremes", "hammers", "colors", "session"), [(True, True, False, ""), (False, True, True, ""), (True, False, True, "0400-1200"), (False, False, False, "2200-0300")])
def test_volume_toggles(spark, extremes, hammers, colors, session):
    rng, found = random.Random(7), walks(8, 120, 19)
    volumes = {s: [rng.uniform(1, 9) for _ in bars] for s, bars in found.items()}
    b = frame(spark, found).drop("volume").withColumn("time", (F.col("time") / 24).cast("long"))
    b = b.join(spark.createDataFrame([(s, i + 1, v) for s, x in volumes.items() for i, v in enumerate(x)], "symbol string, i int, volume double"), ["symbol", "i"])
    got = {(r.symbol, r.i): (r.bullish, r.bearish) for r in indicators.volume_spikes(b, 10, 1.1, extremes, hammers, colors, session).collect()}
    allowed = {"": lambda k: True, "0400-1200": lambda k: 4 <= k % 24 < 12, "2200-0300": lambda k: k % 24 >= 22 or k % 24 < 3}[session]
    seen = set()
    for s, bars in found.items():
        want = spikes([(*x, v) for x, v in zip(bars, volumes[s])], 1.1, 10, extremes, hammers, colors, allowed)
        assert [got[s, i + 1] for i in range(120)] == want
        seen |= set(want)
    assert len(seen) >= 2


def test_entry_takes_any_crossing(spark):
    b = frame(spark, walks(1, 70, 2)).withColumn("volume", F.when(F.col("i") < 60, -5.0).otherwise(50.0))
    said = screen.judged(b, {"x": {"rule_of": "relative_volume", "rule": "entry", "lines": ("ma2", "ma4"), "window": 11}, "y": {"rule_of": "relative_volume", "rule": "entry", "lines": ("ma4",), "window": 2}}).first()
    assert said.passed_x is True and said.passed_y is False


def test_labels(spark):
    rows = [(None, 1.0, 2.0), (45.0, 1.0, 2.0), (30.0, 10.0, 20.0), (30.0, 10.0, 35.0), (22.0, 10.0, 5.0), (22.0, 25.0, 5.0), (10.0, 9.0, 1.0)]
    df = spark.createDataFrame(rows, "adx double, di_plus double, di_minus double").coalesce(1)
    up = [r.x for r in df.select(indicators.directional_label("bullish").alias("x")).collect()]
    assert up == ["Early Bullish / Weak Strength", "Bullish Exhaustion Warning", "Strong Bullish Confirmed", "Bullish Confirmed", "Bullish Confirmed", "Bullish Strength Building", "Early Bullish / Weak Strength"]
    assert df.select(indicators.directional_label("bearish").alias("x")).collect()[3].x == "Bearish Strength Building"


def test_as_of_over_long_gaps(spark):
    rng = random.Random(1)
    bars = sorted({(s, 3600 * rng.randrange(10_000_000)) for s in "AB" for _ in range(20)})
    asked = [(k, rng.choice("ABC"), rng.randrange(36_000_000_000)) for k in range(300)] + [(400 + k, s, t + 3600 + d) for k, (s, t) in enumerate(bars) for d in (-1, 0)]
    left = spark.createDataFrame(asked, "id long, symbol string, time long")
    table = spark.createDataFrame([(s, t, float(k)) for k, (s, t) in enumerate(bars)], "symbol string, time long, close double")
    got = sorted((r.id, r.time, r.close) for r in relations.as_of(left, table).collect())
    want = []
    for i, s, t in asked:
        mine = [(u, k) for k, (x, u) in enumerate(bars) if x == s]
        at = bisect.bisect_right([u for u, _ in mine], t - 3600) - 1
        want.append((i, t, float(mine[at][1]) if at >= 0 else None))
    assert got == sorted(want)
