"""Trend channels and failed recoveries against plain loops over random walks."""

import math
import random

import pytest
from barlight.operators import postfilters, trend
from barlight.sources import bars as B


def walks(n, length, seed):
    rng = random.Random(seed)
    out = {}
    for k in range(n):
        price, rows = 100.0, []
        for i in range(length):
            price = max(5.0, price + rng.gauss(0, 2) + 3 * math.sin(i / (4 + k % 5)))
            o, c = price + rng.gauss(0, 1), price + rng.gauss(0, 1)
            rows.append((round(o, 2), round(max(o, c) + abs(rng.gauss(0, 1)), 2), round(min(o, c) - abs(rng.gauss(0, 1)), 2), round(c, 2)))
        out[f"S{k}"] = rows
    return out


def frame(spark, found):
    rows = [(s, 86400 * i, *map(float, bar), 10.0) for s, bars in found.items() for i, bar in enumerate(bars)]
    return B.latest(spark.createDataFrame(rows, "symbol string, time long, open double, high double, low double, close double, volume double"))


def trend_by_hand(bars, span, width=6.0, zone=1 / 7, period=10):
    """Each pair of neighbouring pivots that opens a channel when none is open, followed to its break by its lines' formula."""
    n = len(bars)
    high, low, close = [b[1] for b in bars], [b[2] for b in bars], [b[3] for b in bars]
    ranges = [high[0] - low[0]] + [max(high[i] - low[i], abs(high[i] - close[i - 1]), abs(low[i] - close[i - 1])) for i in range(1, n)]
    atr = [sum(ranges[:period]) / period] * period
    for r in ranges[period:]:
        atr.append((atr[-1] * (period - 1) + r) / period)
    tops = [i for i in range(span, n - span) if high[i] > max(high[i - span : i]) and high[i] >= max(high[i + 1 : i + span + 1])]
    lows = [i for i in range(span, n - span) if low[i] < min(low[i - span : i]) and low[i] <= min(low[i + 1 : i + span + 1])]
    events = sorted([(b + span, 0, a, b) for a, b in zip(tops, tops[1:])] + [(b + span, 1, a, b) for a, b in zip(lows, lows[1:])])
    free, last = 0, None
    for at, kind, a, b in events:
        y = low if kind else high
        slope = (y[b] - y[a]) / (b - a)
        if at < free or (slope < 0 if kind else slope > 0):
            continue
        reach = atr[at] * width
        ends = (y[b] + reach + reach * zone, y[b] + reach / 2, y[b] - reach * zone) if kind else (y[b] + reach * zone, y[b] - reach / 2, y[b] - reach - reach * zone)
        broken = next((t for t in range(at, n) if low[t] > ends[0] + slope * (t - at + 1) or high[t] < ends[2] + slope * (t - at + 1)), None)
        end = n - 1 if broken is None else broken
        last = ("up" if kind else "down", broken is not None, None if broken is None else broken + 1, a + 1, at + 1, *(e + slope * (end - at + 1) for e in ends))
        if broken is None:
            break
        free = broken + 1
    return last


@pytest.mark.parametrize("span", [3, 8])
def test_trend_channels(spark, span):
    found = walks(25, 260, 4)
    got = {r.symbol: r for r in trend.trend(frame(spark, found), span).collect()}
    kinds = set()
    for s, bars in found.items():
        want = trend_by_hand(bars, span)
        assert (s in got) == (want is not None)
        if want:
            r = got[s]
            kinds.add((r.direction, r.broken))
            assert (r.direction, r.broken, r.break_index, r.start_index, r.created_at) == want[:5]
            assert (r.top, r.middle, r.bottom) == pytest.approx(want[5:])
    assert len(kinds) >= 3


def test_failed_recoveries_by_hand(spark):
    """A low that is bounced off by a fifth and fallen through within twenty bars is a failed recovery."""
    up = [100.0 + k for k in range(60)]
    fall = [*up, *[160.0 - 3 * k for k in range(10)], 100.0, *[105.0 + 4 * k for k in range(8)], *[125.0 - 6 * k for k in range(9)], *[90.0 + k for k in range(12)]]
    rows = {"A": [(c, c + 0.5, c - 0.5, c) for c in fall], "B": [(c, c + 0.5, c - 0.5, c) for c in [*up, *up]]}
    kinds = {r.symbol: r.kind for r in postfilters.dead(frame(spark, rows)).collect()}
    assert kinds == {"A": "failed", "B": "none"}
