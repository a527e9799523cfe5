"""Filters of another length at each bar, and the channel over UTC days, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from barlight.operators import filters
from barlight.sources import bars as B
from tests.test_machines import frame, walks


def filtered(x, periods, kind, volume):
    out = []
    for i, n in enumerate(periods):
        at = [(x[i - k], volume[i - k]) if i >= k else (x[i], volume[i]) for k in range(n)]
        if kind == "ema":
            out.append(x[i] if not out else out[-1] + (x[i] - out[-1]) * 2 / (n + 1))
        elif kind == "rma" and out:
            out.append((out[-1] * (n - 1) + x[i]) / n)
        else:
            w = {"lwma": [n - k for k in range(n)], "vwma": [v for _, v in at], "alma": [math.exp(-((n - 1 - k - 0.85 * (n - 1)) ** 2) / (2 * (n / 6) ** 2)) for k in range(n)]}.get(kind, [1] * n)
            out.append(sum(a * b for (a, _), b in zip(at, w)) / sum(w))
    return out


@pytest.mark.parametrize("kind", filters.KINDS)
def test_lengths_by_bar(spark, kind):
    found = walks(6, 90, 17)
    b = frame(spark, found).withColumns({"n": 1 + F.col("i") * 5 % 17, "volume": 1.0 + F.col("i") % 4})
    got = {(r.symbol, r.i): r.out for r in filters.by_period(b, F.col("close"), F.col("n"), kind, "out").collect()}
    for s, bars in found.items():
        want = filtered([x[3] for x in bars], [1 + (i + 1) * 5 % 17 for i in range(90)], kind, [1.0 + (i + 1) % 4 for i in range(90)])
        assert [got[s, i + 1] for i in range(90)] == pytest.approx(want, rel=1e-9)


def test_long_memories_do_not_overflow(spark):
    found = walks(1, 500, 3)
    b = frame(spark, found)
    for kind, n in (("ema", 2), ("rma", 2), ("ema", 400), ("rma", 1)):
        got = [r.out for r in filters.by_period(b, F.col("close"), F.lit(n), kind, "out").orderBy("i").collect()]
        assert got == pytest.approx(filtered([x[3] for x in found["S0"]], [n] * 500, kind, [1.0] * 500), rel=1e-6)


def regression(x, periods, places, kind, width=1.0):
    f = filtered(x, periods, kind, [1.0] * len(x))
    d = [a - b for a, b in zip(x, f)]
    size = filtered([v * v for v in d], periods, kind, [1.0] * len(x))
    out = []
    for i, n in enumerate(periods):
        half, past = (n + 1) // 2, [d[i - k] if i >= k else d[i] for k in range(n)]
        whole = math.sqrt(n * half * half * sum(v * v for v in past))
        r = half * sum(past) / whole if whole else 0.0
        dev = width * math.sqrt(max(size[i], 0))
        slope = 0.0 if n == 1 else r * dev / half
        out.append((f[i] + slope * (places[i] - (places[i - half] if i >= half else 0.0)), slope, dev, r))
    return out


@pytest.mark.parametrize("kind", ["sma", "lwma", "ema"])
@pytest.mark.parametrize("step", [1, 3])
def test_channel_of_the_day(spark, kind, step):
    rng = random.Random(4)
    times = sorted(rng.sample(range(0, 6 * 24), 90))
    rows = [(s, 3600 * t, 0.0, 0.0, 0.0, 100 + rng.gauss(0, 5), 2.0) for s in ("A", "B") for t in times]
    b = B.latest(spark.createDataFrame(rows, "symbol string, time long, open double, high double, low double, close double, volume double"))
    got = {(r.symbol, r.time): r for r in filters.day_channel(b, 1.5, kind, step).collect()}
    for s in ("A", "B"):
        mine = [(r[1], r[5]) for r in rows if r[0] == s]
        place, taken = {}, []
        for i, (t, _) in enumerate(mine):
            place[i] = sum(u // 86400 == t // 86400 for u, _ in mine[:i])
            if place[i] % step == 0:
                taken.append(i)
        periods = [1 + sum(mine[j][0] // 86400 == mine[i][0] // 86400 for j in taken if j < i) for i in taken]
        said = dict(zip(taken, regression([mine[i][1] for i in taken], periods, [float(i) for i in taken], kind, 1.5)))
        spread = [said[max(j for j in taken if j <= i)] for i in range(len(mine))]
        last = [i for i in range(len(mine)) if mine[i][0] // 86400 == mine[-1][0] // 86400]
        middle, slope, dev, _ = spread[-1]
        assert {t for k, t in got if k == s} == {mine[i][0] for i in last}
        for i in last:
            r, y = got[s, mine[i][0]], middle - slope * (len(mine) - 1 - i)
            assert (r.tracer, r.middle, r.upper, r.lower, r.q1, r.q3) == pytest.approx((spread[i][0], y, y + dev, y - dev, y - dev / 2, y + dev / 2), rel=1e-7, abs=1e-7)


def test_points_of_a_fixed_length(spark):
    found = walks(2, 60, 8)
    got = {(r.symbol, r.i): r for r in filters.regression_series(frame(spark, found), F.lit(15), 2.0, "lwma").collect()}
    for s, bars in found.items():
        for i, (m, slope, dev, r) in enumerate(regression([x[3] for x in bars], [15] * 60, list(range(60)), "lwma", 2.0)):
            x = got[s, i + 1]
            assert (x.middle, x.slope, x.deviation, x.correlation) == pytest.approx((m, slope, dev, r), rel=1e-7, abs=1e-8)
    with pytest.raises(ValueError, match="none of"):
        filters.by_period(frame(spark, found), F.col("close"), F.lit(3), "odd")
