"""Operators on small bars made by hand."""

import pytest
from pyspark.sql import functions as F

from barlight.functions import series as S
from barlight.operators import channels, indicators, postfilters, states, trend
from barlight.operators import relational as R
from barlight.plans import screen
from barlight.sources import bars as B


def make(spark, closes, symbol="A", spread=1.0):
    rows = [(symbol, 86400 * k, c, c + spread, c - spread, c, 10.0 + k) for k, c in enumerate(map(float, closes))]
    return B.latest(spark.createDataFrame(rows, "symbol string, time long, open double, high double, low double, close double, volume double"))


def values(df, c):
    return [r[c] for r in df.orderBy("time").collect()]


def test_moving_average_needs_full_frames(spark):
    assert values(make(spark, [1, 2, 3, 4]).withColumn("m", S.sma(F.col("close"), 3)), "m") == [None, None, 2.0, 3.0]


@pytest.mark.parametrize("n", [1, 2, 3, 14, 200])
def test_recursive_averages_by_recursion(spark, n):
    x = [3.0 + (k * 37 % 11) - (k * 5 % 7) / 3 for k in range(500)]
    got = make(spark, x).withColumns({"e": S.ema(F.col("close"), n), "late": S.ema(F.col("close"), n, 4), "r": S.rma(F.col("close"), n), "s": S.recursive_sum(F.col("close"), n), "seeded": S.seeded_rma(F.col("close"), n), "back": states.backfilled_atr(F.col("close"), n)}).orderBy("time").collect()
    e = r = late = total = None
    seed = sum(x[:n]) / n
    for i, (v, row) in enumerate(zip(x, got, strict=True)):
        e = v if e is None else 2 / (n + 1) * v + (1 - 2 / (n + 1)) * e
        late = None if i < 3 else v if late is None else 2 / (n + 1) * v + (1 - 2 / (n + 1)) * late
        r = v if r is None else (r * i + v) / (i + 1) if i < n else (r * (n - 1) + v) / n
        total = (total or 0.0) * (1 - 1 / n) + v
        want = (e, late, r, total, r if i >= n - 1 else None, seed if i < n else r)
        for g, w in zip((row.e, row.late, row.r, row.s, row.seeded, row.back), want, strict=True):
            assert g == (None if w is None else pytest.approx(w, rel=1e-9))


def test_rsi_without_losses_is_100(spark):
    assert values(indicators.rsi(make(spark, range(1, 20)), 14), "rsi")[13:] == [None] + [100.0] * 5


def test_aroon_takes_the_first_of_equal_extremes(spark):
    df = make(spark, [5, 9, 9, 5, 5]).withColumn("a", indicators.aroon(4))
    assert values(df, "a")[-1] == 25.0


def test_rising_series_correlates_negatively(spark):
    assert values(make(spark, range(10)).withColumn("r", S.pearson(F.col("close"), 5)), "r")[-1] == pytest.approx(-1)


def test_volatility_stop_turns(spark):
    df = states.volatility_stop(make(spark, [10, 11, 12, 13, 5, 4, 3]), 3, 1.0)
    up = values(df, "up")
    assert up[3] is True and up[4] is False


def test_trend_channel_of_rising_lows(spark):
    wave = [100 + k * 0.5 + (6 if k % 10 < 5 else -6) * (1 - abs(k % 5 - 2) / 3) for k in range(80)]
    out = trend.trend(make(spark, wave), 3).collect()
    assert len(out) == 1 and out[0].bottom < out[0].middle < out[0].top
    assert trend.trend(make(spark, [1, 2, 3]), 3).count() == 0


def test_respect_counts_separate_touches(spark):
    b = make(spark, [10, 20, 20, 20, 20, 10, 10, 20]).withColumns({"line": F.lit(10.5), "open": F.col("close") - 0.1})
    assert postfilters.respects(b, "line", 1.0, 3).first().respects == 2


def test_short_series_are_never_dead(spark):
    assert postfilters.dead(make(spark, range(11, 0, -1))).first().kind == "none"


def test_falling_series_bleeds_slowly(spark):
    assert postfilters.dead(make(spark, [300 - k for k in range(260)])).first().kind == "slow"


def test_session_follows_daylight_saving(spark):
    # 13:30 UTC is the open in July and an hour before it in January.
    df = spark.createDataFrame([(1720445400,), (1704720600,), (1704724200,)], "t long").select(R.in_session(F.col("t")).alias("x"))
    assert [r.x for r in df.collect()] == [True, False, True]


def test_upsert_keeps_the_new_row(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert {tuple(r) for r in R.upserted(old, spark.createDataFrame([("b", 3)], "k string, v int"), ["k"]).collect()} == {("a", 1), ("b", 3)}


@pytest.mark.parametrize("raw, want", [("btc", "BTC-USD"), ("X:ETHUSD", "ETH-USD"), ("sol/usd", "SOL-USD"), (" ", ""), (None, "")])
def test_coin_symbols(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "s string").select(R.normal_crypto(F.col("s")).alias("x")).first().x == want


def test_requests_are_checked_before_reading():
    with pytest.raises(ValueError):
        screen.Request(rules={"nothing": {}})
    with pytest.raises(ValueError):
        screen.Request(price=(2.0, 1.0))


def test_empty_bars(spark):
    none = make(spark, [1]).where("false")
    assert indicators.macd(none).count() == 0 and postfilters.dead(none).count() == 0
