"""The screen engine on bars made by hand: groups, windows, confirmations, post-filters, and what requests may ask."""

import pytest
from pyspark.sql import functions as F

from barlight.functions import candles as K
from barlight.operators import channels, postfilters
from barlight.plans import rules, screen
from tests.test_operators import make, values

RAW = ["symbol", "time", "open", "high", "low", "close", "volume"]


@pytest.fixture(scope="module")
def universe(spark):
    rows = [(s, k, s.lower(), "x", "tech" if k else "food", "ok", 100.0 * k) for k, s in enumerate("ABC")]
    return spark.createDataFrame(rows, "symbol string, ordinal long, name string, exchange string, sector string, status string, shares_outstanding double")


@pytest.fixture(scope="module")
def bars(spark):
    """A rises, B falls, C has no bars."""
    return make(spark, range(100, 220)).unionByName(make(spark, range(300, 180, -1), "B")).select(*RAW)


def answers(universe, bars, request):
    return {r.symbol: r for r in screen.explained(universe, bars, request).collect()}


def test_groups_and_reasons(universe, bars):
    rules_ = {"up": {"rule_of": "sma"}, "down": {"rule_of": "sma", "rule": "below"}, "hot": {"rule_of": "rsi", "location": "overbought"}}
    r = answers(universe, bars, screen.Request(rules_))
    assert [r[s].reason for s in "ABC"] == ["excluded:down", "excluded:up", "excluded:no_data"] and r["A"].matched == ["up", "hot"]
    assert r["A"].evidence["hot"] == 100.0 and r["A"].evidence["up"] == pytest.approx(209.5)
    logic = ("any", [("all", ["up", "hot"]), ("not", ["up", "hot", "down"])])
    r = answers(universe, bars, screen.Request(rules_, logic=logic))
    assert [r[s].reason for s in "ABC"] == ["included", "excluded:rules", "excluded:no_data"]


def test_columns_symbols_and_scopes(universe, bars):
    r = answers(universe, bars, screen.Request({"float": {"low": 90.0, "high": 150.0}}, symbols=["A", "B"]))
    assert {s: x.reason for s, x in r.items()} == {"A": "excluded:float", "B": "included"}
    request = screen.Request({"sma": {"timeframe": "primary"}, "rsi": {"timeframe": "secondary"}, "aroon": {}})
    assert list(request.scoped("primary").rules) == ["sma", "aroon"] and list(request.scoped("secondary").rules) == ["rsi", "aroon"]


def test_windows_and_confirmations(spark, universe):
    closes = [100.0] * 30 + [150.0] + [100.0] * 3
    b = make(spark, closes).select(*RAW)
    passed = lambda **c: answers(universe, b, screen.Request({"sma": {"length": 5, **c}}))["A"].passed_sma
    assert [passed(window=w) for w in (1, 3, 4)] == [False, False, True]
    green = b.withColumn("open", F.when(F.col("time") == 86400 * 32, F.col("close") - 0.5).otherwise(F.col("close")))
    confirmed = lambda kind, w, frame: answers(universe, frame, screen.Request({"sma": {"length": 5, "window": 4, "confirmation": {"type": kind, "window": w, "patterns": ["hammer"]}}}))["A"].passed_sma
    assert confirmed("bullish", 2, green) and not confirmed("bullish", 1, green) and not confirmed("strong_bearish", 0, b)


def test_requests_are_checked():
    for bad in (
        {"rules": {"sma": {"window": 0}}}, {"rules": {"sma": {"confirmation": {"type": "odd"}}}}, {"rules": {}, "logic": ("any", ["sma"])}, {"rules": {"float": {}}, "asset": "crypto"}, {"asset": "bonds"},
        {"rules": {"confluence": {"sources": ("lrc",)}}}, {"rules": {"confluence": {"lookback": 5}}}, {"rules": {"confluence": {"tolerance": -1}}}, {"rules": {"dead_assets": {"kinds": ()}}},
    ):
        with pytest.raises(ValueError):
            screen.Request(**bad)
    with pytest.raises(ValueError, match="longer"):
        screen.gated(None, None, screen.Request(), None, screen.Request())
    with pytest.raises(ValueError, match="none of"):
        rules._chosen("nothing", {})


def test_post_filters_in_a_screen(universe, bars):
    r = answers(universe, bars, screen.Request({"dead_assets": {}, "channel_respect": {"least": 1, "tolerance": 1.0}, "trend": {}}))
    assert r["A"].passed_dead_assets and r["A"].passed_channel_respect and not r["A"].passed_trend and r["C"].reason == "excluded:no_data"


def test_zones_breaches_and_ticks(spark):
    b = make(spark, [10, 12, 15, 11, 12], spread=0.5)
    zone = lambda kind, side: values(b.withColumn("x", channels.zone_rule(F.lit(11.5), F.lit(13.0), kind, side)), "x")
    assert zone("entered", "up") == [False, True, False, True, True] and zone("breach", "up") == [False, False, True, False, False]
    assert zone("breach", "down") == [True, False, False, True, False] and zone("rejected", "up") == [False, False, False, True, False]
    b = b.withColumn("open", F.col("close") - 1)
    cut = lambda kind, way: values(b.withColumn("x", channels.breach(F.lit(11.5), kind, way)), "x")
    assert cut("body", "up") == [False, True, True, False, True] and cut("wick", "down") == [True, False, False, True, False]
    one = spark.range(1).select(channels.line_to_tick(F.lit(1.234), 0.01, "upper").alias("u"), channels.line_to_tick(F.lit(1.236), 0.01, "lower").alias("l"), channels.line_to_tick(F.lit(1.236), 0.01, "middle").alias("m"), channels.mintick(F.lit(0.5), F.lit(False)).alias("t"), channels.mintick(F.lit(5.0), F.lit(True)).alias("n"), channels.line_at(F.lit(1), F.lit(10.0), F.lit(3), F.lit(20.0), F.lit(4)).alias("y")).first()
    assert (one.u, one.l, one.m) == (pytest.approx(1.24), pytest.approx(1.23), pytest.approx(1.24)) and one.t == 0.0001 and one.n is None and one.y == 25.0


def test_liquidity(spark):
    b = make(spark, [10.0] * 6).withColumn("volume", F.when(F.col("i") == 6, 20.0).otherwise(10.0))
    assert values(b.withColumn("x", channels.liquidity_elevated()), "x") == [False] * 5 + [True]


def test_filled_filters(spark):
    b = make(spark, [1.0, 2.0, 4.0])
    got = {k: values(b.withColumn("x", channels.filled(F.col("close"), 3, k, F.lit(2.0))), "x") for k in ("sma", "lwma", "vwma", "alma", "ema")}
    assert got["sma"] == pytest.approx([1, 5 / 3, 7 / 3]) and got["lwma"] == pytest.approx([1, (3 * 2 + 2 * 1 + 2) / 6, (3 * 4 + 2 * 2 + 1) / 6]) and got["vwma"] == pytest.approx(got["sma"])
    assert got["alma"][0] == 1.0 and got["ema"] == pytest.approx([1, 1.5, 2.75])


PATTERNS = {  # by pattern: open, high, low, close of the bars, the last of which shows it
    "bullish_engulfing": [(10, 10.5, 8.5, 9), (8.9, 11, 8.8, 10.5)], "bearish_engulfing": [(9, 10.5, 8.5, 10), (10.1, 10.2, 8, 8.5)], "piercing_line": [(10, 10.2, 8.9, 9), (8.5, 9.8, 8.4, 9.7)], "dark_cloud_cover": [(9, 10.1, 8.9, 10), (10.5, 10.6, 9.2, 9.3)],
    "tweezer_bottom": [(10, 10, 8, 8.5), (8.5, 9.5, 8, 9.4)], "tweezer_top": [(9, 10, 8.5, 9.8), (9.8, 10, 9, 9.1)], "morning_star": [(12, 12, 9, 9.5), (9.4, 9.8, 9, 9.5), (9.6, 12, 9.5, 11.5)], "evening_star": [(9, 12, 9, 11.5), (11.6, 12, 11, 11.5), (11.4, 11.5, 9, 9.5)],
    "three_white_soldiers": [(1, 2.1, 1, 2), (2, 3.1, 2, 3), (3, 4.1, 3, 4)], "three_black_crows": [(4, 4, 2.9, 3), (3, 3, 1.9, 2), (2, 2, 0.9, 1)], "doji": [(10, 11, 9, 10.05)], "hammer": [(14, 14, 13, 13), (13, 13, 12, 12), (12, 12, 11, 11), (10.6, 10.85, 9, 10.8)],
    "shooting_star": [(8, 9, 8, 9), (9, 10, 9, 10), (10, 11, 10, 11), (11.2, 13, 10.98, 11)], "bullish_marubozu": [(10, 12, 10, 12)], "bearish_marubozu": [(12, 12, 10, 10)], "double_bottom": [(10, 11, 8, 9), (9, 12, 9, 11), (11, 11, 8, 9)], "double_top": [(10, 12, 9, 11), (11, 11, 8, 9), (9, 12, 9, 11)],
}


@pytest.mark.parametrize("name", sorted(PATTERNS))
def test_patterns_by_hand(spark, name):
    rows = [("A", 86400 * k, *map(float, bar), 1.0) for k, bar in enumerate(PATTERNS[name])]
    b = spark.createDataFrame(rows, "symbol string, time long, open double, high double, low double, close double, volume double")
    assert values(K.with_patterns(b), name)[-1] is True
