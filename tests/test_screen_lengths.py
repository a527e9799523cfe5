"""Screens read as many bars as their rules' configurations need."""

import pytest

from barlight.plans import screen
from tests.test_operators import make


@pytest.mark.parametrize("rules", [{"sma": {"length": 200}}, {"rsi": {"length": 100, "location": "overbought"}}, {"aroon": {"length": 100}}])
def test_long_lengths_have_their_bars(spark, rules):
    u = spark.createDataFrame([("A", 1, "a", "x", "s", "ok")], "symbol string, ordinal long, name string, exchange string, sector string, status string")
    bars = make(spark, range(1, 261)).select("symbol", "time", "open", "high", "low", "close", "volume")
    assert screen.explained(u, bars, screen.Request(rules=rules)).first().reason == "included"


def test_depth_follows_the_configuration():
    depth = lambda **rules: screen.Request(rules=rules).depth
    assert depth(sma={"length": 200, "window": 3, "confirmation": {"type": "bullish", "window": 2}}) == 204 and depth(float={}) == 1
    assert depth(sma={"length": 200}) == 200 and depth(rsi={"length": 60}) == 62 and depth(aroon={}) == 16
    assert depth(macd={}) == 200 and depth(macd={"slow": 80}) == 410 and depth(sma={"length": 900}) == 500
